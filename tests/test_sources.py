import pytest
from pyspark.sql import functions as F

from flowloom.functions import strings
from flowloom.sources import extract, files, html, records
from flowloom.streaming import watch


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    put = {
        "src/server.ts": "import express\napp.get('/api/users', auth, list)\nrouter.post(`/api/users/:id`, h)\nconst p = process.env.PORT ?? 3000\nawait prisma.user.findMany()\nqueue = new Worker('mail', f)\n",
        "src/page.tsx": "fetch('/api/users')\naxios.post(`/api/users/${id}/x`, b)\naxios.get('https://x.example.org/a')\nnew Queue('mail')\n",
        "api/app.py": "@app.get('/items/<int:id>')\ndef f(): return db['items'].find_one()\nrequests.get('http://localhost/a')\nos.getenv('JWT_KEY')\ncur.execute(\"INSERT INTO logs VALUES (1)\")\n",
        "main.go": 'r.GET("/go/:id", h)\n',
        "node_modules/x.ts": "app.get('/no')", "src/a.test.ts": "app.get('/no')", "src/lib.min.js": "x", ".git/y.ts": "z", "readme.md": "x",
    }
    for path, text in put.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return files.discover(spark, f"file://{root}", "r", str(root)).cache()


def test_discovery(tree):
    assert {r["path"]: r["language"] for r in tree.collect()} == {"src/server.ts": "ts", "src/page.tsx": "ts", "api/app.py": "py", "main.go": "go"}


def test_extractors(tree):
    got = {(r["framework"], r["method"], r["route"], r["line"]) for r in extract.endpoints(tree).collect()}
    assert got == {("express", "GET", "/api/users", 2), ("express", "POST", "/api/users/:id", 3), ("bullmq", "JOB", "bullmq:mail", 6), ("flask", "GET", "/items/:id", 1), ("gin", "GET", "/go/:id", 1)}
    got = {(r["method"], r["url"], r["egress"], r["external_host"]) for r in extract.callers(tree).collect()}
    assert got == {("GET", "/api/users", "exact", None), ("POST", "/api/users/:p0/x", "pattern", None), ("GET", "https://x.example.org/a", "exact", "x.example.org"), ("JOB", "bullmq:mail", "exact", None), ("GET", "http://localhost/a", "exact", None)}
    got = {(r["orm"], r["table"], r["operation"]) for r in extract.interactions(tree).collect()}
    assert got == {("prisma", "user", "read"), ("pymongo", "items", "read"), ("sql", "logs", "insert")}
    assert {(r["name"], r["category"]) for r in extract.env_vars(tree).collect()} == {("PORT", "config"), ("JWT_KEY", "auth")}


def test_prefix_and_manifests(spark, tree):
    e = extract.endpoints(tree).where("framework = 'gin'")
    p = spark.createDataFrame([("r", "main.go", "/v1/")], "repository string, path string, prefix string")
    assert {r["route"] for r in extract.compose_prefix(e, p).collect()} == {"/go/:id", "/v1/go/:id"}
    m = spark.createDataFrame([("r", "package.json", '{"dependencies": {"express": "4"}, "devDependencies": {"jest": "1"}}'), ("r", "requirements.txt", "flask==2\n# x\nrequests"), ("r", "go.mod", "module a\nrequire github.com/gin-gonic/gin v1.9\n")], "repository string, path string, content string")
    assert {r["name"] for r in files.dependencies(m).collect()} == {"express", "jest", "flask", "requests", "github.com/gin-gonic/gin"}


def test_html(spark):
    page = "<a href='/about?x=1'>a</a><a href=\"mailto:x\">m</a><!-- <a href='/no'> --><form method=post action='/login'></form><form></form><button onclick=\"save(); if (x) go(1)\">"
    p = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert {(r["href"], r["path"]) for r in html.links(p).collect()} == {("/about?x=1", "/about/"), ("mailto:x", None)}
    assert [(r["method"], r["url"]) for r in html.forms(p).orderBy("ord").collect()] == [("POST", "/login"), ("GET", "")]
    assert {(r["event"], r["function"]) for r in html.handlers(p).collect()} == {("onclick", "save"), ("onclick", "go")}
    routes = spark.createDataFrame([("pages/index.html",), ("src/pages/blog/a.md",)], "p string").select(html.ssg_route(F.col("p")).alias("r"))
    assert [r["r"] for r in routes.collect()] == ["/", "/blog/a/"]


def test_records(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"kind":"fetch","callSite":{"filePath":"a.ts","line":9,"column":1},"method":"get","url":"/x"}\n{"kind":"fetch","callSite":{"filePath":"a.ts","line":9,"column":5},"method":"get","url":"/x"}\n{"kind":"hook","callSite":{"filePath":"a.ts","line":9}}\n{"kind":"axios","callSite":{"filePath":"zz.ts","line":1},"url":"/y"}\nnot json\n')
    t = records.read_trace(spark, str(tmp_path / "t.jsonl")).cache()
    assert t.where("_corrupt IS NOT NULL").count() == 1
    f = spark.createDataFrame([("F", "a.ts")], "file_id string, path string")
    fn = spark.createDataFrame([("f1", "F", 1), ("f2", "F", 8), ("f3", "F", 20)], "function_id string, file_id string, line int")
    assert [(r["function_id"], r["method"], r["egress"]) for r in records.merge_trace(t, f, fn).collect()] == [("f2", "GET", "pattern")]
    s = "model User {\n  id Int @id\n  email String\n  name String?\n  posts Post[]\n}\nmodel Post {\n  id Int @id\n  // no\n  userId Int?\n  user User? @relation(fields: [userId], references: [id])\n}\n"
    m = {(r["model"], r["column"]): r for r in records.prisma_models(spark.createDataFrame([("r", "schema.prisma", s)], "repository string, path string, content string")).collect()}
    assert set(m) == {("User", "id"), ("User", "email"), ("User", "name"), ("Post", "id"), ("Post", "userId")}
    assert m["User", "id"]["is_primary"] and m["User", "name"]["nullable"] and m["Post", "userId"]["references"] == "User.id"
    r = records.redirects(spark.createDataFrame([("r", "vercel.json", '{"redirects": [{"source": "/a", "destination": "/b", "permanent": true}]}')], "repository string, path string, content string"))
    assert [(x["source"], x["destination"], x["status"]) for x in r.collect()] == [("/a", "/b", 308)]


def test_stream(spark, tmp_path):
    repos = spark.createDataFrame([("web", "/w"), ("sub", "/w/sub")], "repository string, root string")
    e = spark.createDataFrame([("/w/sub/a.ts",), ("/w/b.ts",), ("/wx/c.ts",)], "path string")
    assert {(r["path"], r["repository"]) for r in watch.route(e, repos).collect()} == {("/w/sub/a.ts", "sub"), ("/w/b.ts", "web")}
    spark.createDataFrame([("web",), ("web",), ("api",)], "repository string").write.parquet(str(tmp_path / "in"))
    seen = []
    changes = spark.readStream.schema("repository string").parquet(str(tmp_path / "in"))
    watch.refresh_stream(changes, lambda dirty: seen.extend(r[0] for r in dirty.collect()), str(tmp_path / "c"), None).awaitTermination()
    assert sorted(seen) == ["api", "web"]

    def fails(_):
        raise RuntimeError

    watch.refresh_stream(changes, fails, str(tmp_path / "d"), None).awaitTermination()  # a failing cycle doesn't end it


def test_every_match_has_its_own_line(spark):
    files = spark.createDataFrame([("r", "a.ts", "ts", "fetch('/api/users')\nconst x = 1\nfetch('/api/users')\n")], "repository string, path string, language string, content string")
    assert sorted(r["line"] for r in extract.callers(files).collect() if r["framework"] == "fetch") == [1, 3]


def test_chained_verbs_are_an_endpoint_each(spark):
    code = 'let app = Router::new()\n  .route("/x", post(make))\n  .route("/y/:id", get(show).post(change))\n  .route("/z", axum::routing::delete(drop_it));'
    files = spark.createDataFrame([("r", "a.rs", "rust", code)], "repository string, path string, language string, content string")
    got = {(r["line"], r["method"], r["route"]) for r in extract.endpoints(files).collect() if r["framework"] == "axum"}
    assert got == {(2, "POST", "/x"), (3, "GET", "/y/:id"), (3, "POST", "/y/:id"), (4, "DELETE", "/z")}


def test_statements_and_bundles(spark):
    rows = [("INSERT INTO a.b.logs SELECT * FROM events", ("logs", "insert")), ("select 1 from db.schema.t", ("t", "read")), ('update "x" set a = 1', ("x", "update"))]
    got = spark.createDataFrame([(s,) for s, _ in rows], "sql string").select(strings.sql_table_op(F.col("sql")).alias("x")).collect()
    assert [tuple(r["x"]) for r in got] == [want for _, want in rows]
    big = [("lib/a-Vendor.mjs", 1, "", True), ("x/jquery.js", 51200, "a\n", True), ("x/jquery-3.js", 51200, "a\n", False), ("x/jquery.js", 51199, "a\n", False), ("x/b.bundle.js", 10, "a", False), ("x/b.js", 102400, "a" * 300, True), ("x/b.ts", 999999, "a" * 300, False)]
    got = spark.createDataFrame([x[:3] for x in big], "p string, n int, t string").select(strings.looks_vendored(F.col("p"), F.col("n"), F.col("t")).alias("v")).collect()
    assert [r["v"] for r in got] == [x[3] for x in big]
