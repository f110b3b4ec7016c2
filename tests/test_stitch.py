"""The matcher's truth table, and random URLs against a step-by-step matcher."""

import random

import pytest
from pyspark.sql import functions as F

from flowloom.functions import urls
from flowloom.operators import stitch

CALLER = "caller_id string, method string, url string, egress string, template_parts array<string>, span_count int, segment_count int, repository string"
ENDPOINT = "endpoint_id string, method string, route string, repository string, ord long"


def run(spark, callers, endpoints, rules=()):
    c = spark.createDataFrame([(str(i), *x, *[None] * (7 - len(x))) for i, x in enumerate(callers)], CALLER)
    e = spark.createDataFrame([(r, m, r, None, i) for i, (m, r) in enumerate(endpoints)], ENDPOINT)
    out = {}
    for r in stitch.match(c, e, list(rules)).collect():
        out.setdefault(int(r["caller_id"]), []).append((r["endpoint_id"], r["confidence"], r["matched_by"], r["rank"]))
    return {k: sorted(v, key=lambda x: -x[3]) for k, v in out.items()}


TABLE = [
    ("GET", "/api/users", "exact", "/api/users", ("high", "exact-url")),
    ("GET", "/", "exact", "/", ("high", "exact-url")),
    ("GET", "//", "exact", "/", ("high", "exact-url")),
    ("GET", "", "exact", "/api/users", None),
    ("GET", "/api/posts", "exact", "/api/users", None),
    ("GET", "/api/users/123", "exact", "/api/users/:id", ("high", "pattern")),
    ("GET", "/api/users/1/posts/2", "exact", "/api/users/:userId/posts/:postId", ("high", "pattern")),
    ("GET", "/api/users", "exact", "/api/users/:id", None),
    ("GET", "/api/users/123/extra", "exact", "/api/users/:id", None),
    ("GET", "songs//report", "exact", "/songs/:id/report", None),
    ("GET", "songs//report", "exact", "/songs/:id?/report", None),
    ("GET", "orgs/acme//profile", "exact", "/orgs/:org/:id/profile", None),
    ("GET", "/api/users/", "pattern", "/api/users/:id", ("medium", "pattern")),
    ("GET", "/api/users/", "pattern", "/api/users/:id?", ("medium", "pattern")),
    ("GET", "/api/users/", "pattern", "/api/users", None),
    (None, "/api/users", "exact", "/api/users", ("high", "exact-url")),
    ("POST", "/api/users", "exact", "/api/users", None),
    ("GET", None, "exact", "/api/users", None),
    ("GET", "/api/users", "dynamic", "/api/users", None),
    ("GET", "/songs/42/active?expand=ratings", "exact", "/songs/:id/active", ("high", "pattern")),
    ("GET", "/files/a/b/c", "exact", "/files/*", ("high", "pattern")),
    ("GET", "/api/users", "exact", "/api/users/:id?", ("high", "exact-url")),
    ("GET", ":p0/api/tasks", "exact", "/api/tasks", ("high", "exact-url")),
]


def test_truth_table(spark):
    callers = [(m, u, g) for m, u, g, _, _ in TABLE]
    routes = sorted({r for *_, r, _ in TABLE})
    got = run(spark, callers, [("GET", r) for r in routes])
    for i, (_, u, _, route, want) in enumerate(TABLE):
        hit = [x for x in got.get(i, []) if x[0] == route]
        assert ([x[1:3] for x in hit] or [None])[0] == want, (u, route)


def test_both_routes_and_proxy_rules(spark):
    got = run(spark, [("GET", "/api/users/me", "exact")], [("GET", "/api/users/:id"), ("GET", "/api/users/me")])
    assert [x[0] for x in got[0]] == ["/api/users/me", "/api/users/:id"]
    calls = [("GET", "/api/users", "exact"), ("GET", "/apidocs", "exact"), ("GET", "https://api.github.com/repos", "exact"), ("GET", "/api", "exact")]
    ends = [("GET", "/users"), ("GET", "/docs"), ("GET", "/repos"), ("GET", "/")]
    got = run(spark, calls, ends, [("/api", True)])
    assert {k: v[0][0] for k, v in got.items()} == {0: "/users", 3: "/"}
    assert run(spark, calls[:1], ends, [("/api", False)]) == {}


def test_template_parts(spark):
    got = run(spark, [("GET", "/projects/", "pattern", ["/projects/", "/diagrams"]), ("GET", "/a/", "pattern", None, 1), ("GET", "/a/", "pattern", None, None, 3)], [("GET", "/projects/:id/diagrams"), ("GET", "/a/:x"), ("GET", "/a/:x/:y")])
    assert got[0] == [("/projects/:id/diagrams", "high", "pattern", 4)]
    assert got[1][0][:2] == ("/a/:x", "high") and got[2][0][:2] == ("/a/:x/:y", "high")


def step_by_step(url, route, egress):
    """A walk along both sides, one segment at a time."""
    path = url.split("?")[0].lstrip("/")
    trailing, body = path.endswith("/"), path.rstrip("/")
    c = body.split("/") if body else []
    r = route.strip("/")
    p = r.split("/") if r else []
    i = j = 0
    param = splat = skipped = False
    while j < len(p):
        if p[j] == "*":
            splat, i, j = True, len(c), j + 1
            break
        optional = p[j].startswith(":") and p[j].endswith("?")
        if i >= len(c):
            if optional:
                skipped, j = True, j + 1
                continue
            if trailing:
                break
            return None
        if p[j].startswith(":"):
            if not c[i]:
                return None
            param = True
        elif p[j] != c[i]:
            return None
        i, j = i + 1, j + 1
    if egress == "exact" and not trailing:
        if i < len(c) or any(not (x.startswith(":") and x.endswith("?")) for x in p[j:]):
            return None
        return 4 if param or splat else 5
    if trailing:
        return None if j >= len(p) and i >= len(c) and not splat and not skipped else 2
    return 2 if j >= len(p) and i >= len(c) else None


def test_random_urls(spark):
    rng = random.Random(1)
    seg = ["a", "b", "c", ""]
    routes = sorted({"/" + "/".join(rng.choice(["a", "b", ":x", ":y?", "*"]) for _ in range(rng.randint(0, 4))) for _ in range(60)})
    calls = [("GET", "/".join([""] * rng.randint(0, 1) + [rng.choice(seg) for _ in range(rng.randint(0, 4))]) + rng.choice(["", "/", "?q=1"]), rng.choice(["exact", "pattern"])) for _ in range(150)]
    got = run(spark, calls, [("GET", r) for r in routes])
    for i, (_, u, g) in enumerate(calls):
        want = {r: k for r in routes if (k := step_by_step(u, r, g)) is not None}
        assert {x[0]: x[3] for x in got.get(i, [])} == want, u


@pytest.mark.parametrize("url,want", [("https://x.example.com/a", "x.example.com"), ("http://localhost:3000", None), ("http://user-service:80/a", None), ("http://172.99.0.1/", None), ("/a", None), ("http://a.local/", None)])
def test_external(spark, url, want):
    assert spark.range(1).select(urls.external_host(F.lit(url))).first()[0] == want


def test_rules_and_prefix_mining(spark):
    c = spark.createDataFrame([(str(i), "GET", u, "web") for i, u in enumerate(["/api/v1/users/1", "/api/v1/users/2", "/api/v1/songs/9", "/other/x"])], "caller_id string, method string, url string, repository string")
    e = spark.createDataFrame([("e1", "GET", "/users/{id}", "api", 1), ("e2", "ALL", "/songs/:id", "api", 2)], ENDPOINT)
    mined = stitch.mine_prefixes(c, e).collect()
    assert [(r["prefix"], r["fixes"]) for r in mined] == [("/api/v1", 3)]
    hit = stitch.apply_rules(c, e, [{"name": "r", "from": "web", "to": "api", "strip": "/api/v1"}], c.limit(0).select("caller_id")).collect()
    assert sorted((r["caller_id"], r["endpoint_id"]) for r in hit) == [("0", "e1"), ("1", "e1"), ("2", "e2")]
