from flowloom.sources import ui


def test_ui_tables(spark):
    rows = [
        ("r", "src/App.tsx", "ts", "<Route path='/users' element={<Users/>} />\n<Link to='/users'>x</Link>\n<button onClick={save}>\nuseEffect(() => { load() }, [])\nnew GetObjectCommand({ Bucket: 'b', Key: 'k' })\n"),
        ("r", "pages/blog/[id].tsx", "ts", "export default function Post() {}\nrouter.push('/done')"),
        ("r", "pages/index.tsx", "ts", "export default function Home() {}"),
        ("r", "a.py", "py", "@cli.command()\ndef sync():\n  s3.put_object(Bucket='x', Key='y')\nif __name__ == '__main__':\n  sync()"),
        ("r", "a.go", "go", "func (s *userServer) GetUser(ctx context.Context) {}"),
    ]
    f = spark.createDataFrame(rows, "repository string, path string, language string, content string").cache()
    assert {(r["kind"], r["name"], r["function"]) for r in ui.processes(f).collect()} == {("event_handler", "onClick", "save"), ("lifecycle_hook", "useEffect", "load"), ("cli_command", "sync", "sync"), ("script_entry", "__name__", None)}
    assert {(r["route"], r["component"]) for r in ui.screens(f).collect()} == {("/users", "Users"), ("/blog/:id", "Post"), ("/", "Home")}
    assert {(r["target"], r["method"]) for r in ui.navigations(f).collect()} == {("/users", "link"), ("/done", "push")}
    assert {r["url"] for r in ui.remote_objects(f).collect()} == {"s3://b/k", "s3://x/y"}
    assert {(r["method"], r["route"]) for r in ui.procedures(f).collect()} == {("GRPC", "grpc:user/GetUser")}
