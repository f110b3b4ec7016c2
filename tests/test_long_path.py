from flowloom.operators import walk


def test_path_of_more_than_32_steps(spark):
    calls = spark.createDataFrame([(i, i + 1) for i in range(36)] + [(36, 0), (0, 1)], "src long, dst long").coalesce(1)
    roots = spark.createDataFrame([("r", 0)], "root string, node long")
    found = {r["node"]: r for r in walk.shortest_paths(roots, calls).collect()}
    assert {n: r["depth"] for n, r in found.items()} == {n: n for n in range(37)}
    assert found[36]["path"] == list(range(37))
    assert len(walk.shortest_paths(roots, calls, 2).collect()) == 3
