from semloom.operators import graph


def test_levels_beyond_64(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(66)] + [(100, 101), (101, 100)], "source int, target int")
    nodes = spark.createDataFrame([(i,) for i in (*range(67), 100, 101)], "node int")
    got = {r["node"]: r["level"] for r in graph.topological_levels(edges, nodes).collect()}
    assert got == {i: i for i in range(67)} | {100: None, 101: None}
