"""Back edges of many graphs: graphs follow each other in a task, without a call of pandas for each."""

from weft.operators import layout


def test_back_edges_of_many_graphs(spark):
    nodes = spark.createDataFrame([(g, i, i) for g in range(30) for i in range(4)] + [(None, 0, 0)], "g int, id int, pos int")
    arcs = spark.createDataFrame([(g, i, (i + 1) % 4, i) for g in range(30) for i in range(3 + g % 2)], "g int, src int, dst int, pos int")
    found = layout.back_edges(nodes, arcs, "g")
    assert sorted(map(tuple, found.collect())) == [(g, 3, 0) for g in range(1, 30, 2)]
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
