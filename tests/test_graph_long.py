"""Paths longer than any number of rounds."""

import pytest

from plexar.operators import cypher, graph_algo
from plexar.operators.graph import Graph


def test_shortest_paths_reach_the_end_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(54)], "src string, dst string")
    cost = {r["node"]: r["cost"] for r in graph_algo.shortest_paths(links, "n0").collect()}
    assert cost == {f"n{k}": float(k) for k in range(55)}
    with pytest.raises(RuntimeError):
        graph_algo.shortest_paths(links, "n0", max_rounds=2)


def test_paths_without_a_bound(spark):
    g = Graph(spark)
    g.add_nodes("stop", spark.createDataFrame([(k, f"s{k}") for k in range(9)], "_id long, name string"))
    for k in range(8):
        g.add_edge(("stop", k), "line", ("stop", k + 1))
    ends = lambda text: sorted(r[0] for r in cypher.run(g, text).collect())
    assert ends("MATCH (a:stop)-[*]->(b:stop) WHERE a.name = 's0' RETURN b.name") == [f"s{k}" for k in range(1, 9)]
    assert ends("MATCH (a:stop)-[:line*7..]->(b:stop) RETURN b.name") == ["s7", "s8", "s8"]
    assert ends("MATCH (a:stop)-[*9..]->(b:stop) RETURN b.name") == []
    assert ends("MATCH (a:stop)<-[*2]-(b:stop) WHERE a.name = 's4' RETURN b.name") == ["s2"]
    with pytest.raises(ValueError):
        cypher.parse("MATCH (a:stop)-[*3..2]->(b:stop) RETURN b")


def test_paths_take_no_edge_twice(spark):
    g = Graph(spark)
    g.add_nodes("stop", spark.createDataFrame([(k,) for k in range(3)], "_id long"))
    for a, b in ((0, 1), (1, 0), (1, 2)):
        g.add_edge(("stop", a), "line", ("stop", b))
    paths = cypher.run(g, "MATCH (a:stop)-[*]->(b:stop) RETURN a._id AS a, b._id AS b").collect()
    assert sorted(tuple(r) for r in paths) == sorted(_plain([(0, 1), (1, 0), (1, 2)]))


def _plain(edges):
    """(first, last) of every path that takes no edge twice."""
    out, now = [], [[k] for k in range(len(edges))]
    while now:
        out += [(edges[p[0]][0], edges[p[-1]][1]) for p in now]
        now = [[*p, k] for p in now for k, e in enumerate(edges) if k not in p and e[0] == edges[p[-1]][1]]
    return out
