import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plexar.operators import acl, cypher, graph_algo, triples
from plexar.operators.graph import Graph


@pytest.fixture
def graph(spark):
    g = Graph(spark)
    places = [(7, "harbour", [4.0, 1.0]), (8, "mill", [4.0, 9.0]), (9, "chapel", None)]
    g.add_nodes("place", spark.createDataFrame(places, "_id long, kind string, at array<float>"))
    roads = [((7, 8), "road", {}), ((8, 9), "ferry", {"fare": "3"}), ((7, 9), "road", {})]
    for n, ((a, b), how, props) in enumerate(roads):
        assert g.add_edge(("place", a), how, ("place", b), props) == n
    return g


def test_store(graph, tmp_path):
    assert [r["dst_id"] for r in graph.neighbors("place", 7).collect()] == [8, 9]
    assert [r["src_id"] for r in graph.incoming("place", 9, "ferry").collect()] == [8]
    graph.dump(str(tmp_path / "g"))
    graph.restore(str(tmp_path / "g"))
    assert graph.add_edge(("place", 9), "path", ("place", 7)) == 3


def test_cypher(graph):
    road = "MATCH (x:place)-[:road]->(y:place)"
    by_place = cypher.run(graph, f"{road} RETURN y.kind ORDER BY distance(y.at,[4,3])").collect()
    assert [r[0] for r in by_place] == ["mill", "chapel"] and by_place[1]["distance"] is None  # a missing vector comes last
    assert by_place[0]["distance"] == pytest.approx(6)
    near = cypher.run(graph, f"{road} WHERE x.kind='harbour' RETURN x,y ORDER BY distance(y.at,[1,9],'l2') LIMIT 1").first()
    assert (near["x"]["kind"], near["y"]["kind"], near["distance"]) == ("harbour", "mill", pytest.approx(3))
    two = cypher.run(graph, "MATCH (x:place)-[*2..2]->(y:place) RETURN x.kind AS s, y.kind AS t").collect()
    assert [tuple(r) for r in two] == [("harbour", "chapel")]
    assert cypher.run(graph, "MATCH (x:place)-[r:ferry]->(y:place) WHERE r.fare = '3' RETURN x").count() == 1
    assert cypher.run(graph, "MATCH (x:place)-[:road]->(y:place)-[:ferry]->(z:place) RETURN z.kind AS t").first()["t"] == "chapel"
    for bad in ("MATCH (x:place) WHERE w.x = 1", "MATCH (x)-[:road]->(y:place) RETURN x", "MATCH (x:nope) RETURN x", "FIND (x:place)", "MATCH (x:place) RETURN x LIMIT 2 extra"):
        with pytest.raises(ValueError):
            cypher.run(graph, bad)


@settings(max_examples=50, deadline=None)
@given(st.integers(-5, 5), st.text("abc' ", max_size=5), st.integers(0, 9))
def test_parser_round_trip(n, s, k):
    lit = s.replace("'", "\\'")
    q = cypher.parse(f"MATCH (a:T)<-[:R*1..3]-(b:U) WHERE a.order = {n} AND b.or = '{lit}' RETURN b.return AS r ORDER BY a.x DESC LIMIT {k}")
    assert q.filters == [("a", "order", "=", n), ("b", "or", "=", s)] and q.limit == k and not q.rels[0].forward and q.rels[0].high == 3


def test_algorithms(spark):
    links = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0), ("c", "d", 1.0), ("x", "y", 1.0)], "src string, dst string, w double")
    depth = {r["node"]: r["depth"] for r in graph_algo.bfs(links, spark.createDataFrame([("a",)], "node string")).collect()}
    assert depth == {"a": 0, "b": 1, "c": 1, "d": 2}
    cost = {r["node"]: (r["cost"], r["previous"]) for r in graph_algo.shortest_paths(links, "a", weight="w").collect()}
    assert cost == {"a": (0, None), "b": (1, "a"), "c": (2, "b"), "d": (3, "c")}
    comp = {r["node"]: r["component"] for r in graph_algo.connected(links).collect()}
    assert comp == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    rank = {r["node"]: r["rank"] for r in graph_algo.pagerank(links, 20).collect()}
    assert sum(rank.values()) == pytest.approx(6) and rank["d"] > rank["a"]


def test_triples(spark):
    t = spark.createDataFrame([("x", "knows", "y"), ("y", "knows", "z"), ("z", "name", "Zed"), ("q", "likes", "q")], "s string, p string, o string")
    assert [tuple(r) for r in triples.match(t, [("?a", "knows", "?b"), ("?b", "knows", "?c"), ("?c", "name", "?n")]).select("a", "n").collect()] == [("x", "Zed")]
    assert triples.match(t, [("?a", "likes", "?a")]).count() == 1
    assert triples.select(t, 'SELECT ?a WHERE { ?a <name> "Zed" } LIMIT 5').first()["a"] == "z"
    with pytest.raises(ValueError):
        triples.select(t, "ASK { ?a ?b ?c }")


def test_acl(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "_id long")
    grants = spark.createDataFrame([("t", 1, "user", "u", "read"), ("t", 2, "role", "r", "admin"), ("t", None, "user", "boss", "write"), ("t", None, "user", "root", "admin")], "table string, row_id long, subject_kind string, subject string, perm string")
    roles = spark.createDataFrame([("u", "r")], "user string, role string")
    ids = lambda table, user, perm="read": sorted(r[0] for r in acl.readable(df, table, grants, roles, user, perm).collect())
    assert ids("t", "u") == [1, 2] and ids("t", "nobody") == [] and ids("open", "nobody") == [0, 1, 2, 3, 4]
    assert ids("t", "boss") == [] and ids("t", "boss", "write") == [0, 1, 2, 3, 4] and ids("t", "root") == [0, 1, 2, 3, 4]
    assert acl.verb_bit("select 1") == acl.READ and acl.verb_bit(" DELETE FROM x") == acl.DELETE
    with pytest.raises(ValueError):
        acl.verb_bit("GRANT x")
    assert acl.masked(df, ["_id"], False).first()[0] is None


def test_paths_need_every_place(graph, spark):
    """A path of two hops is hidden from a user who may not read the place in the middle."""
    roles = spark.createDataFrame([], "user string, role string")
    path = "MATCH (x:place)-[*2..2]->(y:place) RETURN x.kind AS s"
    for readable, n in (((7, 9), 0), ((7, 8, 9), 1)):
        grants = spark.createDataFrame([("place", k, "user", "ann", "read") for k in readable], "table string, row_id long, subject_kind string, subject string, perm string")
        assert cypher.run(graph, path, "ann", grants, roles).count() == n
