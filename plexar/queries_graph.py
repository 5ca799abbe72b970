"""Graph queries over customers, orders, parts, suppliers, nations and regions; grants."""

from __future__ import annotations

from pyspark.sql import functions as F

from plexar.operators import acl, cypher, graph_algo, triples
from plexar.operators.graph import Graph, edges_from, links
from plexar.registry import query

_KEYS = {"customer": "c_custkey", "orders": "o_orderkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey", "part": "p_partkey", "embeddings": "vec_id"}


def _graph(t) -> Graph:
    g = Graph(t.spark)
    for label, key in _KEYS.items():
        g.add_nodes(label, t(label), key)
    g.edges = (
        edges_from(t("orders"), "customer", "o_custkey", "PLACED", "orders", "o_orderkey", {"status": F.col("o_orderstatus")})
        .unionByName(edges_from(t("customer"), "customer", "c_custkey", "IN_NATION", "nation", "c_nationkey"))
        .unionByName(edges_from(t("supplier"), "supplier", "s_suppkey", "IN_NATION", "nation", "s_nationkey"))
        .unionByName(edges_from(t("nation"), "nation", "n_nationkey", "IN_REGION", "region", "n_regionkey"))
        .unionByName(edges_from(t("embeddings").withColumn("n", F.col("vec_id") % 25), "nation", "n", "SIMILAR", "embeddings", "vec_id")))
    return g


@query("SELECT o_custkey AS src_id, o_orderkey AS dst_id FROM orders WHERE o_custkey = 7")
def graph_neighbors(t):
    return _graph(t).neighbors("customer", 7, "PLACED").select("src_id", "dst_id")


@query("SELECT s_suppkey AS src_id, 'supplier' AS src_table FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_nationkey = 3")
def graph_incoming(t):
    return _graph(t).incoming("nation", 3, "IN_NATION").select("src_id", "src_table")


@query("""SELECT 'PLACED' AS rel_type, count(*) AS n FROM orders UNION ALL SELECT 'IN_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)
UNION ALL SELECT 'IN_REGION', count(*) FROM nation UNION ALL SELECT 'SIMILAR', count(*) FROM embeddings""")
def graph_edge_counts(t):
    return _graph(t).edges.groupBy("rel_type").agg(F.count("*").alias("n"))


@query("SELECT c_name AS name, o_orderkey AS k FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 150000")
def cypher_hop(t):
    return cypher.run(_graph(t), "MATCH (c:customer)-[:PLACED]->(o:orders) WHERE c.c_mktsegment = 'BUILDING' AND o.o_totalprice > 150000 RETURN c.c_name AS name, o.o_orderkey AS k")


@query("SELECT n_name AS nation, c_custkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name <> 'x' AND c_acctbal > 0")
def cypher_reverse(t):
    return cypher.run(_graph(t), "MATCH (n:nation)<-[IN_NATION]-(c:customer) WHERE n.n_name <> 'x' AND c.c_acctbal > 0 RETURN n.n_name AS nation, c.c_custkey AS k")


@query("""SELECT r_name AS region, o_orderkey AS k FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 200000""")
def cypher_multi_hop(t):
    q = "MATCH (r:region)<-[:IN_REGION]-(n:nation)<-[:IN_NATION]-(c:customer)-[:PLACED]->(o:orders) WHERE o.o_totalprice > 200000 RETURN r.r_name AS region, o.o_orderkey AS k"
    return cypher.run(_graph(t), q)


@query("SELECT c_custkey AS c, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def cypher_variable_length(t):
    return cypher.run(_graph(t), "MATCH (c:customer)-[*1..3]->(r:region) RETURN c.c_custkey AS c, r.r_name AS r")


@query("SELECT DISTINCT n_name AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey ORDER BY n LIMIT 12")
def cypher_distinct(t):
    return cypher.run(_graph(t), "MATCH (s:supplier)-[:IN_NATION]->(n:nation) RETURN DISTINCT n.n_name AS n ORDER BY n.n_name LIMIT 12")


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def cypher_edge_property(t):
    return cypher.run(_graph(t), "MATCH (c:customer)-[p:PLACED]->(o:orders) WHERE p.status = 'F' RETURN o.o_orderkey AS k").agg(F.count("*").alias("n"))


@query("SELECT r_regionkey AS k, r_name AS name FROM region WHERE r_regionkey >= 1 ORDER BY r_name DESC LIMIT 3")
def cypher_node_only(t):
    return cypher.run(_graph(t), "MATCH (r:region) WHERE r.r_regionkey >= 1 RETURN r.r_regionkey AS k, r.r_name AS name ORDER BY r.r_name DESC LIMIT 3")


@query("""WITH q AS (SELECT list_transform(range(64), lambda i: 0.1::DOUBLE) AS q)
SELECT n_name AS nation, vec_id AS k, round(list_distance(embedding::DOUBLE[], q), 6) AS distance FROM nation JOIN embeddings ON vec_id % 25 = n_nationkey, q
WHERE n_regionkey = 2 ORDER BY list_distance(embedding::DOUBLE[], q), n_nationkey, vec_id LIMIT 8""")
def cypher_nearest(t):
    q = ", ".join(["0.1"] * 64)
    out = cypher.run(_graph(t), f"MATCH (n:nation)-[:SIMILAR]->(e:embeddings) WHERE n.n_regionkey = 2 RETURN n.n_name AS nation, e.vec_id AS k ORDER BY distance(e.embedding, [{q}], 'l2') LIMIT 8")
    return out.withColumn("distance", F.round("distance", 6))


@query("""WITH e AS (SELECT 'customer/' || o_custkey AS s, 'orders/' || o_orderkey AS d FROM orders UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer
UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation)
SELECT node, min(depth)::INT AS depth FROM (SELECT 'customer/1' AS node, 0 AS depth UNION ALL SELECT d, 1 FROM e WHERE s = 'customer/1'
UNION ALL SELECT b.d, 2 FROM e a JOIN e b ON a.d = b.s WHERE a.s = 'customer/1') GROUP BY node""")
def graph_bfs(t):
    edges = _graph(t).edges.where("rel_type <> 'SIMILAR' AND src_table <> 'supplier'")
    return graph_algo.bfs(links(edges), t.spark.createDataFrame([("customer/1",)], "node string"), 5)


@query("""SELECT 'region/' || r_regionkey AS node, min(2 + n_nationkey)::DOUBLE AS cost FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE c_custkey = 1 GROUP BY ALL""")
def graph_shortest_path(t):
    e = _graph(t).edges.where("rel_type IN ('IN_NATION', 'IN_REGION')")
    weighted = links(e).withColumn("w", F.when(F.col("src").startswith("nation/"), F.substring_index("src", "/", -1).cast("double") + 1).otherwise(1.0))
    return graph_algo.shortest_paths(weighted, "customer/1", weight="w").where("node LIKE 'region/%'").select("node", "cost")


def _rank_sql(rounds: int) -> str:
    """PageRank unrolled: each round is a table of (node, degree, rank)."""
    edges = """SELECT 'nation/' || n_nationkey AS s, 'region/' || n_regionkey AS d FROM nation UNION SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey FROM supplier"""
    nodes = "SELECT node, (SELECT count(*) FROM e WHERE s = node) AS degree, 1.0::DOUBLE AS rank FROM (SELECT s AS node FROM e UNION SELECT d FROM e)"
    steps = "".join(
        f""", r{k + 1} AS (SELECT node, degree, 0.15 + 0.85 * (coalesce(got, 0) + (SELECT coalesce(sum(rank) FILTER (WHERE degree = 0), 0) / count(*) FROM r{k})) AS rank
FROM r{k} LEFT JOIN (SELECT d, sum(rank / degree) AS got FROM e JOIN r{k} ON s = node GROUP BY d) ON d = node)"""
        for k in range(rounds))
    return f"WITH e AS ({edges}), r0 AS ({nodes}){steps} SELECT node, round(rank, 6) AS rank FROM r{rounds}"


@query(_rank_sql(5))
def graph_pagerank(t):
    e = _graph(t).edges.where("rel_type = 'IN_REGION' OR (rel_type = 'IN_NATION' AND src_table = 'supplier')")
    return graph_algo.pagerank(links(e), 5).withColumn("rank", F.round("rank", 6))


@query("""SELECT 'nation/' || n_nationkey AS node, (SELECT min(x) FROM (SELECT 'nation/' || m.n_nationkey AS x FROM nation m WHERE m.n_regionkey = nation.n_regionkey)) AS component FROM nation
UNION ALL SELECT 'region/' || r_regionkey, (SELECT min('nation/' || m.n_nationkey) FROM nation m WHERE m.n_regionkey = r_regionkey) FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)""")
def graph_components(t):
    return graph_algo.connected(links(_graph(t).edges, "IN_REGION"))


def _triples(t):
    n = t("nation").select(F.concat(F.lit("nation/"), "n_nationkey").alias("s"), F.lit("in").alias("p"), F.concat(F.lit("region/"), "n_regionkey").alias("o"))
    r = t("region").select(F.concat(F.lit("region/"), "r_regionkey").alias("s"), F.lit("name").alias("p"), F.col("r_name").alias("o"))
    s = t("supplier").select(F.concat(F.lit("supplier/"), "s_suppkey").alias("s"), F.lit("in").alias("p"), F.concat(F.lit("nation/"), "s_nationkey").alias("o"))
    return n.unionByName(r).unionByName(s)


@query("SELECT 'supplier/' || s_suppkey AS s, r_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def triple_pattern(t):
    return triples.match(_triples(t), [("?s", "in", "?n"), ("?n", "in", "?r"), ("?r", "name", "?name")]).select("s", "name")


@query("SELECT DISTINCT 'region/' || n_regionkey AS r FROM nation")
def triple_select(t):
    return triples.select(_triples(t), 'SELECT DISTINCT ?r WHERE { ?n <in> ?r . ?r <name> ?name . }')


def _grants(t):
    rows = [("supplier", None, "role", "auditor", "read"), ("customer", 3, "user", "ann", "read"), ("customer", 5, "role", "sales", "admin"), ("customer", 8, "user", "bob", "read"), ("orders", None, "user", "bob", "read")]
    g = t.spark.createDataFrame(rows, "table string, row_id long, subject_kind string, subject string, perm string")
    return g, t.spark.createDataFrame([("ann", "sales"), ("bob", "auditor")], "user string, role string")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (3, 5)")
def acl_rows(t):
    return acl.readable(t("customer"), "customer", *_grants(t), "ann", key="c_custkey").select("c_custkey")


@query("SELECT count(*) FILTER (WHERE k = 's') AS suppliers, count(*) FILTER (WHERE k = 'n') AS nations, 0::BIGINT AS orders FROM (SELECT 'n' AS k FROM nation)")
def acl_tables(t):
    """Without a grant that names ann, suppliers and orders are closed; nation has no grant and is open."""
    g, r = _grants(t)
    n = lambda name, key: acl.readable(t(name), name, g, r, "ann", key=key).agg(F.count("*"))
    return n("supplier", "s_suppkey").toDF("suppliers").crossJoin(n("nation", "n_nationkey").toDF("nations")).crossJoin(n("orders", "o_orderkey").toDF("orders"))


@query("SELECT * FROM (VALUES ('files', 3), ('jobs', 1), ('tables', 15)) AS v(resource, bits)")
def acl_effective_bits(t):
    d = t.spark.createDataFrame([("tables", 1), ("jobs", 1), ("files", 0)], "resource string, bits int")
    s = t.spark.createDataFrame([("ann", "tables", 3), ("sales", "tables", 12), ("ann", "files", 1), ("sales", "files", 2), ("bob", "jobs", 15)], "principal string, resource string, bits int")
    return acl.effective(d, s, ["ann", "sales"])


@query("SELECT n_name AS name, vec_id AS k FROM embeddings JOIN nation ON n_nationkey = vec_id % 25 WHERE vec_id IN (0, 5)")
def acl_graph(t):
    g = t.spark.createDataFrame([("embeddings", 0, "user", "ann", "read"), ("embeddings", 5, "user", "ann", "admin")], "table string, row_id long, subject_kind string, subject string, perm string")
    roles = t.spark.createDataFrame([], "user string, role string")
    return cypher.run(_graph(t), "MATCH (n:nation)-[:SIMILAR]->(e:embeddings) RETURN n.n_name AS name, e.vec_id AS k", "ann", g, roles)
