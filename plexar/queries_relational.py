"""Relational queries: scans, projection, filters, joins, aggregation, windows, ordering, set operations, changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plexar.functions.scalar import bucket, near
from plexar.operators import dml, relational
from plexar.plans.where import Where
from plexar.registry import query, sql_query
from plexar.sources import tables as src

# --- scans


@query("SELECT * FROM nation")
def scan_all(t):
    return t("nation")


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity > 45")
def scan_pushed(t):
    return t("lineitem").where("l_shipdate < timestamp_ntz'1996-01-01' AND l_quantity > 45").select("l_orderkey", "l_quantity")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20")
def table_sample(t):
    return relational.first_rows(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 20)


@query("SELECT * FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def point_lookup(t):
    o = t("orders")
    return o.where(F.col("o_orderkey") == o.agg(F.max("o_orderkey")).first()[0])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey >= 10 AND c_custkey < 200")
def key_range_scan(t):
    return src.key_range(t("customer"), "c_custkey", 10, 200).select("c_custkey", "c_name")


@query("SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'P')")
def key_prefix_scan(t):
    return src.key_prefix(t("part"), "p_type", "P").select("p_partkey", "p_type")


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0 AND s_suppkey % 2 = 0")
def python_predicate_scan(t):
    return src.where_python(t("supplier").select("s_suppkey", "s_acctbal"), lambda r: r["s_acctbal"] > 0 and r["s_suppkey"] % 2 == 0)


# --- projection

sql_query("project_alias_expr", "orders", spark="SELECT o_orderkey AS id, o_totalprice * 2 AS net, upper(o_orderstatus) AS st, lower(o_orderpriority) AS pr FROM orders")
sql_query("project_case", "part", spark="SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class FROM part")
sql_query("scalar_functions", "part", "supplier", spark="SELECT p_partkey, trim(p_name) AS name, length(p_name) AS n, abs(p_size - 25) AS d, round(p_retailprice, 1) AS price FROM part",
          duck="SELECT p_partkey, trim(p_name) AS name, length(p_name)::INT AS n, abs(p_size - 25) AS d, round(p_retailprice, 1) AS price FROM part")


@query('SELECT n_nationkey AS "n.n_nationkey", n_name AS "n.n_name", n_regionkey AS "n.n_regionkey" FROM nation')
def qualified_columns(t):
    return relational.qualify(t("nation"), "n")


# --- filters

sql_query("filter_comparisons", "lineitem", spark="""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20 AND l_discount <> 0.05
  AND l_linenumber < 5 AND NOT l_tax > 0.06 AND l_returnflag = 'N'""")
sql_query("filter_three_valued", "orders", spark="""SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders) q
  WHERE p > 100000 OR NOT (p > 100000 OR o_orderkey % 2 = 0)""")


def _where(build):
    w = Where()
    build(w)
    return w.to_column()


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_type NOT LIKE 'S%'")
def filter_like(t):
    return t("part").where(_where(lambda w: w.like("p_name", "%a%").like("p_type", "S%").invert())).select("p_partkey", "p_name")


@query("SELECT doc_id FROM documents WHERE text ILIKE '%THE%' AND lang NOT ILIKE 'E%'")
def filter_ilike(t):
    return t("documents").where(_where(lambda w: w.ilike("text", "%THE%").ilike("lang", "E%").invert())).select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
def filter_in(t):
    return t("orders").where(_where(lambda w: w.where_in("o_orderstatus", ["F", "O"]).where_not_in("o_orderpriority", ["1-URGENT", "5-LOW"]))).select("o_orderkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 OR p_retailprice NOT BETWEEN 900 AND 1900")
def filter_between(t):
    w = Where().where_between("p_size", 10, 20).or_where("p_retailprice", "NOT BETWEEN", 900, 1900)
    return t("part").where(w.to_column()).select("p_partkey", "p_size")


@query("SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
def filter_null(t):
    both = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.where(Where().where_null("o_orderkey").to_column()).select("c_custkey")


@query("SELECT p_partkey FROM part WHERE (p_size = 1 OR p_size = 2) AND p_retailprice > 1000")
def filter_left_associative(t):
    return t("part").where(Where().where("p_size", "=", 1).or_where("p_size", "=", 2).and_where("p_retailprice", ">", 1000).to_column()).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size > 10 AND NOT (p_size = 20 OR p_brand = 'Brand#11')")
def filter_negated_group(t):
    w = Where().where("p_size", ">", 10).group(lambda g: g.where("p_size", "=", 20).or_where("p_brand", "=", "Brand#11")).invert()
    return t("part").where(w.to_column()).select("p_partkey")


@query("SELECT s_suppkey FROM supplier, (SELECT max(s_acctbal) AS m FROM supplier) WHERE abs(s_acctbal - m) < 1e-9")
def filter_float_equality(t):
    s = t("supplier")
    return s.where(near(F.col("s_acctbal"), F.lit(s.agg(F.max("s_acctbal")).first()[0]))).select("s_suppkey")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def filter_json(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t("events").where(k > 50).select("event_id", k.alias("k"))


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7' OR json_extract_string(props, '$.k') = '9'")
def filter_json_operators(t):
    t.views("events")
    from plexar.plans.rewrite import rewrite

    return t.spark.sql(rewrite("""SELECT event_id FROM events WHERE props ->> 'k' = '7' OR props @> '{"k": 9}'"""))


@query("SELECT o_orderkey AS k, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS i FROM orders QUALIFY o_totalprice > 100000")
def filter_selection_vector(t):
    lists = t("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("v"))
    return lists.select(F.posexplode("v").alias("i", "x")).where("x.o_totalprice > 100000").select(F.col("x.o_orderkey").alias("k"), "i")


# --- joins


@query('SELECT c_custkey AS "c.c_custkey", c_name AS "c.c_name", o_orderkey AS "o.o_orderkey", o_custkey AS "o.o_custkey" FROM customer JOIN orders ON c_custkey = o_custkey')
def join_inner(t):
    return relational.join(t("customer").select("c_custkey", "c_name"), t("orders").select("o_orderkey", "o_custkey"), ("c", "o"), ("c_custkey", "o_custkey"))


for _how, _sql in (("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL")):
    sql_query(f"join_{_how}", "customer", "orders", spark=f"SELECT c_custkey, o_orderkey FROM customer {_sql} JOIN orders ON c_custkey = o_custkey AND c_acctbal > 0 AND o_totalprice > 100000")
sql_query("join_null_keys", "orders", spark="""WITH a AS (SELECT CASE WHEN o_orderstatus <> 'F' THEN o_custkey END AS k, count(*) AS n FROM orders GROUP BY 1),
  b AS (SELECT CASE WHEN o_orderpriority <> '1-URGENT' THEN o_custkey END AS k, count(*) AS n FROM orders GROUP BY 1) SELECT CAST(sum(a.n * b.n) AS BIGINT) AS n FROM a JOIN b ON a.k = b.k""")
sql_query("join_cross", "region", "nation", spark="SELECT r_name, n_name FROM region CROSS JOIN nation")
sql_query("join_semi", "customer", "orders", spark="SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000",
          duck="SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
sql_query("join_anti", "customer", "orders", spark="SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey",
          duck="SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
sql_query("join_theta", "supplier", "nation", spark="SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey AND s_acctbal > 5000")
sql_query("join_using_natural", "nation", "region", spark="""SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) n JOIN (SELECT r_regionkey AS k, r_name FROM region) r USING (k)""")
sql_query("join_where_star", "lineitem", "orders", "customer", "nation", spark="""SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE l_returnflag = 'R' AND o_totalprice > 1000 GROUP BY n_name""")
sql_query("join_limit", "customer", "orders", spark="SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey ORDER BY o_orderkey, c_custkey LIMIT 10")
sql_query("subquery_in", "orders", "customer", spark="SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
sql_query("subquery_correlated", "orders", spark="SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders i WHERE i.o_custkey = o.o_custkey)")
sql_query("cte", "lineitem", spark="""WITH q AS (SELECT l_orderkey, sum(l_quantity) AS s FROM lineitem GROUP BY l_orderkey), r AS (SELECT * FROM q WHERE s > 100)
  SELECT l_orderkey, s FROM r""")
sql_query("cte_recursive", "nation", spark="WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 25) SELECT r.n, n_name FROM r JOIN nation ON n_nationkey = r.n")

# --- aggregation

sql_query("aggregate_seven", "lineitem", spark="""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_extendedprice), 4) AS a,
  min(l_discount) AS lo, max(l_tax) AS hi, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity), 6) AS v FROM lineitem GROUP BY l_returnflag, l_linestatus""")
sql_query("aggregate_global", "documents", spark="SELECT count(*) AS n, round(avg(length(text)), 6) AS mean_length FROM documents")
sql_query("group_by_all", "orders", spark="SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
sql_query("having", "orders", spark="SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
sql_query("distinct", "lineitem", spark="SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem")
sql_query("count_distinct", "lineitem", spark="SELECT l_linenumber, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_linenumber")
sql_query("cube", "orders", spark="SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql_query("rollup", "customer", spark="SELECT c_mktsegment, c_nationkey, round(sum(c_acctbal), 2) AS s FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
sql_query("grouping_sets", "part", spark="SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())")


@query("SELECT min(p_size)::BIGINT AS min, max(p_size)::BIGINT AS max, sum(p_size)::BIGINT AS sum, count(p_size) AS count FROM part")
def columnar_summary(t):
    return relational.summary(t("part"), "p_size", "bigint")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, p AS point, value FROM r, (SELECT unnest([50, 95, 99])::INT AS p) q WHERE i = least(n * p // 100, n - 1)""")
def percentiles_by_index(t):
    return relational.percentiles(t("events"), "value", [50, 95, 99], ["event_type"])


@query("""SELECT sum(n)::BIGINT AS rows, (var_pop(n) >= 0) AS measured FROM (SELECT o_custkey % 16 AS b, count(*) AS n FROM orders GROUP BY b)""")
def hash_bucket_quality(t):
    return relational.bucket_quality(t("orders"), ["o_orderkey"], 16).select(F.col("rows").cast("bigint"), (F.col("score") > 0.5).alias("measured"))


@query("SELECT event_type, count(*) AS processed, (count(*) FILTER (WHERE value < 10))::BIGINT AS failures, round((count(*) FILTER (WHERE value < 10)) / count(*), 9) AS error_rate FROM events GROUP BY event_type")
def error_rate(t):
    from plexar.streaming.windows import outcome

    return outcome(t("events"), F.coalesce(F.col("value") < 10, F.lit(False)), ("event_type",)).withColumn("error_rate", F.round("error_rate", 9))


@query("SELECT round(var_pop(n), 6) AS v FROM (SELECT count(*) AS n FROM events GROUP BY event_type)")
def population_variance(t):
    return t("events").groupBy("event_type").count().agg(F.round(F.var_pop("count"), 6).alias("v"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def status_counts(t):
    return t("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, 16::BIGINT AS buckets FROM customer")
def partition_spread(t):
    b = t("customer").groupBy(bucket(["c_custkey"], 16).alias("b")).count()
    return b.agg(F.sum("count").alias("n"), F.count("*").alias("buckets"))


@query("SELECT (row_number() OVER (ORDER BY c_custkey) - 1)::BIGINT AS _id, count(*) OVER () AS n FROM customer")
def dense_row_ids(t):
    d = relational.dense_ids(t("customer").select("c_custkey"))
    return d.select("_id").crossJoin(F.broadcast(d.agg(F.count("*").alias("n"))))


# --- windows

sql_query("window_ranking", "orders", spark="""SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER p AS r, dense_rank() OVER p AS dr FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""",
          duck="""SELECT o_orderkey, (row_number() OVER w)::INT AS rn, (rank() OVER p)::INT AS r, (dense_rank() OVER p)::INT AS dr FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
sql_query("window_offset", "orders", spark="""SELECT o_orderkey, lag(o_totalprice, 1) OVER w AS prev, lead(o_totalprice, 2) OVER w AS ahead, first_value(o_orderkey) OVER w AS f,
  last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
sql_query("window_frames", "orders", spark="""SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s3,
  count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS near FROM orders""")

# --- order, limit, sets

sql_query("order_multi", "part", spark="SELECT p_partkey, p_size, p_brand FROM part ORDER BY p_size DESC NULLS LAST, p_brand ASC NULLS LAST, p_partkey LIMIT 50")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def order_page(t):
    return relational.page(t("orders"), 3, 25, F.col("o_totalprice").desc(), F.col("o_orderkey")).select("o_orderkey")


@query("SELECT c_custkey, list_sort(list(o_totalprice)) AS prices FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def sort_within(t):
    return t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list("o_totalprice")).alias("prices")).join(t("customer").select("c_custkey"), "c_custkey", "left_semi")


@query("SELECT o_orderstatus, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) <= 5")
def top_k_per_group(t):
    w = Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t("orders").withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("o_orderstatus", "o_orderkey", "o_totalprice")


sql_query("set_union", "customer", "supplier", spark="SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql_query("set_union_all", "nation", "region", spark="SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
sql_query("set_intersect", "customer", "supplier", spark="SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
sql_query("set_except_all", "customer", "supplier", spark="SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")

# --- changes: the table's next version


@query("SELECT s_suppkey, s_name, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal, s_nationkey FROM supplier")
def change_update(t):
    return dml.update(t("supplier"), {"s_acctbal": F.lit(0.0)}, F.col("s_acctbal") < 0)


@query("SELECT * FROM supplier WHERE NOT coalesce(s_acctbal < 1000, false)")
def change_delete(t):
    return dml.delete(t("supplier"), F.col("s_acctbal") < 1000)


@query("SELECT * FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 10 ORDER BY s_suppkey LIMIT 7)")
def change_delete_limit(t):
    return dml.delete(t("supplier"), F.col("s_nationkey") < 10, 7, "s_suppkey")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, n_name, NULL FROM nation WHERE n_regionkey = 1")
def change_insert(t):
    n = t("nation")
    return dml.insert(n, n.where("n_regionkey = 1").select((F.col("n_nationkey") + 100).alias("n_nationkey"), "n_name"))


_NEW = "(SELECT n_nationkey + 10 AS n_nationkey, 'new ' || n_name AS n_name, n_regionkey FROM nation)"


def _new(t):
    return t("nation").select((F.col("n_nationkey") + 10).alias("n_nationkey"), F.concat(F.lit("new "), "n_name").alias("n_name"), "n_regionkey")


@query(f"SELECT * FROM nation UNION ALL SELECT * FROM {_NEW} q WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation)")
def upsert_ignore(t):
    return dml.upsert(t("nation"), _new(t), ["n_nationkey"], "ignore")


@query(f"SELECT * FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey FROM {_NEW} q) UNION ALL SELECT * FROM {_NEW} q")
def upsert_replace(t):
    return dml.upsert(t("nation"), _new(t), ["n_nationkey"], "replace")


@query(f"""SELECT coalesce(a.n_nationkey, b.n_nationkey) AS n_nationkey, coalesce(b.n_name, a.n_name) AS n_name, coalesce(a.n_regionkey, b.n_regionkey) AS n_regionkey
FROM nation a FULL JOIN {_NEW} b ON a.n_nationkey = b.n_nationkey""")
def upsert_update(t):
    return dml.upsert(t("nation"), _new(t), ["n_nationkey"], "update", ["n_name"])


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def collection_projection(t):
    from pyspark.sql import types as T

    from plexar.sources.collections import project

    docs = t("events").select(F.concat(F.lit('{"id":'), "event_id", F.lit(","), F.substring("props", 2, 100000)).alias("doc"))
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("k", T.LongType())])
    return project(docs, "doc", schema, {"event_id": "id", "k": "k"})[0]
