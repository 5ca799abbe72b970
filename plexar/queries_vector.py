"""Vector queries: distances, nearest neighbours in their forms, the index, and SQL text with vector operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plexar.functions.vector import distance, register
from plexar.operators import knn as nn
from plexar.operators.graph_algo import checkpoint_dir
from plexar.operators.ivf import IvfIndex
from plexar.operators.set_knn import jaccard_nearest
from plexar.plans.rewrite import rewrite
from plexar.registry import query

#: The query vector of single queries is that of the least vec_id.
_Q = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 1)"
_DUCK = {
    "l2": "list_distance(embedding::DOUBLE[], q)", "ip": "-list_inner_product(embedding::DOUBLE[], q)", "cosine": "list_cosine_distance(embedding::DOUBLE[], q)",
    "l1": "list_sum([abs(x[1] - x[2]) FOR x IN list_zip(embedding::DOUBLE[], q)])",
}


def _target(t) -> list[float]:
    return [float(x) for x in t("embeddings").where("embedding IS NOT NULL").orderBy("vec_id").select("embedding").first()[0]]


def _register(name: str, sql: str):
    def wrap(f):
        f.__name__ = name
        return query(sql)(f)

    return wrap


for _m in _DUCK:
    @_register(f"vector_knn_{_m}", f"SELECT vec_id, round({_DUCK[_m]}, 6) AS distance FROM embeddings, {_Q} ORDER BY {_DUCK[_m]}, vec_id LIMIT 10")
    def _run(t, metric=_m):
        return nn.knn(t("embeddings"), "embedding", _target(t), 10, metric, "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, round({_DUCK['l2']}, 6) AS l2, round({_DUCK['ip']}, 6) AS ip, round({_DUCK['cosine']}, 6) AS cosine, round({_DUCK['l1']}, 6) AS l1 FROM embeddings, {_Q}")
def vector_distances(t):
    q = F.array(*map(F.lit, _target(t)))  # four metrics at once: too much code to unroll
    return t("embeddings").select("vec_id", *[F.round(distance("embedding", q, m), 6).alias(m) for m in ("l2", "ip", "cosine", "l1")])


@query(f"SELECT vec_id, round({_DUCK['l2']}, 6) AS distance FROM embeddings, {_Q} WHERE label = 1 ORDER BY {_DUCK['l2']}, vec_id LIMIT 15")
def vector_knn_filtered(t):
    return nn.knn(t("embeddings"), "embedding", _target(t), 15, "l2", "vec_id", where=F.col("label") == 1).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, label FROM embeddings, {_Q} WHERE {_DUCK['cosine']} <= 0.7")
def vector_within(t):
    return t("embeddings").where(distance("embedding", _target(t), "cosine", safe=True) <= 0.7).select("vec_id", "label")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT query_id, vec_id, round(list_distance(embedding::DOUBLE[], q), 12) AS d FROM q, embeddings)
SELECT query_id, vec_id, round(d, 5) AS distance, (row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id))::INT AS rank FROM d QUALIFY rank <= 10""")
def vector_knn_join(t):
    e = t("embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return nn.knn_join(q, e, 10, "l2", "query_id", "vec_id").withColumn("distance", F.round("distance", 5))


@query(f"SELECT label, round(min({_DUCK['l2']}), 6) AS nearest FROM embeddings, {_Q} GROUP BY label")
def vector_nearest_by_label(t):
    return t("embeddings").groupBy("label").agg(F.round(F.min(distance("embedding", _target(t), "l2")), 6).alias("nearest"))


@query(f"SELECT vec_id FROM embeddings, {_Q} WHERE label <= 2 AND {_DUCK['l2']} > 1 ORDER BY {_DUCK['l2']}, vec_id LIMIT 12")
def vector_sql_text(t):
    register(t.spark)
    t.views("embeddings")
    q = "ARRAY[" + ", ".join(map(repr, _target(t))) + "]"
    return t.spark.sql(rewrite(f"SELECT vec_id /* <-> stays */ FROM embeddings WHERE label <= 2 AND embedding <-> {q} > 1 ORDER BY embedding <-> {q}, vec_id LIMIT 12"))


@query(f"SELECT vec_id, round({_DUCK['cosine']}, 6) AS distance FROM embeddings, {_Q} ORDER BY {_DUCK['cosine']}, vec_id LIMIT 10")
def vector_sql_cosine(t):
    register(t.spark)
    t.views("embeddings")
    q = "ARRAY[" + ", ".join(map(repr, _target(t))) + "]"
    return t.spark.sql(rewrite(f"SELECT vec_id, round(embedding <=> {q}, 6) AS distance FROM embeddings ORDER BY embedding <=> {q}, vec_id LIMIT 10"))


def _index(t, metric: str = "l2") -> IvfIndex:
    path = f"{checkpoint_dir(t.spark)}/ivf-{uuid.uuid4().hex}"
    return IvfIndex.build(t("embeddings"), path, "vec_id", "embedding", metric)


@query(f"SELECT vec_id, round({_DUCK['l2']}, 6) AS distance FROM embeddings, {_Q} ORDER BY {_DUCK['l2']}, vec_id LIMIT 10")
def vector_index_full_probe(t):
    index = _index(t)
    return index.search(_target(t), 10, ef=8 * len(index.centroids)).withColumn("distance", F.round("distance", 6))


@query("SELECT true AS enough, count(*) AS queries FROM embeddings WHERE vec_id % 100 = 0")
def vector_index_recall(t):
    index = _index(t)
    q = t("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = nn.knn_join(q, t("embeddings"), 10, "l2", "query_id", "vec_id")
    found = index.search_many(q, 10)
    r = nn.recall(found, exact, "query_id", "vec_id")
    return r.agg((F.avg("recall") >= 0.9).alias("enough"), F.count("*").alias("queries"))


@query("SELECT sum(n)::BIGINT AS rows FROM (SELECT count(*) AS n FROM embeddings)")
def vector_index_stats(t):
    return _index(t, "cosine").stats().agg(F.sum("rows").alias("rows"))


@query("""WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS w FROM documents),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, round(1 - len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)), 6) AS distance FROM d a JOIN d b ON a.doc_id <> b.doc_id WHERE a.doc_id % 100 = 0 AND len(a.w) > 0)
SELECT a, b, distance FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY distance, b) <= 10""")
def jaccard_queries_all_rows(t):
    """The ten nearest of all documents for each query row."""
    from pyspark.sql import Window

    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0)))
    d = t("documents").select(F.col("doc_id").alias("id"), words.alias("w"))
    p = jaccard_nearest(d.where((F.col("id") % 100 == 0) & (F.size("w") > 0)), d, 10)
    return p.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))).where("n <= 10").drop("n")


@query("""SELECT 'embeddings' AS table_name, 'l' || label AS column_name, count(*) AS n, 64::INT AS dims FROM embeddings WHERE label IS NOT NULL GROUP BY label""")
def vector_store_batch(t):
    from plexar.sources.vectors import store_batch

    e = t("embeddings").where("label IS NOT NULL")
    rows = e.select(F.lit("embeddings").alias("table_name"), F.concat(F.lit("l"), "label").alias("column_name"), F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"), F.create_map().cast("map<string,string>").alias("metadata"))
    return store_batch(rows, f"{checkpoint_dir(t.spark)}/vectors-{uuid.uuid4().hex}")
