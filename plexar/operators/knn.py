"""Exact nearest neighbours: one query, many queries, filtered, by threshold; and recall."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexar.functions.vector import check_target, distance, metric_name

#: Query sets up to this many numbers are sent to all tasks; larger ones are worked on in blocks of this size.
BLOCK_NUMBERS = 4_000_000


def knn(df: DataFrame, vector: str, target: Sequence[float], k: int = 10, metric: str = "l2", key: str = "_id",
        where: Column | None = None, within: float | None = None, safe: bool = True) -> DataFrame:
    """The k rows closest to the target, with their ``distance``, closest first, equal distances by key.

    where applies before the k are chosen, so k rows come back where there are as many. within keeps distances up to
    it. Null vectors come last. Vectors of another length are left out (safe) or raise. Planned as one pass with a
    partial top k in every task.
    """
    target = check_target(target, metric)
    rows = df if where is None else df.where(where)
    if safe:
        rows = rows.where(F.col(vector).isNull() | (F.size(vector) == len(target)))
    rows = rows.withColumn("distance", distance(vector, target, metric, safe))
    if within is not None:
        rows = rows.where(F.col("distance") <= within)
    return rows.orderBy(F.col("distance").asc_nulls_last(), key).limit(max(k, 0))


def batch_distance(spark, query: Sequence[float], vectors: Sequence[Sequence[float]], metric: str = "l2", top_k: int = 10) -> DataFrame:
    """(index, distance) of given vectors: none for top_k 0, all where top_k is as many or more."""
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "index long, v array<double>")
    return knn(rows, "v", query, top_k, metric, "index", safe=False).select("index", "distance")


def pair_distances(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """(queries, rows) distances in double."""
    kind = metric_name(metric)
    if kind == "l1":
        return np.abs(queries[:, None, :] - rows[None, :, :]).sum(2)
    dot = queries @ rows.T
    if kind == "ip":
        return -dot
    qq, rr = (queries**2).sum(1), (rows**2).sum(1)
    if kind == "cosine":
        norms = np.sqrt(qq)[:, None] * np.sqrt(rr)[None, :]
        return np.where(norms == 0, 1.0, 1 - dot / np.where(norms == 0, 1, norms))
    return np.sqrt(np.maximum(qq[:, None] + rr[None, :] - 2 * dot, 0))


def _blocks(queries: DataFrame, key: str, vector: str) -> Iterator[tuple[list, np.ndarray]]:
    """The query set in blocks of bounded size, in key order."""
    ids, block, numbers = [], [], 0
    for r in queries.select(key, vector).where(F.col(vector).isNotNull()).orderBy(key).toLocalIterator():
        ids.append(r[0])
        block.append(r[1])
        numbers += len(r[1])
        if numbers >= BLOCK_NUMBERS:
            yield ids, np.array(block, float)
            ids, block, numbers = [], [], 0
    if ids:
        yield ids, np.array(block, float)


def knn_join(queries: DataFrame, rows: DataFrame, k: int = 10, metric: str = "l2", q_key: str = "query_id", key: str = "id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, distance, rank): for every query the k closest rows, equal distances by id.

    Every task compares its rows with a block of queries as one matrix product and keeps k for each query; only those
    meet in the final ranking. No pairs are emitted beyond k for each query and batch of rows. Null vectors and those
    of another length than the queries are left out.
    """
    kinds = {q_key: queries.schema[q_key].dataType.simpleString(), key: rows.schema[key].dataType.simpleString()}
    parts = []
    for ids, block in _blocks(queries, q_key, vector):
        def run(batches: Iterator[pd.DataFrame], ids=ids, block=block) -> Iterator[pd.DataFrame]:
            best_d = np.full((len(ids), k), np.inf)
            best_i = np.full((len(ids), k), None, object)
            for b in batches:
                if not len(b):
                    continue
                got = np.array(b[vector].tolist(), float)
                d = np.round(pair_distances(block, got, metric), 12)
                names = b[key].to_numpy()
                d = np.hstack([best_d, d])
                n = np.hstack([best_i, np.broadcast_to(names.astype(object), (len(ids), len(names)))])
                for q in range(len(ids)):
                    near = np.argpartition(d[q], min(k, d.shape[1] - 1))[: min(k, d.shape[1])]
                    edge = d[q][near].max()
                    near = np.flatnonzero((d[q] <= edge) & np.isfinite(d[q]))
                    order = sorted(near, key=lambda j: (d[q][j], n[q][j]))[:k]
                    best_d[q, : len(order)], best_i[q, : len(order)] = d[q][order], n[q][order]
            q, j = np.nonzero(np.isfinite(best_d))
            yield pd.DataFrame({"q": [ids[x] for x in q], "i": [best_i[x, y] for x, y in zip(q, j)], "d": best_d[q, j]})

        good = rows.where(F.col(vector).isNotNull() & (F.size(vector) == block.shape[1])).select(key, vector)
        parts.append(good.mapInPandas(run, f"q {kinds[q_key]}, i {kinds[key]}, d double"))
    if not parts:
        return rows.sparkSession.createDataFrame([], f"{q_key} {kinds[q_key]}, {key} {kinds[key]}, distance double, rank int")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    w = Window.partitionBy("q").orderBy("d", "i")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(q_key), F.col("i").alias(key), F.col("d").alias("distance"), "rank")


def recall(found: DataFrame, exact: DataFrame, q_key: str = "query_id", key: str = "id") -> DataFrame:
    """(query_id, recall): the share of the exact neighbours that were found."""
    hits = exact.select(q_key, key).join(found.select(q_key, key).distinct().withColumn("__hit", F.lit(1)), [q_key, key], "left")
    return hits.groupBy(q_key).agg(F.avg(F.coalesce("__hit", F.lit(0))).alias("recall"))
