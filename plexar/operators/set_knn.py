"""Exact nearest neighbours of sets by Jaccard distance, as blocks of matrix products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries and rows that meet in one task, rows of a product, and words of a product: of the words that COMMON queries
#: hold or more, the most common ones. All decide cost only.
BLOCK, PART, CHUNK, COMMON, WIDE = 8192, 8192, 1024, 16, 4096


def nearest_sets(queries: list, sizes: np.ndarray, query_ids: np.ndarray, rows: list, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, row's id, distance in millionths, a half rounded up): each query's k nearest of rows of another id, ties by id.
    Sets are arrays of distinct hashes; queries are not empty."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    words, flat = np.unique(np.concatenate(queries), return_inverse=True)
    owner = np.repeat(np.arange(len(queries)), sizes)
    held = np.bincount(flat, minlength=len(words))
    wide = np.argsort(-held, kind="stable")[:WIDE]
    wide = wide[held[wide] >= COMMON]
    column = np.full(len(words), -1)
    column[wide] = np.arange(len(wide))
    product = np.zeros((len(queries), len(wide)), np.float32)
    in_product = column[flat] >= 0
    product[owner[in_product], column[flat[in_product]]] = 1
    by_word = owner[np.argsort(flat, kind="stable")]
    start = np.cumsum(held) - held
    n, none = len(ids), np.iinfo(np.int64).max
    best = np.full((len(queries), k), none)
    for c in range(0, n, CHUNK):
        sets = [rows[i] for i in order[c : c + CHUNK]]
        size = np.array([len(s) for s in sets])
        w = np.concatenate(sets).astype(np.int64)
        row = np.repeat(np.arange(len(sets)), size)
        at = np.minimum(np.searchsorted(words, w), len(words) - 1)
        known = words[at] == w
        at, row = at[known], row[known]
        common = column[at] >= 0
        d = np.zeros((len(sets), len(wide)), np.float32)
        d[row[common], column[at[common]]] = 1
        both = product @ d.T
        at, row = at[~common], row[~common]
        times = held[at]
        place = np.repeat(start[at] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        np.add.at(both, (by_word[place], np.repeat(row, times)), np.float32(1))
        both = both.astype(np.int64)
        union = sizes[:, None] + size - both
        key = ((union - both) * 2_000_000 + union) // (2 * union) * n + np.arange(c, c + len(sets))
        key[query_ids[:, None] == ids[c : c + len(sets)]] = none
        best = np.partition(np.concatenate([best, key], axis=1), k - 1, axis=1)[:, :k]
    q, j = np.nonzero(best < none)
    return q, ids[best[q, j] % n], best[q, j] // n


def jaccard_nearest(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(a, b, distance): for each row of queries (id, w), w an array of distinct words, not empty, its k nearest of each part
    of rows (id, w) by Jaccard distance, rounded to six places, ties by id; rows of a query's own id and null ids are left
    out. The k nearest of all are among them.

    Words are compared by their 64-bit hashes. Every query meets every row, in blocks of queries and parts of rows."""
    hashed = [df.where("id IS NOT NULL").select("id", F.transform("w", lambda x: F.xxhash64(x)).alias("w")) for df in (queries, rows)]
    blocks, parts = (max(1, -(-df.count() // most)) for df, most in ((queries, BLOCK), (rows, PART)))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        df = df.withColumn(own, F.pmod(F.xxhash64("id", "w"), F.lit(n)))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))

    q, r = dealt(hashed[0], "block", blocks, "part", parts), dealt(hashed[1], "part", parts, "block", blocks)

    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"a": [], "b": [], "distance": []}).astype({"a": "int64", "b": "int64"})
        ids = q["id"].to_numpy()
        i, b, far = nearest_sets(list(q["w"]), q["w"].map(len).to_numpy(), ids, list(r["w"]), r["id"].to_numpy(), k)
        return pd.DataFrame({"a": ids[i], "b": b, "distance": far / 1e6})

    return q.groupBy("block", "part").cogroup(r.groupBy("block", "part")).applyInPandas(run, "a long, b long, distance double")
