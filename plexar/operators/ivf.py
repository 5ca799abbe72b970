"""An approximate vector index: cells around centroids, searched by probing the nearest cells and ranking exactly."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexar.functions.vector import check_target, metric_name
from plexar.operators.knn import knn

#: Ranges of the options that an index is created with.
RANGES = {"m": (4, 64), "ef_construction": (16, 2048)}
#: Rows by least hash of the key that centroids are trained on.
TRAIN_ROWS = 20_000


def check_options(options: dict[str, object]) -> dict[str, object]:
    """m, ef_construction and metric; raises on others and on values outside their ranges."""
    out: dict[str, object] = {"m": 16, "ef_construction": 200, "metric": "l2"}
    for k, v in options.items():
        k = k.lower()
        if k == "metric":
            out[k] = metric_name(str(v))
        elif k in RANGES:
            low, high = RANGES[k]
            if not low <= int(v) <= high:  # type: ignore[call-overload]
                raise ValueError(f"{k} must be between {low} and {high}")
            out[k] = int(v)  # type: ignore[call-overload]
        else:
            raise ValueError(f"unknown option: {k}")
    return out


def _spread(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as clustering sees them: unit length where only direction counts."""
    if metric_name(metric) in ("cosine", "ip"):
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(n == 0, 1, n)
    return x


def nearest_cells(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    d = (x**2).sum(1)[:, None] + (centroids**2).sum(1)[None, :] - 2 * x @ centroids.T
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def train_centroids(x: np.ndarray, cells: int, rounds: int, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        cell = nearest_cells(x, c, 1)[:, 0]
        for k in range(len(c)):
            own = x[cell == k]
            c[k] = own.mean(0) if len(own) else x[rng.integers(len(x))]
    return c


@dataclass
class IvfIndex:
    """Rows in a table partitioned by cell, centroids and removed keys beside it. Every row is indexed.

    ``effort`` of a search (ef) becomes the number of cells probed, one for 8; with all cells it equals the exact search.
    Without it, five eighths of the cells and two more are probed: vectors without clusters need as many for a recall of 0.9.
    """

    spark: SparkSession
    path: str
    key: str
    vector: str
    metric: str
    centroids: np.ndarray

    @classmethod
    def build(cls, df: DataFrame, path: str, key: str = "_id", vector: str = "embedding", metric: str = "l2", m: int = 16, ef_construction: int = 200) -> IvfIndex:
        check_options({"m": m, "ef_construction": ef_construction, "metric": metric})
        rows = df.where(F.col(vector).isNotNull()).select(key, vector)
        some = rows.orderBy(F.xxhash64(key), key).limit(TRAIN_ROWS).collect()
        if not some:
            raise ValueError("no vectors to index")
        x = _spread(np.array([r[1] for r in some], float), metric)
        cells = max(1, min(4 * m, int(np.sqrt(len(x))) * 2))
        index = cls(df.sparkSession, path, key, vector, metric_name(metric), train_centroids(x, cells, max(3, min(25, ef_construction // 20))))
        index._assign(rows).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        p = index.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/removed")
        p.getFileSystem(index.spark._jsc.hadoopConfiguration()).delete(p, True)
        index._save()
        return index

    def _save(self) -> None:
        meta = json.dumps({"key": self.key, "vector": self.vector, "metric": self.metric})
        rows = [(k, [float(v) for v in c], meta) for k, c in enumerate(self.centroids)]
        self.spark.createDataFrame(rows, "cell int, centroid array<double>, meta string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IvfIndex:
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
        meta = json.loads(rows[0][2])
        return cls(spark, path, meta["key"], meta["vector"], meta["metric"], np.array([r[1] for r in rows]))

    def _assign(self, rows: DataFrame) -> DataFrame:
        centroids, metric = self.centroids, self.metric

        @F.pandas_udf("int")
        def cell(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype="int32")
            return pd.Series(nearest_cells(_spread(np.array(v.tolist(), float), metric), centroids, 1)[:, 0].astype("int32"))

        return rows.withColumn("cell", cell(self.vector))

    def rows(self) -> DataFrame:
        """Indexed rows that are not removed."""
        out = self.spark.read.parquet(f"{self.path}/rows")
        gone = self._removed()
        return out if gone is None else out.join(gone, self.key, "left_anti")

    def _removed(self) -> DataFrame | None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/removed")
        there = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.parquet(f"{self.path}/removed") if there else None

    def probes(self, k: int, ef: int | None) -> int:
        if not ef:
            return min(len(self.centroids), -(-5 * len(self.centroids) // 8) + 2)
        ef = min(max(ef, k), 8192)
        return min(len(self.centroids), max(1, ef // 8))

    def search(self, target: Sequence[float], k: int = 10, ef: int | None = None) -> DataFrame:
        """(key, distance), closest first. Only the probed cells' files are read."""
        t = check_target(target, self.metric)
        cells = nearest_cells(_spread(np.array([t]), self.metric), self.centroids, self.probes(k, ef))[0]
        rows = self.rows().where(F.col("cell").isin([int(c) for c in cells]))
        return knn(rows, self.vector, t, k, self.metric, self.key).select(self.key, "distance")

    def search_many(self, queries: DataFrame, k: int = 10, ef: int | None = None, q_key: str = "query_id") -> DataFrame:
        """(query_id, key, distance, rank): queries meet the rows of their probed cells by an equi-join on the cell."""
        from pyspark.sql import Window

        from plexar.functions.vector import distance

        centroids, metric, n = self.centroids, self.metric, self.probes(k, ef)

        @F.pandas_udf("array<int>")
        def cells(v: pd.Series) -> pd.Series:
            return pd.Series(list(nearest_cells(_spread(np.array(v.tolist(), float), metric), centroids, n).astype("int32"))) if len(v) else pd.Series([], dtype=object)

        q = queries.select(F.col(q_key), F.col(self.vector).alias("__q"), F.explode(cells(self.vector)).alias("cell"))
        found = q.join(self.rows(), "cell").withColumn("distance", distance(self.vector, "__q", self.metric, safe=True))
        w = Window.partitionBy(q_key).orderBy(F.col("distance").asc_nulls_last(), self.key)
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(q_key, self.key, "distance", "rank")

    def add(self, df: DataFrame) -> None:
        """Puts new rows into their cells. Keys that were removed before stay removed until ``rebuild``."""
        self._assign(df.where(F.col(self.vector).isNotNull()).select(self.key, self.vector)).write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")

    def remove(self, keys: DataFrame) -> None:
        """Marks keys as removed; the rows go when the index is built again."""
        keys.select(self.key).distinct().write.mode("append").parquet(f"{self.path}/removed")

    def removed_from(self, first: object) -> bool:
        """Whether a key of first or more was removed since the index was built."""
        gone = self._removed()
        return gone is not None and not gone.where(F.col(self.key) >= first).isEmpty()

    def stats(self) -> DataFrame:
        """(cell, rows, centroid_norm) for every cell."""
        norms = self.spark.createDataFrame([(k, float(np.linalg.norm(c))) for k, c in enumerate(self.centroids)], "cell int, centroid_norm double")
        counts = self.rows().groupBy("cell").agg(F.count("*").alias("rows"))
        return norms.join(counts, "cell", "left").select("cell", F.coalesce("rows", F.lit(0)).alias("rows"), "centroid_norm")

    def info(self) -> dict[str, object]:
        return {"key": self.key, "vector": self.vector, "metric": self.metric, "cells": len(self.centroids), "dims": int(self.centroids.shape[1])}

