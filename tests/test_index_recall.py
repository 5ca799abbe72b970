"""The recall of a search with the default effort."""

import numpy as np
from pyspark.sql import functions as F

from plexar.operators import knn as nn
from plexar.operators.ivf import IvfIndex
from plexar.plans.engine import Engine


def test_default_effort_reaches_its_recall(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(1500, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = IvfIndex.build(df, str(tmp_path / "i"), "vec_id")
    q = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = nn.knn_join(q, df, 10, "l2", "query_id", "vec_id")
    assert nn.recall(index.search_many(q, 10), exact, "query_id", "vec_id").agg(F.avg("recall")).first()[0] >= 0.9
    assert Engine.ef_search is None and index.probes(10, None) < len(index.centroids)
