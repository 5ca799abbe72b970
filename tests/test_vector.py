import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plexar.functions.vector import check_target, distance, jaccard_distance, metric_name, norm
from plexar.operators import knn as nn
from plexar.operators.ivf import IvfIndex, check_options


def one(spark, a, b, metric, literal=False):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    return df.select(distance("a", b if literal else "b", metric)).first()[0]


@pytest.mark.parametrize("literal", [False, True])
@pytest.mark.parametrize(("metric", "a", "b", "want"), [
    ("l2", [1, 0, 0], [0, 1, 0], math.sqrt(2)), ("ip", [1, 0, 0], [0, 1, 0], 0.0), ("ip", [1, 0, 0], [1, 0, 0], -1.0), ("cosine", [1, 0, 0], [1, 0, 0], 0.0),
    ("cosine", [1, 0, 0], [0, 1, 0], 1.0), ("l2", [0] * 64, [1] * 64, 8.0), ("cosine", [0] * 64, [1] * 64, 1.0), ("ip", [0] * 64, [1] * 64, 0.0), ("l1", [1, 2], [4, -2], 7.0),
])
def test_metrics(spark, metric, a, b, want, literal):
    assert one(spark, [float(x) for x in a], [float(x) for x in b], metric, literal) == pytest.approx(want, abs=1e-9)


def test_mismatch_raises_or_is_null(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="dim mismatch"):
        df.select(distance("a", "b")).collect()
    assert [r[0] for r in df.select(distance("a", "b", safe=True)).collect()] == [None, None]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-10, 10), min_size=3, max_size=8), st.integers(0, 3))
def test_numpy_pairs_agree_with_definitions(v, k):
    import numpy as np

    from plexar.operators.knn import pair_distances

    w = [x + k for x in v]
    a, b = np.array([v]), np.array([w])
    assert pair_distances(a, b, "l2")[0, 0] == pytest.approx(math.dist(v, w), abs=1e-6)
    assert pair_distances(a, a, "l2")[0, 0] == pytest.approx(0, abs=1e-5)
    assert 0 - 1e-9 <= pair_distances(a, b, "cosine")[0, 0] <= 2 + 1e-9
    assert pair_distances(a, b, "l1")[0, 0] == pytest.approx(sum(abs(x - y) for x, y in zip(v, w)), abs=1e-6)


def test_targets_and_names():
    assert metric_name("Angular") == "cosine" and metric_name("dot") == "ip"
    for bad, metric in (([], "l2"), ([float("nan")], "l2"), ([0.0], "cosine"), ([1.0] * 5000, "l2")):
        with pytest.raises(ValueError):
            check_target(bad, metric)
    with pytest.raises(ValueError):
        metric_name("hamming")


def test_batch_distance(spark):
    vs = [[0, 0, 0], [1, 0, 0], [0, 1, 1], [0, 0, 2]]
    got = nn.batch_distance(spark, [0, 0, 1], vs, "l2", 2).collect()
    assert {r["index"] for r in got} <= {0, 2, 3} and [r["distance"] for r in got] == [1.0, 1.0]
    assert nn.batch_distance(spark, [0, 0, 1], vs, "l2", 0).count() == 0
    assert nn.batch_distance(spark, [0, 0, 1], vs, "l2", 99).count() == 4
    assert nn.batch_distance(spark, [0, 0, 1], [], "l2", 3).count() == 0
    with pytest.raises(Exception, match="dim mismatch"):
        nn.batch_distance(spark, [1.0], vs).collect()


def test_filtered_knn_gives_k(spark):
    rows = [(i, [float(i), 0.0], "a" if i % 3 else "b") for i in range(30)] + [(99, None, "b")]
    df = spark.createDataFrame(rows, "_id long, v array<double>, c string")
    got = nn.knn(df, "v", [0.0, 0.0], 5, where=F.col("c") == "b")
    assert [r["_id"] for r in got.collect()] == [0, 3, 6, 9, 12]
    assert nn.knn(df, "v", [0.0, 0.0], 100, where=F.col("c") == "b").collect()[-1]["_id"] == 99
    assert nn.knn(df, "v", [0.0, 0.0], 100, within=4.0).count() == 5


def test_norm_and_jaccard(spark):
    df = spark.createDataFrame([([3.0, 4.0], ["a", "b"], ["b", "c"])], "v array<double>, a array<string>, b array<string>")
    assert df.select(norm("v"), jaccard_distance("a", "b")).first()[:] == (5.0, pytest.approx(2 / 3))


def test_index(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(800)]
    df = spark.createDataFrame(data, "_id long, embedding array<double>")
    index = IvfIndex.build(df, str(tmp_path / "i"))
    q = data[5][1]
    full = [r["_id"] for r in index.search(q, 10, 8 * len(index.centroids)).collect()]
    assert full == [r["_id"] for r in nn.knn(df, "embedding", q, 10).collect()]
    index.add(spark.createDataFrame([(5000, q)], df.schema))
    assert {r["_id"] for r in index.search(q, 2).collect()} == {5, 5000}
    index.remove(spark.createDataFrame([(5,)], "_id long"))
    again = IvfIndex.load(spark, index.path)
    assert again.search(q, 1).first()["_id"] == 5000
    assert again.stats().agg(F.sum("rows")).first()[0] == 800
    assert again.info()["dims"] == 16
    for bad in ({"m": 2}, {"ef_construction": 9}, {"metric": "x"}, {"y": 1}):
        with pytest.raises(ValueError):
            check_options(bad)
