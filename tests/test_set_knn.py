"""Nearest sets against plain Python, and without a join of all pairs of rows."""

import random

from plexar.operators.set_knn import jaccard_nearest
from plexar.queries import QUERIES


def test_nearest(spark, monkeypatch):
    from plexar.operators import set_knn

    for name, n in (("BLOCK", 9), ("PART", 70), ("CHUNK", 16), ("COMMON", 3), ("WIDE", 20)):
        monkeypatch.setattr(set_knn, name, n)
    r = random.Random(3)
    sets = [(k, r.sample([f"w{j}" for j in range(60)], r.choice([0, 1, 3, 8, 20]))) for k in range(300)] + [(7, ["w1", "w2"]), (None, ["w1"])]
    rows = spark.createDataFrame(sets, "id long, w array<string>")
    got = {}
    for a, b, d in jaccard_nearest(rows.where("id % 10 = 0 and size(w) > 0"), rows, 10).collect():
        got.setdefault(a, []).append((d, b))
    q = {k: set(w) for k, w in sets if k is not None and k % 10 == 0 and w}
    assert set(got) == set(q) and len(q) > 9
    for a, w in q.items():
        want = sorted((int(1e6 * (1 - len(w & set(x)) / len(w | set(x))) + 0.5 + 1e-7) / 1e6, b) for b, x in sets if b not in (a, None))[:10]
        assert sorted(got[a])[:10] == want


def test_no_pair_join(spark):
    plan = QUERIES["jaccard_queries_all_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
