"""The pipeline stage by stage against plain versions."""

import collections

import pytest

import corpus_pipeline as cp
from test_corpus import DOC, brute_fingerprint, brute_groups, brute_leaks, brute_lines, brute_mix, brute_quality, words  # noqa: F401


@pytest.fixture
def corpus(spark, tmp_path):
    passage = words(40, "leak")
    rows = []
    for k in range(60):
        text = "\n".join(words(12, f"{k}/{j}") for j in range(7))
        if k % 10 == 3:
            text = rows[k - 3][1]  # a copy
        if k % 10 == 4:
            text = text.replace(" ", " # ")  # symbols
        if k % 10 == 5:
            text += "\n" + passage
        if k % 10 == 6:
            text = rows[k - 6][1].split("\n")
            text = "\n".join([*text[2:6], *(words(12, f"own{k}/{j}") for j in range(6))])  # shares a run of lines
        if k % 10 == 7:
            text = words(20, k)
        rows.append((k, text, "en", f"src{k % 3}", len(text)))
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return rows, passage, str(tmp_path)


def brute_run(rows, passage):
    def good(t):
        n, chars, sym, dup, rep = brute_quality(t)
        ls = len([x for x in t.split("\n") if x.strip()])
        return n >= 50 and 100 * rep <= 50 * n and 10 * sym <= n and 100 * dup <= 60 * ls and 2 * n <= chars <= 20 * n

    docs = {i: (t, s) for i, t, _, s, _ in rows if good(t)}
    clean = {i: t for i, _, t in brute_lines([(i, t) for i, (t, _) in docs.items()])}
    groups = brute_groups(list(clean.items()))
    clean = {int(i): clean[int(i)] for i, _, c in groups if i == c}
    leaks = {x[0] for x in brute_leaks(list(clean.items()), [(1, passage)])}
    return {i: (t, docs[i][1]) for i, t in clean.items() if i not in leaks}


def test_run(spark, corpus):
    rows, passage, folder = corpus
    want = brute_run(rows, passage)
    got = cp.run(spark, folder).collect()
    size, target = brute_mix([(i, t, s) for i, (t, s) in want.items()])
    taken = collections.Counter()
    for x in got:
        t, s = want[x["doc_id"]]
        assert (x["text"], x["source"], x["n_chars"]) == (t, s, len(t)) and 1 <= x["repeats"] <= 2
        taken[s] += len(t.split()) * x["repeats"]
    assert all(abs(taken[s] - target[s]) <= 90 for s in size)


def test_stages_keep_columns(spark, corpus):
    docs = spark.read.parquet(f"{corpus[2]}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, corpus[2])
        assert out.columns == docs.columns, name
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
    assert len(cp.STAGES) == 5 and stage(spark, docs.limit(0), corpus[2]).count() == 0


def test_registered():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert all(any(n.startswith(f"op{k}_") for n in q) for k in range(1, 11)) and "pipeline" in q and set(o) <= set(q)
