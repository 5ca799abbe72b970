"""Pipeline stages take only the rows whose own text calls for it, where ids repeat or are null."""

import corpus_pipeline as cp
from test_corpus import DOC, words


def test_clean_rows_of_shared_ids_stay(spark, tmp_path):
    item = words(30, "item")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leak = f"{words(20, 'a')} {item}"
    rows = [(None, leak), (None, words(60, "clean")), (None, words(60, "clean 2")), (7, leak), (7, words(60, "clean 3")), (8, words(60, "clean 4"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOC)
    got = sorted(str(x["doc_id"]) + x["text"] for x in cp.decontamination(spark, docs, str(tmp_path)).collect())
    assert got == sorted(str(i) + t for i, t in rows if t != leak)


def test_texts_of_one_id_are_not_copies(spark):
    rows = [(5, words(60, "p")), (5, words(60, "q")), (None, words(60, "r")), (None, words(60, "s")), (6, words(60, "p")), (None, words(60, "p")), (5, words(60, "q"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOC)
    got = sorted(str(x["doc_id"]) + x["text"] for x in cp.near_dedup(spark, docs, "").collect())
    assert got == sorted(str(i) + t for i, t in rows[:4])
