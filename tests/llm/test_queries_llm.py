"""Corpus queries against their SQL on the smallest tables, and plans without Python where operators are native."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import SF
from oracle import connection, same
from plexar.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    cols, ours, theirs = same(QUERIES[name](spark, SF), connection(SF), ORACLE_SQL[name])
    assert cols and ours == theirs


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_rows(spark, name):
    """Queries without SQL give a row per row of their table (findings for the secret scan)."""
    df = QUERIES[name](spark, SF)
    table = {"op9_html_text": "pages"}.get(name, "documents")
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert df.count() == n or name.startswith("op5")


@pytest.mark.parametrize("name", ["op1_mix", "op3_line_dedup", "op5_secrets", "op6_decontaminate"])
def test_native(spark, name):
    p = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in p for x in ("Python", "Pandas", "Arrow"))


def test_toxicity_held_out(spark):
    """Labelled rows of sf0.1 that nothing was learnt from."""
    folder = SF.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = QUERIES["op2_toxicity"](spark, folder).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r[0], r[1]): r[2] for r in rows}
    hit = n[1, 1]
    assert hit / (hit + n.get((1, 0), 0)) > 0.9 and hit / (hit + n.get((0, 1), 0)) > 0.85
