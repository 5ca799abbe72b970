"""Pages with extra columns of clashing names, repeated rows, and very long texts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from plexar.llm import html_extract, warc

CLASHING = ("id", "text", "n_chars", "bytes", "digest", "d", "i", "refers", "refers_to", "sha", "name", "n", "body", "x", "no", "chunk", "last", "data", "record_id", "first", "ref", "k")
LONG = " ".join(f"word{k} of one very long block" for k in range(60_000))


@pytest.fixture(scope="module")
def pages(spark):
    page = f"<html><body><nav><a href=/>Home</a></nav><article><h1>A long page</h1><p>{LONG}.</p><p>And a short paragraph that ends it.</p></article></body></html>"
    rows = [(1, "u", page), (2, "u", page), (2, "u", page), (3, None, None), (None, "u", ""), (4, "u", "   ")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in CLASHING}), page


def test_warc(pages):
    df, page = pages
    got = sorted(warc.round_trip(df).collect(), key=str)
    assert len(got) == 6
    by = {r["page_id"]: r for r in got}
    assert (by[1]["record_type"], by[1]["refers_to"]) == ("response", None) and (by[2]["record_type"], by[2]["refers_to"]) == ("revisit", 1)
    assert {r["payload_digest"] for r in got if r["page_id"] in (1, 2)} == {hashlib.sha256(page.encode()).hexdigest()}
    assert by[1]["payload_bytes"] == len(page.encode()) and by[3]["payload_bytes"] == 0 and by[None]["record_type"] == "response"


def test_extract(pages):
    df, _ = pages
    got = html_extract.extract(df).collect()
    assert len(got) == 6 and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    long = [r["text"] for r in got if r["page_id"] in (1, 2)]
    assert len(long) == 3 and all(f"{LONG}." in t.split("\n\n") and "Home" not in t for t in long)
    assert all(r["n_chars"] == len(r["text"]) for r in got) and [r["text"] for r in got if r["page_id"] in (3, 4, None)] == ["", "", ""]
