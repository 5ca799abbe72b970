"""Substring dedup by hashing lines, cut at sentence ends, or paragraphs; removed spans keep their offsets in the
original text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, text_of

#: What separates units.
BREAK = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t\x0b\x0c\r]*(?:\n[ \t\x0b\x0c\r]*)+")}
#: A line's sentences: what ends in a run of full stops, marks or the line's end. A word that changes in a long line,
#: or a passage that begins within one, then costs a sentence and not the line.
SENTENCE = re.compile(r"[^.!?。！？\n]+[.!?。！？]*|[.!?。！？]+|\n")
#: Shorter units are not hashed: they are no evidence of their own, and do not end a run either.
LEAST_WORDS = 4
#: Words of a run of adjacent repeated units from which on it is a repeated passage: half of a passage of 50 words, as
#: the sentences at its ends may be joined to others.
LEAST_RUN = 25


def units(text: str, unit: str = "sentence") -> Iterator[tuple[int, int]]:
    """(start, end) of the units of a text, in code points; separators of lines and paragraphs belong to none."""
    if unit == "sentence":
        yield from (m.span() for m in SENTENCE.finditer(text))
        return
    at = 0
    for m in BREAK[unit].finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def normalise(unit: str) -> tuple[bytes, int]:
    """(lower-cased words with single spaces between them, number of words)."""
    words = unit.lower().encode("utf-8", "replace").split()
    return b" ".join(words), len(words)


def duplicate_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "sentence", min_words: int = LEAST_WORDS,
                    min_run: int = LEAST_RUN, scratch: Scratch | None = None) -> DataFrame:
    """Every unit of a repeated passage that occurred before: (id, th, start, n_chars, n_words, first_id, first_start).

    Units are sentences of lines, whole lines or paragraphs, lower-cased with runs of space as one; those of fewer than
    min_words words are not hashed. Occurrences rank by (id, hash of the text, start), null ids last; the earliest
    stays and is named by first_id and first_start, all others are repeated. Repeated units of a document without an
    unrepeated hashed one between them are a run; a run of min_run words or more, counted from its first unit to the
    end of its last, is a repeated passage, and its units are given (min_run 0: every repeated unit). start and n_chars
    are code points in the original text, of which nothing is left out however long it is. th is the hash of the text,
    which tells apart rows that share an id; rows equal in id and text are one document. Null and empty texts have no
    units. An empty table gives an empty result.

    Plan: digests (128 bits) leave the scan without texts, are pre-aggregated to (first, last occurrence), and only
    repeated digests are joined back; a digest's occurrences are never gathered, and a hot one is a skewed join key.
    Runs are found within documents, among repeated units only.
    """
    from xxhash import xxh3_128_intdigest

    scratch = scratch or Scratch(docs.sparkSession)
    cols = ["id", "th", "no", "word", "start", "n_chars", "n_words", "h1", "h2"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, th, t in zip(b["id"], b["th"], b["text"]):
                no = word = 0
                for a, e in units(t, unit):
                    norm, n = normalise(t[a:e])
                    if n >= max(min_words, 1):
                        h = xxh3_128_intdigest(norm)
                        out.append((i, th, no, word, a, e - a, n, (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)))
                        no += 1
                    word += n
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=cols)
                    out = []
            yield pd.DataFrame(out, columns=cols)

    t = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(t).alias("th"), t.alias("text"))
    found = rows.mapInPandas(run, "id string, th long, no int, word int, start int, n_chars int, n_words int, h1 long, h2 long")
    found = scratch.save(found.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)), "units")
    rank = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("th").alias("th"), F.col("start").alias("start"))
    first = found.groupBy("h1", "h2").agg(F.min(rank).alias("f"), F.max(rank).alias("e")).where("f <> e")
    first = scratch.save(first.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "f"), "repeated")
    later = found.join(first, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).where(rank != F.col("f"))
    later = later.select("id", "th", "no", "word", "start", "n_chars", "n_words", F.col("f.id").alias("first_id"), F.col("f.start").alias("first_start"))
    if min_run > 0:
        text = ("id", "th")
        later = later.distinct().withColumn("run", F.col("no") - F.row_number().over(Window.partitionBy(*text).orderBy("no")))
        own = Window.partitionBy(*text, "run")
        later = later.withColumn("words", F.max(F.col("word") + F.col("n_words")).over(own) - F.min("word").over(own))
        later = later.where(F.col("words") >= min_run)
    to_long = [F.col(c).cast("long").alias(c) for c in ("start", "n_chars", "n_words")]
    return later.select("id", "th", *to_long, "first_id", F.col("first_start").cast("long").alias("first_start"))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the spans (start, length). A line of which nothing but space is left goes with its end, and blank lines
    on both sides of it become one."""
    out, at = [], 0
    for a, n in [*sorted(spans), (len(text), 0)]:
        out += [text[at:a], "\0" if n else ""]
        at = max(at, a + n)
    if "\0" in text:  # then the mark is no mark; lines stay as they are
        return "".join(x for x in out if x != "\0")
    kept: list[str] = []
    gone = False  # whether the line before went
    for x in "".join(out).split("\n"):
        plain = x.replace("\0", "")
        if "\0" in x and not plain.strip():
            gone = True
        elif not (gone and not plain.strip() and (not kept or not kept[-1].strip())):  # two blank lines that meet are one
            kept.append(plain)
            gone = False
    while gone and kept and not kept[-1].strip():
        kept.pop()
    return "\n".join(kept)


def remove_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "sentence", min_words: int = LEAST_WORDS,
                 min_run: int = LEAST_RUN) -> DataFrame:
    """docs with the units of ``duplicate_units`` cut from the text, and ``removed``: array of (start, n_chars) in the
    original text, empty where nothing went. A line that is left without a word goes with its end. Rows, other columns
    and texts without repeated passages do not change; rules as in ``duplicate_units``."""
    scratch = Scratch(docs.sparkSession)
    gone = duplicate_units(docs, id_col, text_col, unit, min_words, min_run, scratch).distinct()
    k_id, k_th, k_spans = fresh(docs, "id", "th", "spans")
    gone = gone.groupBy(F.col("id").alias(k_id), F.col("th").alias(k_th)).agg(F.sort_array(F.collect_list(F.struct("start", "n_chars"))).alias(k_spans))
    gone = scratch.save(gone, "gone")

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None or not len(s) else cut(t, [(int(x["start"]), int(x["n_chars"])) for x in s]) for t, s in zip(texts, spans)], dtype=object)

    t = text_of(text_col)
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col(k_id)) & (F.xxhash64(t) == F.col(k_th)), "left")
    empty = F.array().cast("array<struct<start:bigint,n_chars:bigint>>")
    return joined.select(
        *[(F.when(F.col(k_spans).isNull(), F.col(text_col)).otherwise(without(F.col(text_col), F.col(k_spans))).alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns if c.lower() != "removed"],
        F.coalesce(F.col(k_spans), empty).alias("removed"),
    )
