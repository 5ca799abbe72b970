"""Line dedup by overlapping windows of consecutive lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, text_of

#: Documents that lose lines, up to which their keys' hashes are broadcast, so that only their texts cross a shuffle.
BROADCAST_KEYS = 500_000


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """Removes later occurrences of windows of ``window`` consecutive lines; all rows and columns stay.

    Lines are what newline characters separate. Every run of ``window`` lines is hashed (128 bits). Of a window that
    occurs more than once in the whole table the first occurrence stays, in the order of (id, hash of text,
    position), null ids last; the lines of every later one go, overlapping windows merged into covered positions.
    Blank lines are lines like others, so of three of them in a row the first in the table stay and later ones go.
    The text becomes the remaining lines joined by newlines; texts shorter than ``window`` lines do not change.
    Adds n_lines and n_removed (ints; input columns of these names are replaced).

    Null text: stays null, n_lines 0. Empty text: one line. Rows equal in id and text are one document and get the
    same result. An empty table gives an empty result. A copy of an earlier document loses all lines and stays as a
    row with an empty text.

    Plan: windows are exploded from the scan as (hash, position) rows, without texts, and pre-aggregated to (first
    occurrence, count). The few repeated windows are written to the shared folder; the occurrences are joined to
    them (a hot window is a skewed join key, which may be split; nothing gathers a window's occurrences), and the
    covered positions meet the texts in one join on the document key. The documents that lose no line are told by the
    broadcast hashes of the others' keys and stay where they are; beyond BROADCAST_KEYS all texts go through the join.
    """
    scratch = Scratch(docs.sparkSession)
    t = text_of(text_col)
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(t).alias("th"), F.split(t, "\n", -1).alias("l"))
    hashes = F.transform(
        F.sequence(F.lit(0), F.size("l") - window),
        lambda i: F.struct(
            F.xxhash64(*[F.col("l")[i + k] for k in range(window)]).alias("h1"),
            F.xxhash64(F.lit(1), *[F.col("l")[i + k] for k in range(window)]).alias("h2"),
        ),
    )
    found = keyed.where(F.size("l") >= window).select("id", "th", F.posexplode(hashes).alias("pos", "h"))
    found = scratch.save(found.select("id", "th", "pos", F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2")), "windows")
    rank = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("th").alias("th"), F.col("pos").alias("pos"))
    # repeated rows of one document do not make a window occur twice: its first and last occurrence then agree
    first = found.groupBy("h1", "h2").agg(F.min(rank).alias("f"), F.max(rank).alias("e")).where("f <> e")
    first = scratch.save(first.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "f"), "repeated")
    # joins of tables that both grow with the corpus: sorted and merged at every size
    later = found.join(first.hint("merge"), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    later = later.where(rank != F.col("f")).select("id", "th", "pos")
    k_id, k_th, k_pos, k_lines, k_mark = fresh(docs, "id", "th", "pos", "lines", "mark")
    gone = scratch.save(
        later.groupBy("id", "th").agg(F.collect_set("pos").alias("pos"))  # bounded by the lines of one document
        .select(F.col("id").alias(k_id), F.col("th").alias(k_th), F.col("pos").alias(k_pos)), "gone",
    )
    touched, whole = docs, None
    if gone.count() <= BROADCAST_KEYS:  # a chance equality of hashes sends one more text through the join
        marks = F.broadcast(gone.select(F.xxhash64(k_id, k_th).alias(k_mark)))
        marked = F.xxhash64(F.col(id_col), F.xxhash64(t)) == F.col(k_mark)
        touched, whole = docs.join(marks, marked, "left_semi"), docs.join(marks, marked, "left_anti")
    joined = touched.join(gone.hint("merge"), F.col(id_col).eqNullSafe(F.col(k_id)) & (F.xxhash64(t) == F.col(k_th)), "left")
    covered = F.array_distinct(F.flatten(F.transform(k_pos, lambda p: F.sequence(p, p + window - 1))))
    lines = F.split(t, "\n", -1)
    mark = F.transform(F.sequence(F.lit(0), F.size(k_lines) - 1), lambda i: i)
    kept = F.array_except(mark, covered)
    joined = joined.withColumn(k_lines, F.when(F.col(k_pos).isNotNull(), lines))
    new = F.when(F.col(k_pos).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.col(k_lines)[i]), "\n"))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1)
    n_gone = F.when(F.col(k_pos).isNull(), 0).otherwise(F.size(covered))
    own = ("n_lines", "n_removed")

    def out(rows: DataFrame, text, n_removed) -> DataFrame:
        return rows.select(
            *[(text.alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns if c.lower() not in own],
            n_lines.cast("int").alias("n_lines"), n_removed.cast("int").alias("n_removed"),
        )

    done = out(joined, new, n_gone)
    return done if whole is None else out(whole, F.col(text_col), F.lit(0)).unionAll(done)
