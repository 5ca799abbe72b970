"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, text_of, word_count

#: Source tables up to this many rows are broadcast; larger ones are joined with a shuffle.
BROADCAST_SOURCES = 100_000
#: The seeded order is cut in two rounds, by so many digits of the hash each: first into 16 ** 3 ranges, then the range
#: that holds a source's cut into as many again. What is left to order is a 16.7 millionth of a source.
ORDER_DIGITS = (3, 6)


def water_level(sources: DataFrame, size: str, weight: str, budget_ratio: float, max_epochs: float) -> tuple[float, float]:
    """(level, total size): a source's target is min(max_epochs * size, level * weight), and all targets add up to
    budget_ratio times all sizes.

    Sources above their cap are clamped and their excess goes to the others by weight, until none is above. Each
    round is one aggregate over the source table and brings two sums to the driver; the clamped set only grows.
    """
    cap = F.lit(max_epochs) * F.col(size)
    total = sources.agg(F.sum(size)).first()[0] or 0
    budget = budget_ratio * total
    level, before = 0.0, -1
    while True:
        over = (cap <= F.lit(level) * F.col(weight)) if before >= 0 else F.lit(False)
        n, capped, free = sources.agg(
            F.sum(over.cast("long")), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col(weight)))
        ).first()
        if not n and before < 0 and not free or n == before:
            return level, float(total)
        if not free:  # every source is at its cap: the budget was more than all caps together
            return float("inf"), float(total)
        before, level = n, (budget - (capped or 0.0)) / free


def source_table(sized: DataFrame, scratch: Scratch, weights: Sequence[float]) -> DataFrame:
    """(source, source_size, weight): sources in code-point order, null last, weigh as in weights, repeating.

    The position is found without one task that holds all sources: a range sort, counts per range, and each row's
    place within its range.
    """
    by = F.col("source").asc_nulls_last()
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = scratch.save(sums.repartitionByRange(by).withColumn("part", F.spark_partition_id()), "sources")
    offsets = ranged.groupBy("part").count()
    offsets = offsets.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("offset"))
    place = F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy(by)) - 1
    return ranged.join(F.broadcast(offsets), "part").select(  # a row for each partition of the range sort
        "source", "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")).alias("weight"),
    )


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, budget_ratio, max_epochs, seed):
    spark = docs.sparkSession
    scratch = Scratch(spark)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    order = F.md5(F.concat(F.lit(f"{seed}|"), name, F.lit("|"), F.md5(text_of(text_col).cast("binary"))).cast("binary"))
    slim = scratch.save(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), order.alias("u")), "sized"
    )
    sources = scratch.save(source_table(slim, scratch, weights), "weights")
    level, _ = water_level(sources, "source_size", "weight", budget_ratio, max_epochs)
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    target = F.least(cap, F.lit(level) * F.col("weight")) if level != float("inf") else cap
    whole = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(0).cast("int")
    sources = sources.select("source", "source_size", target.alias("target"), whole.alias("whole"))
    sources = sources.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    # the fractional repetition: documents in seeded order while they bring the words nearer to the target
    few = sources.count() <= BROADCAST_SOURCES
    hint = F.broadcast if few else (lambda df: df)
    cut = sources.select(F.col("source").alias("cs"), F.lit("").alias("cr"), F.lit(0).cast("long").alias("base"), "rest")
    for digits in ORDER_DIGITS:
        # documents of the range that holds the cut so far, summed by the next digits
        inside = slim.join(hint(cut), F.col("source").eqNullSafe(F.col("cs")) & F.col("u").startswith(F.col("cr"))).drop("cs", "cr")
        ranges = inside.groupBy("source", F.substring("u", 1, digits).alias("range"), "base", "rest").agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("range"))  # 4096 rows for a source at most
        ranges = ranges.withColumn("before", F.col("base") + upto - F.col("n"))
        cut = ranges.where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("n")))
        cut = scratch.save(cut.select(F.col("source").alias("cs"), F.col("range").alias("cr"), F.col("before").alias("base"), "rest"), "cut")  # a row for each source at most
    inside = slim.join(hint(cut), F.col("source").eqNullSafe(F.col("cs")) & F.col("u").startswith(F.col("cr")))
    inside = inside.groupBy("source", "u", "base", "rest").agg(F.sum("size").alias("n"))
    w = Window.partitionBy("source").orderBy("u")
    inside = inside.withColumn("upto", F.col("base") + F.sum("n").over(w))
    # a document is taken if at least half of it lies below the target
    last = inside.where(F.col("upto") - F.col("n") / 2 <= F.col("rest")).groupBy("source").agg(F.max("u").alias("u_in"))
    last = last.select(F.col("source").alias("s3"), "u_in")
    cut = cut.select(F.col("cs"), F.col("cr"))
    sources = (
        sources.join(cut, F.col("source").eqNullSafe(F.col("cs")), "left").join(last, F.col("source").eqNullSafe(F.col("s3")), "left")
        # ranges below the one of the cut are taken whole, also where nothing of that one is
        .select("source", "source_size", "target", "whole", F.coalesce("u_in", "cr").alias("u_in"))
    )
    return scratch, slim, scratch.save(sources, "plan"), hint, order


def mix_plan(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(3, 1, 2),
             budget_ratio=1.5, max_epochs=2.0, seed=17) -> DataFrame:
    """Per row of docs: (id, size, source, source_size, target, repeats, taken).

    Sizes are words. The sources' targets are found by capped water-filling (``water_level``). A source's documents
    are all repeated floor(target / size) times; the rest of the target is filled by documents in a seeded order
    (MD5 of seed, id and text), each taken once more if at least half of it lies below the target, so that what is taken
    differs from the target by half a document at most, or half of a group of rows equal in id and text, which share one
    place in the order. Every document of an even larger source costs one
    comparison: the order is cut at one value per source, found from sums over ranges of the order.

    Null sources are one source, which sorts last. Null, empty and blank texts have size 0 and take 0 words. Rows
    equal in id (null or not) and text share a place in the order and are all taken or all left. An empty table
    gives an empty result. Reruns agree: nothing depends on partitioning.
    """
    _, slim, sources, hint, _ = _plan(docs, id_col, text_col, source_col, weights, budget_ratio, max_epochs, seed)
    s = sources.withColumnRenamed("source", "s")
    repeats = F.col("whole") + F.when(F.col("u") <= F.col("u_in"), 1).otherwise(0)
    return slim.join(hint(s), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("id").alias(id_col), "size", "source", "source_size", "target", repeats.alias("repeats"),
        (repeats * F.col("size")).cast("long").alias("taken"),
    )


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(3, 1, 2),
        budget_ratio=1.5, max_epochs=2.0, seed=17) -> DataFrame:
    """The rows of docs that the mix takes, with all their columns and ``repeats`` (1 or more), the number of times
    that each is read. Rules and corner cases as in ``mix_plan``; rows without words are not taken. An input column
    named repeats is replaced. Texts are not shuffled: the source table is broadcast while it has at most
    BROADCAST_SOURCES rows."""
    _, _, sources, hint, order = _plan(docs, id_col, text_col, source_col, weights, budget_ratio, max_epochs, seed)
    s, w, u = fresh(docs, "s", "whole", "u")
    plan = sources.select(F.col("source").alias(s), F.col("whole").alias(w), F.col("u_in").alias(u))
    repeats = F.col(w) + F.when(order <= F.col(u), 1).otherwise(0)
    joined = docs.join(hint(plan), F.col(source_col).eqNullSafe(F.col(s)))
    joined = joined.where((repeats > 0) & (word_count(text_col) > 0))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "repeats"], repeats.cast("int").alias("repeats"))
