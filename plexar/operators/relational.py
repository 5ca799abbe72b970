"""Relational operators that Spark does not have under one name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def qualify(df: DataFrame, table: str) -> DataFrame:
    """Columns renamed to table.column, as the results of joins name them."""
    return df.select(*[F.col(f"`{c}`").alias(f"{table}.{c}") for c in df.columns])


def join(left: DataFrame, right: DataFrame, names: tuple[str, str], on: tuple[str, str], how: str = "inner") -> DataFrame:
    """Equi-join with both sides' columns as table.column. Null keys match nothing; outer joins keep all of their side."""
    l, r = qualify(left, names[0]), qualify(right, names[1])
    return l.join(r, F.col(f"`{names[0]}.{on[0]}`") == F.col(f"`{names[1]}.{on[1]}`"), how)


def first_rows(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The first rows in key order (not a random sample); none for limit 0."""
    return df.orderBy(F.col(key).asc_nulls_last()).limit(max(limit, 0))


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page number (from 1; 0 is the first too) of the ordered rows."""
    return df.orderBy(*order).offset(max(number - 1, 0) * size).limit(size)


def summary(df: DataFrame, col: str, kind: str = "double") -> DataFrame:
    """One row (min, max, sum, count) in one pass; zeros for an empty input. Integers are summed as long."""
    c = F.col(col).cast(kind)
    zero = F.lit(0).cast(kind)
    return df.agg(F.coalesce(F.min(c), zero).alias("min"), F.coalesce(F.max(c), zero).alias("max"), F.coalesce(F.sum(c), zero).alias("sum"), F.count(c).alias("count"))


def percentiles(df: DataFrame, value: str, points: Sequence[int], by: Sequence[str] = (), ranges: int = 200) -> DataFrame:
    """(by..., point, value): the value at index floor(n * p / 100) of the sorted values, for every group.

    Exact, and no group is sorted in one task: sketched quantiles cut each group's values into ranges, the ranges are
    counted, and only the range that holds a point's index is sorted. Nulls do not count."""
    keys = list(by) or ["__all"]
    rows = (df if by else df.withColumn("__all", F.lit(0))).where(F.col(value).isNotNull())
    sketch = rows.groupBy(*keys).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10_000).alias("__b"), F.count("*").alias("__n"))
    at = F.size(F.filter("__b", lambda b: b < F.col(value))).alias("__r")
    placed = rows.select(*keys, value).join(sketch, keys).select(*keys, F.col(value).alias("value"), "__n", at)
    counts = placed.groupBy(*keys, "__n", "__r").agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__r"))  # as many rows as ranges
    counts = counts.withColumn("__before", upto - F.col("__c")).withColumn("point", F.explode(F.array(*map(F.lit, points))))
    index = F.least(F.floor(F.col("__n") * F.col("point") / 100), F.col("__n") - 1)
    holding = counts.where((F.col("__before") <= index) & (index < F.col("__before") + F.col("__c")))
    holding = holding.select(*keys, "__r", "point", (index - F.col("__before") + 1).alias("__k"))
    near = placed.select(*keys, "__r", "value").join(holding, [*keys, "__r"])
    w = Window.partitionBy(*keys, "point").orderBy("value")
    return near.withColumn("__i", F.row_number().over(w)).where(F.col("__i") == F.col("__k")).select(*by, "point", "value")


def running_percentile_approx(df: DataFrame, value: str, points: Sequence[int], by: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """The same by sketch, for groups of any size: one aggregate, bounded error."""
    return df.groupBy(*by).agg(F.percentile_approx(value, [p / 100 for p in points], accuracy).alias("values"))


def bucket_quality(df: DataFrame, cols: Sequence[str], n: int) -> DataFrame:
    """(rows, mean, variance, score): how evenly a hash deals the rows to n buckets; score 1 is even."""
    from plexar.functions.scalar import bucket

    counts = df.groupBy(bucket(list(cols), n).alias("b")).count()
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left")
    c = F.coalesce(F.col("count"), F.lit(0))
    out = every.agg(F.sum(c).alias("rows"), F.avg(c).alias("mean"), F.var_pop(c).alias("variance"))
    return out.withColumn("score", F.when(F.col("mean") == 0, 1.0).otherwise(1 / (1 + F.col("variance") / (F.col("mean") * F.col("mean")))))


def selected(values: DataFrame, col: str, op: str, constant: object) -> DataFrame:
    """Indices of the elements of an array column that compare true: the selection vector of a columnar filter."""
    ops = {"==": lambda x: x == constant, ">": lambda x: x > constant, "<": lambda x: x < constant, ">=": lambda x: x >= constant, "<=": lambda x: x <= constant}
    if op not in ops:
        raise ValueError(f"unknown operator: {op}")
    return values.select(F.posexplode(col).alias("index", "value")).where(ops[op](F.col("value"))).select("index")


def dense_ids(df: DataFrame, name: str = "_id", start: int = 0) -> DataFrame:
    """Adds dense ids from start, in partition order: counts per partition, then a place within it. No single task
    sees all rows; the input is read twice, so it should be a table or written."""
    from pyspark.sql import types as T

    parted = df.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    counts = parted.groupBy("__p").count()
    offsets = counts.select(F.col("__p").alias("__q"), (F.sum("count").over(Window.orderBy("__p")) - F.col("count") + start).alias("__o"))
    place = F.col("__m") - F.shiftleft(F.col("__p").cast(T.LongType()), 33)
    out = parted.join(F.broadcast(offsets), F.col("__p") == F.col("__q"))  # a row for each partition
    return out.select((F.col("__o") + place).alias(name), *[F.col(f"`{c}`") for c in df.columns])


def ordered_ids(df: DataFrame, order: Sequence[str], name: str = "_id", start: int = 0) -> DataFrame:
    """Adds dense ids from start, in the order of columns that tell all rows apart. Ranges of the order are written with
    their number, so that counts and places agree whatever is computed again; a place is found within its range."""
    from plexar.operators.graph_algo import Rounds

    ranged = Rounds(df.sparkSession).save(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("__p").count()
    offsets = counts.select("__p", (F.sum("count").over(Window.orderBy("__p")) - F.col("count") + start - 1).alias("__o"))
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    out = ranged.join(F.broadcast(offsets), "__p").withColumn("__i", place)  # a row for each range
    return out.select((F.col("__o") + F.col("__i")).alias(name), *[F.col(f"`{c}`") for c in df.columns])
