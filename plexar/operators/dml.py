"""Changes as transformations: each gives the table's next version, which the table store swaps in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Columns that rows lack become null; those that the table lacks are an error."""
    extra = set(rows.columns) - set(table.columns)
    if extra:
        raise ValueError(f"no such column: {sorted(extra)}")
    return table.unionByName(rows.select(*[(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema]))


def update(table: DataFrame, sets: dict[str, Column | object], where: Column | None = None) -> DataFrame:
    """Rows where the condition holds (not null, not false) get the values; expressions see the old row."""
    if not sets:
        raise ValueError("UPDATE needs at least one SET")
    missing = set(sets) - set(table.columns)
    if missing:
        raise ValueError(f"no such column: {sorted(missing)}")
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    new = {c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(f"`{c}`")).cast(table.schema[c].dataType) for c, v in sets.items()}
    return table.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in table.columns])


def delete(table: DataFrame, where: Column | None = None, limit: int | None = None, key: str | None = None, confirm_all: bool = False) -> DataFrame:
    """The rows that stay. Without a condition it must be confirmed. A limit deletes the first rows in key order."""
    if where is None and not confirm_all:
        raise ValueError("DELETE without a condition must be confirmed")
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    if limit is None:
        return table.where(~hit)
    if key is None:
        raise ValueError("DELETE with a limit needs a key")
    gone = table.where(hit).select(key).orderBy(key).limit(limit)
    return table.join(gone, key, "left_anti")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], conflict: str = "fail", columns: list[str] | None = None) -> DataFrame:
    """Insert with a rule for keys that are there already: fail, ignore, replace or update (of the named columns).

    Of new rows with one key the last is meant to be unique; repeats among them are an error under fail and one of them
    wins otherwise (the greatest by its columns, so that reruns agree)."""
    full = rows.select(*[(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema])
    if conflict == "fail":
        both = table.select(*keys).unionByName(full.select(*keys))
        if not both.groupBy(*keys).count().where(F.col("count") > 1).isEmpty():
            raise ValueError("duplicate key")
        return table.unionByName(full)
    w = Window.partitionBy(*keys).orderBy(*[F.col(f"`{c}`").desc_nulls_last() for c in table.columns if c not in keys] or [F.lit(1)])
    full = full.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n")
    if conflict == "ignore":
        return table.unionByName(full.join(table.select(*keys), keys, "left_anti"))
    if conflict == "replace":
        return table.join(full.select(*keys), keys, "left_anti").unionByName(full)
    if conflict != "update":
        raise ValueError(f"unknown conflict rule: {conflict}")
    names = columns or [c for c in rows.columns if c not in keys]
    new = full.select(*keys, *[F.col(f"`{c}`").alias(f"__{c}") for c in table.columns if c not in keys], F.lit(True).alias("__new"))
    old = table.withColumn("__old", F.lit(True)).join(new, keys, "full")
    pick = lambda c: F.when(F.col("__old").isNull(), F.col(f"`__{c}`")).when(F.col("__new").isNotNull(), F.col(f"`__{c}`") if c in names else F.col(f"`{c}`")).otherwise(F.col(f"`{c}`"))
    return old.select(*[(F.col(f"`{c}`") if c in keys else pick(c).alias(c)) for c in table.columns])
