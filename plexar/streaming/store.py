"""Event store: an append-only table partitioned by organisation and type, replay, snapshots, compaction; and changes
between two versions of a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexar.streaming.filters import stream_filter
from plexar.streaming.model import EVENT_SCHEMA

MOST_ROWS = 1000
SNAPSHOT_EVERY = 1000


@dataclass
class EventStore:
    spark: SparkSession
    path: str

    def events(self) -> DataFrame:
        from plexar.sources.tables import Files

        files = Files(self.spark)
        if not files.exists(f"{self.path}/events") and files.exists(f"{self.path}/events.new/_SUCCESS"):
            self._move("events.new", "events")  # a compaction ended between its two renames
        if not files.exists(f"{self.path}/events"):
            return self.spark.createDataFrame([], EVENT_SCHEMA)
        return self.spark.read.schema(EVENT_SCHEMA).parquet(f"{self.path}/events")

    def append(self, events: DataFrame) -> int:
        """Gives the events the next sequence numbers, in order of time and id, and appends them."""
        from plexar.operators.graph_algo import Rounds
        from plexar.operators.relational import ordered_ids

        last = self.events().agg(F.max("sequence")).first()[0]
        rows = ordered_ids(events.drop("sequence"), ["ts", "event_id"], "sequence", 1 if last is None else last + 1)
        rows = Rounds(self.spark).save(rows, "append")
        names = [f.split()[0] for f in EVENT_SCHEMA.split(", ")]
        rows.select(*names).write.mode("append").partitionBy("org_id", "event_type").parquet(f"{self.path}/events")
        return rows.count()

    def between(self, first: str, last: str, limit: int = MOST_ROWS) -> DataFrame:
        """Events by id, both ends included."""
        return self.events().where(F.col("event_id").between(first, last)).orderBy("event_id").limit(min(limit, MOST_ROWS))

    def query(self, orgs=(), types=(), topics=(), start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
        """Events in order of sequence; organisation and type prune partitions."""
        return stream_query(self.events(), orgs, types, topics, start, end, limit)

    def replay(self, first: int, last: int) -> DataFrame:
        return self.events().where(F.col("sequence").between(first, last)).orderBy("sequence")

    def snapshot(self, aggregate: Column, state: Column) -> DataFrame:
        """Writes and returns (aggregate, state, sequence): the latest state of every aggregate."""
        out = latest_state(self.events(), aggregate, state)
        out.write.mode("overwrite").parquet(f"{self.path}/snapshots")
        return self.spark.read.parquet(f"{self.path}/snapshots")

    def snapshot_due(self) -> bool:
        from plexar.sources.tables import Files

        last = self.events().agg(F.max("sequence")).first()[0] or 0
        if not Files(self.spark).exists(f"{self.path}/snapshots"):
            return last >= SNAPSHOT_EVERY
        done = self.spark.read.parquet(f"{self.path}/snapshots").agg(F.max("sequence")).first()[0] or 0
        return last - done >= SNAPSHOT_EVERY

    def compact(self, before: str) -> int:
        """Removes events older than a time; returns how many. The new version is whole before the old one moves away,
        so a crash loses nothing: ``events`` ends a switch that was begun."""
        from plexar.sources.tables import Files

        files, old = Files(self.spark), self.events()
        kept = compacted(old, before)
        n = old.count() - kept.count()
        kept.write.mode("overwrite").partitionBy("org_id", "event_type").parquet(f"{self.path}/events.new")
        files.delete(f"{self.path}/events.old")
        self._move("events", "events.old")
        self._move("events.new", "events")
        files.delete(f"{self.path}/events.old")
        return n

    def _move(self, old: str, new: str) -> None:
        from plexar.sources.tables import Files

        files = Files(self.spark)
        p, fs = files._fs(f"{self.path}/{old}")
        if not fs.rename(p, files._fs(f"{self.path}/{new}")[0]):
            raise OSError(f"cannot rename {p}")

    def stats(self) -> DataFrame:
        return stats(self.events())


def stream_query(events: DataFrame, orgs=(), types=(), topics=(), start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
    cond = stream_filter(types, orgs, topics, mode="segment")
    if start:
        cond &= F.col("ts") >= F.lit(start).cast("timestamp")
    if end:
        cond &= F.col("ts") <= F.lit(end).cast("timestamp")
    out = events.where(cond).orderBy("sequence")
    return out if limit is None else out.limit(limit)


def latest_state(events: DataFrame, aggregate: Column, state: Column) -> DataFrame:
    return events.groupBy(aggregate.alias("aggregate")).agg(F.max_by(state, "sequence").alias("state"), F.max("sequence").alias("sequence"))


def compacted(events: DataFrame, before: str) -> DataFrame:
    return events.where(F.col("ts") >= F.lit(before).cast("timestamp"))


def stats(events: DataFrame) -> DataFrame:
    """(org_id, event_type, n, oldest, newest)."""
    return events.groupBy("org_id", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., operation, old_values, new_values, changed): what turned one version of a table into another.

    Values are JSON text; changed names the columns that differ. Keys must be unique and not null in both."""
    cols = [c for c in new.columns if c not in keys]
    pack = lambda df, name: df.select(*keys, F.struct(*[F.col(f"`{c}`") for c in cols]).alias(name))
    both = pack(old, "o").join(pack(new, "n"), keys, "full")
    op = F.when(F.col("o").isNull(), "INSERT").when(F.col("n").isNull(), "DELETE").otherwise("UPDATE")
    differ = F.filter(F.array(*[F.when(~F.col("o")[c].eqNullSafe(F.col("n")[c]), F.lit(c)) for c in cols]), lambda x: x.isNotNull())
    out = both.withColumn("operation", op).withColumn("changed", differ)
    out = out.where((F.col("operation") != "UPDATE") | (F.size("changed") > 0))
    return out.select(*keys, "operation", F.to_json("o").alias("old_values"), F.to_json("n").alias("new_values"), "changed")


def change_filter(tables=(), operations=(), users=(), orgs=()) -> Column:
    """Row changes by the columns table_name, operation, user_id and org_id; empty parts hold."""
    from plexar.streaming.filters import every

    parts = [(tables, "table_name"), (operations, "operation"), (users, "user_id"), (orgs, "org_id")]
    return every([F.coalesce(F.col(c).isin(*want), F.lit(False)) for want, c in parts if want])


def trigger_rows(changed: DataFrame, least: int | None = None, most: int | None = None, columns: list[str] = (), key: str = "row_id") -> DataFrame:  # type: ignore[assignment]
    """Row changes (with rows_affected, changed, sequence) that a table trigger takes: within the bounds of rows affected,
    with one of the columns changed, the last change of each row."""
    cond = F.lit(True)
    if least is not None:
        cond &= F.col("rows_affected") >= least
    if most is not None:
        cond &= F.col("rows_affected") <= most
    if columns:
        cond &= F.arrays_overlap("changed", F.array(*map(F.lit, columns)))
    w = Window.partitionBy(key).orderBy(F.desc("sequence"))
    return changed.where(cond).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def transactions(events: DataFrame, txn: Column) -> DataFrame:
    """(txn, state, operations, begun, ended, seconds): events of a transaction put together."""
    t = F.col("event_type")
    out = events.groupBy(txn.alias("txn")).agg(
        F.max(F.when(t == "transaction.committed", 3).when(t == "transaction.rolled_back", 2).when(t == "transaction.aborted", 1).otherwise(0)).alias("s"),
        F.count(F.when(~t.startswith("transaction."), 1)).alias("operations"), F.min("ts").alias("begun"), F.max("ts").alias("ended"))
    state = F.element_at(F.array(*map(F.lit, ["begun", "aborted", "rolled back", "committed"])), F.col("s") + 1)
    return out.select("txn", state.alias("state"), "operations", "begun", "ended", (F.unix_micros("ended") - F.unix_micros("begun")).cast("double").alias("micros"))


def invalidated(keys: DataFrame, rules: list[dict], event: dict) -> DataFrame:
    """Cache keys (column key, 'org:category:parts') that an event makes stale, by rules {type, table, operation, keys, priority}:
    those of matching rules, a key pattern with * each, the greatest priority given."""
    from plexar.functions.scalar import topic_pattern

    hits = [r for r in rules if all(r.get(k) in (None, event.get(k)) for k in ("type", "table", "operation"))]
    best = None
    for r in sorted(hits, key=lambda r: -r.get("priority", 0)):
        c = F.col("key").rlike(topic_pattern(r["keys"].format(**event), "glob"))
        best = F.when(c, r.get("priority", 0)) if best is None else best.when(c, r.get("priority", 0))
    if best is None:
        return keys.limit(0).withColumn("priority", F.lit(0))
    return keys.withColumn("priority", best).where(F.col("priority").isNotNull())
