"""Windows over events: rates, trends, frequencies, sessions, batches, alerts. All work in event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tumbling(df: DataFrame, width: str = "1 minute", by: tuple[str, ...] = ("event_type",), late: str | None = None) -> DataFrame:
    """(window_start, by..., n) per window. A stream needs late, the watermark's delay."""
    df = df.withWatermark("ts", late) if late else df
    return df.groupBy(F.window("ts", width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def rate(df: DataFrame, width_seconds: int, windows: int) -> DataFrame:
    """(n, per_second): events of the last ``windows`` windows before the newest event's window ends."""
    newest = df.agg(F.max(F.floor(F.unix_seconds("ts") / width_seconds)).alias("last"))
    rows = df.crossJoin(F.broadcast(newest))  # one row
    rows = rows.where(F.floor(F.unix_seconds("ts") / width_seconds) > F.col("last") - windows)
    return rows.agg(F.count("*").alias("n")).withColumn("per_second", F.col("n") / F.lit(float(width_seconds * windows)))


def trend(df: DataFrame, width: str = "1 hour", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """(window_start, by..., n, trend) from each window and the two before it in time.

    More than 1.5 times the first of the three is increasing, less than half decreasing; otherwise volatile where the
    population variance exceeds 0.3 times the first, else stable. Fewer than three windows are stable."""
    w = Window.partitionBy(*by).orderBy("window_start")
    counts = tumbling(df, width, by)
    first, mid = F.lag("n", 2).over(w), F.lag("n", 1).over(w)
    total, squares = first + mid + F.col("n"), first * first + mid * mid + F.col("n") * F.col("n")
    wide = 10 * (3 * squares - total * total) > 27 * first  # variance > 0.3 * first, in whole numbers
    kind = (
        F.when(first.isNull(), "stable").when(2 * F.col("n") > 3 * first, "increasing").when(2 * F.col("n") < first, "decreasing")
        .when(wide, "volatile").otherwise("stable"))
    return counts.withColumn("trend", kind)


def frequency(df: DataFrame, count: int, seconds: int, by: tuple[str, ...] = ("org_id", "event_type"), spans: int = 16) -> DataFrame:
    """df with n_recent, the events of the key in the last seconds (strictly newer than that long ago, itself included),
    and fires, whether they are at least count.

    A key's events are worked on in slices of ``spans`` times the seconds; each event also joins the slice after its own
    where that may look back to it. So a key with most of the events is still many tasks."""
    width = seconds * spans
    at = F.unix_micros("ts")
    slice_of = lambda t: F.floor(t / F.lit(width * 1_000_000))
    own, reach = slice_of(at), slice_of(at + F.lit(seconds * 1_000_000))
    rows = df.withColumn("__s", F.explode(F.array_distinct(F.array(own, reach)))).withColumn("__own", own == F.col("__s"))
    w = Window.partitionBy(*by, "__s").orderBy(F.unix_micros("ts")).rangeBetween(-seconds * 1_000_000 + 1, 0)
    rows = rows.withColumn("n_recent", F.count("*").over(w)).where("__own").drop("__s", "__own")
    return rows.withColumn("fires", F.col("n_recent") >= count)


def rate_limited(df: DataFrame, most: int, seconds: int, by: tuple[str, ...] = ("org_id",)) -> DataFrame:
    """The first ``most`` events of each key in every period of so many seconds, by time and sequence."""
    w = Window.partitionBy(*by, F.floor(F.unix_seconds("ts") / seconds)).orderBy("ts", "sequence")
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def sessions(df: DataFrame, gap: str = "30 minutes", by: tuple[str, ...] = ("org_id",), late: str | None = None) -> DataFrame:
    """(by..., session_start, session_end, n): runs of events with less than gap between them; the end is gap after the last."""
    df = df.withWatermark("ts", late) if late else df
    return df.groupBy(*by, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select(*by, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def scope() -> Column:
    """What an event is batched under: its transaction, else its organisation, else all."""
    txn = F.coalesce(F.col("correlation_id"), F.get_json_object("data", "$.transaction_id"))
    return F.coalesce(F.concat(F.lit("txn:"), txn), F.concat(F.lit("org:"), F.col("org_id").cast("string")), F.lit("global"))


def batched(df: DataFrame, size: int = 100, age_seconds: int = 5) -> DataFrame:
    """df with scope and batch: events of a scope in time order, cut where age_seconds have passed since the slice of time
    began, and then every size events.

    A slice is a fixed period of time, so that no scope is worked through in one row after another; a hot scope is divided
    by its periods."""
    rows = df.withColumn("scope", scope()).withColumn("slice", F.floor(F.unix_seconds("ts") / age_seconds))
    w = Window.partitionBy("scope", "slice").orderBy("ts", "sequence")
    return rows.withColumn("batch", F.concat_ws("-", "slice", F.floor((F.row_number().over(w) - 1) / size).cast("string"))).drop("slice")


def outcome(df: DataFrame, failed: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., processed, failures, error_rate)."""
    out = df.groupBy(*by).agg(F.count("*").alias("processed"), F.sum(failed.cast("long")).alias("failures"))
    return out.withColumn("error_rate", F.when(F.col("processed") > 0, F.col("failures") / F.col("processed")).otherwise(0.0))


def top_types(df: DataFrame, now: Column, k: int = 10, span_seconds: int = 3600) -> DataFrame:
    """(event_type, n): the most frequent types in the span before now, ties by name."""
    recent = df.where((F.col("ts") <= now) & (F.col("ts") > now - F.make_interval(secs=F.lit(span_seconds))))
    return recent.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(k)


def severity(value: Column, limit: float, worst: str = "critical") -> Column:
    """Null up to the limit, warning above it, worst above twice the limit."""
    return F.when(value > 2 * limit, worst).when(value > limit, "warning")


def health(latency_ms: Column, error_rate: Column, per_second: Column, backlog: Column) -> Column:
    """unhealthy, degraded or healthy by the usual thresholds: 1000 ms, 5 %, 10 a second, 10,000 waiting."""
    bad = (latency_ms > 1000).cast("int") + (error_rate > 0.05).cast("int") + (per_second < 10).cast("int") + (backlog > 10_000).cast("int")
    return F.when(bad == 0, "healthy").when(bad == 1, "degraded").otherwise("unhealthy")
