"""Who gets which events: webhook endpoints, channels, subscriptions, delivery order, schedules. All are columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexar.functions.scalar import json_path, topic_match
from plexar.streaming.filters import every, some, stream_filter
from plexar.streaming.model import user_of


def endpoint(spec: dict) -> Column:
    """What a webhook endpoint takes: {active, types, topics, org}. An inactive one takes nothing; empty parts hold."""
    if not spec.get("active", True):
        return F.lit(False)
    orgs = [spec["org"]] if spec.get("org") is not None else []
    return stream_filter(spec.get("types", ()), orgs, spec.get("topics", ()), mode="segment")


def channel(kind: str, key: object = None) -> Column:
    """Events of a channel: org, room (attribute room), user, table (changes of a table) or system."""
    kinds = {
        "org": lambda: F.col("org_id") == key, "room": lambda: F.col("attributes")["room"] == str(key), "user": lambda: user_of() == str(key),
        "table": lambda: json_path("data", "table_name") == str(key), "system": lambda: F.col("kind") == "system",
    }
    if kind not in kinds:
        raise ValueError(f"unknown channel: {kind}")
    return F.coalesce(kinds[kind](), F.lit(False))


def subscription(org: int, include: list[str] = (), exclude: list[str] = (), start: str | None = None, end: str | None = None, contents: list[Column] = ()) -> Column:  # type: ignore[assignment]
    """What a data subscription lets through: its organisation first, any of the included topics (all where none are named),
    none of the excluded ones, the span of time, all content conditions."""
    parts = [F.col("org_id") == org, *contents]
    if include:
        parts.append(some([topic_match("topic", p) for p in include]))
    if exclude:
        parts.append(~some([topic_match("topic", p) for p in exclude]))
    if start:
        parts.append(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        parts.append(F.col("ts") <= F.lit(end).cast("timestamp"))
    return every(parts)


def ordered(df: DataFrame, guarantee: str, partitions: int | None = None) -> DataFrame:
    """A batch in the promised order: none, timestamp and sequence over all rows, partitioned by sequence within each
    organisation's partition, global by time and sequence."""
    if guarantee == "none":
        return df
    if guarantee == "partitioned":
        parts = df.repartition(partitions, "org_id") if partitions else df.repartition("org_id")
        return parts.sortWithinPartitions("org_id", "sequence")
    keys = {"timestamp": ("ts", "event_id"), "sequence": ("sequence",), "global": ("ts", "sequence")}
    if guarantee not in keys:
        raise ValueError(f"unknown guarantee: {guarantee}")
    return df.orderBy(*keys[guarantee])


def _cron_field(spec: str, value: Column, low: int, high: int) -> Column:
    out = []
    for part in spec.split(","):
        span, _, step = part.partition("/")
        a, b = (low, high) if span == "*" else (int(x) for x in (span.split("-") if "-" in span else (span, span if not step else high)))
        if not low <= a <= b <= high:
            raise ValueError(f"cron field out of range: {spec}")
        cond = value.between(a, b)
        out.append(cond & ((value - a) % int(step) == 0) if step else cond)
    return some(out)


def cron_due(expression: str, ts: Column) -> Column:
    """Whether a task with a cron expression (minute hour day month weekday, UTC, Sunday 0) is due in the minute of ts.
    Where both days are restricted, either will do."""
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError("a cron expression has five fields")
    minute, hour, day, month, week = fields
    days = _cron_field(day, F.dayofmonth(ts), 1, 31)
    weekdays = _cron_field(week.replace("7", "0") if week == "7" else week, F.dayofweek(ts) - 1, 0, 6)
    both = days | weekdays if day != "*" and week != "*" else days & weekdays
    return _cron_field(minute, F.minute(ts), 0, 59) & _cron_field(hour, F.hour(ts), 0, 23) & _cron_field(month, F.month(ts), 1, 12) & both


def transform(df: DataFrame, fields: dict[str, Column], drop: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """Field transformations of a handler: columns replaced or added, others dropped."""
    return df.withColumns(fields).drop(*drop)
