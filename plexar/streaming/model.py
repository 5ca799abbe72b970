"""The event row: schema, kinds, topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT_SCHEMA = (
    "event_id string, org_id bigint, event_type string, kind string, ts timestamp, topic string, data string, source string, "
    "correlation_id string, causation_id string, version string, attributes map<string,string>, sequence bigint"
)
#: The presets of event types by prefix.
DATABASE_TYPES = ("row.inserted", "row.updated", "row.deleted", "table.created", "table.dropped", "schema.changed")
USER_TYPES = ("user.created", "user.updated", "user.deleted", "user.login", "user.logout", "signup", "purchase", "view", "click")
SYSTEM_TYPES = ("system.startup", "system.shutdown", "system.error", "health.check", "error")


def topic_of(kind: Column, event_type: Column, ident: Column, op: Column | None = None) -> Column:
    """The topic that an event is published under, by its kind."""
    t = F.concat_ws
    return (
        F.when(kind == "job", t("/", F.lit("jobs"), ident))
        .when(kind == "database", t("/", F.lit("tables"), ident, event_type))
        .when(kind == "change", t("/", F.lit("tables"), ident, op if op is not None else F.lit("change"), event_type))
        .when(kind == "user", t("/", F.lit("users"), ident, event_type))
        .when(kind == "system", t("/", F.lit("system"), ident, event_type))
        .when(kind == "collection", t("/", F.lit("collections"), ident, event_type))
        .when(kind == "transaction", t("/", F.lit("transactions"), ident, event_type))
        .otherwise(t("/", F.lit("custom"), event_type))
    )


def from_clicks(df: DataFrame, orgs: int = 4) -> DataFrame:
    """The driver's events table (event_id, ts, user_id, event_type, value, props) as events: user events, whose
    organisation is user_id modulo orgs. Batch and streaming frames alike."""
    user = F.col("user_id").cast("string")
    return df.select(
        F.col("event_id").cast("string").alias("event_id"), F.pmod("user_id", F.lit(orgs)).cast("bigint").alias("org_id"), "event_type", F.lit("user").alias("kind"),
        F.col("ts").cast("timestamp").alias("ts"), topic_of(F.lit("user"), F.col("event_type"), user).alias("topic"), F.col("props").alias("data"), F.lit("events").alias("source"),
        F.lit(None).cast("string").alias("correlation_id"), F.lit(None).cast("string").alias("causation_id"), F.lit("1").alias("version"),
        F.create_map(F.lit("user_id"), user, F.lit("value"), F.col("value").cast("string")).alias("attributes"), F.col("event_id").cast("bigint").alias("sequence"))


def user_of() -> Column:
    return F.col("attributes")["user_id"]
