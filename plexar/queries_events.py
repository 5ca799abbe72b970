"""Event queries, batch and streaming. A streaming query drains its source and must give what its batch form gives."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plexar.functions.scalar import topic_match
from plexar.operators.graph_algo import checkpoint_dir
from plexar.registry import query
from plexar.streaming import filters as ff
from plexar.streaming import channels, live, store, windows
from plexar.streaming.model import from_clicks, user_of


def _events(t):
    return from_clicks(t("events"))


_ID = "event_id::VARCHAR AS event_id"
_K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"


@query(f"SELECT {_ID}, user_id % 4 AS org_id, 'users/' || user_id || '/' || event_type AS topic FROM events")
def event_model(t):
    return _events(t).select("event_id", "org_id", "topic")


@query(f"SELECT {_ID} FROM events WHERE event_type IN ('click', 'view') AND user_id % 4 IN (1, 2) AND (user_id::VARCHAR || '/' || event_type) LIKE '1%/click'")
def event_stream_filter(t):
    return _events(t).where(ff.stream_filter(["click", "view"], [1, 2], ["users/1*/click"])).select("event_id")


@query(f"SELECT {_ID} FROM events WHERE event_type = 'purchase'")
def event_topic_segments(t):
    e = _events(t)
    return e.where(topic_match("topic", "users/*/purchase") & topic_match("topic", "**/purchase") & ~topic_match("topic", "users/purchase")).select("event_id")


@query(f"SELECT {_ID} FROM events WHERE {_K} > 20 AND {_K} < 80 AND json_extract_string(props, '$.k') <> '50' AND json_extract_string(props, '$.k') LIKE '%3%'")
def event_content(t):
    c = ff.content("k", "greater_than", 20) & ff.content("k", "less_than", 80) & ff.content("k", "not_equals", "50") & ff.content("k", "contains", "3")
    return _events(t).where(c).select("event_id")


@query(f"SELECT {_ID} FROM events WHERE json_extract_string(props, '$.k') IN ('7', '8', '17') OR regexp_matches(json_extract_string(props, '$.k'), '^4[0-5]$')")
def event_content_sets(t):
    return _events(t).where(ff.content("k", "in", [7, 8, 17]) | ff.content("k", "regex", "^4[0-5]$") | ff.content("missing", "not_in", [1])).select("event_id")


@query(f"SELECT {_ID} FROM events WHERE hour(ts) >= 9 AND hour(ts) < 17 AND dayname(ts) IN ('Monday', 'Tuesday')")
def event_times(t):
    return _events(t).where(ff.during_hours("09:00-17:00") & ff.on_days(["Monday", "tue"])).select("event_id")


@query(f"SELECT {_ID} FROM events WHERE ts > (SELECT min(ts) + INTERVAL 1 HOUR FROM events) AND ts < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def event_time_range(t):
    e = _events(t)
    lo, hi = e.agg((F.min("ts") + F.expr("INTERVAL 1 HOUR")).cast("string"), (F.max("ts") - F.expr("INTERVAL 1 HOUR")).cast("string")).first()
    return e.where(ff.after(lo) & ff.before(hi)).select("event_id")


@query("SELECT (user_id % 4)::BIGINT AS org_id, 1::BIGINT AS partitions, true AS inside, count(*) AS n FROM events GROUP BY ALL")
def event_partitions(t):
    """All events of an organisation go to one partition of the sixty-four."""
    p = _events(t).withColumn("p", ff.partition_key("org", 64)).groupBy(F.col("org_id").cast("long").alias("org_id"), "p").count()
    return p.groupBy("org_id").agg(F.count("p").alias("partitions"), F.every(F.col("p").between(0, 63)).alias("inside"), F.sum("count").alias("n"))


@query(f"SELECT {_ID}, event_type FROM events")
def event_dedup(t):
    e = _events(t)
    return ff.deduplicate(e.unionByName(e.where("sequence % 3 = 0"))).select("event_id", "event_type")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT event_type, user_id % 4, props FROM events)")
def event_dedup_content(t):
    return ff.deduplicate(_events(t).withColumn("h", ff.content_hash()), keys=("h",)).agg(F.count("*").alias("n"))


@query(f"SELECT {_ID} FROM events WHERE user_id IN (1, 2, 3, 4, 5, 6) AND event_type IN ('view', 'error')")
def event_filter_users(t):
    return _events(t).where(ff.event_filter(users=[1, 2, 3, 4, 5, 6], types=["view", "error"])).select("event_id")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('signup', 'purchase', 'view', 'click', 'error') GROUP BY event_type")
def event_presets(t):
    return _events(t).where(ff.user_activity() | ff.system_events() | ff.database_changes()).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"SELECT {_ID} FROM events WHERE user_id = 9")
def event_permissions(t):
    return _events(t).where(ff.permitted("9", 1, ["read"])).select("event_id")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_tumbling(t):
    return windows.tumbling(_events(t), "1 hour").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH m AS (SELECT max(floor(epoch(ts) / 3600)) AS l FROM events)
SELECT count(*) AS n, round(count(*) / (3600.0 * 5), 9) AS per_second FROM events, m WHERE floor(epoch(ts) / 3600) > l - 5""")
def event_rate(t):
    return windows.rate(_events(t), 3600, 5).withColumn("per_second", F.round("per_second", 9))


@query("""WITH c AS (SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL),
l AS (SELECT *, lag(n, 2) OVER w AS a, lag(n, 1) OVER w AS b FROM c WINDOW w AS (PARTITION BY event_type ORDER BY window_start))
SELECT window_start, event_type, n, CASE WHEN a IS NULL THEN 'stable' WHEN 2 * n > 3 * a THEN 'increasing' WHEN 2 * n < a THEN 'decreasing'
  WHEN 10 * (3 * (a * a + b * b + n * n) - (a + b + n) * (a + b + n)) > 27 * a THEN 'volatile' ELSE 'stable' END AS trend FROM l""")
def event_trend(t):
    return windows.trend(_events(t)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"""SELECT {_ID}, count(*) OVER w AS n_recent, count(*) OVER w >= 3 AS fires FROM events
WINDOW w AS (PARTITION BY user_id % 4, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 1799999999 PRECEDING AND CURRENT ROW)""")
def event_frequency(t):
    return windows.frequency(_events(t), 3, 1800).select("event_id", "n_recent", "fires")


@query(f"SELECT {_ID} FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 4, floor(epoch(ts) / 3600) ORDER BY ts, event_id) <= 5")
def event_rate_limit(t):
    return windows.rate_limited(_events(t), 5, 3600).select("event_id")


@query("""WITH g AS (SELECT user_id % 4 AS org_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id % 4 ORDER BY ts)),
n AS (SELECT org_id, ts, sum(s) OVER (PARTITION BY org_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT org_id, min(ts) AS session_start, max(ts) + INTERVAL 10 MINUTE AS session_end, count(*) AS n FROM n GROUP BY org_id, k""")
def event_sessions(t):
    s = windows.sessions(_events(t), "10 minutes")
    return s.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query(f"""SELECT {_ID}, floor(epoch(ts) / 3600)::BIGINT || '-' || floor((row_number() OVER (PARTITION BY user_id % 4, floor(epoch(ts) / 3600) ORDER BY ts, event_id) - 1) / 10)::BIGINT AS batch FROM events""")
def event_batches(t):
    return windows.batched(_events(t), 10, 3600).select("event_id", "batch")


@query(f"SELECT {_ID} FROM events WHERE (event_type = 'error' OR ({_K} >= 90 AND user_id % 4 = 2)) AND NOT event_type = 'view' AND (hour(ts) >= 22 OR hour(ts) <= 5)")
def trigger_conditions(t):
    spec = {"and": [{"or": [{"type": "error"}, {"and": [{"data": ["k", "greater_or_equal", 90]}, {"org": [2]}]}]}, {"not": [{"type": "view"}]}, {"hours": [22, 5]}, {"topic": "users/*/*"}, {"metadata": ["source", "equals", "events"]}]}
    return _events(t).where(ff.condition(spec)).select("event_id")


@query(f"""SELECT {_ID}, (event_type = 'click' AND user_id % 4 = 1) OR coalesce({_K} > 95, false) AS passed,
greatest((CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END + CASE WHEN user_id % 4 = 1 THEN 1.0 ELSE 0 END) / 2.0, CASE WHEN coalesce({_K} > 95, false) THEN 0.7 ELSE 0 END)::DOUBLE AS score FROM events""")
def rule_scores(t):
    passed, score = ff.rule(F.col("event_type") == "click", [F.col("org_id") == 1], [("or", [(ff.content("k", "greater_than", 95), 0.7)])])
    return _events(t).select("event_id", passed.alias("passed"), score.alias("score"))


@query(f"SELECT {_ID}, CASE WHEN event_type = 'purchase' THEN 'sales' WHEN event_type = 'error' THEN 'alerts' ELSE 'default_stream' END AS stream FROM events")
def event_routes(t):
    return _events(t).select("event_id", ff.route([(F.col("event_type") == "purchase", "sales"), (F.col("event_type") == "error", "alerts")]).alias("stream"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts > (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3")
def event_top_types(t):
    e = _events(t)
    return windows.top_types(e, F.lit(e.agg(F.max("ts")).first()[0]), 3)


@query("""SELECT event_type, CASE WHEN avg(value) > 80 THEN 'critical' WHEN avg(value) > 40 THEN 'warning' END AS severity FROM events GROUP BY event_type""")
def event_alerts(t):
    return t("events").groupBy("event_type").agg(windows.severity(F.avg("value"), 40.0).alias("severity"))


@query(f"SELECT {_ID}, event_id AS sequence FROM events WHERE user_id % 4 = 3 AND event_type = 'click' ORDER BY events.event_id LIMIT 40")
def event_store_query(t):
    return store.stream_query(_events(t), [3], ["click"], ["users/*/click"], limit=40).select("event_id", "sequence")


@query("SELECT user_id % 4 AS org_id, event_type, count(*) AS n, min(ts) AS oldest, max(ts) AS newest FROM events GROUP BY ALL")
def event_store_stats(t):
    return store.stats(_events(t)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("oldest", "newest")})


@query("SELECT user_id::VARCHAR AS aggregate, max_by(event_type, event_id) AS state, max(event_id) AS sequence FROM events GROUP BY user_id")
def event_snapshots(t):
    return store.latest_state(_events(t), user_of(), F.col("event_type"))


@query(f"SELECT {_ID}, event_type FROM events WHERE ts >= (SELECT min(ts) + INTERVAL 2 HOUR FROM events)")
def event_compaction(t):
    s = store.EventStore(t.spark, f"{checkpoint_dir(t.spark)}/events-{uuid.uuid4().hex}")
    e = _events(t)
    s.append(e)
    s.compact(str(e.agg(F.min("ts") + F.expr("INTERVAL 2 HOUR")).first()[0]))
    return s.events().select("event_id", "event_type")


@query(f"""SELECT {_ID}, row_number() OVER (ORDER BY user_id % 4 >= 2, ts, event_id::VARCHAR)::BIGINT AS sequence FROM events""")
def event_store_append(t):
    """Two appends: the second one's numbers go on from the first one's, each in order of time and id."""
    s = store.EventStore(t.spark, f"{checkpoint_dir(t.spark)}/events-{uuid.uuid4().hex}")
    e = _events(t)
    s.append(e.where("org_id < 2"))
    s.append(e.where("org_id >= 2"))
    return s.events().select("event_id", F.col("sequence").cast("long").alias("sequence"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 'DELETE' ELSE 'UPDATE' END AS operation FROM supplier WHERE s_suppkey % 10 = 0 OR s_suppkey % 7 = 0
UNION ALL SELECT s_suppkey + 1000000, 'INSERT' FROM supplier WHERE s_suppkey % 5 = 0""")
def change_capture(t):
    old = t("supplier")
    new = old.where("s_suppkey % 10 <> 0").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 7 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")))
    new = new.unionByName(old.where("s_suppkey % 5 = 0").withColumn("s_suppkey", F.col("s_suppkey") + 1000000))
    return store.changes(old, new, ["s_suppkey"]).select("s_suppkey", "operation")


@query("SELECT user_id % 50 AS row_id, max(event_id) AS sequence FROM events WHERE user_id % 7 BETWEEN 2 AND 5 AND event_type IN ('click', 'view') GROUP BY ALL")
def change_trigger_rows(t):
    rows = t("events").select((F.col("user_id") % 50).alias("row_id"), (F.col("user_id") % 7).alias("rows_affected"), F.array("event_type").alias("changed"), F.col("event_id").alias("sequence"))
    return store.trigger_rows(rows, 2, 5, ["click", "view"]).select("row_id", "sequence")


@query("""SELECT (event_id // 5)::BIGINT AS txn, CASE WHEN bool_or(event_id % 5 = 4) THEN 'committed' ELSE 'begun' END AS state, (count(*) FILTER (WHERE event_id % 5 NOT IN (0, 4))) AS operations FROM events GROUP BY event_id // 5""")
def transaction_summary(t):
    kind = F.when(F.col("sequence") % 5 == 0, "transaction.begun").when(F.col("sequence") % 5 == 4, "transaction.committed").otherwise("row.inserted")
    e = _events(t).withColumn("event_type", kind)
    return store.transactions(e, F.floor(F.col("sequence") / 5)).select("txn", "state", "operations")


_LOG = """(SELECT event_id // 3 AS m, event_id % 3 AS i, user_id % 2 AS d FROM events)"""


@query(f"""SELECT CASE WHEN i2 THEN 'delivered' WHEN i1 THEN 'waiting' ELSE 'in flight' END AS state, count(*) AS n FROM
(SELECT m, bool_or(i = 0) AS i0, bool_or(i = 1) AS i1, bool_or(i = 2) AS i2 FROM {_LOG} GROUP BY m HAVING bool_or(i = 0)) GROUP BY state""")
def queue_states(t):
    """Messages get deliver, nack, then (as the third event) a delivery that is acknowledged at once."""
    e = t("events").select((F.floor(F.col("event_id") / 3)).cast("string").alias("message_id"), F.lit("c").alias("consumer"), (F.col("event_id") % 3).alias("i"))
    at = F.timestamp_seconds(F.col("i") * 10)
    first = e.where("i < 2").select("message_id", "consumer", F.when(F.col("i") == 0, "deliver").otherwise("nack").alias("action"), at.alias("ts"))
    last = e.where("i = 2").select("message_id", "consumer", F.explode(F.array(F.struct(F.lit("deliver").alias("action"), at.alias("ts")), F.struct(F.lit("ack").alias("action"), (at + F.expr("INTERVAL 1 SECOND")).alias("ts")))).alias("x")).select("message_id", "consumer", "x.*")
    return live.delivery_states(first.unionByName(last)).groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT 'c' || (user_id % 3) AS consumer, max(event_id) + 1 AS next FROM events GROUP BY user_id % 3")
def queue_offsets(t):
    return live.offsets(t("events").select(F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("consumer"), F.col("event_id").alias("sequence")))


@query(f"SELECT {_ID} FROM events WHERE user_id % 4 = 2 AND event_type IN ('click', 'error')")
def event_webhooks(t):
    e = _events(t)
    on, off = channels.endpoint({"types": ["click", "error"], "org": 2, "topics": ["users/**"]}), channels.endpoint({"active": False})
    return e.where(on | off).select("event_id")


@query(f"SELECT {_ID}, user_id % 4 = 1 AS org, user_id = 7 AS own, false AS room, false AS sys FROM events")
def event_channels(t):
    """Which of four channels each event goes to; clicks belong to no room and are not of the system."""
    on = lambda kind, key: F.coalesce(channels.channel(kind, key), F.lit(False))
    return _events(t).select("event_id", on("org", 1).alias("org"), on("user", 7).alias("own"), on("room", "x").alias("room"), on("system", None).alias("sys"))


@query(f"SELECT {_ID} FROM events WHERE user_id % 4 = 0 AND event_type <> 'view' AND {_K} >= 10")
def event_subscription(t):
    return _events(t).where(channels.subscription(0, ["users/**"], ["users/*/view"], contents=[ff.content("k", "greater_or_equal", 10)])).select("event_id")


@query("SELECT event_id::VARCHAR AS event_id, (row_number() OVER (ORDER BY ts, event_id))::INT AS place FROM events QUALIFY place <= 50")
def event_global_order(t):
    from pyspark.sql import Window

    first = channels.ordered(_events(t), "global").limit(50)
    return first.withColumn("place", F.row_number().over(Window.orderBy("ts", "sequence"))).select("event_id", "place")


@query(f"SELECT {_ID} FROM events WHERE minute(ts) % 15 = 0 AND hour(ts) BETWEEN 8 AND 18 AND dayofweek(ts) IN (1, 3)")
def cron_schedule(t):
    return _events(t).where(channels.cron_due("*/15 8-18 * * 1,3", F.col("ts"))).select("event_id")


# --- streams, drained


def _stream(t, per_trigger: int | None = 1):
    schema = t("events").schema
    return live.read_events(t.spark, t.dir, schema, "events.parquet", per_trigger)


def _place(t, name: str) -> tuple[str, str]:
    root = f"{checkpoint_dir(t.spark)}/stream-{name}-{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/checkpoint"


@query(f"SELECT {_ID}, event_type FROM events WHERE event_type IN ('purchase', 'error') AND {_K} < 50")
def stream_filtered(t):
    s = _stream(t).where(ff.stream_filter(["purchase", "error"]) & ff.content("k", "less_than", 50)).select("event_id", "event_type")
    return live.drain(s, *_place(t, "filter"))


@query(f"SELECT {_ID} FROM events")
def stream_dedup(t):
    return live.drain(ff.deduplicate(_stream(t), "1 hour").select("event_id"), *_place(t, "dedup"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(t):
    out = live.drain(windows.tumbling(_stream(t), "1 hour", late="1 hour"), *_place(t, "tumbling"), mode="complete")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"""SELECT {_ID}, count(*) OVER w AS n_recent FROM events
WINDOW w AS (PARTITION BY user_id % 4, event_type ORDER BY epoch_us(ts), event_id::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def stream_frequency(t):
    """With a span beyond all events, the stateful count is the running count; all files are one batch, as their times may overlap."""
    return live.drain(live.running_frequency(_stream(t, None), 3, 10**8), *_place(t, "frequency")).select("event_id", "n_recent")


@query("""WITH g AS (SELECT user_id % 4 AS org_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id % 4 ORDER BY ts)),
n AS (SELECT org_id, ts, sum(s) OVER (PARTITION BY org_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT org_id, min(ts) AS session_start, max(ts) + INTERVAL 10 MINUTE AS session_end, count(*) AS n FROM n GROUP BY org_id, k""")
def stream_sessions(t):
    out = live.drain(windows.sessions(_stream(t), "10 minutes", late="1 hour"), *_place(t, "sessions"), mode="complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("SELECT event_type AS consumer, 'delivered' AS state, count(*) AS n FROM events GROUP BY event_type")
def stream_deliveries(t):
    """Every event is delivered and acknowledged a second later, by the stateful machine."""
    step = lambda a, s: F.struct(F.lit(a).alias("action"), (F.col("ts") + F.expr(f"INTERVAL {s} SECOND")).alias("at"))
    log = _stream(t).select(F.col("event_id").alias("message_id"), F.col("event_type").alias("consumer"), F.explode(F.array(step("deliver", 0), step("ack", 1))).alias("x"))
    log = log.select("message_id", "consumer", "x.action", F.col("x.at").alias("ts"))
    out = live.drain(live.deliveries(log), *_place(t, "deliveries"), mode="update")
    return out.groupBy("consumer", "state").agg(F.count("*").alias("n"))
