import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plexar.functions.scalar import infer_sql_type, spark_type, topic_pattern
from plexar.streaming import filters as ff
from plexar.streaming import live, store, windows
from plexar.streaming.model import EVENT_SCHEMA


def event(k, ts, type_="click", org=1, data="{}", user="1", kind="user", corr=None):
    return (str(k), org, type_, kind, dt.datetime.fromisoformat(ts), f"users/{user}/{type_}", data, "s", corr, None, "1", {"user_id": user}, k)


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENT_SCHEMA)


@pytest.mark.parametrize(("pattern", "topic", "want"), [
    ("users/*/login", "users/1/login", True), ("users/*/login", "users/1/2/login", False), ("users/**", "users/1/2/login", True), ("users/**", "users", True),
    ("**/login", "users/1/login", True), ("**/login", "login", True), ("**", "a/b", True), ("a.b/*", "axb/c", False), ("a/**/z", "a/z", True), ("a/**/z", "a/b/c/z", True),
])
def test_topics(pattern, topic, want):
    import re

    assert bool(re.search(topic_pattern(pattern), topic)) is want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "cc"]), min_size=1, max_size=5))
def test_topic_properties(parts):
    import re

    topic = "/".join(parts)
    for p in (topic, "**", "/".join("*" * len(parts)), parts[0] + "/**", "**/" + parts[-1]):
        assert re.search(topic_pattern(p), topic)
    assert not re.search(topic_pattern("/".join(["*"] * (len(parts) + 1))), topic)
    assert re.search(topic_pattern(parts[0] + "*", "glob"), topic)


def test_filters(spark):
    e = frame(spark, [event(1, "2026-01-05T09:30:00", data='{"a":{"b":"5"},"table_name":"t"}'), event(2, "2026-01-06T17:00:00", "view", 2, '{"a":{"b":"50"}}', "2"), event(3, "2026-01-10T23:15:00", "error", 1, "{}", kind="system")])
    ids = lambda c: [r[0] for r in e.where(c).orderBy("event_id").select("event_id").collect()]
    assert ids(ff.content("a.b", "less_than", 10)) == ["1"] and ids(ff.content("a.b", "regex", "^5")) == ["1", "2"]
    assert ids(ff.content("zz", "not_equals", 1)) == []  # missing is excluded
    assert ids(ff.content("a.b", "not_in", ["5"])) == ["2"] and ids(ff.content("a.b", "exists")) == ["1", "2"]
    assert ids(ff.during_hours("09:00-17:00")) == ["1"] and ids(ff.during_hours("9-17")) == ["1"] and ids(ff.during_hours((22, 6))) == ["3"]
    assert ids(ff.hour_window(22, 9)) == ["1", "3"] and ids(ff.on_days(["Sat"])) == ["3"]
    assert ids(ff.after("2026-01-05 09:30:00")) == ["2", "3"] and ids(ff.between("2026-01-05 09:30:00", "2026-01-06 17:00:00")) == ["1", "2"]
    assert ids(ff.event_filter(tables=["t"])) == ["1"] and ids(ff.event_filter(attributes={"user_id": "2"})) == ["2"]
    assert ids(ff.permitted("1", 1, ["read"])) == ["1"] and ids(ff.permitted("1", 1, ["read"], roles=["admin"])) == ["1", "3"] and ids(ff.permitted("1", 1, [])) == []
    assert ids(ff.permitted("1", 1, ["admin"], {1: ["other"]})) == []
    assert ids(ff.condition({"not": [{"type": "click"}, {"type": "view"}]})) == [] and ids(ff.condition({"not": [{"type": "click"}]})) == ["2", "3"]
    assert ids(ff.condition({"regex": ["a.b", "0$"]})) == ["2"] and ids(ff.condition({"metadata": ["source", "equals", "s"]})) == ["1", "2", "3"]
    passed, score = ff.rule(F.col("event_type") == "click", groups=[("not", [(F.col("org_id") == 1, 1.0)]), ("and", [(F.col("org_id") == 1, 1.0), (F.col("kind") == "x", 3.0)])])
    assert [tuple(r) for r in e.orderBy("event_id").select(passed, F.round(score, 3)).collect()] == [(True, 1.0), (True, 1.0), (False, 0.25)]
    for bad in (lambda: ff.condition({"x": 1}), lambda: ff.compare(F.col("data"), "zz", 1), lambda: ff.partition_key("zz")):
        with pytest.raises(ValueError):
            bad()


def test_windows(spark):
    at = lambda m, s=0: f"2026-01-01T00:{m:02d}:{s:02d}"
    e = frame(spark, [event(k, at(k // 10, k % 10)) for k in range(30)] + [event(100 + k, at(3, k)) for k in range(59)])
    t = [(r["n"], r["trend"]) for r in windows.trend(e, "1 minute").orderBy("window_start").collect()]
    assert t == [(10, "stable"), (10, "stable"), (10, "stable"), (59, "increasing")]
    f = windows.frequency(e, 3, 2).where("event_id = '5'").first()
    assert f["n_recent"] == 2 and not f["fires"]  # strictly newer than two seconds ago: seconds 4 and 5
    b = windows.batched(e.where("sequence < 30"), 4, 60).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in b) == [2, 2, 2, 4, 4, 4, 4, 4, 4]
    assert windows.rate_limited(e, 2, 60).count() == 8
    assert windows.sessions(e, "20 seconds").count() == 4
    assert windows.top_types(e, F.lit("2026-01-01 01:00:00").cast("timestamp")).first()["n"] == 88  # the event an hour ago is out
    df = spark.createDataFrame([(10.0,), (15.0,), (50.0,)], "v double")
    assert [r[0] for r in df.select(windows.severity(F.col("v"), 10.0)).collect()] == [None, "warning", "critical"]
    h = df.select(windows.health(F.col("v") * 100, F.lit(0.0), F.lit(20.0), F.lit(0))).collect()
    assert [r[0] for r in h] == ["healthy", "degraded", "degraded"]


def test_store(spark, tmp_path):
    s = store.EventStore(spark, str(tmp_path / "es"))
    assert s.events().count() == 0
    assert s.append(frame(spark, [event(9, "2026-01-02T00:00:00"), event(8, "2026-01-01T00:00:00")])) == 2
    assert s.append(frame(spark, [event(7, "2026-01-03T00:00:00", "view", 2)])) == 1
    assert [(r["event_id"], r["sequence"]) for r in s.query().collect()] == [("8", 1), ("9", 2), ("7", 3)]
    assert [r["event_id"] for r in s.query(orgs=[2], topics=["users/*/view"]).collect()] == ["7"]
    assert [r["event_id"] for r in s.between("7", "8").collect()] == ["7", "8"]
    assert [r["sequence"] for r in s.replay(2, 3).collect()] == [2, 3]
    snap = {r["aggregate"]: r["state"] for r in s.snapshot(F.col("org_id"), F.col("event_id")).collect()}
    assert snap == {1: "9", 2: "7"} and not s.snapshot_due()
    assert s.compact("2026-01-02") == 1 and s.stats().agg(F.sum("n")).first()[0] == 2
    (tmp_path / "es" / "events").rename(tmp_path / "es" / "events.new")  # a compaction that ended between its renames
    assert s.events().count() == 2 and (tmp_path / "es" / "events").exists()


def test_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d"), (3, None)], "k long, v string")
    got = {r["k"]: (r["operation"], r["changed"]) for r in store.changes(old, new, ["k"]).collect()}
    assert got == {2: ("UPDATE", ["v"]), 4: ("INSERT", ["v"])}
    assert store.changes(new, old, ["k"]).where("operation = 'DELETE'").first()["k"] == 4
    rows = spark.createDataFrame([("t", "INSERT", "u", 1), ("s", "DELETE", None, 1)], "table_name string, operation string, user_id string, org_id long")
    assert rows.where(store.change_filter(users=["u"])).count() == 1
    keys = spark.createDataFrame([("1:table:orders:5",), ("1:table:users:2",), ("2:table:orders:1",)], "key string")
    hit = store.invalidated(keys, [{"type": "row.updated", "table": "orders", "keys": "{org}:table:orders:*", "priority": 3}, {"type": "x", "keys": "*"}], {"type": "row.updated", "table": "orders", "org": 1})
    assert [tuple(r) for r in hit.collect()] == [("1:table:orders:5", 3)]


def test_delivery_machine():
    step = live.next_delivery
    s = ("waiting", 0, 0)
    for action, ts, want in (("deliver", 0, "in flight"), ("nack", 1, "waiting"), ("deliver", 2, "in flight"), ("ack", 99, "waiting"), ("deliver", 100, "in flight"), ("nack", 101, "dead"), ("ack", 102, "dead")):
        s = step(*s, action, ts)
        assert s[0] == want
    assert step("in flight", 1, 0, "ack", 5)[0] == "delivered"


def test_streams(spark, tmp_path):
    rows = [event(k, f"2026-01-01T00:00:{k:02d}", "click" if k % 2 else "view") for k in range(20)]
    for part in range(2):
        frame(spark, rows[part * 10 : part * 10 + 10] + rows[:1]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = live.drain(ff.deduplicate(read()).select("event_id"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted(int(r[0]) for r in out.collect()) == list(range(20))
    q = live.fan_out(read().where("sequence > 0"), {"clicks": F.col("event_type") == "click", "all": F.lit(True)}, str(tmp_path / "fan"), str(tmp_path / "c2"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "fan/clicks")).count() == 10 and spark.read.parquet(str(tmp_path / "fan/all")).count() == 19
    seen = []
    live.act(read(), [(F.col("event_type") == "view", lambda b, n: seen.append(b.count()))], str(tmp_path / "c3")).awaitTermination()
    assert sum(seen) == 12
    log = spark.createDataFrame([("m", "c", "deliver", dt.datetime(2026, 1, 1)), ("m", "c", "ack", dt.datetime(2026, 1, 1, 0, 0, 5))], "message_id string, consumer string, action string, ts timestamp")
    assert live.delivery_states(log).first()["state"] == "delivered"


def test_types():
    assert spark_type("VECTOR(8)") == "array<float>" and spark_type("decimal(10,2)") == "decimal(10,2)" and spark_type("Integer") == "bigint"
    assert [infer_sql_type(x) for x in (None, True, 1, 1.5, "s", b"x", [1.0], {"a": 1})] == ["NULL", "BOOLEAN", "INTEGER", "REAL", "TEXT", "BLOB", "VECTOR", "JSON"]
