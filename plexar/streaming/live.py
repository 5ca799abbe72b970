"""Structured Streaming: sources, queues and stateful operators; each has a batch twin elsewhere in this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexar.streaming.model import from_clicks


#: State lies on disk: many keys would not fit the heap of an executor.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", per_trigger: int | None = 1) -> DataFrame:
    """A stream of the driver's event files as events; glob names files of the folder, or tables that are folders of files.
    per_trigger None takes all files that are there as one batch."""
    raw = spark.readStream.schema(schema)
    raw = raw if per_trigger is None else raw.option("maxFilesPerTrigger", per_trigger)
    return from_clicks(raw.parquet(f"{folder}/{{{glob}}}"))  # the braces: only a pattern may name a file


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append", timeout: int | None = None) -> DataFrame:
    """Runs a stream over all that is there and gives what it wrote; it ends by itself, and only a timeout (seconds) cuts it.
    Parquet output for append; complete and update modes write each batch through foreachBatch, the last state of every
    batch replacing the one before."""
    spark = df.sparkSession
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", path).outputMode("append")
    else:
        writer = writer.outputMode(mode).foreachBatch(lambda b, n: b.write.mode("overwrite" if mode == "complete" else "append").parquet(path))
    before = spark.conf.get(STATE_STORE)
    try:  # a query keeps the settings it was started with
        spark.conf.set(STATE_STORE, ROCKSDB)
        q = writer.start()
    finally:
        spark.conf.set(STATE_STORE, before)
    if timeout is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout):
        q.stop()
        raise TimeoutError("the stream did not end")
    return spark.read.parquet(path)


def fan_out(df: DataFrame, subscribers: dict[str, object], folder: str, checkpoint: str):
    """One pass over a stream for many subscribers, {name: condition column}: each gets the events it takes, in a folder of
    its own. A batch that is run again overwrites what it wrote, so each event arrives once."""

    def write(batch: DataFrame, n: int) -> None:
        batch.persist()
        for name, cond in subscribers.items():
            batch.where(cond).write.mode("overwrite").parquet(f"{folder}/{name}/batch={n}")
        batch.unpersist()

    return df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def act(df: DataFrame, actions: list[tuple[object, Callable[[DataFrame, int], None]]], checkpoint: str):
    """Trigger actions over a stream: every (condition, action) gets the events of each batch that its condition takes."""

    def run(batch: DataFrame, n: int) -> None:
        batch.persist()
        for cond, do in actions:
            do(batch.where(cond), n)
        batch.unpersist()

    return df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(run).start()


def running_frequency(df: DataFrame, count: int, seconds: int, by: tuple[str, ...] = ("org_id", "event_type")) -> DataFrame:
    """The stream form of ``windows.frequency``: (by..., event_id, ts, n_recent, fires), state of at most the events of the
    last seconds for each key. A batch's rows of a key are counted by their places in order, without a loop over rows."""
    keys = list(by)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    out = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", event_id string, ts timestamp, n_recent long, fires boolean"

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        recent = np.sort(np.array(state.get[0] if state.exists else [], np.int64))
        rows = pd.concat(list(pdfs), ignore_index=True).sort_values(["ts", "event_id"])
        at = rows["ts"].astype("int64").to_numpy() // (1000 if str(rows["ts"].dtype).startswith("datetime64[ns") else 1)
        since = at - seconds * 1_000_000
        n = len(recent) - np.searchsorted(recent, since, "right") + np.arange(1, len(at) + 1) - np.searchsorted(at, since, "right")
        recent = np.concatenate([recent, at])
        state.update((recent[recent > since[-1]].tolist(),))
        found = {k: [v] * len(n) for k, v in zip(keys, key)}
        yield pd.DataFrame(found | {"event_id": rows["event_id"].array, "ts": rows["ts"].array, "n_recent": n, "fires": n >= count})

    return df.groupBy(*keys).applyInPandasWithState(step, out, "recent array<bigint>", "append", "NoTimeout")


def deliveries(df: DataFrame, attempts: int = 3, timeout_seconds: int = 30) -> DataFrame:
    """Delivery state of a queue's messages from a stream of (message_id, consumer, action, ts), where action is deliver, ack or
    nack: (consumer, message_id, state, tries). States: in flight, delivered, waiting, dead. A delivery that is not answered
    within the timeout counts as a nack when the next action comes; a message that failed attempts times is dead.

    A message's actions are kept and gone through in order of time, whenever they came; no Python runs for a message."""
    log = df.groupBy("consumer", "message_id").agg(F.collect_list(F.struct("ts", "action")).alias("log"))
    start = F.struct(F.lit("waiting").alias("now"), F.lit(0).alias("tries"), F.lit(0).cast("long").alias("since"))
    last = F.aggregate(F.array_sort("log"), start, lambda s, x: delivery_step(s, x, attempts, timeout_seconds))
    # a column of its own, or its parts would each be computed anew
    out = log.select("consumer", "message_id", F.explode(F.array(last)).alias("s"))
    return out.select("consumer", F.col("message_id").cast("string").alias("message_id"), F.col("s.now").alias("state"), F.col("s.tries").alias("tries"))


def delivery_step(s: Column, x: Column, attempts: int, timeout: int) -> Column:
    """``next_delivery`` as a column: s (now, tries, since), x (ts, action)."""
    at, failed = F.unix_seconds(x["ts"]), F.when(s["tries"] >= attempts, "dead").otherwise("waiting")
    late = (s["now"] == "in flight") & (at - s["since"] > timeout)
    now = F.when(late, failed).otherwise(s["now"])
    sent = (x["action"] == "deliver") & (now == "waiting")
    answer = F.when(x["action"] == "ack", "delivered").when(x["action"] == "nack", failed).otherwise(now)
    new = F.when(sent, "in flight").when(now == "in flight", answer).otherwise(now)
    return F.struct(new.alias("now"), F.when(sent, s["tries"] + 1).otherwise(s["tries"]).alias("tries"), F.when(sent, at).otherwise(s["since"]).alias("since"))


def next_delivery(now: str, tries: int, since: int, action: str, ts: int, attempts: int = 3, timeout: int = 30) -> tuple[str, int, int]:
    """One step of the delivery state machine."""
    if now in ("delivered", "dead"):
        return now, tries, since
    if now == "in flight" and ts - since > timeout:
        now = "dead" if tries >= attempts else "waiting"
    if action == "deliver" and now == "waiting":
        return "in flight", tries + 1, ts
    if action == "ack" and now == "in flight":
        return "delivered", tries, since
    if action == "nack" and now == "in flight":
        return ("dead" if tries >= attempts else "waiting"), tries, since
    return now, tries, since


def delivery_states(log: DataFrame, attempts: int = 3, timeout_seconds: int = 30) -> DataFrame:
    """The batch twin of ``deliveries``: the last state of every message."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        now, tries, since = "waiting", 0, 0
        for action, ts in zip(*(pdf.sort_values(["ts", "action"])[c] for c in ("action", "ts"))):
            now, tries, since = next_delivery(now, tries, since, action, int(ts.timestamp()), attempts, timeout_seconds)
        return pd.DataFrame([(pdf["consumer"].iloc[0], pdf["message_id"].iloc[0], now, tries)], columns=["consumer", "message_id", "state", "tries"])

    return log.groupBy("consumer", "message_id").applyInPandas(step, "consumer string, message_id string, state string, tries int")


def offsets(consumed: DataFrame) -> DataFrame:
    """(consumer, next): the next sequence number of each consumer, one above the greatest acknowledged."""
    return consumed.groupBy("consumer").agg((F.max("sequence") + 1).alias("next"))
