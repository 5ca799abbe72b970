"""Stream queries on tables of several files, and streams that take long."""

import datetime as dt
import inspect

import numpy as np
import pandas as pd

from plexar.queries import QUERIES
from plexar.streaming import live


class State:
    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def events(spark, tmp_path, n=400):
    """A table of four files whose times overlap."""
    rows = [(k, dt.datetime(2026, 1, 1) + dt.timedelta(seconds=k // 3), k % 7, "click" if k % 5 else "view", 1.0, "{}") for k in range(n)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    for part in range(4):
        df.where(f"event_id % 4 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    return rows


def test_frequency_over_files(spark, tmp_path):
    rows = sorted(events(spark, tmp_path), key=lambda r: (r[1], str(r[0])))
    seen, want = {}, {}
    for k, _, user, kind, _, _ in rows:
        seen[user % 4, kind] = want[str(k)] = seen.get((user % 4, kind), 0) + 1
    got = {r["event_id"]: r["n_recent"] for r in QUERIES["stream_frequency"](spark, str(tmp_path)).collect()}
    assert got == want


def test_running_frequency_step():
    """Against one row after another, over batches of which the second is late; a key of 200,000 events takes no loop over rows."""

    class Frame:
        schema = [type("f", (), {"name": n, "dataType": type("t", (), {"simpleString": staticmethod(lambda: "string")})}) for n in ("org_id", "event_type")]

        def groupBy(self, *keys):
            return self

        def applyInPandasWithState(self, step, *args):
            return step

    step, state, rng = live.running_frequency(Frame(), 3, 20), State(), np.random.default_rng(1)
    recent, start = [], pd.Timestamp("2026-01-01")
    for first, n in ((0, 300), (50, 100), (400, 5)):
        rows = pd.DataFrame({"event_id": [f"{first}-{i}" for i in range(n)], "ts": start + pd.to_timedelta(first + rng.integers(0, 60, n), "s")})
        out = pd.concat(step(("a", "b"), iter([rows[: n // 2], rows[n // 2 :]]), state))
        want = []
        for t in rows.sort_values(["ts", "event_id"])["ts"]:
            recent = [x for x in recent if x > t - pd.Timedelta(seconds=20)] + [t]
            want.append(len(recent))
        assert out["n_recent"].tolist() == want and out["fires"].tolist() == [x >= 3 for x in want]
        assert len(state.get[0]) == len(recent)
    n = 200_000
    rows = pd.DataFrame({"event_id": [str(i) for i in range(n)], "ts": start + pd.to_timedelta(np.arange(n), "s")})
    (out,) = live.running_frequency(Frame(), 3, 10**8)(("a", "b"), iter([rows]), State())
    assert out["n_recent"].iloc[-1] == n


def test_drain_waits():
    assert inspect.signature(live.drain).parameters["timeout"].default is None


def test_deliveries_machine(spark):
    """The columns against the machine on random logs, without Python for each message."""
    rng = np.random.default_rng(2)
    start, rows = dt.datetime(2026, 1, 1), []
    for m in range(300):
        for at in sorted(rng.choice(120, rng.integers(1, 12), replace=False).tolist()):
            rows.append((str(m), "c", ["deliver", "deliver", "ack", "nack"][rng.integers(4)], start + dt.timedelta(seconds=at)))
    want = {}
    for m, _, action, ts in rows:
        want[m] = live.next_delivery(*want.get(m, ("waiting", 0, 0)), action, int(ts.replace(tzinfo=dt.timezone.utc).timestamp()))
    out = live.deliveries(spark.createDataFrame(rows, "message_id string, consumer string, action string, ts timestamp").repartition(5))
    assert {r["message_id"]: (r["state"], r["tries"]) for r in out.collect()} == {m: x[:2] for m, x in want.items()}
    assert {x[0] for x in want.values()} == {"waiting", "in flight", "delivered", "dead"}
    assert "Pandas" not in out._jdf.queryExecution().executedPlan().toString()
