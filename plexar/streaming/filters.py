"""Event filters and trigger conditions as column expressions: they work on batch and streaming frames alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexar.functions.scalar import json_path, topic_match
from plexar.streaming.model import DATABASE_TYPES, SYSTEM_TYPES, USER_TYPES, user_of

TRUE = F.lit


def every(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def some(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def compare(value: Column, op: str, want: object) -> Column:
    """One of nine comparisons of a text value; a missing value compares false. Numbers compare as numbers."""
    number = value.try_cast("double")
    ops = {
        "equals": lambda: value == str(want), "not_equals": lambda: value != str(want), "contains": lambda: value.contains(str(want)),
        "starts_with": lambda: value.startswith(str(want)), "ends_with": lambda: value.endswith(str(want)),
        "greater_than": lambda: number > float(want), "less_than": lambda: number < float(want),  # type: ignore[arg-type]
        "greater_or_equal": lambda: number >= float(want), "less_or_equal": lambda: number <= float(want),  # type: ignore[arg-type]
        "in": lambda: value.isin(*[str(x) for x in want]), "not_in": lambda: ~value.isin(*[str(x) for x in want]),  # type: ignore[union-attr]
        "regex": lambda: value.rlike(str(want)), "exists": lambda: value.isNotNull(),
    }
    if op not in ops:
        raise ValueError(f"unknown comparison: {op}")
    return F.coalesce(ops[op](), F.lit(False))


def content(path: str, op: str, want: object = None, data: str = "data") -> Column:
    """A comparison of the value at a dotted path of the JSON payload."""
    return compare(json_path(data, path), op, want)


def after(ts: str) -> Column:
    return F.col("ts") > F.lit(ts).cast("timestamp")


def before(ts: str) -> Column:
    return F.col("ts") < F.lit(ts).cast("timestamp")


def between(low: str, high: str) -> Column:
    return F.col("ts").between(F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp"))


def _hour(x: int | str) -> int:
    return int(x) if isinstance(x, int) or x.isdigit() else int(x.split(":")[0])


def during_hours(span: str | tuple[int, int]) -> Column:
    """Hours [start, end) in UTC, from '09:00-17:00', '9-17' or (9, 17); a span past midnight wraps."""
    low, high = map(_hour, span.split("-") if isinstance(span, str) else span)
    h = F.hour("ts")
    return (h >= low) & (h < high) if low <= high else (h >= low) | (h < high)


def hour_window(start: int, end: int) -> Column:
    """Hours from start to end, both included, wrapping past midnight."""
    h = F.hour("ts")
    return (h >= start) & (h <= end) if start <= end else (h >= start) | (h <= end)


def on_days(days: list[str]) -> Column:
    """Days by their English names or first three letters."""
    return F.lower(F.date_format("ts", "EEE")).isin(*[d.lower()[:3] for d in days])


def stream_filter(types=(), orgs=(), topics=(), contents=(), times=(), mode: str = "glob") -> Column:
    """What a stream lets through: all parts must hold, any of the topics; empty parts hold."""
    out = []
    if types:
        out.append(F.col("event_type").isin(*types))
    if orgs:
        out.append(F.col("org_id").isin(*orgs))
    if topics:
        out.append(some([topic_match("topic", t, mode) for t in topics]))
    return every([*out, *contents, *times])


def event_filter(tables=(), operations=(), users=(), orgs=(), types=(), connections=(), transactions=(), attributes=None) -> Column:
    """All parts must hold; an event without the value that a part asks for is rejected."""
    at = lambda k: json_path("data", k)
    parts = [(tables, at("table_name")), (operations, at("operation")), (users, F.coalesce(at("user_id"), user_of())), (orgs, F.col("org_id").cast("string")),
             (types, F.col("event_type")), (connections, at("connection_id")), (transactions, at("transaction_id"))]
    out = [F.coalesce(c.isin(*map(str, want)), F.lit(False)) for want, c in parts if want]
    out += [F.coalesce(F.col("attributes")[k] == v, F.lit(False)) for k, v in (attributes or {}).items()]
    return every(out)


def database_changes() -> Column:
    return F.col("event_type").isin(*DATABASE_TYPES)


def user_activity() -> Column:
    return F.col("event_type").isin(*USER_TYPES)


def system_events() -> Column:
    return F.col("event_type").isin(*SYSTEM_TYPES)


def permitted(user: str, org: int, permissions: list[str], tables: dict[int, list[str]] | None = None, roles: list[str] = ()) -> Column:  # type: ignore[assignment]
    """What a user may see: events of its organisation, of tables it may use (where tables are listed for the
    organisation), with read or admin; user events only its own; system events for admins and operators."""
    reads = F.lit(bool({"read", "admin"} & set(permissions)))
    table = json_path("data", "table_name")
    listed = (tables or {}).get(org)
    table_ok = F.lit(True) if listed is None else (table.isNull() | table.isin(*listed))
    own = (F.col("kind") != "user") | (user_of() == user)
    system = (F.col("kind") != "system") | F.lit(bool({"admin", "operator"} & set(roles)))
    return (F.col("org_id") == org) & reads & table_ok & F.coalesce(own, F.lit(False)) & system


def deduplicate(df: DataFrame, ttl: str = "1 hour", keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """One event of each key. In a stream, within the watermark; in a batch, the first by sequence."""
    if df.isStreaming:
        return df.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(list(keys))
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.col("sequence").asc_nulls_last(), "ts")
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def content_hash() -> Column:
    """A key for events of equal type, organisation and payload."""
    return F.sha2(F.concat_ws("\x1f", "event_type", F.col("org_id").cast("string"), "data"), 256)


def partition_key(strategy: str, n: int = 16, field: str | None = None) -> Column:
    """The partition an event goes to: none, org, type, field (a JSON path) or hash. Hash values are Spark's own."""
    if strategy == "none":
        return F.lit(0)
    by = {"org": lambda: F.col("org_id"), "type": lambda: F.col("event_type"), "field": lambda: json_path("data", field or ""), "hash": lambda: F.col("event_id")}
    if strategy not in by:
        raise ValueError(f"unknown strategy: {strategy}")
    return F.pmod(F.xxhash64(by[strategy]()), F.lit(n)).cast("int")


def route(rules: list[tuple[Column, str]], default: str = "default_stream") -> Column:
    """The stream of the first rule that holds."""
    out = None
    for cond, name in rules:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return F.lit(default) if out is None else out.otherwise(default)


# --- trigger conditions: nested dictionaries, compiled


def condition(spec: dict) -> Column:
    """A trigger condition as a column.

    {"type": [...]}, {"topic": pattern}, {"data": [path, op, value]}, {"metadata": [field, op, value]}, {"org": [...]},
    {"hours": [start, end]}, {"regex": [path, pattern]}, {"and": [...]}, {"or": [...]}, {"not": [one]}. A not over other
    than one child is false. Frequency needs neighbouring events and is a window, see ``windows.frequency``."""
    (kind, arg), = spec.items()
    if kind == "type":
        return F.col("event_type").isin(*([arg] if isinstance(arg, str) else arg))
    if kind == "topic":
        return topic_match("topic", arg)
    if kind == "data":
        return content(*arg)
    if kind == "metadata":
        name, op, *want = arg
        col = F.col(name) if name in ("source", "correlation_id", "causation_id", "version") else F.col("attributes")[name]
        return compare(col, op, want[0] if want else None)
    if kind == "org":
        return F.col("org_id").isin(*arg)
    if kind == "hours":
        return hour_window(*arg)
    if kind == "regex":
        return content(arg[0], "regex", arg[1])
    if kind == "and":
        return every([condition(c) for c in arg])
    if kind == "or":
        return some([condition(c) for c in arg])
    if kind == "not":
        return ~condition(arg[0]) if len(arg) == 1 else F.lit(False)
    raise ValueError(f"unknown condition: {kind}")


def rule(primary: Column, additional: list[Column] = (), groups: list[tuple[str, list[tuple[Column, float]]]] = ()) -> tuple[Column, Column]:  # type: ignore[assignment]
    """(passed, score) of a rule: the primary and all additional conditions, or any alternative group.

    A group is (and | or | not, [(condition, weight)]). Scores: the share of conditions that hold; an and group the
    weighted share, an or group the greatest weight that holds, a not group 1 where nothing holds."""
    conds = [primary, *additional]
    num = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    passed = every([F.coalesce(c, F.lit(False)) for c in conds])
    score = sum((num(c) for c in conds), F.lit(0.0)) / len(conds)
    for how, items in groups:
        holds = [F.coalesce(c, F.lit(False)) for c, _ in items]
        if how == "and":
            ok, value = every(holds), sum((num(c) * w for c, w in items), F.lit(0.0)) / (sum(w for _, w in items) or 1.0)
        elif how == "or":
            ok, value = some(holds), F.greatest(F.lit(0.0), F.lit(0.0), *[num(c) * w for c, w in items])
        elif how == "not":
            ok = ~some(holds)
            value = ok.cast("double")
        else:
            raise ValueError(f"unknown group: {how}")
        passed, score = passed | ok, F.greatest(score, value)
    return passed, score
