"""Vector distances as columns. Lower is closer for every metric; arithmetic is in double."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Names of metrics, and the SQL operators that stand for them.
METRICS = {
    "l2": "l2", "euclidean": "l2",
    "cosine": "cosine", "angular": "cosine",
    "ip": "ip", "inner_product": "ip", "innerproduct": "ip", "inner": "ip", "dot": "ip",
    "l1": "l1", "manhattan": "l1",
}
OPERATORS = {"<->": "l2", "<=>": "cosine", "<#>": "ip", "<|>": "l1"}
FUNCTION = {"l2": "l2_distance", "cosine": "cosine_distance", "ip": "inner_product", "l1": "l1_distance"}
MAX_DIMS = 4096
#: Up to this many dimensions a literal vector becomes one compiled sum; above it, generated code would grow too long.
UNROLL = 200

Vector = Sequence[float]


def metric_name(metric: str) -> str:
    try:
        return METRICS[metric.lower()]
    except KeyError:
        raise ValueError(f"unknown metric: {metric}") from None


def check_target(target: Vector, metric: str) -> list[float]:
    """The target as floats; raises where it is empty, too long, not finite, or zero under cosine."""
    t = [float(x) for x in target]
    if not t:
        raise ValueError("vector is empty")
    if len(t) > MAX_DIMS:
        raise ValueError(f"vector has {len(t)} dimensions; at most {MAX_DIMS}")
    if not all(map(math.isfinite, t)):
        raise ValueError("vector holds a value that is not finite")
    if metric_name(metric) == "cosine" and not any(t):
        raise ValueError("zero vector under cosine")
    return t


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _fold(a: Column, b: Column, f) -> Column:
    return _total(F.zip_with(a, b, f))


def _cosine(ab: Column, aa: Column, bb: Column) -> Column:
    return F.when((aa == 0) | (bb == 0), F.lit(1.0)).otherwise(F.lit(1.0) - ab / (F.sqrt(aa) * F.sqrt(bb)))


def distance(a: Column | str, b: Column | str | Vector, metric: str = "l2", safe: bool = False) -> Column:
    """Distance between an array column and another, or a literal vector.

    l2 is the root of the squared differences, cosine 1 minus the similarity (1 where a norm is 0), ip the negated
    inner product, l1 the sum of absolute differences. Null vectors give null. Vectors of different lengths raise
    ``dim mismatch``, or give null where safe. A literal of up to UNROLL dimensions is one compiled expression.
    """
    kind = metric_name(metric)
    a = F.col(a) if isinstance(a, str) else a
    if not isinstance(b, str | Column):
        target = [float(x) for x in b]
        out = _unrolled(a, target, kind) if len(target) <= UNROLL else _pair(a, F.array(*map(F.lit, target)), kind)
        return _guard(out, a, F.lit(len(target)), safe)
    b = F.col(b) if isinstance(b, str) else b
    return _guard(_pair(a, b.cast("array<double>"), kind), a, F.size(b), safe, b)


def _guard(out: Column, a: Column, size: Column, safe: bool, b: Column | None = None) -> Column:
    null = a.isNull() if b is None else a.isNull() | b.isNull()
    other = F.lit(None).cast("double") if safe else F.raise_error(F.concat(F.lit("dim mismatch: "), F.size(a).cast("string"), F.lit(" and "), size.cast("string"))).cast("double")
    return F.when(null, F.lit(None).cast("double")).when(F.size(a) == size, out).otherwise(other)


def _unrolled(a: Column, t: list[float], kind: str) -> Column:
    x = [F.get(a, F.lit(i)).cast("double") for i in range(len(t))]

    def add(terms: list[Column]) -> Column:
        out = F.lit(0.0)
        for c in terms:
            out = out + c
        return out

    if kind == "l2":
        return F.sqrt(add([(u - v) * (u - v) for u, v in zip(x, t)]))
    if kind == "l1":
        return add([F.abs(u - v) for u, v in zip(x, t)])
    dot = add([u * v for u, v in zip(x, t)])
    if kind == "ip":
        return -dot
    return _cosine(dot, add([u * u for u in x]), F.lit(sum(v * v for v in t)))


def _pair(a: Column, b: Column, kind: str) -> Column:
    a = a.cast("array<double>")
    if kind == "l2":
        return F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y)))
    if kind == "l1":
        return _fold(a, b, lambda x, y: F.abs(x - y))
    dot = _fold(a, b, lambda x, y: x * y)
    if kind == "ip":
        return -dot
    square = lambda v: _total(F.transform(v, lambda x: x * x))
    return _cosine(dot, square(a), square(b))


def norm(a: Column | str) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    return F.sqrt(_total(F.transform(a.cast("array<double>"), lambda x: x * x)))


def jaccard_distance(a: Column | str, b: Column | str) -> Column:
    """1 minus the share of common elements among all; 0 for two empty arrays."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def sql_expression(metric: str, a: str, b: str) -> str:
    """A distance as SQL text over two vector expressions; it may stand anywhere, also in ORDER BY."""
    kind = metric_name(metric)
    a, b = f"CAST({a} AS ARRAY<DOUBLE>)", f"CAST({b} AS ARRAY<DOUBLE>)"
    fold = lambda f: f"aggregate(zip_with({a}, {b}, (x, y) -> {f}), 0D, (s, v) -> s + v)"
    if kind == "cosine":
        norm = f"(sqrt(aggregate({a}, 0D, (s, v) -> s + v * v)) * sqrt(aggregate({b}, 0D, (s, v) -> s + v * v)))"
        body = f"CASE WHEN {norm} = 0 THEN 1D ELSE 1D - {fold('x * y')} / {norm} END"
    else:
        body = {"l2": f"sqrt({fold('(x - y) * (x - y)')})", "ip": f"-{fold('x * y')}", "l1": fold("abs(x - y)")}[kind]
    other = f"CAST(raise_error(concat('dim mismatch: ', size({a}), ' and ', size({b}))) AS DOUBLE)"
    return f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN size({a}) = size({b}) THEN {body} ELSE {other} END)"


def register(spark: SparkSession) -> None:
    """Makes the distance functions known to SQL text, under the names in FUNCTION. (Spark takes SQL functions in
    SELECT and WHERE, not in ORDER BY; the vector operators are rewritten to expressions and stand anywhere.)"""
    for metric, name in FUNCTION.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {sql_expression(metric, 'a', 'b')}")
