"""Condition trees: built call by call, folded left to right into a Column or into SQL text with named parameters."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plexar.functions.scalar import safe_name

ALIASES = {"EQ": "=", "==": "=", "NE": "<>", "!=": "<>", "LT": "<", "LE": "<=", "GT": ">", "GE": ">="}
INVERSE = {"=": "<>", "<>": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<", "LIKE": "NOT LIKE", "ILIKE": "NOT ILIKE", "IN": "NOT IN", "BETWEEN": "NOT BETWEEN", "IS NULL": "IS NOT NULL"}
INVERSE |= {v: k for k, v in INVERSE.items() if k not in ("=", "<>", "<", "<=", ">", ">=")}


@dataclass
class Condition:
    column: str
    op: str
    values: tuple = ()
    negated: bool = False

    def __post_init__(self) -> None:
        op = " ".join(self.op.upper().split())
        self.op = ALIASES.get(op, op)
        safe_name(self.column)
        if self.op not in INVERSE:
            raise ValueError(f"unknown operator: {self.op}")
        n = len(self.values)
        want = {"IS NULL": n == 0, "IS NOT NULL": n == 0, "IN": n > 0, "NOT IN": n > 0, "BETWEEN": n == 2, "NOT BETWEEN": n == 2}.get(self.op, n == 1)
        if not want:
            raise ValueError(f"{self.op} with {n} values")

    @property
    def effective(self) -> str:
        return INVERSE[self.op] if self.negated else self.op

    def to_column(self) -> Column:
        c, op, v = F.col(self.column), self.effective, self.values
        if op in ("IS NULL", "IS NOT NULL"):
            return c.isNull() if op == "IS NULL" else c.isNotNull()
        base = op.removeprefix("NOT ")
        if base == "IN":
            out = c.isin(*v)
        elif base == "BETWEEN":
            out = c.between(*v)
        elif base == "LIKE":
            out = c.like(v[0])
        elif base == "ILIKE":
            out = c.ilike(v[0])
        else:
            return {"=": c == v[0], "<>": c != v[0], "<": c < v[0], "<=": c <= v[0], ">": c > v[0], ">=": c >= v[0]}[op]
        return ~out if op.startswith("NOT ") else out

    def to_sql(self, params: dict[str, object]) -> str:
        def bind(v: object) -> str:
            name = f"{''.join(x if x.isalnum() else '_' for x in self.column)}_{len(params)}"
            params[name] = v
            return f":{name}"

        op = self.effective
        if not self.values:
            return f"{self.column} {op}"
        marks = [bind(v) for v in self.values]
        if op.endswith("IN"):
            return f"{self.column} {op} ({', '.join(marks)})"
        if op.endswith("BETWEEN"):
            return f"{self.column} {op} {marks[0]} AND {marks[1]}"
        return f"{self.column} {op} {marks[0]}"


@dataclass
class Where:
    """A group. Calls associate to the left: (a OR b), then and_where(c), is (a OR b) AND c."""

    items: list[tuple[str, Condition | Where]] = field(default_factory=list)
    negated: bool = False

    def _add(self, how: str, item: Condition | Where) -> Where:
        self.items.append((how, item))
        return self

    def where(self, column: str, op: str, *values: object) -> Where:
        return self._add("AND", Condition(column, op, values))

    and_where = where

    def or_where(self, column: str, op: str, *values: object) -> Where:
        return self._add("OR", Condition(column, op, values))

    def where_in(self, column: str, values) -> Where:
        return self._add("AND", Condition(column, "IN", tuple(values)))

    def where_not_in(self, column: str, values) -> Where:
        return self._add("AND", Condition(column, "NOT IN", tuple(values)))

    def where_between(self, column: str, low: object, high: object) -> Where:
        return self._add("AND", Condition(column, "BETWEEN", (low, high)))

    def where_not_between(self, column: str, low: object, high: object) -> Where:
        return self._add("AND", Condition(column, "NOT BETWEEN", (low, high)))

    def where_null(self, column: str) -> Where:
        return self._add("AND", Condition(column, "IS NULL"))

    def where_not_null(self, column: str) -> Where:
        return self._add("AND", Condition(column, "IS NOT NULL"))

    def like(self, column: str, pattern: str) -> Where:
        return self._add("AND", Condition(column, "LIKE", (pattern,)))

    def ilike(self, column: str, pattern: str) -> Where:
        return self._add("AND", Condition(column, "ILIKE", (pattern,)))

    def group(self, build, how: str = "AND") -> Where:
        """build gets a new group to fill."""
        inner = Where()
        build(inner)
        if not inner.items:
            raise ValueError("empty group")
        return self._add(how, inner)

    def or_group(self, build) -> Where:
        return self.group(build, "OR")

    def invert(self) -> Where:
        """Negates the last item: a condition by its inverse operator, a group by NOT."""
        if not self.items:
            raise ValueError("nothing to negate")
        item = self.items[-1][1]
        item.negated = not item.negated
        return self

    def to_column(self) -> Column:
        if not self.items:
            return F.lit(True)
        first, *rest = self.items
        out = reduce(lambda a, x: (a & x[1].to_column()) if x[0] == "AND" else (a | x[1].to_column()), rest, first[1].to_column())
        return ~out if self.negated else out

    def to_sql(self, params: dict[str, object] | None = None) -> str:
        """SQL text; values go to params under unique names. 1=1 where there is nothing."""
        params = {} if params is None else params
        if not self.items:
            return "1=1"

        def one(x: Condition | Where) -> str:
            s = x.to_sql(params)
            return f"({s})" if isinstance(x, Where) and not x.negated else s

        out = one(self.items[0][1])
        for k, (how, x) in enumerate(self.items[1:], 1):
            changes = k > 1 and how != self.items[k - 1][0]
            out = f"({out}) {how} {one(x)}" if changes else f"{out} {how} {one(x)}"
        return f"NOT ({out})" if self.negated else out
