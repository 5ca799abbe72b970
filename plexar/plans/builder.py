"""Fluent builders over a store's tables. They become one DataFrame plan; SQL text is for reading."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexar.functions.scalar import coerce, safe_name
from plexar.functions.vector import OPERATORS, check_target, distance, metric_name
from plexar.operators import dml
from plexar.plans.where import Where


def literal(v: object) -> str:
    """A value as SQL text."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int | float):
        return repr(v)
    if isinstance(v, bytes | bytearray):
        return f"'{bytes(v).hex()}'"
    if isinstance(v, list | tuple):
        return "ARRAY[" + ", ".join(repr(float(x)) for x in v) + "]"
    return "'" + str(v).replace("'", "''") + "'"


class _Filtered:
    """Condition calls, handed on to the condition tree."""

    cond: Where

    def where(self, column: str, op: str, *values: object):
        self.cond.where(column, op, *values)
        return self

    and_where = where

    def or_where(self, column: str, op: str, *values: object):
        self.cond.or_where(column, op, *values)
        return self

    def where_in(self, column: str, values):
        self.cond.where_in(column, values)
        return self

    def where_between(self, column: str, low: object, high: object):
        self.cond.where_between(column, low, high)
        return self

    def where_null(self, column: str):
        self.cond.where_null(column)
        return self

    def where_not_null(self, column: str):
        self.cond.where_not_null(column)
        return self

    def where_group(self, build):
        self.cond.group(build)
        return self


@dataclass
class Select(_Filtered):
    """select().from_(table).columns(...).where(...).order_by(...).limit(n).execute()"""

    store: object
    table: str | None = None
    cols: list[tuple[str, str]] = field(default_factory=list)  # expression, alias
    cond: Where = field(default_factory=Where)
    joins: list[tuple[str, str, str, str]] = field(default_factory=list)
    groups: list[str] = field(default_factory=list)
    having_sql: str | None = None
    orders: list[tuple[str, str, object]] = field(default_factory=list)
    limit_n: int | None = None
    offset_n: int = 0
    unique: bool = False
    threshold: float | None = None
    scores: bool = False

    def from_(self, table: str) -> Select:
        self.table = safe_name(table)
        return self

    def _need_table(self) -> None:
        if self.table is None:
            raise ValueError("choose a table first")

    def columns(self, *names: str) -> Select:
        for n in names:
            self.column(n)
        return self

    def column(self, name: str, alias: str | None = None) -> Select:
        """A column once; naming it again changes nothing."""
        self._need_table()
        safe_name(name)
        if (name, alias or name) not in self.cols:
            self.cols.append((name, alias or name))
        return self

    def expr(self, sql: str, alias: str | None = None) -> Select:
        self._need_table()
        self.cols.append((sql, alias or sql))
        return self

    def count(self, name: str = "*", alias: str = "count") -> Select:
        return self.expr(f"count({name})", alias)

    def upper(self, name: str, alias: str | None = None) -> Select:
        return self.expr(f"upper({safe_name(name)})", alias or f"upper_{name}")

    def lower(self, name: str, alias: str | None = None) -> Select:
        return self.expr(f"lower({safe_name(name)})", alias or f"lower_{name}")

    def case(self, cases: list[tuple[str, object]], otherwise: object = None, alias: str = "case") -> Select:
        whens = " ".join(f"WHEN {c} THEN {literal(v)}" for c, v in cases)
        tail = f" ELSE {literal(otherwise)}" if otherwise is not None else ""
        return self.expr(f"CASE {whens}{tail} END", alias)

    def join(self, table: str, left: str, right: str, how: str = "inner") -> Select:
        """left: a column of what is selected so far; right: one of the table. Columns of the joined table keep their names;
        those that clash become table.column."""
        if how not in ("inner", "left", "right", "full", "left_semi", "left_anti"):
            raise ValueError(f"unknown join: {how}")
        self.joins.append((safe_name(table), left, right, how))
        return self

    def distinct(self) -> Select:
        self.unique = True
        return self

    def group_by(self, *names: str) -> Select:
        self.groups += names
        return self

    def having(self, sql: str) -> Select:
        self.having_sql = sql
        return self

    def order_by(self, name: str, descending: bool = False) -> Select:
        self.orders.append(("column", safe_name(name), descending))
        return self

    def order_by_raw(self, sql: str) -> Select:
        self.orders.append(("raw", sql, None))
        return self

    def order_by_distance(self, column: str, target: list[float], metric: str = "l2") -> Select:
        self.orders.append(("distance", safe_name(column), (check_target(target, metric), metric_name(metric))))
        return self

    def l2(self, column: str, target: list[float]) -> Select:
        return self.order_by_distance(column, target, "l2")

    def cosine(self, column: str, target: list[float]) -> Select:
        return self.order_by_distance(column, target, "cosine")

    def inner_product(self, column: str, target: list[float]) -> Select:
        return self.order_by_distance(column, target, "ip")

    def manhattan(self, column: str, target: list[float]) -> Select:
        return self.order_by_distance(column, target, "l1")

    def knn(self, column: str, target: list[float], k: int = 10, metric: str = "l2") -> Select:
        return self.order_by_distance(column, target, metric).limit(k)

    def within(self, distance: float) -> Select:
        """Keeps rows up to a distance of the ordering target."""
        self.threshold = distance
        return self

    def with_scores(self) -> Select:
        self.scores = True
        return self

    def limit(self, n: int) -> Select:
        self.limit_n = n
        return self

    def offset(self, n: int) -> Select:
        self.offset_n = n
        return self

    def page(self, number: int, size: int) -> Select:
        self.limit_n, self.offset_n = size, max(number - 1, 0) * size
        return self

    def build(self) -> Select:
        self._need_table()
        if not self.cols:
            raise ValueError("select a column (or *)")
        return self

    def to_sql(self, params: dict[str, object] | None = None) -> str:
        self.build()
        params = {} if params is None else params
        cols = ", ".join(e if e == a else f"{e} AS {a}" for e, a in self.cols)
        out = f"SELECT {'DISTINCT ' if self.unique else ''}{cols} FROM {self.table}"
        for t, l, r, how in self.joins:
            out += f" {how.replace('_', ' ').upper()} JOIN {t} ON {l} = {r}"
        if self.cond.items:
            out += f" WHERE {self.cond.to_sql(params)}"
        if self.groups:
            out += f" GROUP BY {', '.join(self.groups)}"
        if self.having_sql:
            out += f" HAVING {self.having_sql}"
        if self.orders:
            sign = {v: k for k, v in OPERATORS.items()}
            one = {"column": lambda n, x: n + (" DESC" if x else " ASC"), "raw": lambda n, x: n, "distance": lambda n, x: f"{n} {sign[x[1]]} {literal(x[0])}"}
            out += " ORDER BY " + ", ".join(one[k](n, x) for k, n, x in self.orders)
        if self.limit_n is not None:
            out += f" LIMIT {self.limit_n}"
        return out + (f" OFFSET {self.offset_n}" if self.offset_n else "")

    def execute(self) -> DataFrame:
        self.build()
        df = self.store.scan(self.table, with_id=True)
        for t, l, r, how in self.joins:
            right = self.store.scan(t)
            right = right.select(*[F.col(f"`{c}`").alias(f"{t}.{c}" if c in df.columns else c) for c in right.columns])
            key = r if r in right.columns else f"{t}.{r}"
            df = df.join(right, F.col(f"`{l}`") == F.col(f"`{key}`"), how)
        if self.cond.items:
            df = df.where(self.cond.to_column())
        order, names = [], []
        for i, (kind, name, x) in enumerate(self.orders):
            if kind == "distance":
                label = "distance" if "distance" not in df.columns else f"distance_{i}"
                df = df.withColumn(label, distance(name, x[0], x[1], safe=True))
                names.append(label)
                order.append(F.col(label).asc_nulls_last())
                if self.threshold is not None:
                    df = df.where(F.col(label) <= self.threshold)
        star = [c for c in df.columns if c not in ("_id", *names)]
        cols = [x for e, a in self.cols for x in ([F.col(f"`{c}`") for c in star] if e == "*" else [F.expr(e).alias(a)])]
        if self.scores:
            cols += [F.col(n) for n in names]
        aggregated = bool(self.groups) or any(e.lower().startswith(("count(", "sum(", "avg(", "min(", "max(", "stddev", "var")) for e, _ in self.cols)
        for kind, name, x in self.orders:
            if kind == "column":
                order.append(F.col(name).desc_nulls_last() if x else F.col(name).asc_nulls_last())
            elif kind == "raw":
                order.append(F.expr(name))
        if aggregated:
            own = {g for g in self.groups}
            df = df.groupBy(*self.groups).agg(*[F.expr(e).alias(a) for e, a in self.cols if e not in own])
            df = df.where(self.having_sql) if self.having_sql else df
            df = df.select(*[F.col(f"`{a if e not in own else e}`").alias(a) for e, a in self.cols])
            df = df.orderBy(*order) if order else df
        elif self.unique:
            df = df.select(*cols).distinct()
            df = df.orderBy(*order) if order else df
        else:
            df = (df.orderBy(*order, "_id") if order else df).select(*cols)
        df = df.offset(self.offset_n) if self.offset_n else df
        return df.limit(self.limit_n) if self.limit_n is not None else df


@dataclass
class Insert:
    store: object
    table: str | None = None
    rows: list[dict[str, object]] = field(default_factory=list)
    conflict: str | None = None
    keys: list[str] = field(default_factory=list)
    update_columns: list[str] | None = None

    def into(self, table: str) -> Insert:
        self.table = safe_name(table)
        return self

    def value(self, **row: object) -> Insert:
        self.rows.append(row)
        return self

    def values(self, rows: list[dict[str, object]]) -> Insert:
        """Columns are those of the first row; others are an error, missing ones null."""
        self.rows += rows
        return self

    def on_conflict(self, keys: list[str], rule: str, columns: list[str] | None = None) -> Insert:
        if rule not in ("fail", "ignore", "replace", "update"):
            raise ValueError(f"unknown conflict rule: {rule}")
        self.keys, self.conflict, self.update_columns = keys, rule, columns
        return self

    def to_sql(self) -> str:
        if not self.table or not self.rows:
            raise ValueError("INSERT needs a table and a row")
        names = list(self.rows[0])
        rows = ", ".join("(" + ", ".join(literal(r.get(n)) for n in names) + ")" for r in self.rows)
        out = f"INSERT INTO {self.table} ({', '.join(map(safe_name, names))}) VALUES {rows}"
        if self.conflict == "ignore":
            out += f" ON CONFLICT ({', '.join(self.keys)}) DO NOTHING"
        elif self.conflict in ("replace", "update"):
            cols = self.update_columns or [n for n in names if n not in self.keys]
            out += f" ON CONFLICT ({', '.join(self.keys)}) DO UPDATE SET " + ", ".join(f"{c} = EXCLUDED.{c}" for c in cols)
        return out

    def frame(self) -> DataFrame:
        self.to_sql()
        names = list(self.rows[0])
        if extra := {k for r in self.rows for k in r} - set(names):
            raise ValueError(f"columns that the first row lacks: {sorted(extra)}")
        t = self.store.catalog.table(self.table)
        kinds = {n: t.column(n).field() for n in names}
        from pyspark.sql import types as T

        data = [tuple(coerce(r.get(n), kinds[n].dataType) for n in names) for r in self.rows]
        return self.store.spark.createDataFrame(data, T.StructType([kinds[n] for n in names]))

    def execute(self) -> int:
        """Number of rows given."""
        df = self.frame()
        if self.conflict is None:
            return self.store.insert(self.table, df)
        _merge(self.store, self.table, df, self.keys, self.conflict, self.update_columns)
        return len(self.rows)

    def returning(self) -> DataFrame:
        """Inserts, and gives the rows as they are in the table, with _id."""
        first = self.store.next_id(self.table)
        self.execute()
        return self.store.scan(self.table, with_id=True).where(F.col("_id") >= first)


def _merge(store, table: str, df: DataFrame, keys: list[str], rule: str, columns: list[str] | None) -> None:
    """Upsert that keeps the ids of rows that stay and gives new rows the next ones."""
    from plexar.operators.graph_algo import Rounds
    from plexar.operators.relational import dense_ids

    keep = Rounds(store.spark)
    old = store.scan(table, with_id=True)
    ids = old.select(*keys, "_id")
    new = keep.save(dml.upsert(store.scan(table), df, keys, rule, columns), "merged").join(ids, keys, "left")
    store.check_rows(table, new)
    fresh = keep.save(new.where(F.col("_id").isNull()).drop("_id"), "fresh")
    store.replace(table, new.where(F.col("_id").isNotNull()).unionByName(dense_ids(fresh, "_id", store.next_id(table))))


@dataclass
class Update(_Filtered):
    store: object
    table: str
    sets: dict[str, object] = field(default_factory=dict)
    cond: Where = field(default_factory=Where)

    def set(self, column: str, value: object) -> Update:
        self.sets[safe_name(column)] = value
        return self

    def set_expr(self, column: str, sql: str) -> Update:
        self.sets[safe_name(column)] = F.expr(sql)
        self.raw = getattr(self, "raw", {}) | {column: sql}
        return self

    def to_sql(self, params: dict[str, object] | None = None) -> str:
        if not self.sets:
            raise ValueError("UPDATE needs at least one SET")
        raw = getattr(self, "raw", {})
        sets = ", ".join(f"{c} = {raw[c] if c in raw else literal(v)}" for c, v in self.sets.items())
        return f"UPDATE {self.table} SET {sets}" + (f" WHERE {self.cond.to_sql(params)}" if self.cond.items else "")

    def execute(self) -> int:
        """Number of rows that the condition takes."""
        hit = F.coalesce(self.cond.to_column(), F.lit(False))
        n = self.store.scan(self.table, with_id=True).where(hit).count()
        self.store.apply(self.table, lambda df: dml.update(df, {c: v if isinstance(v, Column) or v is None or not isinstance(v, list | tuple) else F.array(*map(F.lit, v)) for c, v in self.sets.items()}, hit))
        return n


@dataclass
class Delete(_Filtered):
    store: object
    table: str
    cond: Where = field(default_factory=Where)
    limit_n: int | None = None
    confirmed: bool = False

    def limit(self, n: int) -> Delete:
        self.limit_n = n
        return self

    def confirm_delete_all(self) -> Delete:
        self.confirmed = True
        return self

    def to_sql(self, params: dict[str, object] | None = None) -> str:
        if not self.cond.items and not self.confirmed:
            raise ValueError("DELETE without a condition must be confirmed")
        out = f"DELETE FROM {self.table}" + (f" WHERE {self.cond.to_sql(params)}" if self.cond.items else "")
        return out + (f" LIMIT {self.limit_n}" if self.limit_n is not None else "")

    def execute(self) -> int:
        """Number of rows that went."""
        self.to_sql({})
        where = self.cond.to_column() if self.cond.items else None
        before, after = self.store.apply(self.table, lambda df: dml.delete(df, where, self.limit_n, "_id", self.confirmed))
        return before - after
