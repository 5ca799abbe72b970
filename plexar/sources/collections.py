"""JSON documents projected onto table columns, strictly typed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plexar.sources.catalog import Catalog


@dataclass
class Projection:
    """A named collection: the table it feeds, and for each column the document's top-level key."""

    name: str
    table: str
    columns: dict[str, str]


def put(catalog: Catalog, p: Projection) -> None:
    catalog.collections[p.name] = {"table": p.table, "columns": p.columns}


def get(catalog: Catalog, name: str) -> Projection:
    if name not in catalog.collections:
        raise ValueError(f"collection not found: {name}")
    return Projection(name, **catalog.collections[name])


def names(catalog: Catalog) -> list[str]:
    return sorted(catalog.collections)


def _typed(doc: str, key: str, kind: T.DataType) -> tuple[Column, Column]:
    """(value, whether it is right): integers for long, any number for double, strings for string, arrays of numbers
    for vectors. A JSON value of another type is wrong even where a cast would do."""
    raw = F.try_variant_get(F.try_parse_json(F.col(doc)), f"$['{key}']", "variant")
    shape = F.schema_of_variant(raw)
    if isinstance(kind, T.LongType | T.IntegerType):
        ok = shape.isin("BIGINT", "DECIMAL(1,0)") | shape.rlike(r"^(TINYINT|SMALLINT|INT|BIGINT)$")
    elif isinstance(kind, T.DoubleType | T.FloatType | T.DecimalType):
        ok = shape.rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$")
    elif isinstance(kind, T.BooleanType):
        ok = shape == "BOOLEAN"
    elif isinstance(kind, T.ArrayType):
        ok = shape.rlike(r"^ARRAY<(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)>$")
    else:
        ok = shape == "STRING"
    return F.try_variant_get(F.try_parse_json(F.col(doc)), f"$['{key}']", kind.simpleString()), F.coalesce(ok, F.lit(False))


def project(docs: DataFrame, doc: str, schema: T.StructType, columns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): documents as typed rows, and those with a missing or wrong key (doc, bad_keys).

    Every column of the schema must be mapped."""
    lost = [f.name for f in schema if f.name not in columns]
    if lost:
        raise ValueError(f"columns without a key: {lost}")
    parts = {f.name: _typed(doc, columns[f.name], f.dataType) for f in schema}
    bad = F.filter(F.array(*[F.when(~ok, F.lit(columns[n])) for n, (_, ok) in parts.items()]), lambda x: x.isNotNull())
    judged = docs.withColumn("bad_keys", bad)
    good = judged.where(F.size("bad_keys") == 0).select(*[v.alias(n) for n, (v, _) in parts.items()])
    return good, judged.where(F.size("bad_keys") > 0).select(doc, "bad_keys")


def ingest(store, name: str, docs: DataFrame, doc: str = "doc", strict: bool = True) -> int:
    """Projects documents and appends them to the collection's table. strict raises on the first reject; otherwise
    rejects are left out. Returns the number of rows."""
    p = get(store.catalog, name)
    rows, rejects = project(docs, doc, store.catalog.table(p.table).schema(), p.columns)
    if strict and (bad := rejects.first()) is not None:
        raise ValueError(f"missing or wrong key: {', '.join(bad['bad_keys'])}")
    return store.insert(p.table, rows)
