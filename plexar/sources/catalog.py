"""Table, column and index definitions, kept as one JSON document beside the tables."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

from pyspark.sql import types as T

from plexar.functions.scalar import spark_type, vector_dims
from plexar.functions.vector import metric_name

MAX_INDEX_COLUMNS = 16


@dataclass
class ColumnDef:
    name: str
    type: str
    nullable: bool = True
    primary_key: bool = False
    default: object = None

    def field(self) -> T.StructField:
        dims = vector_dims(self.type)
        schema = T._parse_datatype_string(f"x {spark_type(self.type)}")
        return T.StructField(self.name, schema[0].dataType, True, {"dims": dims} if dims else {})


@dataclass
class TableDef:
    name: str
    columns: list[ColumnDef]
    version: int = 0

    def check(self) -> None:
        if not self.name:
            raise ValueError("a table needs a name")
        if not self.columns:
            raise ValueError(f"table {self.name} needs a column")
        names = [c.name.lower() for c in self.columns]
        if "" in names:
            raise ValueError("a column needs a name")
        if len(set(names)) < len(names):
            raise ValueError(f"duplicate column in {self.name}")
        for c in self.columns:
            if c.primary_key and c.nullable:
                raise ValueError(f"primary key {c.name} must not be nullable")
            spark_type(c.type)

    def schema(self) -> T.StructType:
        return T.StructType([c.field() for c in self.columns])

    def column(self, name: str) -> ColumnDef:
        for c in self.columns:
            if c.name == name:
                return c
        raise ValueError(f"no such column: {self.name}.{name}")


@dataclass
class IndexDef:
    name: str
    table: str
    columns: list[str]
    kind: str = "btree"
    unique: bool = False
    dimension: int | None = None
    metric: str | None = None
    options: dict[str, object] = field(default_factory=dict)

    def check(self, table: TableDef) -> None:
        if self.kind not in ("btree", "hash", "vector"):
            raise ValueError(f"unknown index type: {self.kind}")
        if not self.columns or len(self.columns) > MAX_INDEX_COLUMNS:
            raise ValueError(f"an index has 1 to {MAX_INDEX_COLUMNS} columns")
        if len(set(self.columns)) < len(self.columns):
            raise ValueError("duplicate column in index")
        for c in self.columns:
            table.column(c)
        if self.kind == "vector":
            if len(self.columns) > 1:
                raise ValueError("a vector index has one column")
            if self.unique:
                raise ValueError("a vector index cannot be unique")
            metric_name(self.metric or "l2")


class Catalog:
    """Definitions of one organisation. Changes raise before anything is changed."""

    def __init__(self) -> None:
        self.tables: dict[str, TableDef] = {}
        self.indexes: dict[str, IndexDef] = {}
        self.collections: dict[str, dict] = {}

    def create_table(self, table: TableDef, if_not_exists: bool = False) -> bool:
        table.check()
        if table.name in self.tables:
            if if_not_exists:
                return False
            raise ValueError(f"table exists: {table.name}")
        self.tables[table.name] = table
        return True

    def table(self, name: str) -> TableDef:
        if name not in self.tables:
            raise ValueError(f"no such table: {name}")
        return self.tables[name]

    def list_tables(self) -> list[str]:
        return sorted(self.tables)

    def drop_table(self, name: str, if_exists: bool = False) -> bool:
        if name not in self.tables:
            if if_exists:
                return False
            raise ValueError(f"no such table: {name}")
        del self.tables[name]
        self.indexes = {k: i for k, i in self.indexes.items() if i.table != name}
        return True

    def add_column(self, table: str, column: ColumnDef) -> None:
        new = dataclasses.replace(self.table(table), columns=[*self.table(table).columns, column])
        new.check()
        self.tables[table] = new

    def drop_column(self, table: str, name: str) -> None:
        old = self.table(table)
        if old.column(name).primary_key:
            raise ValueError(f"cannot drop primary key column {name}")
        new = dataclasses.replace(old, columns=[c for c in old.columns if c.name != name])
        new.check()
        self.tables[table] = new

    def rename_column(self, table: str, name: str, to: str) -> None:
        old = self.table(table)
        old.column(name)
        new = dataclasses.replace(old, columns=[dataclasses.replace(c, name=to) if c.name == name else c for c in old.columns])
        new.check()
        self.tables[table] = new

    def rename_table(self, name: str, to: str) -> None:
        old = self.table(name)
        if not to or to in self.tables:
            raise ValueError(f"table exists: {to}")
        self.tables[to] = dataclasses.replace(old, name=to)
        del self.tables[name]
        for i in self.indexes.values():
            i.table = to if i.table == name else i.table

    def create_index(self, index: IndexDef, if_not_exists: bool = False) -> bool:
        index.check(self.table(index.table))
        if index.name in self.indexes:
            if if_not_exists:
                return False
            raise ValueError(f"index exists: {index.name}")
        self.indexes[index.name] = index
        return True

    def drop_index(self, name: str, if_exists: bool = False) -> bool:
        if name not in self.indexes:
            if if_exists:
                return False
            raise ValueError(f"no such index: {name}")
        del self.indexes[name]
        return True

    def list_indexes(self, table: str | None = None) -> list[IndexDef]:
        return sorted((i for i in self.indexes.values() if table in (None, i.table)), key=lambda i: i.name)

    def vector_index(self, table: str, column: str) -> IndexDef | None:
        return next((i for i in self.list_indexes(table) if i.kind == "vector" and i.columns == [column]), None)

    def to_json(self) -> str:
        return json.dumps({
            "tables": [dataclasses.asdict(t) for t in self.tables.values()], "indexes": [dataclasses.asdict(i) for i in self.indexes.values()],
            "collections": self.collections}, indent=1)

    @classmethod
    def from_json(cls, text: str) -> Catalog:
        """Definitions from older documents lack nullable and primary_key: they are true and false."""
        out, data = cls(), json.loads(text)
        for t in data["tables"]:
            out.tables[t["name"]] = TableDef(t["name"], [ColumnDef(**c) for c in t["columns"]], t.get("version", 0))
        for i in data.get("indexes", []):
            out.indexes[i["name"]] = IndexDef(**i)
        out.collections = data.get("collections", {})
        return out


def schema_changes(old: TableDef, new: TableDef) -> dict[str, list[str]]:
    """What a migration from old to new adds, drops and retypes; primary keys must stay."""
    a, b = ({c.name: c for c in t.columns} for t in (old, new))
    lost = [c for c, d in a.items() if d.primary_key and c not in b]
    if lost:
        raise ValueError(f"a migration cannot drop primary key columns: {lost}")
    return {"add": [c for c in b if c not in a], "drop": [c for c in a if c not in b], "retype": [c for c in b if c in a and spark_type(a[c].type) != spark_type(b[c].type)]}
