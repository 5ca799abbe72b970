"""Tables as versioned Parquet folders: a change writes the next version, then the catalog points at it.

Readers of an earlier version go on reading it; versions other than the current and the one before are removed. One
writer at a time. Rows of all organisations share a table and are partitioned by org_id, which every read filters on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexar.sources.catalog import Catalog, ColumnDef, TableDef

ID, ORG = "_id", "org_id"


class Files:
    """Small files and folders on whatever store Spark uses."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm

    def _fs(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        p, fs = self._fs(path)
        fs.delete(p, True)

    def read(self, path: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.text(path).collect())

    def write(self, path: str, text: str) -> None:
        """Written beside and renamed, so that readers see the old or the new text."""
        p, fs = self._fs(path)
        tmp, _ = self._fs(path + ".new")
        out = fs.create(tmp, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if fs.exists(p):
            fs.delete(p, False)
        fs.rename(tmp, p)

    def copy(self, source: str, target: str) -> None:
        a, fa = self._fs(source)
        b, fb = self._fs(target)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(fa, a, fb, b, False, self.spark._jsc.hadoopConfiguration())


@dataclass
class Store:
    """Tables of one organisation under a root folder."""

    spark: SparkSession
    root: str
    org: int = 1
    catalog: Catalog = field(default_factory=Catalog)

    def __post_init__(self) -> None:
        self.files = Files(self.spark)
        if self.files.exists(self._meta):
            self.catalog = Catalog.from_json(self.files.read(self._meta))

    @property
    def _meta(self) -> str:
        return f"{self.root}/catalog-{self.org}.json"

    def save(self) -> None:
        self.files.write(self._meta, self.catalog.to_json())

    def path(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/v{version}"

    def create(self, table: TableDef, if_not_exists: bool = False) -> bool:
        made = self.catalog.create_table(table, if_not_exists)
        if made:
            self.save()
        return made

    def drop(self, name: str, if_exists: bool = False) -> bool:
        gone = self.catalog.drop_table(name, if_exists)
        if gone:
            self.files.delete(f"{self.root}/{name}")
            self.save()
        return gone

    def scan(self, name: str, with_id: bool = False) -> DataFrame:
        """All rows. Filters and columns that callers add reach the Parquet scan, the organisation prunes partitions."""
        t = self.catalog.table(name)
        schema = t.schema()
        if not t.version:
            df = self.spark.createDataFrame([], schema.add(ID, "long"))
        else:
            full = t.schema().add(ID, "long").add(ORG, "long")
            df = self.spark.read.schema(full).parquet(self.path(name, t.version)).where(F.col(ORG) == self.org)
        return df.select(*[F.col(f"`{c.name}`") for c in t.columns], *([ID] if with_id else []))

    def replace(self, name: str, df: DataFrame) -> None:
        """Makes df (with _id) the table's next version."""
        t = self.catalog.table(name)
        new = t.version + 1
        df.withColumn(ORG, F.lit(self.org)).write.mode("overwrite").partitionBy(ORG).parquet(self.path(name, new))
        t.version = new
        self.save()
        if new > 2:
            self.files.delete(self.path(name, new - 2))

    def next_id(self, name: str) -> int:
        found = self.scan(name, with_id=True).agg(F.max(ID)).first()[0]
        return 0 if found is None else found + 1

    def insert(self, name: str, rows: DataFrame) -> int:
        """Appends rows, with dense ids after the greatest, in the order given. Columns left out get their default or null. Checks not-null
        columns and primary keys. Returns the number of rows."""
        from plexar.operators.dml import insert
        from plexar.operators.graph_algo import Rounds
        from plexar.operators.relational import ordered_ids

        t = self.catalog.table(name)
        for c in t.columns:
            if c.name not in rows.columns and c.default is not None:
                rows = rows.withColumn(c.name, F.lit(c.default))
        new = insert(self.scan(name).limit(0), rows).withColumn("__at", F.monotonically_increasing_id())
        new = Rounds(self.spark).save(new, "insert")
        self.check_rows(name, new)
        keys = [c.name for c in t.columns if c.primary_key]
        if keys and not self.scan(name).select(*keys).unionByName(new.select(*keys)).groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"duplicate primary key in {name}")
        n = new.count()
        numbered = ordered_ids(new, ["__at"], ID, self.next_id(name)).drop("__at")
        self.replace(name, self.scan(name, with_id=True).unionByName(numbered))
        return n

    def check_rows(self, name: str, rows: DataFrame) -> None:
        for c in self.catalog.table(name).columns:
            if not c.nullable and not rows.where(F.col(f"`{c.name}`").isNull()).isEmpty():
                raise ValueError(f"null in column {name}.{c.name}")

    def apply(self, name: str, change: Callable[[DataFrame], DataFrame]) -> tuple[int, int]:
        """Replaces the table by change(table with _id); gives the row counts before and after."""
        old = self.scan(name, with_id=True)
        before = old.count()
        new = change(old)
        self.check_rows(name, new)
        self.replace(name, new)
        return before, self.scan(name).count()

    def get(self, name: str, row_id: int) -> DataFrame:
        """The row of an id, or none."""
        return self.scan(name, with_id=True).where(F.col(ID) == row_id)

    def sample(self, name: str, limit: int = 20) -> DataFrame:
        """The first rows in id order."""
        return self.scan(name, with_id=True).orderBy(ID).limit(max(limit, 0)).drop(ID)

    def add_column(self, name: str, column: ColumnDef) -> None:
        """Old rows have null there (or the default)."""
        had = self.catalog.table(name).version
        old = self.scan(name, with_id=True)
        self.catalog.add_column(name, column)
        if had and column.default is not None:
            f = column.field()
            self.replace(name, old.withColumn(column.name, F.lit(column.default).cast(f.dataType)))
        self.save()

    def drop_column(self, name: str, column: str) -> None:
        old = self.scan(name, with_id=True)
        self.catalog.drop_column(name, column)
        if self.catalog.table(name).version:
            self.replace(name, old.drop(column))
        self.save()

    def rename(self, name: str, to: str) -> None:
        old = self.scan(name, with_id=True)
        self.catalog.rename_table(name, to)
        t = self.catalog.table(to)
        if t.version:
            t.version = 0
            self.replace(to, old)
            self.files.delete(f"{self.root}/{name}")
        self.save()

    def migrate(self, name: str, new: TableDef) -> dict[str, list[str]]:
        """Rewrites a table to another definition: added columns null or default, retyped ones cast; values that cannot be
        cast stop it before anything changes."""
        from plexar.sources.catalog import schema_changes

        changes = schema_changes(self.catalog.table(name), new)
        old = self.scan(name, with_id=True)
        cols = []
        for c in new.columns:
            kind = c.field().dataType
            if c.name in changes["add"]:
                cols.append(F.lit(c.default).cast(kind).alias(c.name))
            elif c.name in changes["retype"]:
                cast = F.col(f"`{c.name}`").try_cast(kind)
                if not old.where(F.col(f"`{c.name}`").isNotNull() & cast.isNull()).isEmpty():
                    raise ValueError(f"values of {name}.{c.name} do not fit {c.type}")
                cols.append(cast.alias(c.name))
            else:
                cols.append(F.col(f"`{c.name}`"))
        version = self.catalog.table(name).version
        self.catalog.tables[name] = TableDef(name, new.columns, version)
        self.replace(name, old.select(*cols, ID))
        return changes

    def dump(self, folder: str) -> None:
        """Every table as JSON lines, and the catalog."""
        for name in self.catalog.list_tables():
            self.scan(name, with_id=True).write.mode("overwrite").json(f"{folder}/{name}")
        self.files.write(f"{folder}/catalog.json", self.catalog.to_json())

    def load(self, folder: str) -> None:
        """Takes the place of all tables with what dump wrote."""
        found = Catalog.from_json(self.files.read(f"{folder}/catalog.json"))
        for name, t in found.tables.items():
            t.version = self.catalog.tables[name].version if name in self.catalog.tables else 0
        self.catalog = found
        for name, t in found.tables.items():
            self.replace(name, self.spark.read.schema(t.schema().add(ID, "long")).json(f"{folder}/{name}"))

    def backup(self, folder: str) -> DataFrame:
        """Copies current versions and writes a manifest of (table, rows, checksum), which it returns."""
        rows = []
        for name in self.catalog.list_tables():
            if v := self.catalog.table(name).version:
                self.files.copy(self.path(name, v), f"{folder}/{name}/v{v}")
            rows.append((name, *self._checksum(self.scan(name, with_id=True))))
        self.files.write(f"{folder}/catalog.json", self.catalog.to_json())
        manifest = self.spark.createDataFrame(rows, "table string, rows long, checksum string")
        manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
        return manifest

    def _checksum(self, df: DataFrame) -> tuple[int, str]:
        n, s = df.agg(F.count("*"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)"))).first()
        return n, str(s or 0)

    def restore(self, folder: str) -> None:
        """Brings a backup back; raises where rows do not match the manifest, before the catalog changes."""
        found = Catalog.from_json(self.files.read(f"{folder}/catalog.json"))
        other = Store(self.spark, folder, self.org, found)
        for r in self.spark.read.json(f"{folder}/manifest").collect():
            if (r["rows"], r["checksum"]) != self._checksum(other.scan(r["table"], with_id=True)):
                raise ValueError(f"backup of {r['table']} does not match its manifest")
        for name, t in found.tables.items():
            df = other.scan(name, with_id=True)
            had = self.catalog.tables[name].version if name in self.catalog.tables else 0
            self.catalog.tables[name] = TableDef(name, t.columns, had)
            if t.version:
                self.replace(name, df)
        self.catalog.indexes, self.catalog.collections = found.indexes, found.collections
        self.save()


def key_range(df: DataFrame, key: str, low: object, high: object) -> DataFrame:
    """Rows with low <= key < high; None leaves a side open."""
    cond = F.lit(True)
    if low is not None:
        cond &= F.col(key) >= low
    if high is not None:
        cond &= F.col(key) < high
    return df.where(cond)


def key_prefix(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows whose text key begins with prefix; reaches the scan as a pushed filter."""
    return df.where(F.col(key).startswith(prefix))


def batches(df: DataFrame, size: int = 100) -> Iterator[list]:
    """Rows in lists of at most size, streamed to the driver a partition at a time."""
    out: list = []
    for r in df.toLocalIterator():
        out.append(r)
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out


def where_python(df: DataFrame, predicate: Callable[[dict], bool]) -> DataFrame:
    """Rows that a Python predicate takes, batch by batch; for predicates that no column can express."""
    def run(pdfs):
        for b in pdfs:
            yield b[[bool(predicate(r)) for r in b.to_dict("records")]]

    return df.mapInPandas(run, df.schema)


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of every key by an order column."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last())
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def org_filter(df: DataFrame, org: int | Column) -> DataFrame:
    return df.where(F.col(ORG) == org)
