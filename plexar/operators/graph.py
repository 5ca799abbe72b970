"""A property graph over tables: nodes are rows of labelled tables, edges a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_SCHEMA = "edge_id long, src_table string, src_id long, rel_type string, dst_table string, dst_id long, props map<string,string>"


def edges_from(df: DataFrame, src_table: str, src: str, rel: str, dst_table: str, dst: str, props: dict[str, Column] | None = None) -> DataFrame:
    """Edges (without ids) from two key columns; rows with a null end have none."""
    entries = [x for k, v in (props or {}).items() for x in (F.lit(k), v.cast("string"))]
    return df.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(
        F.lit(None).cast("long").alias("edge_id"), F.lit(src_table).alias("src_table"), F.col(src).cast("long").alias("src_id"), F.lit(rel).alias("rel_type"),
        F.lit(dst_table).alias("dst_table"), F.col(dst).cast("long").alias("dst_id"),
        (F.create_map(*entries) if entries else F.create_map()).cast("map<string,string>").alias("props"))


@dataclass
class Graph:
    """Node tables by label (each with the key column named in keys) and one edge table."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    keys: dict[str, str] = field(default_factory=dict)
    edges: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.edges is None:
            self.edges = self.spark.createDataFrame([], EDGE_SCHEMA)

    def add_nodes(self, label: str, df: DataFrame, key: str = "_id") -> None:
        self.tables[label], self.keys[label] = df, key

    def add_edge(self, src: tuple[str, int], rel: str, dst: tuple[str, int], props: dict[str, str] | None = None) -> int:
        """Appends an edge; its id is one above the greatest, from 0."""
        n = self.edges.agg(F.max("edge_id")).first()[0]
        n = 0 if n is None else n + 1
        row = self.spark.createDataFrame([(n, *src, rel, *dst, props or {})], EDGE_SCHEMA)
        self.edges = self.edges.unionByName(row)
        return n

    def neighbors(self, table: str, node: int, rel: str | None = None) -> DataFrame:
        """Edges out of a node, by edge id."""
        return self._side("src", table, node, rel)

    def incoming(self, table: str, node: int, rel: str | None = None) -> DataFrame:
        """Edges into a node, by edge id."""
        return self._side("dst", table, node, rel)

    def _side(self, side: str, table: str, node: int, rel: str | None) -> DataFrame:
        out = self.edges.where((F.col(f"{side}_table") == table) & (F.col(f"{side}_id") == node))
        return (out if rel is None else out.where(F.col("rel_type") == rel)).orderBy("edge_id")

    def dump(self, path: str) -> None:
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")

    def restore(self, path: str) -> None:
        self.edges = self.spark.read.schema(EDGE_SCHEMA).parquet(f"{path}/edges")


def links(edges: DataFrame, rel: str | None = None) -> DataFrame:
    """(src, dst) node names of the form table/id."""
    rows = edges if rel is None else edges.where(F.col("rel_type") == rel)
    name = lambda s: F.concat_ws("/", f"{s}_table", F.col(f"{s}_id").cast("string")).alias(s)
    return rows.select(name("src"), name("dst"))
