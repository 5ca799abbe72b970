"""Helpers shared by the corpus operators: word expressions, row keys, and tables kept in the shared folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexar.session import ship

#: What separates words; a word is a run of other characters.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def text_of(col: Column | str) -> Column:
    """The text, '' for null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(col: Column | str) -> Column:
    """Array of words, empty for null, empty or blank texts."""
    return F.array_remove(F.split(text_of(col), SPACE_RUN), "")


def word_count(col: Column | str) -> Column:
    """Number of words, as long."""
    return F.size(words_of(col)).cast("long")


def words_in(text: str) -> list[bytes]:
    """The words of a text as UTF-8 (bytes split at exactly the six ASCII spaces)."""
    return text.encode("utf-8", "replace").split()


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names beginning with the stems that df does not have (names compare without case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for s in stems:
        name = f"__{s}"
        while name in have:
            name += "_"
        have.add(name)
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or, on one machine (tests), one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        found = "/tmp/checkpoints/plexar"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder, to cut lineage or to be read more than once.

    Written tables survive the loss of any executor. ``drop`` removes what is no longer read; what a returned
    DataFrame still reads goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/plexar-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self._remove, self.root)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if path := getattr(df, "_scratch_path", None):
                self._remove(path)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended before us; the folder is then the cluster's to clean
            return


#: Links in a file of a round's tables.
ROWS_PER_FILE = 100_000


def components(spark: SparkSession, scratch: Scratch, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph, by alternating large-star and small-star rounds.

    links: (a, b), non-null longs; loops and repeats are allowed. Returns (node, root), one row per node that has a
    link, root the smallest node it reaches. Each round sends each link twice at most, never gathers a node's
    neighbours in one place (minima are partial aggregates, and the joins may be split where a node is hot) and is
    written to the shared folder. Rounds end when nothing changes: O(log^2 n), a dozen in practice.
    """
    edges = scratch.save(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links"
    )

    def signature(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = signature(edges)
    for _ in range(max_rounds):
        files = before[0] // ROWS_PER_FILE + 1  # rounds over few links do not write a file for every partition
        # large star: every neighbour above a node goes to the node's least neighbour (or itself)
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.save(
            both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")).coalesce(files), "least"
        )
        large = scratch.save(
            edges.join(least, edges.b == least.n).where("a <> m").select("a", F.col("m").alias("b")).distinct().coalesce(files), "large"
        )
        # small star: a node's smaller neighbours and itself go to the least of them
        low = scratch.save(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n").coalesce(files), "low")
        small = scratch.save(
            large.join(low, large.a == low.n)
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
            .coalesce(files),
            "small",
        )
        scratch.drop(edges, least, large, low)
        edges = small
        after = signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components: no fixed point")
    return scratch.save(
        edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()),
        "components",
    )
