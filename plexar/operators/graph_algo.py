"""Iterative graph algorithms as joins. Every round is written to the shared folder, which cuts the lineage; what comes
to the driver is a count."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or, on one machine, one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        found = "/tmp/checkpoints/plexar"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Rounds:
    """Tables of an iteration; only the latest of each name stays."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n, self.last = spark, f"{checkpoint_dir(spark)}/rounds-{uuid.uuid4().hex}", 0, {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{name}-{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        if old := self.last.get(name):
            p = self.spark._jvm.org.apache.hadoop.fs.Path(old)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self.last[name] = path
        return out


def bfs(links: DataFrame, start: DataFrame, max_depth: int = 10) -> DataFrame:
    """(node, depth) of all nodes within max_depth steps of the start nodes (column node). Follows src to dst."""
    spark = links.sparkSession
    rounds = Rounds(spark)
    pairs = rounds.save(links.select("src", "dst").distinct(), "links")
    seen = rounds.save(start.select("node").distinct().withColumn("depth", F.lit(0)), "seen")
    for depth in range(1, max_depth + 1):
        front = seen.where(F.col("depth") == depth - 1).select(F.col("node").alias("src"))
        new = pairs.join(front, "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        new = rounds.save(new.withColumn("depth", F.lit(depth)), "front")
        if new.isEmpty():
            break
        seen = rounds.save(seen.unionByName(new), "seen")
    return seen


def shortest_paths(links: DataFrame, source: str, max_rounds: int | None = None, weight: str | None = None) -> DataFrame:
    """(node, cost, previous): least cost from the source to every node it reaches; hops where no weight is named.

    Weights must not be negative; negative ones raise, as rounds would not end. Of equal costs the least previous node is
    kept. Rounds go on until nothing changes; where max_rounds is given and does not suffice, this raises."""
    spark = links.sparkSession
    rounds = Rounds(spark)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    pairs = rounds.save(links.select("src", "dst", w.alias("w")).groupBy("src", "dst").agg(F.min("w").alias("w")), "links")
    best = rounds.save(spark.createDataFrame([(source, 0.0, None)], "node string, cost double, previous string"), "best")
    if pairs.where("w < 0").limit(1).count():
        raise ValueError("shortest_paths: negative weight")
    front = best
    for done in itertools.count():
        if max_rounds is not None and done >= max_rounds:
            raise RuntimeError("shortest_paths: no fixed point within the rounds")
        step = pairs.join(front.select(F.col("node").alias("src"), "cost"), "src")
        step = step.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct((F.col("cost") + F.col("w")).alias("cost"), F.col("src").alias("previous"))).alias("b"))
        step = step.select("node", "b.cost", "b.previous")
        old = best.select("node", F.col("cost").alias("was"))
        front = rounds.save(step.join(old, "node", "left").where(F.col("was").isNull() | (F.col("cost") < F.col("was"))).drop("was"), "front")
        if front.isEmpty():
            break
        best = rounds.save(best.join(front, "node", "left_anti").unionByName(front), "best")
    return best


def pagerank(links: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, rank) after a fixed number of rounds; ranks add up to the number of nodes, and nodes without links out give
    their rank to all equally."""
    spark = links.sparkSession
    keep = Rounds(spark)
    pairs = keep.save(links.select("src", "dst").distinct(), "links")
    degree = pairs.groupBy("src").agg(F.count("*").alias("degree"))
    nodes = keep.save(pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct().join(degree, F.col("node") == F.col("src"), "left").select("node", "degree"), "nodes")
    n = nodes.count()
    ranks = nodes.select("node", "degree", F.lit(1.0).alias("rank"))
    for _ in range(rounds):
        loose = ranks.where(F.col("degree").isNull()).agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        given = pairs.join(ranks.where(F.col("degree").isNotNull()).select(F.col("node").alias("src"), (F.col("rank") / F.col("degree")).alias("share")), "src")
        given = given.groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("got"))
        new = (1 - damping) + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(loose / max(n, 1)))
        ranks = keep.save(nodes.join(given, "node", "left").select("node", "degree", new.alias("rank")), "ranks")
    return ranks.select("node", "rank")


def connected(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component): the least node name that is reachable when links go both ways. Least names spread along links,
    and each round also jumps to the name of one's name, so that long chains take few rounds."""
    keep = Rounds(links.sparkSession)
    both = links.select("src", "dst").union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = keep.save(both, "links")
    labels = keep.save(both.select(F.col("src").alias("node"), F.col("src").alias("component")).distinct(), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("now"))
        step = keep.save(step, "step")
        jump = step.select(F.col("node").alias("now"), F.col("now").alias("jump"))
        new = keep.save(step.join(jump, "now", "left").select("node", "was", F.least("now", F.coalesce("jump", "now")).alias("component")), "new")
        changed = new.where(F.col("component") < F.col("was")).limit(1).count()
        labels = keep.save(new.select("node", "component"), "labels")
        if not changed:
            return labels
    raise RuntimeError("connected: no fixed point within the rounds")
