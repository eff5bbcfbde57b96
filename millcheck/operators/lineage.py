"""Cutting lineage in the shared folder, and connected components, which need it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, one machine can have a
    new folder, as in tests; on a cluster executors would write to their own disks, so it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint, which outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large and small stars.

    edges: columns a and b of one ordered type; loops, repeats and both directions are allowed, rows with a null are
    not links. Returns node, component (the smallest node that is reachable) for every node of a link between two
    different nodes. Each round is two aggregates and two joins on the node, so no node's neighbours are ever
    collected; a hub's rows are spread by the skew join. Ends when a round leaves the links as they were.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # every link now goes from a node to a smaller one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
        state = now
