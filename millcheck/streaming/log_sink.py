"""Log events kept from a stream: each line once, and the newest lines at hand.

A micro-batch writes its lines to a folder of its own number, which a replay of the batch writes over; so a stream that died
between its write and its commit leaves each line once when it is begun again. The newest lines are kept beside: a batch
merges its own with those that the batch before has left, by a top-n, and writes them to the other of two folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millcheck.operators.ledger import last_n

#: Fixed value: lines that are kept at hand.
RING = 1000


def newest(spark: SparkSession, path: str, slot: int, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(f"{path}/newest/slot={slot}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append(path: str, order: tuple[str, ...], ring: int = RING, after_lines: Callable[[int], None] = lambda batch: None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch. order: columns by which lines are newer. after_lines is called between the two writes."""

    def write(lines: DataFrame, batch: int) -> None:
        spark = lines.sparkSession
        lines.write.mode("overwrite").parquet(f"{path}/lines/batch={batch}")
        after_lines(batch)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema)
        mine = spark.read.schema(schema).parquet(f"{path}/lines/batch={batch}")
        before = newest(spark, path, (batch + 1) % 2, f"{schema}, ring_batch long").drop("ring_batch")
        both = last_n(before.unionByName(mine), ring, *order).withColumn("ring_batch", F.lit(batch).cast("long"))
        both.write.mode("overwrite").parquet(f"{path}/newest/slot={batch % 2}")

    return write


def sink(stream: DataFrame, path: str, order: tuple[str, ...], **more) -> None:
    """Runs a stream of log events to its end. Begun again with the same path it goes on where it stopped."""
    q = stream.writeStream.foreachBatch(append(path, order, **more)).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()


def lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines, with the batch that brought each."""
    return spark.read.parquet(f"{path}/lines")


def recent(spark: SparkSession, path: str, n: int, *order: str) -> DataFrame:
    """The newest n lines, RING at most, from those at hand."""
    both = spark.read.option("basePath", f"{path}/newest").parquet(f"{path}/newest/slot=*")
    last = both.agg(F.max("ring_batch")).first()[0]
    return last_n(both.where(F.col("ring_batch") == last).drop("ring_batch", "slot"), n, *order)
