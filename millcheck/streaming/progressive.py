"""Progressive audit as a stream: first verdicts, patches and interrupts by task and batch.

Events carry a task, a batch, a run and a stage; each micro-batch turns them to what a listener is told. Interrupted
batches wait in a quarantine table and come back when a correction for them arrives, which is a join and no suspended
process.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millcheck.operators.lookup import first_of

#: Gates in order of precedence, and the least confidence that passes.
GATES = (("UNKNOWN_STANDARD", "not standard_known"), ("UNKNOWN_GRADE", "not grade_known"), ("LOW_CONFIDENCE", "confidence < 0.8"), ("PROPERTY_AMBIGUITY", "category in ('mechanical', 'chemical') and property_confidence < 0.6"))


def gate() -> Column:
    """The first gate that stops a row for a person, null if none."""
    out = None
    for name, test in GATES:
        out = F.when(F.expr(test), name) if out is None else out.when(F.expr(test), name)
    return out


def thread_key(session: str, batch: str, run: str) -> Column:
    """session::batch, with ::run where there is a run."""
    return F.concat_ws("::", session, batch, run)


def told(events: DataFrame) -> DataFrame:
    """What a listener is told of each event (session_id, batch_id, run_id, stage, and the columns of GATES)."""
    g = gate()
    kind = F.when(F.col("stage") == "error", "error").when(g.isNotNull(), "hitl_interrupt").when(F.col("stage") == "deterministic_eval", "tier1_ready").when(F.col("stage") == "reevaluated", "tier2_patch").when(F.col("stage") == "done", "complete")
    return events.withColumn("gate", g).withColumn("kind", kind).where("kind is not null").withColumn("thread", thread_key("session_id", "batch_id", "run_id"))


def corrected(records: DataFrame, corrections: DataFrame) -> DataFrame:
    """records (thread, property_key, value) with the newest correction of each (thread, property_key, new_key, value,
    rejected, at) applied; what a reviewer rejected is marked, not dropped."""
    c = first_of(corrections, ["thread", "property_key"], F.desc("at")).select("thread", "property_key", "new_key", F.col("value").alias("new_value"), "rejected")
    x = records.join(c, ["thread", "property_key"], "left")
    return x.select(*(c for c in records.columns if c not in ("property_key", "value")), F.coalesce("new_key", "property_key").alias("property_key"), F.coalesce("new_value", "value").alias("value"), F.coalesce("rejected", F.lit(False)).alias("is_rejected"))


def resume(quarantine: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quarantined rows that a correction frees, and those that still wait."""
    return quarantine.join(corrections, "thread", "left_semi"), quarantine.join(corrections, "thread", "left_anti")


def event_rows(df: DataFrame) -> DataFrame:
    """The driver's events as audit events."""
    stage = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "deterministic_eval").when(F.col("event_type") == "click", "reevaluated").when(F.col("event_type") == "purchase", "done").otherwise("note")
    k = F.get_json_object("props", "$.k").cast("int")
    return df.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("batch_id"), F.lit(None).cast("string").alias("run_id"), stage.alias("stage"),
        (k % 10 != 0).alias("standard_known"), (k % 7 != 0).alias("grade_known"), F.when(k % 5 == 0, 0.7).otherwise(0.9).alias("confidence"), F.lit("mechanical").alias("category"), F.lit(0.9).alias("property_confidence"),
    )


def replay(spark: SparkSession, path: str) -> DataFrame:
    """Counts by what listeners were told, from the events read as a stream until its end. Each run has a name of its own."""
    name = f"progressive_{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    folder, _, file = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 8).parquet(f"{folder}/{file[:-8]}*")
    counts = told(event_rows(stream)).withWatermark("ts", "1 day").groupBy("kind", F.coalesce("gate", F.lit("-")).alias("gate")).agg(F.count("*").alias("n"))
    q = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.table(name)
