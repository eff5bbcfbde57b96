"""What the corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millcheck.operators.lineage import components, cut, shared_dir

__all__ = ["WORD", "components", "cut", "scratch", "shared_dir", "table", "words"]

#: A word, as Spark's and DuckDB's regular expressions write it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8. bytes.split() splits at exactly \\x20 and \\x09-\\x0D."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
