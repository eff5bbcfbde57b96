"""Tables kept in versions: a commit adds files and names, by day, those that belong to its version.

Rows lie in folders part=<commit>/day=<day>, which are written once and never changed. A version is one small file that lists
which parts hold which days; it appears with the rename that ends its writing, after the rows are there. So a reader sees a
version whole or not at all, one that reads an older version goes on undisturbed, and what a writer left behind that died
before its commit belongs to no version. A deletion rewrites the days that it touches and no others. Writers come one at a
time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millcheck.operators.lineage import cut

VERSION = "version long, day date, part string"


class Versions:
    """A table of rows of a schema at a path that all executors share. Its rows are kept by the column day, a date; a null day is
    that of NO_DAY."""

    NO_DAY = "0001-01-01"

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.schema, self.rows, self.list = spark, schema, f"{path}/rows", f"{path}/versions"

    def files(self, path: str, schema: str) -> DataFrame:
        """What is at a path, no rows before anything has been written there."""
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def versions(self) -> DataFrame:
        """version, day, part of all versions; each has a row without a day besides."""
        return self.files(self.list, VERSION)

    def all_rows(self) -> DataFrame:
        return self.files(self.rows, f"{self.schema}, part string")

    def latest(self) -> int:
        """The number of the newest version, 0 before the first."""
        return self.versions().agg(F.max("version")).first()[0] or 0

    def manifest(self, version: int | None = None) -> DataFrame:
        """day, part of a version, the newest if none is named."""
        n = self.latest() if version is None else version
        return self.versions().where(F.col("version") == n).where("day is not null").select("day", "part")

    def read(self, version: int | None = None, days: tuple[str, str] | None = None) -> DataFrame:
        """The rows of a version, all or those of some days; only the folders of these are read."""
        listed = self.manifest(version)
        listed = listed.where(F.col("day").between(*days)) if days else listed
        x = self.all_rows()
        # a row per day and part: bounded by the folders, which the scan lists anyway
        return x.join(F.broadcast(listed), ["day", "part"], "left_semi").select(*self.names())

    def names(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def commit(self, rows: DataFrame, replaced: DataFrame | None = None) -> int:
        """A version with the rows added, and without the days (day) that are replaced but for what rows has of them."""
        part, n = f"c{uuid.uuid4().hex}", self.latest()
        rows = rows.select(*self.names()).withColumn("day", F.coalesce("day", F.lit(self.NO_DAY).cast("date")))
        # a day's rows in few files, a large day's in several tasks
        rows.withColumn("part", F.lit(part)).hint("rebalance", "day").write.partitionBy("part", "day").mode("append").parquet(self.rows)
        self.publish(part, n, replaced)
        return n + 1

    def publish(self, part: str, n: int, replaced: DataFrame | None) -> None:
        """Lists the version after n: what it keeps of n and the days of the part."""
        kept = self.manifest(n)
        kept = kept if replaced is None else kept.join(replaced.select("day").distinct(), "day", "left_anti")
        new = self.all_rows().where(F.col("part") == part).select("day", "part").distinct()
        listed = kept.unionByName(new).withColumn("version", F.lit(n + 1).cast("long"))
        empty = self.spark.createDataFrame([(n + 1, None, None)], VERSION)
        listed.select("version", "day", "part").union(empty).coalesce(1).write.mode("append").parquet(self.list)

    def append(self, rows: DataFrame) -> int:
        return self.commit(rows)

    def change(self, keys: DataFrame, on: str, new: DataFrame | None = None) -> int:
        """A version without the rows whose `on` is in keys, and with the new rows, if any. Days without such rows stay as they
        are; the others are written again."""
        if not self.latest():
            return self.commit(new) if new is not None else 0
        now, gone = self.read(), keys.select(on).where(F.col(on).isNotNull())
        # found once, as what stays and what is listed both need it; a row per day
        touched = cut(now.join(gone, on, "left_semi").select("day").distinct())
        left = now.join(F.broadcast(touched), "day", "left_semi").join(gone, on, "left_anti")
        return self.commit(left if new is None else left.unionByName(new), touched)

    def changed_days(self, since: int) -> DataFrame:
        """The days whose parts are not those of an older version."""
        old, now = self.manifest(since), self.manifest()
        return now.exceptAll(old).union(old.exceptAll(now)).select("day").distinct()


def refresh(table: Versions, summary: Versions, partial: Callable[[DataFrame], DataFrame], key: str = "source_version") -> int:
    """Brings a table of partial aggregates by day up to the newest version of another: only days that have changed since
    are worked out again. partial: rows to their aggregates, by day and more; they carry the version that they come from."""
    n = table.latest()
    seen = summary.read().agg(F.max(key)).first()[0] or 0
    days = table.changed_days(seen)
    fresh = partial(table.read().join(F.broadcast(days), "day", "left_semi")).withColumn(key, F.lit(n).cast("long"))
    return summary.commit(fresh, days)
