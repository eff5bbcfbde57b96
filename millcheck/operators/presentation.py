"""What a reviewer sees beside verdicts: where an item comes from, and the names of what no rule asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that stand for a reviewer's decision and are no names, and what is shown where there is no name.
AGREED, REJECTED = "special_protocol_item", "unrecognized_rejected_item"
SHOWN = {AGREED: "订货技术协议特约项目", REJECTED: "未识别非标排除项"}
UNNAMED = "特约检验项目"


def name_or_null(c: Column) -> Column:
    """A name, null if it is empty or stands for a decision."""
    return F.when((F.coalesce(F.trim(c), F.lit("")) != "") & ~F.lower(F.trim(c)).isin(AGREED, REJECTED), c)


def origins(items: DataFrame, resolved: DataFrame, corrections: DataFrame) -> DataFrame:
    """items (cert_id, property_key) with origin: degraded or resolved if the property was resolved (cert_id,
    resolved_key, is_degraded, pos; the first), else corrected if a reviewer mapped a name to it (cert_id, raw_name,
    target_key), else null; and raw_name, the first such name. Each side is one row per property before it is joined."""
    r = resolved.groupBy("cert_id", F.col("resolved_key").alias("property_key")).agg(F.min_by("is_degraded", "pos").alias("d_"), F.count("*").alias("n_"))
    c = corrections.groupBy("cert_id", F.col("target_key").alias("property_key")).agg(F.min("raw_name").alias("raw_name"))
    x = items.join(r, ["cert_id", "property_key"], "left").join(c, ["cert_id", "property_key"], "left")
    origin = F.when(F.col("n_").isNotNull(), F.when(F.coalesce("d_", F.lit(False)), "degraded").otherwise("resolved")).when(F.col("raw_name").isNotNull(), "corrected")
    return x.withColumn("origin", origin).drop("d_", "n_")


def shown_names(unmatched: DataFrame, corrections: DataFrame, tests: DataFrame) -> DataFrame:
    """unmatched (cert_id, rec_id, property_key, raw_name, display_name, measured) with shown: its raw name, else its shown
    name, else the name that a reviewer mapped to its property, else that of an extra test (cert_id, name, result) with
    its result, else a text for what the reviewer decided. Of several names the first by order of names."""
    by_key = corrections.where(name_or_null(F.col("raw_name")).isNotNull()).groupBy("cert_id", F.col("target_key").alias("property_key")).agg(F.min("raw_name").alias("by_key"))
    decided = corrections.groupBy("cert_id", "raw_name").agg(F.min("target_key").alias("decided"))
    by_result = tests.where(name_or_null(F.col("name")).isNotNull() & F.col("result").isNotNull()).groupBy("cert_id", F.col("result").alias("measured")).agg(F.min("name").alias("by_result"))
    x = unmatched.join(by_key, ["cert_id", "property_key"], "left").join(by_result, ["cert_id", "measured"], "left").join(decided, ["cert_id", "raw_name"], "left")
    said = F.coalesce(F.when(F.col("property_key").isin(AGREED, REJECTED), F.col("property_key")), F.col("decided"))
    default = F.when(said == AGREED, SHOWN[AGREED]).when(said == REJECTED, SHOWN[REJECTED]).otherwise(UNNAMED)
    shown = F.coalesce(name_or_null(F.col("raw_name")), name_or_null(F.col("display_name")), "by_key", "by_result", default)
    return x.withColumn("shown", shown).drop("by_key", "by_result", "decided")


def item_filter(items: DataFrame, wanted: str) -> DataFrame:
    """Items of a report: all, those that failed or are missing (fail_or_missing), or those of a category."""
    if wanted == "all":
        return items
    return items.where(F.col("status").isin("FAIL", "MISSING") if wanted == "fail_or_missing" else F.col("category") == wanted)


def slice_filter(slices: DataFrame, q: str = "", structure: str = "all") -> DataFrame:
    """Slices of a structure (all for any; duplex is austenitic_ferritic too) with q in their key, grade, code, shown name
    or an alias, whatever its case."""
    kinds = [structure, "austenitic_ferritic"] if structure == "duplex" else [structure]
    x = slices if structure == "all" else slices.where(F.col("structure_type").isin(*kinds))
    q = q.strip().lower()
    if not q:
        return x
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False))
    alias = F.coalesce(F.exists("aliases", lambda a: F.contains(F.lower(a), F.lit(q))), F.lit(False))
    return x.where(has(F.col("spec_key")) | has(F.col("primary_grade")) | has(F.col("unified_code")) | has(F.col("display_name")) | alias)
