"""Names that reviewers have taught, valid from one time to another, and grades by their usual names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millcheck.functions.keys import canonical, cleaned


def intervals(events: DataFrame) -> DataFrame:
    """key, property_key, category, valid_from, valid_to (null: still valid) of events (alias, event_at, event_id, status,
    property_key, category).

    registered makes an alias valid with its property, revoked suspends it, restored makes it valid again, deleted forgets
    it, so that nothing is left to restore. Other statuses and events without alias or time change nothing."""
    x = events.where(F.col("status").isin("registered", "revoked", "restored", "deleted") & F.col("alias").isNotNull() & F.col("event_at").isNotNull())
    order = Window.partitionBy("key").orderBy("event_at", "event_id")
    x = x.withColumn("key", cleaned(F.trim("alias"))).withColumn("life", F.sum((F.col("status") == "deleted").cast("int")).over(order))
    taught = F.when(F.col("status") == "registered", F.struct("property_key", "category"))
    life = Window.partitionBy("key", "life").orderBy("event_at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("taught", F.last(taught, ignorenulls=True).over(life)).withColumn("valid_to", F.lead("event_at").over(order))
    valid = F.col("status").isin("registered", "restored") & F.col("taught").isNotNull() & (F.col("valid_to").isNull() | (F.col("event_at") < F.col("valid_to")))
    return x.where(valid).select("key", F.col("taught.property_key").alias("property_key"), F.col("taught.category").alias("category"), F.col("event_at").alias("valid_from"), "valid_to")


#: Seconds of a range of time: a name that very many records have is as many tasks as it has ranges.
RANGE = 86_400


def as_of(records: DataFrame, known: DataFrame, name: str, at: str) -> DataFrame:
    """records with learned: struct(property_key, category) of the alias that was valid for their name at their time, null if
    none was.

    Intervals of a key do not overlap, so the last one that began decides. Records and intervals are sorted together by key
    and range of time, and each range begins with the last interval of the ranges before it, so the work grows with the rows,
    however many intervals and records a key has."""
    begins = known.select(F.col("key").alias("asked_"), F.col("valid_from").alias("at_"), F.struct("valid_from", "valid_to", F.struct("property_key", "category").alias("learned")).alias("i_")).withColumn("range_", F.floor(F.col("at_").cast("double") / RANGE))
    x = records.withColumns({"asked_": cleaned(F.trim(F.col(name))), "at_": F.col(at).cast("timestamp")})
    placed = F.col("asked_").isNotNull() & F.col("at_").isNotNull()
    none = F.lit(None).cast("struct<property_key:string,category:string>")
    apart = x.where(~placed).select(*records.columns, none.alias("learned"))
    x = x.where(placed).withColumn("range_", F.floor(F.col("at_").cast("double") / RANGE))
    ranges = x.select("asked_", "range_").distinct().select("*", F.lit(None).cast(begins.schema["i_"].dataType).alias("i_"))
    ranges = ranges.union(begins.groupBy("asked_", "range_").agg(F.max_by("i_", "at_").alias("i_"))).groupBy("asked_", "range_").agg(F.first("i_", ignorenulls=True).alias("i_"))
    before = Window.partitionBy("asked_").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select("asked_", "range_", F.last("i_", ignorenulls=True).over(before).alias("i_")).where("i_ is not null").withColumn("at_", F.col("i_.valid_from"))
    own = F.struct(*records.columns)
    begins = begins.unionByName(carried).select("asked_", "range_", "at_", "i_", F.lit(None).cast(x.select(own.alias("r")).schema["r"].dataType).alias("r_"))
    rows = begins.unionByName(x.select("asked_", "range_", "at_", F.lit(None).cast(begins.schema["i_"].dataType).alias("i_"), own.alias("r_")))
    # an interval comes before the records of its first moment
    so_far = Window.partitionBy("asked_", "range_").orderBy("at_", F.col("i_").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("i_", F.last("i_", ignorenulls=True).over(so_far)).where("r_ is not null")
    valid = F.col("i_.valid_to").isNull() | (F.col("at_") < F.col("i_.valid_to"))
    return rows.select("r_.*", F.when(valid, F.col("i_.learned")).alias("learned")).union(apart)


def property_as_of(records: DataFrame, known: DataFrame, name: str, at: str, category: Column | None = None, unit: Column | None = None) -> DataFrame:
    """records with property: struct(property_key, category, sub_property, is_known, is_learned). What reviewers have taught
    goes before the cascade of functions.keys."""
    learned = F.struct("learned.property_key", "learned.category", F.lit(None).cast("string").alias("sub_property"), F.lit(True).alias("is_known"), F.lit(True).alias("is_learned"))
    usual = F.struct("found_.property_key", "found_.category", "found_.sub_property", "found_.is_known", F.lit(False).alias("is_learned"))
    x = as_of(records, known, name, at).withColumn("found_", canonical(F.col(name), category, unit))
    return x.withColumn("property", F.when(F.col("learned").isNotNull(), learned).otherwise(usual)).drop("learned", "found_")


# Usual names of grades: primary name, code, structure, and all names without marks in upper case.
GRADES = (
    ("06Cr19Ni10", "S30408", "austenitic", "06CR19NI10 0CR18NI9 S30408 SUS304 TP304 304"),
    ("022Cr19Ni10", "S30403", "austenitic", "022CR19NI10 00CR19NI10 S30403 SUS304L TP304L 304L"),
    ("07Cr19Ni10", "S30409", "austenitic", "07CR19NI10 S30409 TP304H"),
    ("06Cr17Ni12Mo2", "S31608", "austenitic", "06CR17NI12MO2 0CR17NI12MO2 S31608 SUS316 TP316"),
    ("022Cr17Ni12Mo2", "S31603", "austenitic", "022CR17NI12MO2 00CR17NI14MO2 S31603 SUS316L TP316L 316L"),
    ("06Cr17Ni12Mo2Ti", "S31668", "austenitic", "06CR17NI12MO2TI S31668 316TI TP316TI"),
    ("06Cr18Ni11Ti", "S32168", "austenitic", "06CR18NI11TI 0CR18NI10TI S32168 SUS321 TP321"),
    ("07Cr19Ni11Ti", "S32169", "austenitic", "07CR19NI11TI S32169 TP321H"),
    ("06Cr18Ni11Nb", "S34778", "austenitic", "06CR18NI11NB S34778 TP347"),
    ("07Cr18Ni11Nb", "S34779", "austenitic", "07CR18NI11NB S34779 TP347H"),
    ("015Cr21Ni26Mo5Cu2", "S39042", "austenitic", "015CR21NI26MO5CU2 S39042 904L N08904"),
    ("015Cr20Ni18Mo6CuN", "S31252", "austenitic", "015CR20NI18MO6CUN S31252 254SMO"),
    ("022Cr21Ni25Mo7N", "S38367", "austenitic", "022CR21NI25MO7N S38367 654SMO"),
    ("10Cr17", "S11710", "ferritic", "10CR17 1CR17 S11710 SUS430 TP430"),
    ("008Cr27Mo", "S12791", "ferritic", "008CR27MO S12791"),
    ("06Cr13", "S11306", "ferritic", "06CR13 S11306 TP410S"),
)


def bare_grade(c: Column) -> Column:
    """A grade without the standard before it and the brackets in it."""
    start = r"(?i)^(ASTM\s+[A-Z0-9/]+|GB[/_\-T\s0-9]+|JIS\s+[A-Z0-9]+)[\s:,/]+"
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), start, ""), r"\s*[(（][^()（）]*[)）]", ""))


def usual_grade(c: Column) -> Column:
    """struct(primary_grade, unified_code, structure_type, confidence) of a grade by its usual names, with 0.98; others as they
    are written, with 0.5."""
    names = [x for primary, code, kind, all_names in GRADES for n in all_names.split() for x in (F.lit(n), F.struct(F.lit(primary).alias("primary_grade"), F.lit(code).alias("unified_code"), F.lit(kind).alias("structure_type"), F.lit(0.98).alias("confidence")))]
    none = F.lit(None).cast("string")
    found = F.try_element_at(F.create_map(*names), F.regexp_replace(F.upper(bare_grade(c)), r"[\s\-_/\\]", ""))
    return F.coalesce(found, F.struct(bare_grade(c).alias("primary_grade"), none.alias("unified_code"), none.alias("structure_type"), F.lit(0.5).alias("confidence")))
