"""Extracted batches as records, and what is done to them before the audit.

A batch has batch_id, chemical array<struct<element,value>>, mechanical and process map<string,string>, and extra
array<struct<name,value,unit,category>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millcheck.functions import keys, text

# Names of the mechanical slots, in order of preference, and of the technical fields left out.
YIELD = ("yield_rp02", "yield_reh", "yield_rel", "yield_strength", "yield", "reh", "rp02", "屈服强度", "屈服点")
SLOTS = {"tensile_strength": ("tensile_rm",), "yield_strength_rp02": YIELD, "elongation_A": ("elongation_a",), "hardness": ("hardness",), "impact_absorbed_energy": ("impact_akv",)}
PROCESS_SLOTS = {"flattening_test": "flattening", "flaring_test": "flaring", "bending_test": "bending", "grain_size": "grainSize", "intergranular_corrosion": "intergranularCorrosion", "eddy_current_test": "ndt_et", "ultrasonic_test": "ndt_ut"}
METADATA = r"数量|重量|件数|支数|长度合计|合同号|订单号|页码"


def lead_number(c: Column) -> Column:
    """The number that a text starts with."""
    return F.nullif(F.regexp_extract(c, r"^[\s]*([-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+))", 1), F.lit("")).try_cast("double")


def slot(name: str) -> Column:
    """Value of a mechanical slot: the first of its names that is there, even if empty."""
    return F.coalesce(*(F.try_element_at("mechanical", F.lit(n)) for n in SLOTS[name]))


def records(batches: DataFrame) -> DataFrame:
    """Long form of batches: batch_id, pos, category, property_key, sub_property, value, raw, text, level, unit,
    provenance. Chemistry, then mechanics, process and extras; of process results with one property the first stays."""
    made = lambda order, cat, key, sub, value, raw, unit, prov: F.struct(F.lit(order).alias("part"), cat.alias("category"), key.alias("property_key"), sub.cast("string").alias("sub_property"), value.cast("double").alias("value"), raw.alias("raw"), unit.cast("string").alias("unit"), F.lit(prov).alias("provenance"))
    none, lit = F.lit(None), F.lit
    chem = F.transform(F.coalesce("chemical", F.array().cast("array<struct<element:string,value:string>>")), lambda c: made(1, lit("chemical"), c["element"], none, text.measured(text.clean(c["value"])), text.clean(c["value"]), lit("%"), "core"))
    hard = slot("hardness")
    scale = F.when(hard.rlike("(?i)HV|维氏"), "HV").when(hard.rlike("(?i)HRB|洛氏"), "HRB").when(hard.rlike("(?i)HBW|HBS|布氏"), "HBW")
    mech = F.array(
        made(2, lit("mechanical"), lit("tensile_strength"), none, lead_number(slot("tensile_strength")), slot("tensile_strength"), lit("MPa"), "core"),
        made(3, lit("mechanical"), lit("yield_strength_rp02"), none, text.measured(slot("yield_strength_rp02")), slot("yield_strength_rp02"), lit("MPa"), "core"),
        made(4, lit("mechanical"), lit("elongation_A"), none, lead_number(slot("elongation_A")), slot("elongation_A"), lit("%"), "core"),
        made(5, lit("mechanical"), lit("hardness"), scale, text.hardness_mean(hard), hard, scale, "core"),
        made(6, lit("mechanical"), lit("impact_absorbed_energy"), none, text.measured(slot("impact_absorbed_energy")), slot("impact_absorbed_energy"), lit("J"), "core"),
    )
    done = F.filter(F.concat(chem, mech), lambda r: F.coalesce(text.clean(r["raw"]), lit("")) != "")
    first = batches.select("batch_id", F.posexplode(done).alias("pos", "r")).select("batch_id", F.struct(F.col("r.part"), "pos").alias("o"), "r.*")
    entries = F.transform(F.map_entries(F.coalesce("process", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"), lit(None).cast("string").alias("unit"), lit("process").alias("category")))
    extra = F.coalesce("extra", F.array().cast("array<struct<name:string,value:string,unit:string,category:string>>"))
    tagged = lambda a, part: F.transform(a, lambda x: F.struct(lit(part).alias("part"), x["name"].alias("name"), x["value"].alias("value"), x["unit"].alias("unit"), x["category"].alias("category")))
    long = batches.select("batch_id", F.posexplode(F.concat(tagged(entries, 7), tagged(extra, 8))).alias("pos", "x")).select("batch_id", "pos", "x.*").where("name <> 'ndt' and trim(value) <> ''")
    number = text.measured(F.col("value"))
    long = long.withColumn("k", keys.canonical(F.col("name"), F.col("category"), F.col("unit"), number))
    dup = Window.partitionBy("batch_id", "part", "k.property_key").orderBy("pos")
    long = long.withColumn("n_", F.row_number().over(dup)).where("part = 8 or n_ = 1")
    second = long.select("batch_id", F.struct("part", "pos").alias("o"), "part", "k.category", "k.property_key", "k.sub_property", F.when(~text.packaged(F.col("value")), number).alias("value"), F.col("value").alias("raw"), "unit", F.when(F.col("part") == 7, "core").otherwise("additional").alias("provenance"))
    both = first.unionByName(second)
    pos = F.row_number().over(Window.partitionBy("batch_id").orderBy("o")) - 1
    words = F.when(F.col("value").isNull() | (F.col("part") == 7), text.result(F.col("raw")))
    return both.select("batch_id", pos.alias("pos"), "category", "property_key", "sub_property", "value", "raw", words.alias("text"), text.level(F.col("raw")).alias("level"), "unit", "provenance")


def annotate(extras: DataFrame) -> DataFrame:
    """Extra tests (batch_id, name, value, unit, category, and the batch's mechanical and process) with is_composite,
    duplicate_of and is_suspected_duplicate. Nothing is dropped; a composite is not looked at further."""
    k = keys.canonical(F.col("name"), F.col("category"), F.col("unit"), text.measured(F.col("value")))
    there = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    same = F.lit(None).cast("string")
    for name in SLOTS:
        same = F.when((F.col("k.property_key") == name) & there(slot(name)), name).otherwise(same)
    for name, source in PROCESS_SLOTS.items():
        same = F.when((F.col("k.property_key") == name) & there(F.try_element_at("process", F.lit(source))), name).otherwise(same)
    composite = text.packaged(F.col("value"))
    x = extras.withColumn("k", k).withColumn("is_composite", composite)
    x = x.withColumn("duplicate_of", F.when(~composite & F.col("k.is_known"), same))
    return x.withColumn("is_suspected_duplicate", F.col("duplicate_of").isNotNull()).drop("k")


def long_tail(recs: DataFrame) -> DataFrame:
    """Records that no rule is likely to know, without counts, weights and other papers' data."""
    return recs.where(~F.coalesce(F.col("is_known"), F.lit(False)) | (F.col("category") == "other")).where(~F.col("name").rlike(METADATA))


def not_empty(value: Column, raw: Column, words: Column) -> Column:
    there = lambda c: F.coalesce(text.clean(c), F.lit("")) != ""
    return value.isNotNull() | there(raw) | there(words)


def set_value(batches: DataFrame, edits: DataFrame) -> DataFrame:
    """batches with edited fields (batch_id, field, value): 'chem_<element>' or 'mech_<slot>'."""
    e = edits.groupBy("batch_id").agg(F.map_from_entries(F.collect_list(F.struct(F.lower("field"), "value"))).alias("e_"))
    new = lambda p, k: F.try_element_at("e_", F.concat(F.lit(p), F.lower(k)))
    x = batches.join(e, "batch_id", "left")
    chem = F.transform("chemical", lambda c: F.struct(c["element"].alias("element"), F.coalesce(new("chem_", c["element"]), c["value"]).alias("value")))
    mech = F.transform_values("mechanical", lambda k, v: F.coalesce(new("mech_", k), v))
    return x.withColumn("chemical", chem).withColumn("mechanical", mech).drop("e_")
