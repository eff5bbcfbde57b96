"""Raw payloads of extractors, whatever their shape, as certificates and clean records.

A payload is JSON text with a header and test_records. Fields stand alone or as objects with a value; records are a list of
objects, or one object of results by name. All shapes are read by one plan, as variants, without a fixed schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millcheck.functions import keys, text, units

HEADER = ("certificate_no", "supplier_name", "purchase_order_no", "declared_standard", "declared_grade", "heat_number", "lot_number", "material_form", "manufacturing_process", "delivery_state", "issue_date", "inspector_name")


def scalar(v: Column, path: str) -> Column:
    """The text of a field, or of the value of the object there; null where neither is a plain value."""
    # an object or a list as text is its JSON, which is no value
    plain = lambda p: F.when(~F.coalesce(F.schema_of_variant(F.try_variant_get(v, p, "variant")).rlike("^(OBJECT|ARRAY)"), F.lit(True)), F.try_variant_get(v, p, "string"))
    return F.coalesce(plain(f"{path}.value"), plain(path))


def first(v: Column, *paths: str) -> Column:
    return F.coalesce(*(scalar(v, p) for p in paths))


def parsed(payloads: DataFrame, body: str) -> DataFrame:
    """payloads with v_, the variant of the body, null where it is no JSON."""
    return payloads.withColumn("v_", F.try_parse_json(text.json_body(F.col(body))))


def certificates(payloads: DataFrame, key: str = "payload_id", body: str = "body") -> DataFrame:
    """A row per payload: key, the fields of HEADER (trimmed, null if blank), confidence (0.95 if not said). A standard or grade
    that is not declared is UNKNOWN, a certificate without a number UNKNOWN-NO."""
    x = parsed(payloads, body)
    field = {c: F.nullif(text.clean(scalar(F.col("v_"), f"$.header.{c}")), F.lit("")) for c in HEADER}
    field |= {c: F.coalesce(field[c], F.lit("UNKNOWN-NO" if c == "certificate_no" else "UNKNOWN")) for c in ("certificate_no", "declared_standard", "declared_grade")}
    return x.select(key, *(c.alias(n) for n, c in field.items()), F.coalesce(F.try_variant_get("v_", "$.overall_confidence", "double"), F.lit(0.95)).alias("confidence"))


def raw_records(payloads: DataFrame, key: str = "payload_id", body: str = "body") -> DataFrame:
    """key, pos, name, category, raw, unit: a row per record that has a name."""
    listed = F.try_variant_get("v_", "$.test_records", "array<variant>")
    named = F.map_entries(F.try_variant_get("v_", "$.test_records", "map<string,variant>"))
    none = F.lit(None).cast("string")
    one = F.struct(none.alias("name"), F.col("v_").alias("v"))
    items = F.coalesce(F.transform(listed, lambda v: F.struct(none.alias("name"), v.alias("v"))), F.transform(named, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("v"))), F.filter(F.array(one), lambda _: F.lit(False)))
    x = parsed(payloads, body).select(key, F.posexplode(items).alias("pos", "i")).select(key, "pos", F.col("i.name").alias("name"), F.col("i.v").alias("v"))
    v, by_name = F.col("v"), F.col("name").isNotNull()
    raw = F.when(by_name, F.coalesce(first(v, "$.raw_value"), scalar(v, "$"))).otherwise(first(v, "$.raw_value", "$.value"))
    x = x.select(key, "pos", F.coalesce("name", first(v, "$.raw_property_name", "$.name")).alias("name"), first(v, "$.raw_category", "$.category").alias("category"), raw.alias("raw"), first(v, "$.raw_unit", "$.unit").alias("unit"))
    return x.where(F.coalesce(F.trim("name"), F.lit("")) != "")


def records(payloads: DataFrame, key: str = "payload_id", body: str = "body") -> DataFrame:
    """key, pos, category, property_key, sub_property, is_known, value, unit, text, level, raw, from_unit (of a converted
    strength), problem (what could not be read): raw records cleaned by their category.

    Chemistry and elongation are percent, strength is MPa, hardness the number in its scale, grain size a class; roughness has a
    number and a result, all others a result, a level and the number in their text."""
    # a file of payloads is small for the work that they make: one that is read by a task or two is dealt to all
    x = raw_records(payloads.repartition(3 * payloads.sparkSession.sparkContext.defaultParallelism), key, body)
    k = keys.canonical(F.col("name"), F.col("category"), F.col("unit"), text.measured(F.col("raw")))
    x = x.withColumn("k", k).select(key, "pos", "name", "k.category", "k.property_key", "k.sub_property", "k.is_known", "raw", F.col("unit").alias("raw_unit"))
    said, number = text.quantity(F.col("raw")), text.measured(F.col("raw"))
    x = x.withColumn("said_", said).withColumn("given_", F.coalesce("raw_unit", F.nullif("said_.unit", F.lit(""))))
    chemical, elongation, hardness = F.col("category") == "chemical", F.col("property_key") == "elongation_A", F.col("property_key") == "hardness"
    strength = (F.col("category") == "mechanical") & ~elongation & ~hardness
    grain, rough = F.col("category") == "metallographic", F.col("property_key") == "surface_roughness"
    exact_number, loose = F.col("said_.number"), F.nullif(F.regexp_extract("raw", r"[-+]?[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).try_cast("double")
    value = F.when(chemical | elongation, exact_number).when(strength, units.to_mpa(exact_number, F.col("given_"))).when(hardness, text.hardness_mean(F.col("raw"))).when(grain, number).otherwise(loose)
    unit = F.when(chemical | elongation, "%").when(strength, "MPa").when(hardness, F.coalesce("sub_property", F.lit("HRB"))).when(grain, "级").when(rough, F.coalesce("raw_unit", F.lit("μm"))).otherwise(F.col("raw_unit"))
    words = ~(chemical | (F.col("category") == "mechanical") | grain)
    converted = strength & F.lower(F.trim("given_")).isin(*units.STRENGTH)
    problem = F.when(~F.col("is_known"), "unknown property").when((chemical | strength | elongation) & exact_number.isNull(), "not a number")
    x = x.withColumn("value", value)
    return x.select(
        key, "pos", "category", "property_key", "sub_property", "is_known", "value", F.when(F.col("value").isNotNull(), unit).alias("unit"), F.when(words, text.result(F.col("raw"))).alias("text"), F.when(words & ~rough, text.level(F.col("raw"))).alias("level"),
        F.coalesce("raw", F.lit("")).alias("raw"), F.when(converted & F.col("value").isNotNull(), F.col("given_")).alias("from_unit"), problem.alias("problem"),
    )
