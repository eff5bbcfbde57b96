"""The whole audit as one plan: certificates and records against the rules of their slices.

rules is a catalogue: spec_key, rule_id, pos, rule_type, category, property_key, sub_property, level, trigger, lo, hi,
decimals, lo_inclusive, hi_inclusive, formula_lo, formula_hi, required_level, least_level, options
array<struct<key, required_level, lo, hi, decimals>>, group_id, group_op, min_pass, adjustments array<struct<when, min_offset,
max_offset>>, which may be left out. Its triggers, formulas and offsets are data of the plan (functions.programs). The records that rules ask for are settled by certificate and slot, with a partial aggregate
before the shuffle, and come together as one map per certificate; everything after that is by cert_id and stays where it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millcheck.functions import programs, verdicts
from millcheck.operators import audit as ops

SCHEMA = (
    "spec_key string, rule_id string, pos int, rule_type string, category string, property_key string, sub_property string, level string, trigger string, lo double, hi double, decimals int, lo_inclusive boolean, hi_inclusive boolean, "
    "formula_lo string, formula_hi string, required_level string, least_level double, options array<struct<key:string,required_level:string,lo:double,hi:double,decimals:int>>, group_id string, group_op string, min_pass int, adjustments array<struct<when:string,min_offset:double,max_offset:double>>"
)


@dataclass
class Audit:
    items: DataFrame
    groups: DataFrame
    summary: DataFrame
    unmatched: DataFrame


def value_of(source: Column, name: Column) -> Column:
    """A name of a formula, looked up in the certificate and the records that it holds."""
    record = F.try_element_at("held_", F.concat(F.lit(ops.NUMBER_OF), name))["value"]
    header = F.try_element_at("header", name).try_cast("double")
    return F.when(source == "record", record).when(source == "dimension", F.try_element_at("dimensions", name)).when(source == "header", header)


def slot_order() -> Column:
    """Names under which a rule looks for its record, first match first."""
    key, cat, sub = F.col("property_key"), F.col("category"), F.col("sub_property")
    words = F.col("rule_type").isin("qualitative_pass", "qualitative_enum", "alternative_group", "dynamic_formula_pass", "qualitative_and_numeric")
    kind = F.when(words, "#qual").otherwise("#num")
    plain = F.array(F.concat(key, kind), key, F.concat_ws("_", cat, key))
    both = F.concat_ws("_", key, sub)
    return F.when(sub.isNull(), plain).otherwise(F.array(F.concat(both, kind), both, F.concat(sub, kind), sub))


def audit(certs: DataFrame, records: DataFrame, rules: DataFrame, extras: DataFrame | None = None) -> Audit:
    """certs: cert_id, spec_key, header map<string,string>, dimensions map<string,double>. records: as slots() reads.
    extras: records that no rule asks for and that a reviewer has seen, with is_rejected; rejected ones fail."""
    if "adjustments" not in rules.columns:
        rules = rules.withColumn("adjustments", F.lit(None).cast("array<struct<when:string,min_offset:double,max_offset:double>>"))
    made = {"low_steps": programs.compiled(F.col("formula_lo")), "high_steps": programs.compiled(F.col("formula_hi")), "terms": programs.conditions(F.col("trigger")), "moved": programs.moved(F.col("adjustments"))}
    rules = rules.withColumns(made)
    # one count decides for all tables made of the catalogue: none has more rows than its rules have names
    small = F.broadcast if rules.limit(ops.SMALL + 1).count() <= ops.SMALL else lambda df: df
    # a rule with options asks for each option, other rules for themselves; worked out on the catalogue alone
    one = F.array(F.struct(F.col("property_key").alias("key"), F.lit(None).cast("string").alias("required_level"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(None).cast("int").alias("decimals")))
    chosen = F.col("rule_type").isin("or_choice_group", "alternative_group")
    asked = rules.select("*", F.posexplode(F.when(chosen, F.col("options")).otherwise(one)).alias("option_at", "option"))
    scale = F.array(F.concat_ws("_", "property_key", "option.key"), F.concat(F.lit("mech.hardness."), F.col("option.key")), F.col("option.key"))
    names = F.when(F.col("rule_type") == "or_choice_group", scale).when(F.col("rule_type") == "alternative_group", F.array(F.col("option.key"))).otherwise(slot_order())
    asked = asked.withColumn("rule_", F.col("rule_id")).withColumn("rule_id", F.concat_ws("\u0000", "rule_id", "option_at")).withColumn("names", names)
    # only slots that some rule or formula asks for are settled
    steps = F.concat(F.coalesce("low_steps", F.array().cast(programs.STEPS)), F.coalesce("high_steps", F.array().cast(programs.STEPS)))
    numbers = rules.select(F.explode(F.filter(steps, lambda s: s["source"] == "record")).alias("s")).select(F.concat(F.lit(ops.NUMBER_OF), "s.name").alias("slot"))
    wanted = small(asked.select(F.explode("names").alias("slot")).union(numbers).distinct())
    slotted = ops.settled_slots(records).select("cert_id", "slot", "rank_", "pos", "value", "text", "level")
    held = ops.held_maps(ops.arbitrate(slotted.join(wanted, "slot", "left_semi")))
    # by a merge join: the maps grow with the certificates, and everything after stays where it puts them
    x = certs.join(held.hint("merge"), "cert_id", "left").join(small(asked), "spec_key").withColumn("triggered", programs.holds(F.col("terms"), F.col("header"), F.col("dimensions")))
    x = x.withColumn("record", ops.first_held(F.col("names")))
    value, level = F.col("record.value"), F.col("level")
    found = F.col("record").isNotNull()
    words = F.concat_ws(" ", "record.text", "record.level")
    decimals = F.when(F.col("rule_type") == "or_choice_group", F.coalesce("option.decimals", F.lit(0))).otherwise(F.col("decimals"))
    # rounded once, in columns of their own: the verdicts use them many times
    limit = lambda c: F.when(F.col("rule_type") == "numeric_range", programs.move(F.col(c), F.col("moved"), "min_offset" if c == "lo" else "max_offset", F.col("header"))).otherwise(F.coalesce(f"option.{c}", c))
    x = x.withColumn("lo_", limit("lo")).withColumn("hi_", limit("hi"))
    rounded = verdicts.half_even(value, F.when(F.col("rule_type") == "dynamic_expression", F.coalesce(decimals, F.lit(3))).otherwise(decimals))
    x = x.withColumn("rounded_", rounded).withColumn("low_", programs.evaluate(F.col("low_steps"), value_of)).withColumn("high_", programs.evaluate(F.col("high_steps"), value_of))
    d = F.coalesce("decimals", F.lit(3))
    x = x.withColumn("low_", verdicts.half_even(F.col("low_"), d)).withColumn("high_", verdicts.half_even(F.col("high_"), d))
    ranged = verdicts.numeric_range(F.col("rounded_"), F.col("lo_"), F.col("hi_"), level, None, F.col("lo_inclusive"), F.col("hi_inclusive"))
    inside = (F.col("formula_lo").isNull() | F.coalesce(F.col("rounded_") >= F.col("low_"), F.lit(False))) & (F.col("formula_hi").isNull() | F.coalesce(F.col("rounded_") <= F.col("high_"), F.lit(False)))
    claimed = F.col("record.level")
    number = F.nullif(F.regexp_extract(claimed, r"[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).try_cast("double")
    verdict = (
        F.when(F.col("rule_type") == "exemption", "EXEMPT")
        .when(F.col("rule_type").isin("numeric_range", "or_choice_group"), ranged["status"])
        .when(F.col("rule_type") == "dynamic_expression", verdicts.status(value.isNotNull(), inside, level))
        .when(F.col("rule_type") == "alternative_group", verdicts.status(found, verdicts.alternative(words, claimed, F.col("option.required_level")), level))
        .when(F.col("rule_type").isin("dynamic_formula_pass", "qualitative_and_numeric"), verdicts.visual(words, found, level))
        .otherwise(verdicts.enum(words, claimed, number, F.col("required_level"), F.col("least_level"), found, level))
    )
    each = x.select("cert_id", "spec_key", F.col("rule_").alias("rule_id"), "triggered", found.alias("found"), verdict.alias("s"), F.when(F.col("rule_type") == "numeric_range", ranged["deviation"]).alias("deviation"), value.alias("value"), F.coalesce("low_", "high_").alias("bound"))
    has = lambda s: F.max((F.col("s") == s).cast("int")) == 1
    reported = F.max(F.col("found").cast("int")) == 1
    status = F.when(has("EXEMPT"), "EXEMPT").when(has("PASS"), "PASS").when(has("FAIL") & reported, "FAIL").when(has("MISSING"), "MISSING").otherwise("SKIPPED")
    items = each.groupBy("cert_id", "spec_key", "rule_id").agg(status.alias("status"), reported.alias("reported"), (F.max(F.col("triggered").cast("int")) == 1).alias("triggered"), F.max("deviation").alias("deviation"), F.max("value").alias("value"), F.max("bound").alias("bound"))
    items = items.join(small(rules.select("spec_key", "rule_id", "pos", "rule_type", "property_key", "level", "group_id", "group_op", "min_pass")), ["spec_key", "rule_id"])
    items = items.withColumn("status", verdicts.dispatch(F.col("triggered"), F.col("reported"), F.col("status")))
    listed = ops.with_groups(items)
    groups = listed.where("group_id is not null and order_ = 1").select("cert_id", "group_id", "group_op", "n_rules", "n_pass", "n_fail", "n_missing", "group_status", "blocking")
    keys = F.concat(F.array("property_key"), F.coalesce(F.transform("options", lambda o: o["key"]), F.array().cast("array<string>")))
    looked_at = small(rules.select("spec_key", F.explode(keys).alias("property_key")).distinct())
    rest = records.join(certs.select("cert_id", "spec_key"), "cert_id").join(looked_at, ["spec_key", "property_key"], "left_anti")
    judged = listed if extras is None else listed.unionByName(ops.rejected_rows(extras), allowMissingColumns=True)
    return Audit(listed, groups, ops.summary(certs, judged), rest.select(*records.columns))
