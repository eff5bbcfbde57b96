"""Several specifications as one: for each property the strictest limits, with where they come from.

rules: property_key, sub_property, standard_id, category, priority, pos (order within equal priority), rule_id, level,
lo, hi, unit, decimals. The first rule of a property is that of the smallest (priority, pos).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millcheck.functions.verdicts import rank
from millcheck.operators.audit import highest_level


def priority_of(standard_id: Column, name: Column) -> Column:
    """struct(category, priority) of a standard by its id and name."""
    text = F.upper(F.concat_ws(" ", standard_id, name))
    made = lambda c, p: F.struct(F.lit(c).alias("category"), F.lit(p).alias("priority"))
    return (
        F.when(text.rlike("^TA[-_]|协议|AGREEMENT|SPECIFICATION"), made("technical_agreement", 1))
        .when(text.rlike("^(NB|HG|SH|JB|YB|DL)[/_ T-]"), made("industry_standard", 2))
        .when(text.rlike("^Q[/_]|企业"), made("enterprise_standard", 3))
        .otherwise(made("national_standard", 4))
    )


def order() -> Column:
    return F.struct("priority", "pos")


def by_property(rules: DataFrame):
    return rules.groupBy(F.concat_ws("__", "property_key", "sub_property").alias("key"))


def envelope(rules: DataFrame) -> DataFrame:
    """Numeric overlay, a row per key: the largest lo and smallest hi, most decimals, last unit, highest level,
    governing standard (of the first strictest lo if sources differ there, else of hi, else the first), tightened, the
    sources in order. An agreement that comes first and is looser than the strictest national or industry limit takes
    precedence with its own limits and sets relaxed and the baseline it leaves."""
    first = lambda c: F.min_by(F.col(c), order())
    statutory = F.col("category").isin("national_standard", "industry_standard")
    g = by_property(rules).agg(
        F.max("lo").alias("max_lo"), F.min("lo").alias("min_lo"), F.min("hi").alias("min_hi"), F.max("hi").alias("max_hi"),
        F.max_by("standard_id", F.when(F.col("lo").isNotNull(), F.struct("lo", -F.col("priority"), -F.col("pos")))).alias("lo_by"),
        F.min_by("standard_id", F.when(F.col("hi").isNotNull(), F.struct("hi", "priority", "pos"))).alias("hi_by"),
        first("standard_id").alias("first_by"), first("category").alias("first_category"), first("lo").alias("first_lo"), first("hi").alias("first_hi"), first("rule_id").alias("rule_id"),
        F.max(F.when(statutory, F.col("lo"))).alias("base_lo"), F.min(F.when(statutory, F.col("hi"))).alias("base_hi"),
        F.max("decimals").alias("decimals"), F.max_by("unit", F.when(F.coalesce("unit", F.lit("")) != "", order())).alias("unit"), highest_level(F.col("level")).alias("level"),
        F.count("*").alias("n_sources"), F.transform(F.array_sort(F.collect_list(F.struct("priority", "pos", "standard_id"))), lambda x: x["standard_id"]).alias("sources"),
    )
    agreed = F.col("first_category") == "technical_agreement"
    looser = lambda c: F.coalesce(c, F.lit(False))
    relaxed = agreed & (looser(F.col("first_lo") < F.col("base_lo")) | looser(F.col("first_hi") > F.col("base_hi")))
    lo_differs, hi_differs = F.coalesce(F.col("max_lo") != F.col("min_lo"), F.lit(False)), F.coalesce(F.col("max_hi") != F.col("min_hi"), F.lit(False))
    g = g.withColumn("relaxed", relaxed)
    governing = F.when(F.col("relaxed"), F.col("first_by")).when(lo_differs, F.col("lo_by")).when(hi_differs, F.col("hi_by")).otherwise(F.col("first_by"))
    base = F.when(F.col("relaxed"), F.concat_ws(" & ", F.concat(F.lit(">= "), F.col("base_lo").cast("decimal(18,4)").cast("string")), F.concat(F.lit("<= "), F.col("base_hi").cast("decimal(18,4)").cast("string"))))
    return g.select(
        "key", "rule_id", "level", F.when(F.col("relaxed"), F.coalesce("first_lo", "base_lo")).otherwise(F.col("max_lo")).alias("lo"), F.when(F.col("relaxed"), F.coalesce("first_hi", "base_hi")).otherwise(F.col("min_hi")).alias("hi"),
        "unit", "decimals", governing.alias("governing"), (F.col("relaxed") | lo_differs | hi_differs).alias("tightened"), "relaxed", base.alias("baseline"), F.col("n_sources").cast("long").alias("n_sources"), "sources",
    )


def best_level(rules: DataFrame, level: str, ranks: dict[str, int]) -> DataFrame:
    """A row per key: the strictest test level, the standard that asks for it first, and the first source's rule, whose
    other criteria stay."""
    r = rank(F.col(level), ranks, 0)
    return by_property(rules).agg(F.max_by(level, F.struct(r, -F.col("priority"), -F.col("pos"))).alias("best_level"), F.max_by("standard_id", F.struct(r, -F.col("priority"), -F.col("pos"))).alias("governing"), F.min_by("rule_id", order()).alias("rule_id"), F.count("*").alias("n_sources"))


def kind_of_overlay(rules: DataFrame) -> DataFrame:
    """How each key is overlaid: copied (one source), envelope (all ranges), alternative (any), else first."""
    kinds = F.collect_set("rule_type")
    g = by_property(rules).agg(F.count("*").alias("n"), kinds.alias("kinds"))
    return g.select("key", F.when(F.col("n") == 1, "copied").when(F.array_distinct("kinds") == F.array(F.lit("numeric_range")), "envelope").when(F.array_contains("kinds", "alternative_group"), "alternative").otherwise("first").alias("overlay"))


def pinned_groups(members: DataFrame) -> DataFrame:
    """Overlay of rule groups with one semantic code (members: code, standard_id, category, priority, element, op,
    value, min_pass): the elements of the first agreement, if there is one, are the only ones allowed; each has the
    strictest value by its operator; min_pass is at most their number."""
    agreed = members.where("category = 'technical_agreement'").select("code", "element").distinct()
    has = agreed.select("code").distinct().withColumn("pinned", F.lit(True))
    x = members.join(has, "code", "left").join(agreed.withColumn("named", F.lit(True)), ["code", "element"], "left").where("pinned is null or named")
    strict = x.groupBy("code", "element", "op").agg(F.when(F.col("op").isin(">=", ">"), F.max("value")).otherwise(F.min("value")).alias("value"), F.min("min_pass").alias("min_pass"))
    n = x.groupBy("code").agg(F.countDistinct("element").alias("n_elements"), F.min("min_pass").alias("group_pass"))
    return strict.join(n, "code").select("code", "element", "op", "value", F.least("group_pass", "n_elements").cast("long").alias("min_pass"))
