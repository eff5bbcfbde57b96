"""Certificates against rules: slots, probes, groups and roll-up, each over all certificates at once.

Certificates have cert_id; records have cert_id, pos (their order, which decides ties), property_key, sub_property,
category, value, text, level and provenance; rules have rule_id, pos, their own keys and limits. Everything up to the
roll-up is keyed by cert_id, so one shuffle of the records serves the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millcheck.functions.verdicts import LEVEL_RANK, PROVENANCE_RANK, STATUS_RANK, rank

#: Rows up to which a catalogue is broadcast; a larger one is joined by shuffle.
SMALL = 100_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """Marks a table for broadcast if it has at most so many rows, counted first."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


# Further names under which a record of a property is found.
ALIASES = {
    "tensile_strength": ("mech.tensile_strength.Rm", "Rm"),
    "yield_strength_rp02": ("mech.yield_strength.Rp02", "Rp0.2", "ReH"),
    "elongation_A": ("mech.elongation.A", "A"),
    "flattening_test": ("test.flattening",),
    "flaring_test": ("test.flaring",),
    "bending_test": ("test.bending",),
    "hydraulic_test": ("test.hydrostatic",),
    "eddy_current_test": ("test.eddy_current",),
    "pressure_tightness": ("test.pressure_tightness", "test.tightness"),
    "ultrasonic_test": ("test.ultrasonic",),
    "intergranular_corrosion": ("test.intergranular_corrosion",),
}


def slot_names(key: Column, category: Column, sub: Column) -> list[Column]:
    """All names under which a record can be looked up, before the suffixes by kind; null where there is none."""
    alias = lambda i: rank(key, {k: names[i] for k, names in ALIASES.items() if i < len(names)}, None)
    return [
        key, F.when(category.isNotNull(), F.concat_ws("_", category, key)), F.when(category == "chemical", F.concat(F.lit("chem.element."), key)), *(alias(i) for i in range(max(map(len, ALIASES.values())))),
        F.concat(key, F.lit("_"), sub), F.concat(F.lit("mech.hardness."), sub), sub,
    ]


#: Before the name of a property: the slot of its number for formulas.
NUMBER_OF = "\u0001"


def slots(records: DataFrame) -> DataFrame:
    """cert_id, slot, and the record columns with rank_: a row per record and name, with '#num' and '#qual' names for
    records that have a number or words, and the NUMBER_OF slot of those that have a number."""
    key, category, sub = F.col("property_key"), F.col("category"), F.col("sub_property")
    kinds = F.when(F.col("value").isNotNull(), "#num"), F.when(F.col("text").isNotNull(), "#qual")
    number = F.when(F.col("value").isNotNull(), F.concat(F.lit(NUMBER_OF), key))
    every = lambda names: F.array(number, *(x for n in names for x in (n, *(F.concat(n, k) for k in kinds))))
    names = slot_names(key, category, sub)
    # most records have two names, which differ; arrays are made without lambdas, which would not be compiled
    plain = sub.isNull() & ~key.isin(*ALIASES) & ~F.coalesce(category == "chemical", F.lit(False))
    all_names = F.when(plain, every(names[:2])).otherwise(F.array_distinct(every(names)))
    return records.withColumn("rank_", rank(F.col("provenance"), PROVENANCE_RANK, 2)).withColumn("slot", F.explode(all_names)).where("slot is not null")


def arbitrate(slotted: DataFrame, keys: tuple = ("cert_id", "slot")) -> DataFrame:
    """The record that holds each slot, and the best that it superseded: rank first, then order."""
    fields = [c for c in slotted.columns if c not in (*keys, "rank_", "n_")]
    n = F.sum("n_") if "n_" in slotted.columns else F.count("*")
    order = F.struct(-F.col("rank_"), F.col("pos"))
    best = slotted.groupBy(*keys).agg(F.min_by(F.struct(*fields), order).alias("record"), n.alias("n_records"), F.min(order).alias("o_"))
    return best.select(*keys, "record", "n_records")


def settled(records: DataFrame) -> DataFrame:
    """The best record of each certificate among those that are found under the same names, with n_: how many those are; pos
    is an int.

    They compete for the same slots, so only the best has to be looked up under its names. Ranks, positions and values are
    compared as plain numbers, apart by text and level, so that this is a hash aggregate: the records are never sorted."""
    kind = ["cert_id", "category", "property_key", "sub_property", "text", "level"]
    r = rank(F.col("provenance"), PROVENANCE_RANK, 2).cast("long")
    order = F.coalesce(F.col("pos").cast("long"), F.lit(-(2**31))) - r * 2**32
    # an order of its own for each rank and position; whether there is a value decides about names
    x = records.groupBy(*kind, F.col("value").isNull().alias("empty_")).agg(F.min_by("value", order).alias("value"), F.min_by("pos", order).alias("pos"), F.min_by(r, order).alias("held_rank_"), F.count("*").alias("n_"))
    return x.drop("empty_")


def settled_slots(records: DataFrame) -> DataFrame:
    """As slots, of the settled records alone, with n_."""
    s = settled(records)
    return slots(s.withColumn("provenance", F.lit(None).cast("string"))).drop("provenance", "rank_").withColumnRenamed("held_rank_", "rank_")


def dealt(df: DataFrame, key: str, rows: int = 500_000) -> DataFrame:
    """df by key in as many tasks as it has so many rows, where those are more than a shuffle has, so that a task's memory stays
    the same however large the table."""
    n = df.count() // rows + 1
    return df.repartition(n, key) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def superseded(slotted: DataFrame, keys: tuple = ("cert_id", "slot")) -> DataFrame:
    """The best record of each slot that does not hold it."""
    w = Window.partitionBy(*keys).orderBy(F.desc("rank_"), "pos")
    return slotted.withColumn("n_", F.row_number().over(w)).where("n_ = 2").drop("n_")


def held_slots(records: DataFrame) -> DataFrame:
    """Exact slots where a record with only words and one with a number compete: in order of pos, a record of the same
    or a mixed kind takes the slot if its rank is higher; one of the other kind never does, but the last such holds the
    typed slot. Returns cert_id, property_key, main, num, qual: positions of the records that hold each."""
    kind = F.when(F.col("value").isNotNull() & F.col("text").isNotNull(), "mixed").when(F.col("value").isNotNull(), "num").otherwise("qual")
    item = F.struct("pos", rank(F.col("provenance"), PROVENANCE_RANK, 2).alias("rank"), kind.alias("kind"))
    state = F.struct(*(F.lit(None).cast(t).alias(n) for n, t in (("main", "int"), ("main_rank", "int"), ("main_kind", "string"), ("num", "int"), ("num_rank", "int"), ("qual", "int"), ("qual_rank", "int"))))

    def step(s, x):
        empty = s["main"].isNull()
        other = ((s["main_kind"] == "qual") & (x["kind"] == "num")) | ((s["main_kind"] == "num") & (x["kind"] == "qual"))
        take = empty | (~other & (x["rank"] > s["main_rank"]))
        is_num, is_qual = x["kind"] != "qual", x["kind"] != "num"
        num = is_num & (s["num"].isNull() | (x["rank"] > s["num_rank"]) | (~empty & other))
        qual = is_qual & (s["qual"].isNull() | (x["rank"] > s["qual_rank"]) | (~empty & other))
        put = lambda c, new, old: F.when(c, new).otherwise(old)
        return F.struct(
            put(take, x["pos"], s["main"]).alias("main"), put(take, x["rank"], s["main_rank"]).alias("main_rank"), put(take, x["kind"], s["main_kind"]).alias("main_kind"),
            put(num, x["pos"], s["num"]).alias("num"), put(num, x["rank"], s["num_rank"]).alias("num_rank"), put(qual, x["pos"], s["qual"]).alias("qual"), put(qual, x["rank"], s["qual_rank"]).alias("qual_rank"),
        )

    folded = F.aggregate(F.array_sort("items"), state, step)
    return records.groupBy("cert_id", "property_key").agg(F.collect_list(item).alias("items")).select("cert_id", "property_key", folded.alias("s")).select("cert_id", "property_key", "s.main", "s.num", "s.qual")


def value_maps(records: DataFrame) -> DataFrame:
    """cert_id, v: map of property to number for formulas, higher rank and then earlier record first."""
    order = F.struct(-rank(F.col("provenance"), PROVENANCE_RANK, 2), F.col("pos"))
    best = records.where("value is not null").groupBy("cert_id", "property_key").agg(F.min_by("value", order).alias("v"))
    return best.groupBy("cert_id").agg(F.map_from_entries(F.collect_list(F.struct("property_key", "v"))).alias("v"))


def held_maps(held: DataFrame) -> DataFrame:
    """cert_id, held_: a map of slot to record. At most the slots that the rules of a slice ask for come together."""
    return held.groupBy("cert_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "record"))).alias("held_"))


def first_held(names: Column) -> Column:
    """The record of the first of the names that is a key of held_, null if none is."""
    return F.get(F.filter(F.transform(names, lambda n: F.try_element_at("held_", n)), lambda r: r.isNotNull()), F.lit(0))


def probe(pairs: DataFrame, held: DataFrame, names: str = "names") -> DataFrame:
    """For each row of pairs (cert_id, rule_id, and an array of slot names in order of preference): the first slot that
    is held, as `record`, null if none. Rows without a hit stay."""
    asked = pairs.select("cert_id", "rule_id", F.posexplode(names).alias("at", "slot"))
    hits = asked.join(held.select("cert_id", "slot", "record"), ["cert_id", "slot"]).groupBy("cert_id", "rule_id").agg(F.min_by("record", "at").alias("record"), F.min("at").alias("at"))
    return pairs.join(hits, ["cert_id", "rule_id"], "left")


def group_outcome(op: Column, min_pass: Column, n_rules: Column, n_pass: Column, n_fail: Column, n_missing: Column, mandatory: Column) -> tuple[Column, Column]:
    """Status and blocking of a group. OR passes with min_pass passes (one if unset), with a warning if any fails; AND
    if all pass. A failed OR blocks if a member is mandatory, a failed AND if a member fails or is missing."""
    either = op == "OR"
    ok = F.when(either, n_pass >= F.coalesce(min_pass, F.lit(1))).otherwise(n_pass == n_rules)
    status = F.when(~ok, "FAIL").when(either & (n_fail > 0), "PASS_WITH_WARNING").otherwise("PASS")
    blocking = F.when(ok, False).when(either, mandatory == 1).otherwise((n_fail > 0) | (n_missing > 0))
    return status, blocking


def is_status(s: str) -> Column:
    return F.count(F.when(F.col("status") == s, 1))


def is_mandatory() -> Column:
    return F.max(F.coalesce((F.col("level") == "MANDATORY").cast("int"), F.lit(0)))


def group_verdicts(items: DataFrame) -> DataFrame:
    """A row per certificate and rule group of items (cert_id, group_id, group_op, min_pass, status, level): counts,
    group_status, blocking."""
    g = items.where("group_id is not null").groupBy("cert_id", "group_id").agg(
        F.first("group_op").alias("group_op"), F.max("min_pass").alias("min_pass"), F.count("*").alias("n_rules"), is_status("PASS").alias("n_pass"), is_status("FAIL").alias("n_fail"), is_status("MISSING").alias("n_missing"), is_mandatory().alias("mandatory"),
    )
    status, blocking = group_outcome(*(F.col(c) for c in ("group_op", "min_pass", "n_rules", "n_pass", "n_fail", "n_missing", "mandatory")))
    return g.select("cert_id", "group_id", "group_op", "n_rules", "n_pass", "n_fail", "n_missing", status.alias("group_status"), blocking.alias("blocking"))


def with_groups(items: DataFrame) -> DataFrame:
    """items with the verdict of their group (the columns of group_verdicts, null outside groups), the missing and
    skipped members of passing OR groups as SKIPPED, and order_ by which members are listed: unsuppressed first, then
    by status, then pos. Failed members keep their status. One window, so items are worked out once."""
    w = Window.partitionBy("cert_id", "group_id")
    inside = F.col("group_id").isNotNull()
    x = items.withColumns({"n_rules": F.count("*").over(w), "n_pass": is_status("PASS").over(w), "n_fail": is_status("FAIL").over(w), "n_missing": is_status("MISSING").over(w), "mandatory_": is_mandatory().over(w), "least_": F.max("min_pass").over(w)})
    status, blocking = group_outcome(*(F.col(c) for c in ("group_op", "least_", "n_rules", "n_pass", "n_fail", "n_missing", "mandatory_")))
    x = x.withColumn("group_status", F.when(inside, status)).withColumn("blocking", F.when(inside, blocking)).drop("mandatory_", "least_")
    off = inside & (F.col("group_op") == "OR") & (F.col("group_status") != "FAIL") & F.col("status").isin("MISSING", "SKIPPED")
    x = x.withColumn("suppressed", F.coalesce(off, F.lit(False))).withColumn("status", F.when(F.coalesce(off, F.lit(False)), "SKIPPED").otherwise(F.col("status")))
    return x.withColumn("order_", F.row_number().over(w.orderBy("suppressed", rank(F.col("status"), STATUS_RANK, 99), "pos")))


def summary(certs: DataFrame, items: DataFrame) -> DataFrame:
    """A row per certificate: counts by status, what blocks in order (missing rules, then groups if items have the
    columns of with_groups), and the verdict. One failure or one blocking entry vetoes; a certificate without any item
    is for manual review."""
    blocks = (F.col("status") == "MISSING") & F.col("level").isin("MANDATORY", "CONDITIONAL") & F.col("group_id").isNull()
    missing = F.transform(F.array_sort(F.collect_list(F.when(blocks, F.struct("pos", "rule_id")))), lambda x: x["rule_id"])
    groups = F.array_sort(F.collect_set(F.when(F.col("blocking"), F.col("group_id")))) if "blocking" in items.columns else F.array().cast("array<string>")
    s = items.groupBy("cert_id").agg(F.count("*").alias("n_items"), *(is_status(x).alias(f"n_{x.lower()}") for x in ("PASS", "FAIL", "MISSING", "SKIPPED", "EXEMPT")), F.concat(missing, groups).alias("blocking"))
    x = certs.select("cert_id").join(s, "cert_id", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in s.columns if c.startswith("n_")]
    verdict = F.when(F.coalesce("n_items", F.lit(0)) == 0, "MANUAL_REVIEW").when((F.col("n_fail") > 0) | (F.size("blocking") > 0), "FAIL").otherwise("PASS")
    return x.select("cert_id", *counts, F.coalesce("blocking", F.array().cast("array<string>")).alias("blocking"), verdict.alias("verdict"))


def unmatched(records: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Records whose raw property no rule of their certificate looks at; evaluated has cert_id and property_key."""
    return records.join(evaluated.select("cert_id", "property_key").distinct(), ["cert_id", "property_key"], "left_anti")


def rejected_rows(extra: DataFrame) -> DataFrame:
    """A failing item for each extra record that a reviewer rejected."""
    return extra.where("is_rejected").select("cert_id", F.concat(F.lit("rejected:"), "property_key").alias("rule_id"), "pos", F.lit("FAIL").alias("status"), F.lit("MANDATORY").alias("level"), F.lit(None).cast("string").alias("group_id"))


#: Fixed value: names of sources that are agreements.
AGREEMENT = r"(?i)^TA[-_]|协议|SPECIFICATION|AGREEMENT"


def dual_verdicts(sources: DataFrame) -> DataFrame:
    """A row per certificate of per-source statuses (cert_id, standard_id, status): the verdict by standards and that
    by agreements, null where there is no such source."""
    agreed = F.col("standard_id").rlike(AGREEMENT)
    side = lambda c: F.when(F.count(F.when(c, 1)) == 0, None).when(F.count(F.when(c & F.col("status").isin("FAIL", "MISSING"), 1)) > 0, "FAIL").otherwise("PASS")
    return sources.groupBy("cert_id").agg(side(~agreed).alias("standard_verdict"), side(agreed).alias("agreement_verdict"))


def scissors(sources: DataFrame) -> DataFrame:
    """A row per certificate and rule of per-source statuses: status (the worst of them), passing and failing sources,
    and whether they differ: one source passes what another fails."""
    x = sources.groupBy("cert_id", "rule_id").agg(F.count(F.when(F.col("status") == "PASS", 1)).alias("n_pass"), F.count(F.when(F.col("status") == "FAIL", 1)).alias("n_fail"), F.array_sort(F.collect_list(F.struct("standard_id", "status"))).alias("sources"))
    return x.withColumn("is_scissors", (F.col("n_pass") > 0) & (F.col("n_fail") > 0)).withColumn("status", F.when(F.col("n_fail") > 0, "FAIL").when(F.col("n_pass") > 0, "PASS").otherwise("SKIPPED"))


def highest_level(levels: Column) -> Column:
    """Aggregate: the strictest requirement level, an unset one counting as mandatory."""
    level = F.coalesce(levels, F.lit("MANDATORY"))
    return F.max_by(level, rank(level, LEVEL_RANK, 0))
