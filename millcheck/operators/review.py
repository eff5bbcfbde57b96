"""Clause reviews, tallies of rules and batches, declared standards, and documents that share any identifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millcheck.functions.text import standard_key
from millcheck.operators.audit import small
from millcheck.operators.ledger import count_if
from millcheck.operators.lineage import components

# Words of clause titles and of delivery states.
HEAT, NDT, TREATED = "制造方法|交货状态|热处理", "无损|探伤", "固溶|退火|solution"


def semantic_reviews(certs: DataFrame, clauses: DataFrame) -> DataFrame:
    """Two reviews at most of each certificate (cert_id, standard, delivery_state): its standard's first clause on heat
    treatment conforms if the state says so, else needs a waiver; its first on non-destructive tests conforms.
    clauses: standard, pos, clause_id, title."""
    first = lambda words: F.min_by(F.struct("clause_id", "title"), F.when(F.col("title").rlike(words), F.col("pos")))
    found = lambda words: F.max(F.col("title").rlike(words).cast("int")) == 1
    c = clauses.groupBy(standard_key(F.col("standard")).alias("k")).agg(F.when(found(HEAT), first(HEAT)).alias("heat"), F.when(found(NDT), first(NDT)).alias("ndt"))
    treated = F.coalesce(F.col("delivery_state").rlike(TREATED), F.lit(False))
    made = lambda c, verdict: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.clause_id"), F.col(f"{c}.title"), verdict.alias("conclusion")))
    x = certs.withColumn("k", standard_key(F.col("standard"))).join(small(c), "k")
    reviews = F.array_compact(F.array(made("heat", F.when(treated, "CONFORMING").otherwise("REQUIRES_WAIVER")), made("ndt", F.lit("CONFORMING"))))
    return x.select("cert_id", F.explode(reviews).alias("r")).select("cert_id", "r.*")


def declared_ids(asked: DataFrame, catalogue: DataFrame) -> DataFrame:
    """asked (key_id, raw) with ids: each part of raw that the catalogue (id, short_code) knows, by either name; a part
    it does not know is tried together with the next; what stays unknown is kept as written. Distinct in order."""
    both = F.explode(F.array("id", "short_code"))
    known = small(catalogue.select("id", both.alias("name")).select(standard_key(F.col("name")).alias("k"), "id").groupBy("k").agg(F.min("id").alias("id")))
    parts = F.filter(F.transform(F.split("raw", "[、,，;；\\n]+"), lambda x: F.trim(x)), lambda x: (x != "") & (x != "UNKNOWN"))
    p = asked.select("key_id", F.posexplode(parts).alias("at", "name"), parts.alias("all"))
    p = p.withColumn("pair", F.concat_ws(" ", "name", F.get("all", F.col("at") + 1))).withColumn("has_next", F.col("at") + 1 < F.size("all")).drop("all")
    p = p.withColumn("k", standard_key(F.col("name"))).join(known.withColumnRenamed("id", "alone"), "k", "left").drop("k")
    p = p.withColumn("k", F.when(F.col("has_next"), standard_key(F.col("pair")))).join(known.withColumnRenamed("id", "together"), "k", "left").drop("k")
    g = p.groupBy("key_id").agg(F.array_sort(F.collect_list(F.struct("at", "name", "alone", "together"))).alias("parts"))
    start = F.struct(F.array().cast("array<string>").alias("ids"), F.lit(False).alias("skip"))

    def step(s, x):
        pair = x["alone"].isNull() & x["together"].isNotNull() & ~s["skip"]
        found = F.coalesce(x["alone"], x["together"], x["name"])
        have = F.exists(s["ids"], lambda i: standard_key(i) == standard_key(found))
        ids = F.when(s["skip"] | have, s["ids"]).otherwise(F.concat(s["ids"], F.array(found)))
        return F.struct(ids.alias("ids"), pair.alias("skip"))

    none = asked.select("key_id").distinct()
    return none.join(g.select("key_id", F.aggregate("parts", start, step)["ids"].alias("ids")), "key_id", "left").select("key_id", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))


def unlisted(named: DataFrame, listed: DataFrame) -> DataFrame:
    """Standards named (standard) that are not listed (standard), by fingerprint."""
    return named.withColumn("k", standard_key(F.col("standard"))).join(listed.select(standard_key(F.col("standard")).alias("k")).distinct(), "k", "left_anti").drop("k")


#: Categories that candidate rules are shown under, and the parts a slice is shown in.
SHOWN = ("chemical", "mechanical", "process", "metallographic", "corrosion", "ndt", "surface")


def rule_group(category: Column) -> Column:
    return F.when(category.isin(*SHOWN), category).otherwise("additional")


def rule_part(category: Column, rule_type: Column) -> Column:
    """Chemical (but for its formulas), mechanical, process (with corrosion and non-destructive tests), or other."""
    formula = (category == "chemical") & (rule_type == "dynamic_expression")
    return F.when(F.coalesce(formula, F.lit(False)), "other").when(category.isin("chemical", "mechanical"), category).when(category.isin("process", "corrosion", "ndt"), "process").otherwise("other")


def rules_by_part(rules: DataFrame) -> DataFrame:
    """spec_key, part, n_rules, rule_ids in their order: the parts that a slice is shown in; empty ones are left out."""
    part = rule_part(F.col("category"), F.col("rule_type")).alias("part")
    return rules.groupBy("spec_key", part).agg(F.count("*").alias("n_rules"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "rule_id"))), lambda x: x["rule_id"]).alias("rule_ids"))


def rules_by_group(rules: DataFrame) -> DataFrame:
    return rules.groupBy("spec_key", rule_group(F.col("category")).alias("rule_group")).agg(F.count("*").alias("n_rules"))


def tallies(batches: DataFrame) -> DataFrame:
    """One row per session: batches in all, that count as success (PASS or not audited), fail, and wait for a person."""
    v = F.col("verdict")
    return batches.groupBy("session_id").agg(F.count("*").alias("total"), count_if(v.isin("PASS", "UNAUDITED")).alias("success"), count_if(v == "FAIL").alias("failed"), count_if(v == "HITL").alias("hitl"))


def grouped(docs: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """docs with c_, the least order of the documents that any key links, directly or through others."""
    links = None
    for k in keys:
        first = docs.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias("b"))
        x = docs.select(F.col(order).alias("a"), k).join(first, k).select("a", "b")
        links = x if links is None else links.union(x)
    comp = components(links).select(F.col("node").alias("n_"), F.col("component").alias("c_"))
    return docs.join(comp, F.col(order) == F.col("n_"), "left").withColumn("c_", F.coalesce("c_", order)).drop("n_")


def same_documents(docs: DataFrame, keys: tuple[str, ...] = ("doc_id", "md5", "filename"), richness: str = "richness", order: str = "seq") -> DataFrame:
    """One row per set of documents that any key links, directly or through others: the richest, the later of equals.
    Null keys link nothing. order must be unique; the links go from a document to the first with its key, so a key of
    very many documents makes no more links than documents."""
    best = grouped(docs, keys, order).groupBy("c_").agg(F.max_by(F.struct(*docs.columns), F.struct(richness, order)).alias("d"))
    return best.select("d.*")


def merged_documents(docs: DataFrame, keys: tuple[str, ...] = ("doc_id", "md5", "filename"), richness: str = "richness", order: str = "seq") -> DataFrame:
    """As same_documents, with each field that the richest document leaves null or empty (a blank text, an array or map without
    entries) taken from the next that has it, and n_merged, how many documents there were. A field is an aggregate of its own,
    so a set of very many documents never comes together."""

    def there(f) -> Column:
        kind = f.dataType.typeName()
        known = F.col(f.name).isNotNull()
        return known & (F.trim(f.name) != "") if kind == "string" else known & (F.size(f.name) > 0) if kind in ("array", "map") else known

    rank = F.struct(richness, order)
    fields = [F.max_by(f.name, F.when(there(f), rank)).alias(f.name) for f in docs.schema]
    return grouped(docs, keys, order).groupBy("c_").agg(*fields, F.count("*").alias("n_merged")).drop("c_")
