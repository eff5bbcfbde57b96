"""Queries of the audit: slots, probes, evaluators, groups, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millcheck.functions import verdicts
from millcheck.operators import audit as ops
from millcheck.plans import mapping
from millcheck.plans.audit import audit
from millcheck.plans.mapping import table
from millcheck.queries import query

#: The mapped records: four for each line of an order.
RECORDS = """r0 AS (SELECT l_orderkey AS cert_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS line,
  CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END AS rank, CASE l_linestatus WHEN 'F' THEN 'PASS' ELSE 'FAIL' END AS word, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem),
r AS (SELECT cert_id, (line - 1) * 4 + i AS pos, rank, ['quantity', 'extendedprice', 'discount', 'tax'][i + 1] AS property_key, CASE i WHEN 0 THEN l_quantity WHEN 1 THEN l_extendedprice WHEN 2 THEN l_discount ELSE l_tax END AS value, CASE WHEN i = 0 THEN word END AS word
  FROM r0, (SELECT unnest(range(4)) AS i)),
held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cert_id, property_key ORDER BY rank DESC, pos) AS n, count(*) OVER (PARTITION BY cert_id, property_key) AS n_records FROM r) WHERE n = 1)"""
D = "cast(cast({} as varchar) as decimal(38,10))"


@query(f"WITH {RECORDS} SELECT cert_id, property_key, value + 0.0 AS value, pos, n_records FROM held")
def q_slot_arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = ops.arbitrate(ops.settled_slots(mapping.records(spark, sf_dir)).where("slot = property_key"))
    return held.select("cert_id", F.col("slot").alias("property_key"), (F.col("record.value") + 0.0).alias("value"), F.col("record.pos").cast("long").alias("pos"), "n_records")


@query(f"WITH {RECORDS} SELECT cert_id, property_key, pos FROM (SELECT *, row_number() OVER (PARTITION BY cert_id, property_key ORDER BY rank DESC, pos) AS n2 FROM r) WHERE n2 = 2")
def q_slot_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = ops.superseded(ops.slots(mapping.records(spark, sf_dir)).where("slot = property_key"))
    return lost.select("cert_id", F.col("slot").alias("property_key"), F.col("pos").cast("long").alias("pos"))


@query(f"""WITH {RECORDS} SELECT o_orderkey AS cert_id, rule_id, coalesce(a.property_key, b.property_key) AS found FROM orders CROSS JOIN (VALUES ('r1', 'hardness', 'quantity'), ('r2', 'tax', 'discount'), ('r3', 'nothing', 'at_all')) v(rule_id, k1, k2)
LEFT JOIN held a ON a.cert_id = o_orderkey AND a.property_key = k1 LEFT JOIN held b ON b.cert_id = o_orderkey AND b.property_key = k2""")
def q_rule_probe_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("r1", ["hardness", "quantity"]), ("r2", ["tax", "discount"]), ("r3", ["nothing", "at_all"])], "rule_id string, names array<string>")
    pairs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cert_id")).crossJoin(ops.small(rules))
    # only slots that some rule asks for are settled
    wanted = ops.small(rules.select(F.explode("names").alias("slot")).distinct())
    held = ops.arbitrate(ops.settled_slots(mapping.records(spark, sf_dir)).select("cert_id", "slot", "rank_", "pos", "property_key", "n_").join(wanted, "slot", "left_semi"))
    return ops.probe(pairs, held).select("cert_id", "rule_id", F.col("record.property_key").alias("found"))


RANGES = "(VALUES ('quantity', 5.0, 45.0, 0, 'MANDATORY'), ('discount', NULL, 0.08, 2, 'MANDATORY'), ('tax', 0.01, NULL, 2, 'OPTIONAL_AGREED'), ('hardness', 1.0, 2.0, 0, 'CONDITIONAL')) v(property_key, lo, hi, d, level)"


@query(f"""WITH {RECORDS}, x AS (SELECT o_orderkey AS cert_id, v.*, CASE WHEN d = 0 THEN cast(round_even({D.format('value')}, 0) AS decimal(20,4)) ELSE cast(round_even({D.format('value')}, 2) AS decimal(20,4)) END AS val FROM orders CROSS JOIN {RANGES} LEFT JOIN held ON held.cert_id = o_orderkey AND held.property_key = v.property_key),
y AS (SELECT *, CASE WHEN val IS NULL THEN NULL WHEN val < lo THEN lo - val WHEN val > hi THEN val - hi ELSE 0 END AS dev FROM x)
SELECT cert_id, property_key, CASE WHEN val IS NULL THEN CASE WHEN level IN ('MANDATORY', 'CONDITIONAL') THEN 'MISSING' ELSE 'SKIPPED' END WHEN dev > 0 THEN 'FAIL' ELSE 'PASS' END AS status, cast(dev as double) AS deviation,
 abs(cast(round_even(cast(cast(cast(dev as double) / coalesce(nullif(hi, 0), nullif(lo, 0), 1)::DOUBLE * 100 as varchar) as decimal(38,10)), 2) as double)) AS percent FROM y""")
def q_numeric_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("quantity", 5.0, 45.0, 0, "MANDATORY"), ("discount", None, 0.08, 2, "MANDATORY"), ("tax", 0.01, None, 2, "OPTIONAL_AGREED"), ("hardness", 1.0, 2.0, 0, "CONDITIONAL")], "property_key string, lo double, hi double, d int, level string")
    held = ops.arbitrate(ops.settled_slots(mapping.records(spark, sf_dir)).where("slot = property_key")).select("cert_id", F.col("slot").alias("property_key"), F.col("record.value").alias("value"))
    x = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cert_id")).crossJoin(ops.small(rules)).join(held, ["cert_id", "property_key"], "left")
    x = x.withColumn("value", verdicts.half_even(F.col("value"), F.col("d")))
    v = verdicts.numeric_range(F.col("value"), F.col("lo"), F.col("hi"), F.col("level"))
    return x.select("cert_id", "property_key", v.alias("v")).select("cert_id", "property_key", "v.status", "v.deviation", F.col("v.deviation_percent").alias("percent"))


@query(f"""WITH {RECORDS}, p AS (SELECT o_orderkey AS cert_id, q.value AS q, e.value AS e FROM orders LEFT JOIN held q ON q.cert_id = o_orderkey AND q.property_key = 'quantity' LEFT JOIN held e ON e.cert_id = o_orderkey AND e.property_key = 'extendedprice')
SELECT cert_id, CASE WHEN e IS NULL THEN 'MISSING' WHEN round_even({D.format('e')}, 2) >= round_even({D.format('40 * (q + 10)')}, 2) THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN e IS NOT NULL THEN cast(round_even({D.format('40 * (q + 10)')}, 2) as double) END AS bound FROM p""")
def q_dynamic_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millcheck.functions.formula import compile_formula

    v = ops.value_maps(mapping.records(spark, sf_dir))
    x = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cert_id")).join(v, "cert_id", "left")
    get = lambda n: F.try_element_at("v", F.lit(n.rpartition(".")[2]))
    s = verdicts.formula_bound(get("extendedprice"), compile_formula("40 * (ctx.mechanical.quantity + 10)", get), None, F.lit("MANDATORY"), 2)
    return x.select("cert_id", s.alias("s")).select("cert_id", "s.status", "s.bound")


VISUAL_SQL = "regexp_matches(t, '(?i)PASS|OK') AND NOT regexp_matches(t, '(?i)FAIL')"


@query(f"""WITH {RECORDS} SELECT cert_id, pos, CASE WHEN word = 'PASS' THEN 'PASS' ELSE 'FAIL' END AS visual, word = 'PASS' OR value >= 45 AS alternative,
 CASE WHEN value % 3 = 0 THEN CASE WHEN value >= 20 THEN 'PASS' ELSE 'FAIL' END ELSE CASE WHEN word = 'PASS' THEN 'PASS' ELSE 'FAIL' END END AS enum FROM r WHERE property_key = 'quantity'""")
def q_qualitative(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = mapping.records(spark, sf_dir).where("property_key = 'quantity'")
    words, yes, must, none = F.col("text"), F.lit(True), F.lit("MANDATORY"), F.lit(None).cast("string")
    claimed = F.when(F.col("value") >= 45, "e1h")
    number = F.when(F.col("value") % 3 == 0, F.col("value"))
    return r.select("cert_id", F.col("pos").cast("long").alias("pos"), verdicts.visual(words, yes, must).alias("visual"), verdicts.alternative(words, claimed, F.lit("E1H")).alias("alternative"), verdicts.enum(words, none, number, none, F.lit(20.0), yes, must).alias("enum"))


def item_sql() -> str:
    """The items of the mapped catalogue as SQL over `held`."""
    q = "(SELECT h.cert_id AS c, max(CASE WHEN property_key = 'quantity' THEN value END) AS quantity, max(CASE WHEN property_key = 'extendedprice' THEN value END) AS price, max(CASE WHEN property_key = 'discount' THEN value END) AS discount, max(CASE WHEN property_key = 'tax' THEN value END) AS tax FROM held h GROUP BY 1)"
    r = lambda x, d: f"round_even({D.format(x)}, {d})"
    return f"""o AS (SELECT o_orderkey AS cert_id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'strict' ELSE 'usual' END AS spec, o_totalprice / 100000 AS wall, v.* FROM orders LEFT JOIN {q} v ON c = o_orderkey),
f AS (SELECT *, CASE spec WHEN 'strict' THEN 48.0 ELSE 48.0 * 1.1 END AS hi1, CASE spec WHEN 'strict' THEN 0.09 ELSE 0.09 * 1.1 END AS hi2 FROM o),
items AS (
 SELECT cert_id, spec || '-1' AS rule_id, 1 AS pos, 'MANDATORY' AS level, NULL AS group_id, CASE WHEN quantity IS NULL THEN 'MISSING' WHEN {r('quantity', 0)} BETWEEN 2 AND hi1 THEN 'PASS' ELSE 'FAIL' END AS status FROM f
 UNION ALL SELECT cert_id, spec || '-2', 2, 'MANDATORY', NULL, CASE WHEN discount IS NULL THEN 'MISSING' WHEN {r('discount', 2)} <= hi2 THEN 'PASS' ELSE 'FAIL' END FROM f
 UNION ALL SELECT cert_id, spec || '-3', 3, 'MANDATORY', NULL, CASE WHEN price IS NULL THEN 'MISSING' WHEN {r('price', 2)} >= 50 * quantity THEN 'PASS' ELSE 'FAIL' END FROM f
 UNION ALL SELECT cert_id, spec || '-4', 4, 'CONDITIONAL', NULL, CASE WHEN wall >= 3.5 THEN 'MISSING' ELSE 'SKIPPED' END FROM f
 UNION ALL SELECT cert_id, spec || '-5', 5, 'OPTIONAL_AGREED', 'g1', CASE WHEN tax IS NULL THEN 'SKIPPED' WHEN {r('tax', 2)} BETWEEN 0 AND 0.08 THEN 'PASS' ELSE 'FAIL' END FROM f
 UNION ALL SELECT cert_id, spec || '-6', 6, 'OPTIONAL_AGREED', 'g1', 'SKIPPED' FROM f
 UNION ALL SELECT cert_id, spec || '-7', 7, 'EXEMPT', NULL, 'EXEMPT' FROM f)"""


def mapped(spark: SparkSession, sf_dir: str):
    return audit(mapping.certificates(spark, sf_dir), mapping.records(spark, sf_dir), mapping.rules(spark))


@query(f"WITH {RECORDS}, {item_sql()} SELECT cert_id, rule_id, status FROM items")
def q_audit_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir).items.select("cert_id", "rule_id", "status")


GROUPS_SQL = "g AS (SELECT cert_id, count(*) AS n_rules, count(*) FILTER (status = 'PASS') AS n_pass, count(*) FILTER (status = 'FAIL') AS n_fail FROM items WHERE group_id IS NOT NULL GROUP BY 1)"


@query(f"WITH {RECORDS}, {item_sql()}, {GROUPS_SQL} SELECT cert_id, 'g1' AS group_id, n_rules, n_pass, n_fail, CASE WHEN n_pass < 1 THEN 'FAIL' WHEN n_fail > 0 THEN 'PASS_WITH_WARNING' ELSE 'PASS' END AS group_status, false AS blocking FROM g")
def q_group_or_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir).groups.select("cert_id", "group_id", "n_rules", "n_pass", "n_fail", "group_status", "blocking")


@query(f"""WITH {RECORDS}, {item_sql()} SELECT cert_id, count(*) AS n_items, count(*) FILTER (status = 'PASS') AS n_pass, count(*) FILTER (status = 'FAIL') AS n_fail, count(*) FILTER (status = 'MISSING') AS n_missing, count(*) FILTER (status = 'SKIPPED') AS n_skipped, count(*) FILTER (status = 'EXEMPT') AS n_exempt,
 coalesce(string_agg(CASE WHEN status = 'MISSING' AND level IN ('MANDATORY', 'CONDITIONAL') THEN rule_id END, ',' ORDER BY pos), '') AS blocking, CASE WHEN count(*) FILTER (status = 'FAIL' OR (status = 'MISSING' AND level IN ('MANDATORY', 'CONDITIONAL'))) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM items GROUP BY cert_id""")
def q_veto_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = mapped(spark, sf_dir).summary
    return s.select("cert_id", "n_items", "n_pass", "n_fail", "n_missing", "n_skipped", "n_exempt", F.array_join("blocking", ",").alias("blocking"), "verdict")


@query("""SELECT o_orderkey AS cert_id, count(l_orderkey) AS n_items, CASE WHEN count(l_orderkey) = 0 THEN 'MANUAL_REVIEW' WHEN count(*) FILTER (l_quantity > 48) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def q_empty_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    certs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cert_id"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cert_id"), F.lit("r").alias("rule_id"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_quantity") > 48, "FAIL").otherwise("PASS").alias("status"), F.lit("MANDATORY").alias("level"), F.lit(None).cast("string").alias("group_id"))
    return ops.summary(certs, items).select("cert_id", "n_items", "verdict")


@query("""SELECT o_orderkey AS cert_id, CASE WHEN NOT o_totalprice >= 200000 AND l.n IS NULL THEN 'SKIPPED' WHEN l.n IS NULL THEN 'MISSING' WHEN l.q <= 50 THEN 'PASS' ELSE 'FAIL' END AS status FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l_orderkey = o_orderkey""")
def q_exempt_but_reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millcheck.functions.formula import trigger

    l = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.max("l_quantity").alias("q"))
    x = table(spark, sf_dir, "orders").join(l, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    on = trigger("ctx.header.total >= 200000", lambda n: F.col("o_totalprice"))
    verdict = verdicts.numeric_range(F.col("q"), F.lit(None).cast("double"), F.lit(50.0), F.lit("MANDATORY"))["status"]
    return x.select(F.col("o_orderkey").alias("cert_id"), verdicts.dispatch(on, F.col("q").isNotNull(), verdict).alias("status"))


@query(f"WITH {RECORDS} SELECT cert_id, property_key, count(*) AS n FROM r WHERE property_key NOT IN ('quantity', 'discount', 'extendedprice') GROUP BY 1, 2")
def q_unmatched_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    evaluated = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cert_id"), F.explode(F.array(*map(F.lit, ("quantity", "discount", "extendedprice")))).alias("property_key"))
    return ops.unmatched(mapping.records(spark, sf_dir), evaluated).groupBy("cert_id", "property_key").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey AS cert_id, max(CASE WHEN l_suppkey % 2 = 0 THEN CASE WHEN bad_s > 0 THEN 'FAIL' ELSE 'PASS' END END) AS standard_verdict, max(CASE WHEN l_suppkey % 2 = 1 THEN CASE WHEN bad_a > 0 THEN 'FAIL' ELSE 'PASS' END END) AS agreement_verdict
FROM (SELECT *, count(*) FILTER (l_suppkey % 2 = 0 AND l_quantity > 40) OVER (PARTITION BY l_orderkey) AS bad_s, count(*) FILTER (l_suppkey % 2 = 1 AND l_quantity > 40) OVER (PARTITION BY l_orderkey) AS bad_a FROM lineitem) GROUP BY 1""")
def q_dual_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cert_id"), F.when(F.col("l_suppkey") % 2 == 0, "GB/T 13296").otherwise("TA-2024").alias("standard_id"), F.when(F.col("l_quantity") > 40, "FAIL").otherwise("PASS").alias("status"))
    return ops.dual_verdicts(s)


@query("""SELECT l_orderkey AS cert_id, l_linenumber::VARCHAR AS rule_id, count(*) FILTER (q <= m) AS n_pass, count(*) FILTER (q > m) AS n_fail, count(*) FILTER (q <= m) > 0 AND count(*) FILTER (q > m) > 0 AS is_scissors, CASE WHEN count(*) FILTER (q > m) > 0 THEN 'FAIL' ELSE 'PASS' END AS status
FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2), (VALUES (35.0), (40.0)) v(m) GROUP BY 1, 2""")
def q_scissors(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    limits = F.array(*(F.struct(F.lit(s).alias("standard_id"), F.lit(m).alias("m")) for s, m in (("GB/T 1", 35.0), ("NB/T 2", 40.0))))
    x = q.select(F.col("l_orderkey").alias("cert_id"), F.col("l_linenumber").cast("string").alias("rule_id"), "q", F.explode(limits).alias("s"))
    return ops.scissors(x.select("cert_id", "rule_id", "s.standard_id", F.when(F.col("q") <= F.col("s.m"), "PASS").otherwise("FAIL").alias("status"))).select("cert_id", "rule_id", "n_pass", "n_fail", "is_scissors", "status")


@query("""SELECT l_orderkey AS cert_id, 'claimed:' || l_linenumber AS item, count(*) AS n FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber <> a.l_linenumber AND b.l_partkey % 10 = a.l_partkey % 10) GROUP BY 1, 2""")
def q_claimed_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    b = li.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 10).alias("k"))
    a = li.join(b, (F.col("l_orderkey") == F.col("o")) & (F.col("l_partkey") % 10 == F.col("k")) & (F.col("l_linenumber") != F.col("n")), "left_semi")
    return a.groupBy(F.col("l_orderkey").alias("cert_id"), F.concat(F.lit("claimed:"), "l_linenumber").alias("item")).agg(F.count("*").alias("n"))
