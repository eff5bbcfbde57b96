"""Queries of reviews, tallies, declared standards, conversions and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millcheck.functions import verdicts
from millcheck.operators import adapter, audit, review
from millcheck.plans.mapping import table
from millcheck.queries import query

STATE = "CASE o_orderstatus WHEN 'F' THEN '固溶酸洗' WHEN 'O' THEN 'cold' END"


@query(f"""SELECT o_orderkey AS cert_id, unnest(CASE WHEN o_custkey % 2 = 0 THEN ['6.2', '7.1'] ELSE ['9'] END) AS clause_id, unnest(CASE WHEN o_custkey % 2 = 0 THEN [CASE WHEN coalesce({STATE}, '') LIKE '固溶%' THEN 'CONFORMING' ELSE 'REQUIRES_WAIVER' END, 'CONFORMING'] ELSE ['CONFORMING'] END) AS conclusion FROM orders""")
def q_semantic_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    clauses = spark.createDataFrame([("GB/T 1", 1, "6.1", "范围"), ("GB/T 1", 2, "6.2", "热处理"), ("GB/T 1", 3, "6.3", "交货状态"), ("GB/T 1", 4, "7.1", "无损检验"), ("NB-2", 1, "9", "探伤")], "standard string, pos int, clause_id string, title string")
    o = table(spark, sf_dir, "orders")
    return review.semantic_reviews(o.select(F.col("o_orderkey").alias("cert_id"), F.when(F.col("o_custkey") % 2 == 0, "GBT1").otherwise("nb 2").alias("standard"), F.expr(STATE).alias("delivery_state")), clauses).select("cert_id", "clause_id", "conclusion")


@query("""SELECT c_custkey AS key_id, CASE c_custkey % 4 WHEN 0 THEN 'GB/T 13296-2023' WHEN 1 THEN 'GB/T 13296-2023|odd one' WHEN 2 THEN 'NB/T 47019.5' ELSE '' END AS ids FROM customer""")
def q_declared_standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue = spark.createDataFrame([("GB/T 13296-2023", "GB13296"), ("NB/T 47019.5", "NB47019")], "id string, short_code string")
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, "GB/T、13296-2023;gb13296").when(k == 1, "gb 13296,odd one").when(k == 2, "NB_47019、UNKNOWN").otherwise("UNKNOWN")
    return review.declared_ids(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key_id"), raw.alias("raw")), catalogue).select("key_id", F.array_join("ids", "|").alias("ids"))


@query("SELECT DISTINCT source AS standard FROM documents WHERE upper(source) NOT IN (SELECT upper('src' || n_nationkey) FROM nation WHERE n_nationkey % 2 = 0)")
def q_unlisted_standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("SRC_"), "n_nationkey").alias("standard"))
    return review.unlisted(table(spark, sf_dir, "documents").select(F.col("source").alias("standard")).distinct(), listed)


@query("""SELECT p_brand AS spec_key, CASE p_size % 9 WHEN 0 THEN 'chemical' WHEN 1 THEN 'mechanical' WHEN 2 THEN 'process' WHEN 3 THEN 'ndt' WHEN 4 THEN 'surface' ELSE 'additional' END AS rule_group, count(*) AS n_rules FROM part GROUP BY 1, 2""")
def q_rule_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = F.element_at(F.array(*map(F.lit, ("chemical", "mechanical", "process", "ndt", "surface", "geometric", "test", "other", None))), F.col("p_size") % 9 + 1)
    return review.rules_by_group(table(spark, sf_dir, "part").select(F.col("p_brand").alias("spec_key"), cat.alias("category")))


@query("""SELECT o_custkey AS session_id, count(*) AS total, count(*) FILTER (o_orderkey % 4 IN (0, 3)) AS success, count(*) FILTER (o_orderkey % 4 = 1) AS failed, count(*) FILTER (o_orderkey % 4 = 2) AS hitl FROM orders GROUP BY 1""")
def q_batch_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.element_at(F.array(*map(F.lit, ("PASS", "FAIL", "HITL", "UNAUDITED"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return review.tallies(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), v.alias("verdict")))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'FAIL_SCISSORS' WHEN s = 'MISSING' THEN 'FAIL_MISSING' WHEN s = 'FAIL' THEN 'FAIL' WHEN s = 'SKIPPED' THEN 'INFO' WHEN o_custkey % 5 = 0 THEN 'RESOLVED' ELSE 'PASS' END AS shown FROM (SELECT *, ['PASS', 'FAIL', 'MISSING', 'SKIPPED', 'EXEMPT'][1 + o_orderkey % 5] AS s FROM orders)""")
def q_display_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.element_at(F.array(*map(F.lit, ("PASS", "FAIL", "MISSING", "SKIPPED", "EXEMPT"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", verdicts.display(s, F.col("o_custkey") % 7 == 0, F.col("o_custkey") % 5 == 0).alias("shown"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 100 WHEN 1 THEN 98 WHEN 2 THEN 50 ELSE 0 END::INT AS confidence FROM part""")
def q_grade_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    grade = F.when(k == 0, "Q345R").when(k == 1, "SA-387").when(k == 2, "odd").otherwise(" ")
    known = k == 0
    usual = F.when(k == 1, "SA387").otherwise(grade)
    return table(spark, sf_dir, "part").select("p_partkey", verdicts.grade_confidence(known, known, usual).cast("int").alias("confidence"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity % 3 = 0 AS is_composite, CASE WHEN l_quantity % 3 <> 0 AND l_linenumber % 2 = 0 THEN 'tensile_strength' END AS duplicate_of FROM lineitem""")
def q_annotate_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    value = F.when(F.col("l_quantity") % 3 == 0, "Rm: 520 Rp: 330").otherwise("520")
    none = F.lit(None).cast("string")
    extras = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_linenumber") % 2 == 0, "抗拉强度").otherwise("备注").alias("name"), value.alias("value"), none.alias("unit"), none.alias("category"), F.create_map(F.lit("tensile_rm"), F.lit("520")).alias("mechanical"), F.create_map(F.lit("x"), F.lit("y")).alias("process"))
    return adapter.annotate(extras).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "is_composite", "duplicate_of")


@query("""WITH r AS (SELECT o_custkey AS cert_id, o_orderkey AS pos, o_orderstatus IN ('F', 'P') AS num, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '5-LOW' THEN 1 ELSE 2 END AS rank FROM orders WHERE o_orderstatus IN ('F', 'P')) SELECT cert_id, arg_min(pos, {'r': -rank, 'p': pos})::INT AS main FROM r GROUP BY 1""")
def q_slot_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    o = table(spark, sf_dir, "orders").where("o_orderstatus in ('F', 'P')")
    r = o.select(F.col("o_custkey").alias("cert_id"), F.col("o_orderkey").cast("int").alias("pos"), F.lit("x").alias("property_key"), F.col("o_totalprice").alias("value"), F.lit(None).cast("string").alias("text"), F.when(p == "1-URGENT", "core").when(p == "5-LOW", "tier2_resolved").otherwise("additional").alias("provenance"))
    return audit.held_slots(r).select("cert_id", "main")


@query("""SELECT max(doc_id) AS seq FROM documents GROUP BY md5(text)""")
def q_same_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), none.alias("doc_id"), F.md5("text").alias("md5"), none.alias("filename"), F.length("text").alias("richness"))
    return review.same_documents(d).select("seq")
