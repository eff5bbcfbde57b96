"""The driver's tables as certificates: an order is a certificate, its lines are records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millcheck.operators.audit import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four records per line: cert_id, pos, category, property_key, sub_property, value, text, level, provenance."""
    li = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    li = li.withColumn("line", F.row_number().over(order))
    keys = ("quantity", "l_quantity"), ("extendedprice", "l_extendedprice"), ("discount", "l_discount"), ("tax", "l_tax")
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("property_key"), F.col(c).alias("value")) for i, (k, c) in enumerate(keys)))
    provenance = F.when(F.col("l_returnflag") == "R", "core").when(F.col("l_returnflag") == "A", "additional").otherwise("tier2_resolved")
    x = li.select(F.col("l_orderkey").alias("cert_id"), "line", provenance.alias("provenance"), F.col("l_linestatus").alias("status"), F.explode(each).alias("e"))
    word = F.when(F.col("e.property_key") == "quantity", F.when(F.col("status") == "F", "PASS").otherwise("FAIL"))
    return x.select("cert_id", ((F.col("line") - 1) * 4 + F.col("e.i")).cast("int").alias("pos"), F.lit("mechanical").alias("category"), "e.property_key", F.lit(None).cast("string").alias("sub_property"), "e.value", word.alias("text"), F.lit(None).cast("string").alias("level"), "provenance")


def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("cert_id"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "strict").otherwise("usual").alias("spec_key"), F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("header"), F.create_map(F.lit("wall_thickness_mm"), F.col("o_totalprice") / 100000).alias("dimensions"))


def rules(spark: SparkSession) -> DataFrame:
    """A small catalogue of two slices over the mapped properties."""
    from millcheck.plans.audit import SCHEMA

    made = []
    for spec, factor in (("strict", 1.0), ("usual", 1.1)):
        base = dict(spec_key=spec, category="mechanical")
        made += [
            base | dict(rule_id=f"{spec}-1", pos=1, rule_type="numeric_range", property_key="quantity", level="MANDATORY", lo=2.0, hi=48.0 * factor, decimals=0),
            base | dict(rule_id=f"{spec}-2", pos=2, rule_type="numeric_range", property_key="discount", level="MANDATORY", hi=0.09 * factor, decimals=2),
            base | dict(rule_id=f"{spec}-3", pos=3, rule_type="dynamic_expression", property_key="extendedprice", level="MANDATORY", formula_lo="100 * ctx.mechanical.quantity / 2", decimals=2),
            base | dict(rule_id=f"{spec}-4", pos=4, rule_type="numeric_range", property_key="hardness", level="CONDITIONAL", lo=100.0, trigger="S >= 3.5"),
            base | dict(rule_id=f"{spec}-5", pos=5, rule_type="numeric_range", property_key="tax", level="OPTIONAL_AGREED", lo=0.0, hi=0.08, decimals=2, group_id="g1", group_op="OR", min_pass=1),
            base | dict(rule_id=f"{spec}-6", pos=6, rule_type="numeric_range", property_key="ferrite_content", level="OPTIONAL_AGREED", lo=1.0, group_id="g1", group_op="OR", min_pass=1),
            base | dict(rule_id=f"{spec}-7", pos=7, rule_type="exemption", property_key="intergranular_corrosion", level="EXEMPT"),
        ]
    names = spark.createDataFrame([], SCHEMA).columns
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in made], SCHEMA)
