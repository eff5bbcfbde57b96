import numpy as np
from pyspark.sql import functions as F

from millcheck.llm import importance as im
from tests.llm.conftest import words


def test_kth_largest(spark):
    v = [float(x) for x in np.random.default_rng(1).normal(size=3000)] + [0.5] * 40
    df = spark.createDataFrame([(x,) for x in v], "x double")
    for k in (1, 2, 700, 1500, 3039, 3040, 9999):
        assert im.kth_largest(df, "x", k) == sorted(v, reverse=True)[min(k, len(v)) - 1]
    assert im.kth_largest(df, "x", 0) == np.inf


def test_counts_match_brute_force(spark, make):
    docs = [(i, " ".join(words(i, 80, 50))) for i in range(40)] + [(90, None), (91, ""), (92, "one"), (None, "x y")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 20)] + [(i, 0, 0) for i in range(20, 30)] + [(3, 0, 0), (4, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    raw, target, h = np.zeros(im.BUCKETS), np.zeros(im.BUCKETS), im.Hashes()
    for i, t in docs:
        b = im.buckets(t, h)
        np.add.at(raw, b, 1)
        if i is not None and i < 20 and i not in (3, 4):
            np.add.at(target, b, 1)
    want = np.log((target + im.PRIOR) / (raw * target.sum() / raw.sum() + im.PRIOR))
    assert np.allclose(im.log_ratios(make(docs), labels, "doc_id", "text"), want, atol=1e-5)
    got = im.resample(make(docs), labels, share=0.5).collect()
    assert len(got) == len(docs) and sum(r.kept for r in got) == round(0.5 * len(docs)) and {r.log_weight for r in got if r.doc_id in (90, 91)} == {0.0}
    again = im.resample(make(docs).repartition(3), labels, share=0.5).collect()
    assert sorted((str(r.doc_id), r.key) for r in got) == sorted((str(r.doc_id), r.key) for r in again)


def test_sample_follows_weights(spark, make):
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.0).alias("w"), ((F.shiftrightunsigned(F.xxhash64(F.lit(42), "id"), 11) + 0.5) / float(1 << 53)).alias("u")).select("w", (F.col("w") - F.log(-F.log("u"))).alias("key")).cache()
    t = im.kth_largest(rows, "key", 500)
    r = rows.where(F.col("key") >= t).groupBy("w").count().collect()
    n = {x.w: x["count"] for x in r}
    assert abs(n[1.0] / n[0.0] - np.e) < 0.6


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    fit = labels.where("doc_id % 2 = 0")
    got = im.resample(docs, fit).join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    by = {(r.quality, r.toxic): r.kept for r in got}
    assert by[1, 0] > 0.85 and by.get((0, 0), 0) < 0.25


def test_edges(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert im.resample(make([]), none).count() == 0
    assert im.resample(make([(1, "a"), (2, "b")]), none).where("kept").count() == 1


def test_the_noise_decides_near_the_border(spark):
    """The sample is not the top by weight, but nearly so, and toxic text of low weight stays out."""
    d = "/root/testdata/sf0.01"
    rows = im.resample(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).select("log_weight", "kept").collect()
    k = sum(r.kept for r in rows)
    border = sorted((r.log_weight for r in rows), reverse=True)[k - 1]
    swapped = sum(r.kept and r.log_weight < border for r in rows)
    assert 0 < swapped < 0.05 * k
