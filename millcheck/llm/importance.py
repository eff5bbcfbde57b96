"""Quality selection by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

The target is text that labels call good and not toxic. Words and word pairs are hashed to BUCKETS; the raw model
counts all documents, the target model a bounded sample of the labelled ones. A document's log weight is the mean log
ratio of the two models over its n-grams, for a text of LENGTH n-grams, so long texts are weighed like short ones. The
documents with the largest log weight plus Gumbel noise are a sample without replacement by weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millcheck.llm.common import cut, words

BITS = 18
BUCKETS = 1 << BITS
#: Added to either count of a bucket; takes rare n-grams to a ratio of one.
PRIOR = 3.0
LENGTH = 200
#: The most labelled target rows that the target model is fitted on, those with the smallest hash of their id.
MOST_LABELLED = 20_000
#: The share of documents selected is that of target rows among labelled rows, and this more.
MARGIN = 0.05
SEED = 42


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def buckets(text: str | None, hashes: Hashes) -> np.ndarray:
    """The buckets of all words and pairs of successive words, in lower case."""
    w = np.fromiter(map(hashes.__getitem__, words(text.lower() if text else text)), dtype="<u8")
    with np.errstate(over="ignore"):
        pairs = ((w[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ w[1:]) * np.uint64(0xD6E8FEB86659FD93)
    return (np.concatenate([w, pairs]) >> np.uint64(64 - BITS)).astype(np.int64)


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per bucket for a whole task: bucket, raw, target."""
    hashes, n = Hashes(), np.zeros((2, BUCKETS), dtype=np.int64)
    for part in batches:
        for text, target in zip(part["text"], part["target"]):
            b = buckets(text, hashes)
            np.add.at(n[0], b, 1)
            if target:
                np.add.at(n[1], b, 1)
    used = np.flatnonzero(n[0])
    yield pd.DataFrame({"bucket": used.astype("int32"), "raw": n[0][used], "target": n[1][used]})


def log_ratios(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Log ratio of target to raw for each bucket; comes to the driver, BUCKETS numbers whatever the input."""
    good = labels.groupBy("doc_id").agg(F.min(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)).alias("good")).where("doc_id is not null and good = 1")
    sample = good.select(F.col("doc_id").alias("label_id"), F.lit(True).alias("target")).orderBy(F.xxhash64("label_id"), "label_id").limit(MOST_LABELLED)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # the sample's size is bounded above
    rows = rows.join(F.broadcast(sample), F.col("id") == F.col("label_id"), "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    n = rows.mapInPandas(counted, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[n["bucket"]], target[n["bucket"]] = n["raw"], n["target"]
    expected = raw * (target.sum() / max(1.0, raw.sum()))
    return np.log((target + PRIOR) / (expected + PRIOR)).astype(np.float32)


def log_weight(ratios: np.ndarray, text: str):
    @F.pandas_udf(T.DoubleType())
    def weigh(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = Hashes()
        for part in texts:
            yield pd.Series([LENGTH * float(ratios[b].mean(dtype=np.float64)) if len(b := buckets(t, hashes)) else 0.0 for t in part], dtype="float64")

    return weigh(text)


def kth_largest(df: DataFrame, key: str, k: int) -> float:
    """The k-th largest value of a column without nulls. Narrows the range in which it lies by counts of 4096 slices."""
    lo, hi, n = df.agg(F.min(key), F.max(key), F.count("*")).first()
    if k >= n:
        return lo
    if k <= 0:
        return np.inf
    above = 0
    while True:
        inside = df.where((F.col(key) >= lo) & (F.col(key) <= hi))
        width = (hi - lo) / 4096
        slices = inside.groupBy(F.least(F.floor((F.col(key) - lo) / width), F.lit(4095)).alias("s") if width > 0 else F.lit(0).alias("s"))
        found = sorted(slices.agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect(), reverse=True)
        for s in found:
            if above + s.n >= k:
                lo, hi = s.lo, s.hi
                break
            above += s.n
        if lo == hi or len(found) == 1:
            return lo


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float | None = None, seed: int = SEED) -> DataFrame:
    """A row per row of docs: id_col, log_weight, key (log weight plus Gumbel noise), kept (among the share selected).

    labels: doc_id, quality, toxic; where rows for an id differ it is not target. share defaults to that of target
    rows among labelled ones plus MARGIN. Null and texts without words have log weight 0. Equal rows have equal noise
    and are kept alike; null ids are ids like others. Other columns are not looked at; without labels all log weights
    fall to about 0 and half are kept; an empty table gives an empty result.
    """
    ratios = log_ratios(docs, labels, id_col, text_col)
    if share is None:
        n, good = labels.agg(F.count("*"), F.count(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1))).first()
        share = min(1.0, good / n + MARGIN) if n else 0.5
    noise = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col, text_col), 11) + 0.5) / float(1 << 53)
    rows = docs.select(F.col(id_col), log_weight(ratios, text_col).alias("log_weight"), noise.alias("u"))
    rows = cut(rows.select(id_col, "log_weight", (F.col("log_weight") - F.log(-F.log("u"))).alias("key")))
    least = kth_largest(rows, "key", round(share * rows.count()))
    return rows.withColumn("kept", F.col("key") >= F.lit(least))
