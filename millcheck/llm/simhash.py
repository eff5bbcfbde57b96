"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are made distinct first, so exact copies cost one row. Two fingerprints that differ in at most 3 of 64
bits agree in at least n - 3 of n blocks; each choice of n - 3 blocks is a table, and a pair meets in some table.
Tables of few blocks are cheap but can have large buckets where many near copies lie close together. So the search
goes in levels: buckets of up to BUCKET fingerprints are verified in place, and the fingerprints of all larger buckets
go on to the next level with finer blocks. A linked pair that shares a small bucket is found there; otherwise all
buckets that it shares are large, so both go on. At the last level a bucket leaves only 12 bits free, which bounds it
at 4096 distinct fingerprints however many documents there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millcheck.llm.common import components, cut, words

DISTANCE = 3
BUCKET = 48
#: Blocks that must agree and number of blocks, by level.
LEVELS = ((2, 5), (5, 8), (13, 16))


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of the 3-word shingles; zero if there are no words."""
    w = words(text.translate(LOWER)) if text else []
    if not w:
        return 0
    shingles = map(b" ".join, zip(w, w[1:], w[2:])) if len(w) >= 3 else [b" ".join(w)]
    h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


LOWER = {c: c + 32 for c in range(65, 91)}


@F.pandas_udf(T.LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([fingerprint(t) for t in part], dtype="int64")


def masks(level: int) -> list[int]:
    """The bit masks of a level's tables, signed."""
    agree, n = LEVELS[level]
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << hi) - (1 << lo)) for lo, hi in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in map(sum, combinations(blocks, agree))]


def deal(fps: DataFrame, level: int) -> DataFrame:
    """fp, t (table), k (the bits that must agree): a row per fingerprint and table."""
    tables = F.array(*(F.struct(F.lit(i).alias("t"), F.lit(m).cast("long").alias("m")) for i, m in enumerate(masks(level))))
    return fps.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", F.col("fp").bitwiseAND(F.col("x.m")).alias("k"))


def within(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def spanning(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links that connect what is within DISTANCE in each bucket of at most 4096; fewer than its members."""
    for part in batches:
        a, b = [], []
        for fps in part["fps"]:
            x = np.asarray(fps, dtype=np.int64).view(np.uint64)
            new = np.ones(len(x), dtype=bool)
            for seed in range(len(x)):
                if not new[seed]:
                    continue
                new[seed], todo = False, [seed]
                while todo:
                    i = todo.pop()
                    near = np.flatnonzero(new & (np.bitwise_count(x ^ x[i]) <= DISTANCE))
                    new[near] = False
                    todo += near.tolist()
                    a += [fps[i]] * len(near)
                    b += [fps[j] for j in near]
        yield pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})


def links(fps: DataFrame) -> DataFrame:
    """Links a, b that connect all distinct fingerprints fp within DISTANCE bits. Every pair is connected by links, if
    not always directly: of a crowded bucket come links that span it."""
    found, left = None, fps
    for level in range(len(LEVELS)):
        dealt = deal(left, level)
        buckets = dealt.groupBy("t", "k").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
        buckets = cut(buckets)
        last = level == len(LEVELS) - 1
        some = buckets.where("n > 2" if last else f"n > 2 and n <= {BUCKET}").select("t", "k")
        lists = dealt.join(some, ["t", "k"]).groupBy("t", "k").agg(F.collect_list("fp").alias("fps")).select("fps")
        new = buckets.where("n = 2").where(within("a", "b")).select("a", "b").union(lists.mapInPandas(spanning, "a long, b long"))
        found = new if found is None else found.union(new)
        if last:
            break
        large = buckets.where(f"n > {BUCKET}").select("t", "k")
        if large.isEmpty():
            break
        left = cut(dealt.join(large, ["t", "k"]).select("fp").distinct())
    return found.distinct()


def row_key(id_col: str, text_col: str):
    """128 bits that stand for a row's id and text."""
    return F.struct(F.xxhash64(F.lit(1), id_col, text_col).alias("k1"), F.xxhash64(F.lit(2), id_col, text_col).alias("k2"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id_col, fp (signed fingerprint), component_id (the smallest id of the component), and
    k1, k2 (row_key).

    Null and texts without words have fingerprint zero and link like any other. Repeated rows and equal texts share a
    fingerprint and so a component. Null ids are never the smallest unless a component has no other: then it is null.
    Other columns are not looked at; an empty table gives an empty result.
    """
    rows = cut(docs.select(F.col(id_col).alias("id"), fingerprints(F.col(text_col)).alias("fp"), row_key(id_col, text_col).alias("key")))
    fps = cut(rows.groupBy("fp").agg(F.min("id").alias("id")))
    comp = components(links(fps.select("fp")))
    named = fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    of_fp = named.join(least, "component").select("fp", "component_id")
    return rows.join(of_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id", "key.*")


def hex16(fp: str):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, the one with the smallest id, with all its columns as they are. Where rows
    of a component share that id, one of them stays: any, if they are equal, else that of the smallest row_key."""
    best = near_duplicates(docs, id_col, text_col).where(F.col(id_col).eqNullSafe(F.col("component_id")))
    # a component without any id is known by its fingerprints alone, so each of those keeps one row
    group = F.when(F.col("component_id").isNull(), F.col("fp"))
    best = best.groupBy("component_id", group.alias("g_")).agg(F.min(F.struct("k1", "k2")).alias("b_")).select("b_.*")
    rows = docs.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("key")).select("row", "key.*")
    # the join leaves the rows dealt and sorted by key, so taking one of equal rows moves nothing
    return rows.join(best, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row.*")
