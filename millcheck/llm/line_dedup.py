"""Line dedup by pairwise alignment: rare shared lines find the pairs, patience diff aligns them, and what a document
has in common with an earlier one is deleted from it.

Texts are made distinct first: an exact copy aligns with its original as a whole. Short lines are seldom rare, so what
finds a pair is a run: the shortest stretch of lines from a line on, or up to a line, that has BLOCK_WORDS words. Each
line of a common block with so many words lies in a run of the block. A run that several texts hold links each of them
to the earliest, so a run in n texts makes n - 1 pairs, never all pairs, and needs no limit on n. A pair carries the
places of its runs only, so a text of n lines moves about 2 n of them however many texts it is aligned with. Runs that
are once in both texts are aligned by patience diff; those that no alignment in one order can hold, being in another
order or repeated, are deleted as moved blocks. So a line goes if and only if it lies in a common block with any earlier
text, and which holder a run is looked at against makes no difference.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millcheck.llm.common import cut

#: A common block is deleted if it has this many words in all.
BLOCK_WORDS = 5
SPACES = r" \t\r\x0b\x0c"
RUN = T.StructType([T.StructField("run", T.LongType()), T.StructField("check", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("at", T.ArrayType(T.IntegerType()))])


def patience(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest rising run of places (i, j) of what is once in each of two sequences; i must rise."""
    ends, chain = [], []  # patience piles: the last j, and (i, j, link to the pile before)
    piles: list[int] = []
    for i, j in pairs:
        k = bisect_left(ends, j)
        chain.append((i, j, piles[k - 1] if k else -1))
        ends[k : k + 1] = [j]
        piles[k : k + 1] = [len(chain) - 1]
    out, at = [], piles[-1] if piles else -1
    while at >= 0:
        i, j, at = chain[at]
        out.append((i, j))
    return out[::-1]


def common_lines(shared: list[tuple[list[int], int, int, int]]) -> tuple[list[int], int]:
    """Positions of the lines of the runs that a text shares with an earlier one, and how many of them are in no aligned
    run. shared: places in the text, number of lines, first place in the other, number of places there."""
    once = sorted((at[0], other, size) for at, size, other, times in shared if len(at) == 1 and times == 1)
    sizes = {i: size for i, _, size in once}
    aligned: set[int] = set()
    for i, _ in patience([(i, j) for i, j, _ in once]):
        aligned.update(range(i, i + sizes[i]))
    every = {x for at, size, _, _ in shared for i in at for x in range(i, i + size)}
    return sorted(every), len(every - aligned)


def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        found = [common_lines([(x["at"].tolist(), x["size"], x["other"], x["times"]) for x in shared]) for shared in part["shared"]]
        yield pd.DataFrame({"k1": part["k1"], "k2": part["k2"], "gone": [g for g, _ in found], "moved": [n for _, n in found]})


def runs(h: np.ndarray, n_words: np.ndarray, least: int) -> list[tuple[int, int, int, list[int]]]:
    """The distinct runs of a text: hash, another hash, number of lines, places. Blank lines have no words and the hash 0."""
    upto = np.cumsum(n_words, dtype=np.int64)
    at = np.flatnonzero(n_words)
    before = upto[at] - n_words[at]
    end = np.searchsorted(upto, before + least)  # the line in which a run from each line on has enough words
    spans = {(i, j) for i, j in zip(at.tolist(), end.tolist()) if j < len(h)}
    # a run up to a line begins with the last line before which enough words are left
    start = np.searchsorted(upto, upto[at] - least, side="right")
    spans |= {(i, j) for i, j, n in zip(start.tolist(), at.tolist(), upto[at].tolist()) if n >= least}
    raw, found = h.astype("<i8").tobytes(), {}
    for i, j in sorted(spans):
        part = raw[8 * i : 8 * (j + 1)]
        found.setdefault((xxhash.xxh64_intdigest(part) - (1 << 63), xxhash.xxh32_intdigest(part) - (1 << 31), j + 1 - i), []).append(i)
    return [(*x, places) for x, places in found.items()]


def seeds_of(least: int):
    @F.pandas_udf(T.ArrayType(RUN))
    def f(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for h, w in batches:
            yield pd.Series([[dict(zip(RUN.names, x)) for x in runs(a, b, least)] for a, b in zip(h, w)], dtype=object)

    return f


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def staying(gone: pd.Series, n_words: pd.Series) -> pd.Series:
    """Which lines stay: not those that are gone, and no blank ones between two that are."""
    out = []
    for parts, w in zip(gone, n_words):
        full = np.flatnonzero(w)
        away = np.zeros(len(w), dtype=bool)
        for x in parts:
            away[x] = True
        for i, j in zip(full, full[1:]):
            if away[i] and away[j]:
                away[i:j] = True
        out.append(~away)
    return pd.Series(out, dtype=object)


def text_key(text_col: str) -> list:
    """128 bits that stand for a text; null is the empty text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(F.lit(i), text).alias(f"k{i}") for i in (1, 2)]


def plan(docs: DataFrame, id_col: str, text_col: str, block_words: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, k1, k2, n_lines, n_words), and per distinct text: k1, k2, first (its smallest id), stay (by line; null if
    all do), n_links (earlier texts that it was aligned with) and n_moved (lines gone that no alignment holds)."""
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda x: F.trim(F.translate(x, "\t\r\x0b\x0c", "    ")))
    rows = docs.select(F.col(id_col).alias("id"), *text_key(text_col), lines.alias("lines"))
    h = F.transform("lines", lambda x: F.when(x == "", F.lit(0)).otherwise(F.xxhash64(x)))
    w = F.transform("lines", lambda x: F.when(x == "", F.lit(0)).otherwise(1 + F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("int"))
    rows = cut(rows.select("id", "k1", "k2", h.alias("h"), w.alias("w")))
    # null ids come last
    order = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2", F.col("at")[0].alias("place"), F.size("at").alias("times"))
    texts = cut(rows.groupBy("k1", "k2").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("o"), F.first("h").alias("h"), F.first("w").alias("w")).select("k1", "k2", F.col("o.id").alias("id"), "h", "w"))
    seeds = cut(texts.select("id", "k1", "k2", F.explode(seeds_of(block_words)("h", "w")).alias("s")).select("id", "k1", "k2", "s.*"))
    # written out, so that a run of very many texts can be split where it is joined
    run = ["run", "check", "size"]
    held = cut(seeds.groupBy(*run).agg(F.count("*").alias("n"), F.min(order).alias("a")).where("n > 1").drop("n"))
    place = F.struct("at", "size", F.col("a.place").alias("other"), F.col("a.times").alias("times"))
    shared = seeds.join(held, run).where("k1 <> a.k1 or k2 <> a.k2").select("k1", "k2", F.col("a.k1").alias("a1"), F.col("a.k2").alias("a2"), place.alias("s"))
    # at most the runs of one text come together
    pairs = shared.groupBy("k1", "k2", "a1", "a2").agg(F.collect_list("s").alias("shared"))
    found = pairs.select("k1", "k2", "shared").mapInPandas(aligned, "k1 long, k2 long, gone array<int>, moved int")
    gone = found.groupBy("k1", "k2").agg(F.collect_list("gone").alias("gone"), F.count("*").alias("n_links"), F.sum("moved").alias("n_moved"))
    per_text = texts.select("k1", "k2", F.col("id").alias("first"), "w").join(gone, ["k1", "k2"], "left")
    some = per_text.where("gone is not null").select("k1", "k2", "first", staying("gone", "w").alias("stay"), "n_links", "n_moved")
    none = per_text.where("gone is null").select("k1", "k2", "first", F.lit(None).cast("array<boolean>").alias("stay"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_moved"))
    total = F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("id", "k1", "k2", F.size("h").alias("n_lines"), total.alias("n_words")), some.union(none)


def deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per row of docs: id_col, n_lines, deleted (line numbers from 0, rising), n_links (earlier texts that it
    was aligned with, its own original included), n_moved (lines deleted that are in another order or repeated).

    The earlier of two documents is that with the smaller id, null last. Later rows of a text of block_words words or
    more lose all their lines; rows that repeat the first id with its text are one document and are kept alike. Blank
    lines go only between two lines that go. A null text is one blank line; other columns are not looked at; an empty
    table gives an empty result.
    """
    rows, per_text = plan(docs, id_col, text_col, block_words)
    # written out, so that a text of very many rows can be split where it is joined
    x = rows.join(cut(per_text), ["k1", "k2"])
    copy = ~F.col("id").eqNullSafe(F.col("first")) & (F.col("n_words") >= block_words)
    numbers = F.sequence(F.lit(0), F.col("n_lines") - 1)
    gone = F.when(copy, numbers).when(F.col("stay").isNull(), F.array().cast("array<int>")).otherwise(F.filter(numbers, lambda i: ~F.get("stay", i)))
    links = F.col("n_links") + F.when(copy, 1).otherwise(0)
    return x.select(F.col("id").alias(id_col), F.col("n_lines").cast("long").alias("n_lines"), gone.alias("deleted"), links.alias("n_links"), "n_moved")


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with the lines deleted from text_col, all columns else as they are. Rows of which no word is left are
    dropped if they had any; rows without a word are kept."""
    rows, per_text = plan(docs, id_col, text_col, block_words)
    facts = rows.groupBy("k1", "k2").agg(F.max("n_words").alias("n_words"), F.count("*").alias("n"))
    # written out, so that a text of very many rows can be split where it is joined
    edits = cut(per_text.join(facts, ["k1", "k2"]).where("stay is not null or n > 1").select("k1", "k2", "first", "stay", "n_words"))
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id_"), F.col(text_col).alias("text_"), *text_key(text_col))
    x = whole.join(edits, ["k1", "k2"], "left")
    copy = F.col("n_words").isNotNull() & ~F.col("id_").eqNullSafe(F.col("first")) & (F.col("n_words") >= block_words)
    left = F.array_join(F.filter(F.split("text_", "\n", -1), lambda _, i: F.get("stay", i)), "\n")
    text = F.when(F.col("stay").isNull(), F.col("text_")).otherwise(left)
    emptied = copy | (F.col("stay").isNotNull() & ~text.rlike(rf"[^\n{SPACES}]"))
    kept = x.where(~emptied).select(F.col("row"), text.alias("new_"))
    return kept.select(*(F.col("new_").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
