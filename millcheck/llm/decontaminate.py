"""Benchmark decontamination: CGK embeddings, bit-sampling LSH over item-sized windows, exact edit verification.

A CGK random walk reads a token sequence and steps on or stays by a random bit of the step and the token read, so
sequences at a small edit distance get embeddings at a small Hamming distance. Windows the length of each benchmark
item are embedded by several walks; a window and an item are a candidate if some table of the LSH, which samples a few
positions of one walk, agrees on both. Candidates are verified by exact edit distance.

A passage matches an item of n words if some stretch of the text is within floor((1 - similarity) * n) word edits.
Of such a stretch, a gram of ceil((n - e) / (e + 1)) words is untouched, so windows that do not lie around a gram of
their item cannot match and are not embedded; this loses nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millcheck.llm.common import words

SIMILARITY = 0.8
#: Random walks, LSH tables per walk, sampled positions per table; sampled where the item's embedding is not padding. Found
#: of windows at SIMILARITY, 60 trials for each of 5, 10, 20, 50 and 100 words: all; of unrelated windows pass 0 to 0.3 %.
WALKS, TABLES, SAMPLED = 6, 8, 2
#: Items that one pass over the texts looks for: bounds what is sent to the tasks, some 40 MB, whatever the benchmark's size.
BLOCK_ITEMS = 20_000
LONGEST_GRAM = 4
BITS = 22
PAD = np.uint64(0)


class Vocabulary(dict):
    """Word to token: the hash of the word in lower case without the marks around it, 0 if nothing is left."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        s = word.decode("utf-8", "surrogatepass").lower()
        i, j = 0, len(s)
        while i < j and not s[i].isalnum():
            i += 1
        while i < j and not s[j - 1].isalnum():
            j -= 1
        self[word] = h = xxhash.xxh64_intdigest(s[i:j].encode("utf-8", "surrogatepass")) | 1 if i < j else 0
        return h


def tokens(text: str | None, vocabulary: Vocabulary) -> np.ndarray:
    """The tokens of a text; words without a letter or digit have none."""
    t = np.fromiter(map(vocabulary.__getitem__, words(text)), dtype="<u8")
    return t[t != 0]


def grams(t: np.ndarray, q: int) -> np.ndarray:
    n = len(t) - q + 1
    key = np.zeros(max(n, 0), dtype="<u8")
    with np.errstate(over="ignore"):
        for i in range(q if n > 0 else 0):
            key = (key ^ t[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
    return key


def coins(walk: int, n: int) -> np.ndarray:
    """An odd multiplier for each step of a walk: the step's random bit for a token is the top bit of their product."""
    return np.random.default_rng([walk, 7]).integers(0, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def embed(t: np.ndarray, start: np.ndarray, n: int, walk: int) -> np.ndarray:
    """CGK embeddings, 3 n tokens each, of the windows of n tokens of t from each start."""
    at, end = start.copy(), np.minimum(start + n, len(t))
    out = np.zeros((3 * n, len(start)), dtype="<u8")
    padded = np.append(t, PAD)
    with np.errstate(over="ignore"):
        for step, coin in enumerate(coins(walk, 3 * n)):
            inside = at < end
            x = padded[np.where(inside, at, len(t))]
            out[step] = x
            at += inside & ((x * coin) >> np.uint64(63)).astype(bool)
    return out


def close(t: np.ndarray, start: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Which windows the LSH finds for an item of their length."""
    n, hit = len(item), np.zeros(len(start), dtype=bool)
    for walk in range(WALKS):
        left = np.flatnonzero(~hit)
        if not len(left):
            break
        mine = embed(item, np.zeros(1, dtype=np.int64), n, walk)
        read = np.flatnonzero(mine[:, 0] != PAD)
        sampled = read[np.random.default_rng([walk, 11, n]).integers(0, len(read), size=(TABLES, SAMPLED))]
        same = embed(t, start[left], n, walk) == mine
        hit[left] = same[sampled].all(axis=1).any(axis=0)
    return hit


def best_end(pattern: list, text: list) -> tuple[int, int]:
    """Least edit distance of the pattern to any stretch of text, and where the first such ends (bit-parallel)."""
    m = len(pattern)
    where: dict = defaultdict(int)
    for i, x in enumerate(pattern):
        where[x] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, x in enumerate(text):
        eq = where.get(x, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = (mv | ~(xh | pv)) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Items:
    """Benchmark items and an index of their grams."""

    def __init__(self, items: list[tuple[object, str | None]], similarity: float, id_type: T.DataType | None = None):
        self.id_type = id_type or T.LongType()
        v = Vocabulary()
        self.items = [(i, t) for i, text in items if len(t := tokens(text, v))]
        self.edits = [int((1 - similarity) * len(t) + 1e-9) for _, t in self.items]
        by_q: dict[int, list] = defaultdict(list)
        for k, ((_, t), e) in enumerate(zip(self.items, self.edits)):
            q = min(LONGEST_GRAM, -(-(len(t) - e) // (e + 1)))
            by_q[q] += [(int(g), k, at) for at, g in enumerate(grams(t, q))]
        self.index = {}
        for q, found in by_q.items():
            found.sort()
            key = np.array([x[0] for x in found], dtype="<u8")
            flags = np.zeros(1 << BITS, dtype=bool)
            flags[key >> np.uint64(64 - BITS)] = True
            self.index[q] = flags, key, np.array([x[1] for x in found], dtype=np.int32), np.array([x[2] for x in found], dtype=np.int32)

    def windows(self, t: np.ndarray) -> dict[int, np.ndarray]:
        """For each item with a gram in t: where windows can start, counting edits before the gram."""
        items, starts = [], []
        for q, (flags, key, item, offset) in self.index.items():
            g = grams(t, q)
            p = np.flatnonzero(flags[g >> np.uint64(64 - BITS)])
            lo, hi = np.searchsorted(key, g[p], "left"), np.searchsorted(key, g[p], "right")
            n = hi - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            items.append(item[at])
            starts.append(np.repeat(p, n) - offset[at])
        item, start = np.concatenate(items or [[]]), np.concatenate(starts or [[]])
        if not len(item):
            return {}
        item, start = np.unique(np.stack([item, start]), axis=1)
        edges = np.flatnonzero(np.diff(item)) + 1
        return dict(zip(item[np.r_[0, edges]].tolist(), np.split(start, edges)))

    def find(self, t: np.ndarray) -> list[tuple[object, int, int, int]]:
        """(item id, first token, tokens, distance) of the matches, best first for each item, none overlapping."""
        out = []
        for k, diagonals in self.windows(t).items():
            (item_id, item), e = self.items[k], self.edits[k]
            start = np.unique(np.clip((diagonals[:, None] + np.arange(-e, e + 1)).ravel(), 0, max(0, len(t) - 1)))
            start = start[close(t, start, item)]
            if not len(start):
                continue
            pattern, n = item.tolist(), len(item)
            # windows that overlap are one stretch
            edges = np.flatnonzero(np.diff(start) > n) + 1
            for part in np.split(start, edges):
                todo = [(max(0, int(part[0]) - e), min(len(t), int(part[-1]) + n + e))]
                while todo:
                    lo, hi = todo.pop()
                    if hi - lo < n - e:
                        continue
                    stretch = t[lo:hi].tolist()
                    d, end = best_end(pattern, stretch)
                    if d > e:
                        continue
                    _, back = best_end(pattern[::-1], stretch[max(0, end - n - e) : end][::-1])
                    out.append((item_id, lo + end - back, back, d))
                    todo += [(lo, lo + end - back), (lo + end, hi)]
        return out


def blocks(benchmark: DataFrame, id_col: str, text_col: str, similarity: float, size: int = BLOCK_ITEMS) -> Iterator[Items]:
    """The benchmark in blocks of at most about `size` items, one at a time on the driver."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    n = max(1, -(-rows.count() // size))
    for i in range(n):
        yield Items([(r.id, r.text) for r in rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i).collect()], similarity, benchmark.schema[id_col].dataType)


def matches(items: Items, text: Column) -> Column:
    found = T.StructType([T.StructField("item_id", items.id_type), T.StructField("start", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("distance", T.IntegerType())])

    @F.pandas_udf(T.ArrayType(found))
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = Vocabulary()
        for part in texts:
            yield pd.Series([[{"item_id": i, "start": s, "n_words": n, "distance": d} for i, s, n, d in items.find(tokens(t, v))] for t in part], dtype=object)

    return find(text)


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row per passage of a document that matches a benchmark item: id_col, item_id, start and n_words (in words that
    have a letter or digit), distance (word edits).

    Null and empty texts match nothing; items that are null, have no such word or no id are not looked for. Null ids
    and repeated rows give rows like others; other columns are not looked at; an empty table on either side gives none.
    """
    out = None
    for items in blocks(benchmark, item_col, item_text, similarity):
        found = docs.select(F.col(id_col).alias("id"), F.explode(matches(items, F.col(text_col))).alias("m")).select(F.col("id").alias(id_col), "m.*")
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs in which no item is found, with all their columns as they are."""
    for items in blocks(benchmark, item_col, item_text, similarity):
        rows = docs.select(F.struct("*").alias("row"), F.size(matches(items, F.col(text_col))).alias("n"))
        docs = rows.where("n = 0").select("row.*")
    return docs
