"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

A count c is kept as its level, 1 + floor(log(c) to BASE): the filter holds a gram with each number up to its level, and a
reader asks for 1, 2, ... until one is missing. Probabilities come from these levels: each order's estimate is smoothed
towards the next lower one by MU pseudo counts, P(w|h) = (c(hw) + MU P(w|h')) / (c(h) + MU), unigrams towards all words alike. Unigram counts are the exact
ones that the base score needs anyway; the filter has the longer grams.

The filter is built in slices by hash, each by one task from the counts that batches of documents have added up before, so
that its size follows the text and no slice's does. Slices go to the workers in groups of PASS_BYTES at most, whatever their
number: the levels found with one group stay with the documents while the next is asked, so scores do not depend on the
groups. Words go by the same slices: one task adds a slice's words up over all batches and sends each batch the counts of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millcheck.llm.common import scratch

ORDER = 2
BASE = 1.5
#: On held-out documents of sf0.1 the log10 probability is -2.31, -2.22, -2.19, -2.20, -2.24 million at 8, 50, 200, 1000, 5000.
MU = 200.0
#: Each entry has BITS bits of the filter and sets PROBES of them, all in one block of 512.
BITS, PROBES = 10, 5
#: A batch ends with the text that brings it to so many characters; a slice has the grams of about so many bytes of text.
BATCH_CHARS, SLICE_BYTES = 12_000_000, 8_000_000
#: The most bytes of the filter that the driver and a worker hold at a time.
PASS_BYTES = 128_000_000
#: Documents whose crc32 of the id, modulo FOLDS, is HELD_OUT are not learnt from.
FOLDS, HELD_OUT = 7, 2

FIRST = BASE ** np.arange(0, 110)
BEGIN, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(FIRST, counts, side="right")


#: The count that a level stands for: the mean of the whole numbers that have it.
COUNT = np.array([0.0] + [(np.ceil(lo) + np.ceil(lo * BASE) - 1) / 2 if np.ceil(lo) < lo * BASE else lo * BASE**0.5 for lo in FIRST])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on every other."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: The upper 32 bits of a key choose its slice, which has a few million keys whatever the input; the lower 32 tell these apart.
LOW = np.uint64((1 << 32) - 1)


def slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    """Ascends with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


def packed(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Four bytes for each key and one for its count; greater counts take several entries."""
    times = (counts + 254) // 255
    last = counts - 255 * (times - 1)
    n = np.full(int(times.sum()), 255, dtype=np.uint8)
    n[times.cumsum() - 1] = last
    return (np.repeat(keys, times) & LOW).astype("<u4").tobytes(), n.tobytes()


def unpacked(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(keys, dtype="<u4").astype(np.uint64), np.frombuffer(counts, dtype=np.uint8).astype(np.int64)


def shrunk(tokens: np.ndarray) -> bytes:
    """Places of words, the small ones the frequent ones: by planes of bytes, of which most are zero."""
    return zstandard.compress(np.asarray(tokens, dtype="<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def grown(tokens: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(tokens), dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def bits_of(keys: np.ndarray, levels: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block of each entry, among the blocks of its slice, and PROBES places of 9 bits each in it."""
    h = mix((keys & LOW) + levels.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return ((h >> np.uint64(32)) * blocks >> np.uint64(32)).astype(np.int64), mix(h + np.uint64(1))


class Filter:
    """Some slices of the filter: 64-bit words, and for each slice of all its first block and number of blocks, 0 if not here."""

    def __init__(self, slices: int, parts: Iterable[tuple[int, bytes]]):
        self.slices, bits = slices, bytearray()
        self.first, self.blocks = np.zeros(slices, dtype=np.int64), np.zeros(slices, dtype=np.uint64)
        for s, b in parts:
            self.first[s], self.blocks[s] = len(bits) // 64, len(b) // 64
            bits += b
        self.words = np.frombuffer(bits, dtype="<u8")

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key, 0 for those of other slices and, but for false positives, those without a count."""
        found = np.zeros(len(keys), dtype=np.uint8)
        of = slice_of(keys, self.slices)
        alive = np.flatnonzero(self.blocks[of] > 0)
        j = 1
        while len(alive) and j < len(COUNT):
            block, places = bits_of(keys[alive], np.full(len(alive), j), self.blocks[of[alive]])
            word, there = (self.first[of[alive]] + block) * 8, np.ones(len(alive), dtype=bool)
            for p in range(PROBES):
                place = places >> np.uint64(9 * p) & np.uint64(511)
                there &= (self.words[word + (place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
            alive = alive[there]
            found[alive] = j
            j += 1
        return found


def built(keys: np.ndarray, counts: np.ndarray, bits: int = BITS) -> bytes:
    """The bits of a slice. Counts of equal keys are added up."""
    keys, at = np.unique(keys & LOW, return_inverse=True)
    total = np.zeros(len(keys), dtype=np.int64)
    np.add.at(total, at, counts)
    levels = level(total)
    ends = levels.cumsum()
    n = int(ends[-1]) if len(ends) else 0
    blocks = max(1, -(-n * bits // 512))
    flags = np.zeros(blocks * 512, dtype=bool)
    block, places = bits_of(np.repeat(keys, levels), np.arange(1, n + 1) - np.repeat(ends - levels, levels), np.uint64(blocks))
    for p in range(PROBES):
        flags[block * 512 + (places >> np.uint64(9 * p) & np.uint64(511)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


class Text:
    """The tokens of some documents in one row, each document's closed by an end."""

    def __init__(self, vocabulary: np.ndarray, lists: list[np.ndarray], order: int):
        hashes = np.array([END, *(xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in vocabulary[1:])], dtype=np.uint64)
        self.length = np.array([len(x) + 1 for x in lists], dtype=np.int64)
        self.start = self.length.cumsum() - self.length
        self.token = np.zeros(int(self.length.sum()), dtype=np.int32)  # 0 is the end
        for s, x in zip(self.start, lists):
            self.token[s : s + len(x)] = x
        self.at = np.arange(len(self.token), dtype=np.int32)
        self.at -= np.repeat(self.start.astype(np.int32), self.length)
        self.words, self.keys = mix(hashes), []
        for n in range(2, order + 1):
            before = np.empty(len(self.token), dtype=np.uint64)
            before[1:] = (self.keys[-1] if self.keys else self.words[self.token])[:-1]
            if n == 2:
                before[self.start] = mix(BEGIN.reshape(1))[0]
            key = mix(before)
            key *= np.uint64(3)
            key += hashes[self.token]
            self.keys.append(mix(key))

    def grams(self, chosen: np.ndarray) -> np.ndarray:
        """The keys of all grams of two tokens and more of the chosen documents."""
        of = np.repeat(chosen, self.length)
        return np.concatenate([np.zeros(0, dtype=np.uint64), *(k[of & (self.at >= n)] for n, k in enumerate(self.keys))])

    def levels(self, bloom: Filter) -> np.ndarray:
        """The levels of all grams: a row per order from two. Each distinct gram is looked up once."""
        rows = np.zeros((len(self.keys), len(self.token)), dtype=np.uint8)
        for n, k in enumerate(self.keys):
            keys, at = np.unique(k, return_inverse=True)
            rows[n] = np.where(self.at >= n, bloom.levels(keys)[at], 0)
        return rows

    def log10(self, c: np.ndarray, levels: np.ndarray, tokens: int, words: int, texts: int) -> np.ndarray:
        """Each document's score from its tokens' counts and the levels found."""
        p, there = (c + 1) / (tokens + words + 1), c > 0
        for n, found in enumerate(levels):
            history = np.zeros(len(c))
            history[1:] = c[:-1]
            if n == 0:
                history[self.start] = texts
            history[self.at < n] = 0
            found = np.where(there, found, 0)  # what its end has no count of has none
            c, there = np.minimum(COUNT[found], history), found > 0
            p = (c + MU * p) / (history + MU)
        return np.add.reduceat(np.log10(p), self.start)


def batch_rows(batch: int, ids: pa.Array, held: list[bool], texts: list[str | None], slices: int, order: int) -> pa.RecordBatch:
    """A row per document, and one for each slice that the batch has words or grams of."""
    places: dict[bytes, int] = {b"": 0}
    lists = [np.array([places.setdefault(w, len(places)) for w in (t or "").encode("utf-8", "surrogatepass").lower().split()], dtype=np.int32) for t in texts]
    words = np.array([w.decode("utf-8", "surrogatepass") for w in places], dtype=object)
    text, learnt = Text(words, lists, order), ~np.array(held, dtype=bool)
    counts = np.bincount(text.token[np.repeat(learnt, text.length)], minlength=len(words))
    keys, n = np.unique(text.grams(learnt), return_counts=True)
    ends = np.searchsorted(slice_of(keys, slices), np.arange(slices + 1)).tolist()
    order_of = np.argsort(of := slice_of(text.words, slices), kind="stable")
    word_ends = np.searchsorted(of[order_of], np.arange(slices + 1)).tolist()
    own = [(s, *packed(keys[a:b], n[a:b]), order_of[c:d]) for s, a, b, c, d in zip(range(slices), ends, ends[1:], word_ends, word_ends[1:]) if a < b or c < d]
    d, null = len(texts), [None] * len(own)
    return pa.RecordBatch.from_pydict({
        "batch": pa.array([batch] * (d + len(own)), pa.int64()), "id": pa.concat_arrays([ids, pa.nulls(len(own), ids.type)]), "held_out": pa.array([*held, *null], pa.bool_()), "tokens": pa.array([*map(shrunk, lists), *null], pa.binary()),
        "n_tokens": pa.array([*(len(x) + 1 for x in lists), *null], pa.int64()), "slice": pa.array([None] * d + [x[0] for x in own], pa.int32()), "keys": pa.array([None] * d + [x[1] for x in own], pa.binary()), "n": pa.array([None] * d + [x[2] for x in own], pa.binary()),
        "words": pa.array([None] * d + [words[x[3]] for x in own], pa.list_(pa.string())), "places": pa.array([None] * d + [shrunk(x[3]) for x in own], pa.binary()), "counts": pa.array([None] * d + [shrunk(counts[x[3]]) for x in own], pa.binary()),
    })


def batches(docs: DataFrame, id_col: str, text_col: str, slices: int, order: int, batch_chars: int) -> DataFrame:
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).alias("text"))
    kind = to_arrow_type(rows.schema["id"].dataType)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, held, texts, chars = TaskContext.get().partitionId() << 32, [], [], [], 0
        for r in source:
            for i, t in enumerate(r["text"]):
                ids.append(r["id"].slice(i, 1).cast(kind))
                held.append(r["held_out"][i].as_py())
                texts.append(t.as_py())
                chars += len(texts[-1] or "")
                if chars >= batch_chars:
                    yield batch_rows(number, pa.concat_arrays(ids), held, texts, slices, order)
                    number, ids, held, texts, chars = number + 1, [], [], [], 0
        if texts:
            yield batch_rows(number, pa.concat_arrays(ids), held, texts, slices, order)

    path = scratch(docs.sparkSession, "grams")
    rows.mapInArrow(run, f"batch long, id {rows.schema['id'].dataType.simpleString()}, held_out boolean, tokens binary, n_tokens long, slice int, keys binary, n binary, words array<string>, places binary, counts binary").write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def filters(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """slice, bytes, bits: the slices that have grams. A slice's partial counts are of SLICE_BYTES of text, wherever it comes from."""

    def build(table: pa.Table) -> pa.Table:
        keys, n = unpacked(*(b"".join(x.as_py() for x in table[c]) for c in ("keys", "n")))
        made = built(keys, n, bits)
        return pa.table({"slice": pa.array([table["slice"][0].as_py()], pa.int32()), "bytes": pa.array([len(made)], pa.int64()), "bits": pa.array([made], pa.binary())})

    path = scratch(rows.sparkSession, "filter")
    rows.where("slice is not null").select("slice", "keys", "n").groupBy("slice").applyInArrow(build, "slice int, bytes long, bits binary").write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def word_counts(rows: DataFrame) -> DataFrame:
    """batch, words, places, totals (how often each is in the texts learnt from) and, in one row of each slice, n_words (how many
    of its words are there at all)."""

    def add(table: pa.Table) -> pa.Table:
        totals: dict[str, int] = {}
        lists, counts = [x.as_py() for x in table["words"]], [grown(x.as_py()).tolist() for x in table["counts"]]
        for words, n in zip(lists, counts):
            for w, k in zip(words, n):
                totals[w] = totals.get(w, 0) + k
        said = [np.array([totals[w] for w in words], dtype="<u8") for words in lists]
        known = [sum(k > 0 for k in totals.values())] + [0] * (len(lists) - 1)
        return pa.table({"batch": table["batch"], "words": table["words"], "places": table["places"], "totals": pa.array([zstandard.compress(x.tobytes(), 1) for x in said], pa.binary()), "n_words": pa.array(known, pa.int64())})

    path = scratch(rows.sparkSession, "words")
    by_slice = rows.where("slice is not null").select("batch", "slice", "words", "places", "counts").groupBy("slice")
    by_slice.applyInArrow(add, "batch long, words array<string>, places binary, totals binary, n_words long").write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.parquet(path)


def groups_of(sizes: list[tuple[int, int]], most: int) -> list[list[int]]:
    """Slices in groups of most bytes at most, or one slice."""
    out, room = [[]], most
    for s, size in sorted(sizes):
        if out[-1] and size > room:
            out.append([])
            room = most
        out[-1].append(s)
        room -= size
    return out


def documents_of(docs: pa.Table, own: pa.Table, order: int) -> tuple[Text, np.ndarray, np.ndarray]:
    """The tokens of a batch's documents, their counts, and the levels found so far."""
    places = np.concatenate([grown(x.as_py()) for x in own["places"]]).astype(np.int64)
    words, totals = np.empty(len(places), dtype=object), np.zeros(len(places))
    words[places] = [w for x in own["words"] for w in x.as_py()]
    totals[places] = np.concatenate([np.frombuffer(zstandard.decompress(x.as_py()), dtype="<u8") for x in own["totals"]])
    text = Text(words, [grown(x.as_py()) for x in docs["tokens"]], order)
    found = np.zeros((order - 1, len(text.token)), dtype=np.uint8)
    for s, n, x in zip(text.start, text.length, docs["found"]):
        if x.is_valid:
            found[:, s : s + n] = np.frombuffer(x.as_py(), dtype=np.uint8).reshape(order - 1, n)
    return text, totals[text.token], found


def sent(bits: DataFrame, slices: int, group: list[int]) -> Broadcast:
    """Broadcasts a group of slices, whose size groups_of has bounded. They come to the driver a few at a time."""
    here = bits.where(F.col("slice").between(group[0], group[-1])).toLocalIterator() if group else ()
    return bits.sparkSession.sparkContext.broadcast(Filter(slices, ((r.slice, r.bits) for r in here)))


def asking(bloom: Broadcast, order: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Adds the levels found in a group of slices to a batch's documents."""

    def ask(docs: pa.Table, own: pa.Table) -> pa.Table:
        text, _, found = documents_of(docs, own, order)
        found = np.maximum(found, text.levels(bloom.value))
        said = pa.array([found[:, s : s + n].tobytes() for s, n in zip(text.start, text.length)], pa.binary())
        return docs.set_column(docs.schema.get_field_index("found"), "found", said)

    return ask


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, batch_chars: int = BATCH_CHARS, slice_bytes: int = SLICE_BYTES, pass_bytes: int = PASS_BYTES, bits_per_entry: int = BITS) -> DataFrame:
    """A row per document: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Null and empty texts are the end alone. Null ids are learnt from. Repeated rows are documents each; other columns are not
    looked at; an empty table gives an empty result. Without documents to learn from all scores are 0:
    the one kind of token there can be has probability 1. A very long text is a batch of its own. As counts are quantised, the probabilities of all
    continuations of a history add up to one but for the width of the levels.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    slices = max(1, -(-size // slice_bytes))
    rows = batches(docs, id_col, text_col, slices, order, batch_chars)
    learnt = rows.where("tokens is not null and not held_out").agg(F.count("*"), F.sum("n_tokens")).first()
    n_texts, n_tokens = learnt[0], int(learnt[1] or 0)
    words = word_counts(rows)
    n_words = words.agg(F.sum("n_words")).first()[0] or 0
    own = words.select(F.col("batch").alias("of"), "words", "places", "totals").groupBy("of")

    bits = filters(rows, bits_per_entry)
    groups = groups_of([(r.slice, r.bytes) for r in bits.select("slice", "bytes").collect()], pass_bytes)
    state = rows.where("slice is null").select("batch", "id", "held_out", "tokens", F.lit(None).cast("binary").alias("found"))
    for g in groups[:-1]:
        bloom = sent(bits, slices, g)
        path = scratch(spark, "levels")
        state.groupBy("batch").cogroup(own).applyInArrow(asking(bloom, order), state.schema).write.parquet(path)
        bloom.destroy()
        state = spark.read.parquet(path)
    bloom = sent(bits, slices, groups[-1])
    kind = rows.schema["id"].dataType
    arrow = to_arrow_type(kind)

    def finish(docs: pa.Table, own: pa.Table) -> pa.Table:
        text, c, found = documents_of(docs, own, order)
        found = np.maximum(found, text.levels(bloom.value))
        base = np.add.reduceat(np.log10((c + 1) / (n_tokens + n_words + 1)), text.start)
        out = {"id": docs["id"].cast(arrow), "held_out": docs["held_out"], "n_tokens": text.length, "n_known": np.add.reduceat((c > 0).astype(np.int64), text.start), "train_tokens": np.full(len(text.length), n_tokens)}
        return pa.table(out | {"base_score": base, "score": text.log10(c, found, n_tokens, n_words, n_texts)})

    schema = f"id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return state.groupBy("batch").cogroup(own).applyInArrow(finish, schema).withColumnRenamed("id", id_col)
