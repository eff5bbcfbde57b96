"""Alignment of two tokenizers' tokens: which ids stand for the same bytes, over a whole corpus.

A text is cut where a lone space stands between two characters that are not white space: neither tokenizer has a token
across such a place, so stretches are encoded and aligned one by one, and each distinct one once per batch of documents.
DuckDB aligns a batch's new stretches inside its task: token interval tables of both sides on one axis of bytes, semi-joins
for the ends that both share, window sums of these for the groups, ASOF joins for the stretch of each group and, for the table
of translations, for the tokens that overlap. A batch writes its documents as lists of stretches, and its distinct id pairs with the number of
documents; Spark merges these counts and sends each batch those of its own pairs. No document's links are ever written out.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millcheck.llm.common import scratch

#: Where the vocabulary files are; the driver reads them, tasks get their contents, some 2 MB.
TOKENIZERS = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Fixed value: how byte-level vocabularies split a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents are read in parts of so many characters; a batch ends at so many distinct stretches, which are aligned so many at a time.
PART_CHARS, MOST_STRETCHES, TOGETHER = 2_000_000, 400_000, 30_000
#: Stretches that are encoded in one text.
TEXT = 500
#: Texts that do not simply fall apart at their spaces. All white space of Python's is in the class.
ODD = r"[\s\pZ\x0b\x1c-\x1f\x{85}] | [\s\pZ\x0b\x1c-\x1f\x{85}]|^ | $|^$"
CUT = re.compile(r"(?<=\S)(?= \S)")
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def stretches(text: str) -> list[str]:
    """The stretches of a space and the text, each without the space it begins with."""
    return [s[1:] for s in CUT.split(" " + text)]


def listed(texts: pa.Array, places: dict[str, int]) -> list[np.ndarray]:
    """Each text as the places of its stretches, none for null and empty ones; new stretches get the next places."""
    texts = texts.fill_null("")
    odd = pc.match_substring_regex(texts, ODD)
    split = pc.split_pattern(pc.if_else(odd, "", texts), " ")
    coded = split.flatten().dictionary_encode()
    # what odd texts leave behind is one empty stretch each, which is not theirs
    used = np.unique(coded.indices.to_numpy()[np.repeat(~odd.to_numpy(zero_copy_only=False), np.diff(split.offsets.to_numpy()))])
    at = np.zeros(len(coded.dictionary), dtype=np.int32)
    at[used] = [places.setdefault(p, len(places)) for p in coded.dictionary.take(pa.array(used)).to_pylist()]
    codes, ends = at[coded.indices.to_numpy()], split.offsets.to_numpy() - split.offsets[0].as_py()
    lists = [codes[i:j] for i, j in zip(ends, ends[1:])]
    for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
        text = texts[i].as_py()
        lists[i] = np.array([places.setdefault(p, len(places)) for p in stretches(text)] if text else [], dtype=np.int32)
    return lists


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write a printable byte as its own character and the n-th of the others as character 256 + n."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


class Encoders:
    """Both tokenizers and the bytes of their tokens.

    Where the file's merges come in the order of their ids, as in the usual vocabulary, the ids are ranks and tiktoken merges
    by them, which gives the same tokens in a quarter of the time; else the file's own library encodes."""

    def __init__(self, json_a: str, model_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken

        model, back = json.loads(json_a)["model"], byte_alphabet()
        vocabulary = {i: bytes(map(back.__getitem__, t)) for t, i in model["vocab"].items() if all(c in back for c in t)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranked = all(model["vocab"].get("".join(m)) == 256 + i for i, m in enumerate(merges))
        if ranked:
            ranks = {t: i for i, t in vocabulary.items() if i < 256 + len(merges)}
            self.encode_a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_str(json_a)
            own.encode_special_tokens = True  # the strings of special tokens are plain text
            self.encode_a = lambda t: own.encode(t, add_special_tokens=False).ids
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        spelt = {i: bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.bytes_a, self.bytes_b = table_of(vocabulary), table_of(spelt)
        self.length_a, self.length_b = (np.array([len(t) for t in table], dtype=np.int64) for table in (self.bytes_a, self.bytes_b))

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The tokens of all stretches, one after the other, and how many each has, of A and of B. For A, stretches that neither
        begin nor end with white space are encoded many in one text, as texts fall apart between them, and cut by the bytes of
        their tokens; others, and what these do not spell, go one by one."""
        ids, sizes = [], []
        plain = np.array([bool(p) and not p[0].isspace() and not p[-1].isspace() for p in parts], dtype=bool)
        edges = np.flatnonzero(np.diff(plain)) + 1
        for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(parts)]):
            for k in range(i, j, TEXT if j > i and plain[i] else 1):
                said = [" " + p for p in parts[k : min(j, k + TEXT) if plain[i] else k + 1]]
                tokens = np.array(self.encode_a("".join(said)), dtype=np.int32)
                ends = np.fromiter(map(len, map(str.encode, said)), dtype=np.int64, count=len(said)).cumsum()
                stops = self.length_a[tokens].cumsum()
                cuts = np.searchsorted(stops, ends)
                if len(said) > 1 and (not len(stops) or stops[-1] != ends[-1] or (stops[cuts] != ends).any()):
                    each = [self.encode_a(x) for x in said]
                    ids += [np.array(x, dtype=np.int32) for x in each]
                    sizes += map(len, each)
                else:
                    ids.append(tokens)
                    sizes += np.diff(cuts + 1, prepend=0).tolist() if len(said) > 1 else [len(tokens)]
        other = self.b.encode(parts, num_threads=1) if parts else []
        flat = lambda x: np.fromiter(chain.from_iterable(x), dtype=np.int32)
        return np.concatenate([np.zeros(0, dtype=np.int32), *ids]), np.array(sizes, dtype=np.int64), flat(other), np.fromiter(map(len, other), dtype=np.int64)

    def whole(self, parts: list[str], a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Which stretches both sides spell."""
        raw = [b" " + p.encode() for p in parts]
        ok = np.ones(len(parts), dtype=bool)
        for ids, sizes, spelt in ((a, n_a, self.bytes_a), (b, n_b, self.bytes_b)):
            if b"".join(spelt[ids]) != b"".join(raw) or not sizes.all():
                ends = sizes.cumsum()
                ok &= np.array([b"".join(spelt[ids[j - n : j]]) == r for r, j, n in zip(raw, ends.tolist(), sizes.tolist())], dtype=bool)
        return ok


def table_of(spelt: dict[int, bytes]) -> np.ndarray:
    out = np.full(max(spelt) + 1, b"", dtype=object)
    for i, t in spelt.items():
        out[i] = t
    return out


ALIGN = """
CREATE OR REPLACE TEMP TABLE cuts AS SELECT stop FROM ta SEMI JOIN tb USING (stop);
CREATE OR REPLACE TEMP TABLE a AS SELECT start, stop, id, (coalesce(sum(cut) OVER (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS g FROM (SELECT *, (stop IN (SELECT stop FROM cuts))::INT AS cut FROM ta);
CREATE OR REPLACE TEMP TABLE b AS SELECT start, stop, id, (coalesce(sum(cut) OVER (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS g FROM (SELECT *, (stop IN (SELECT stop FROM cuts))::INT AS cut FROM tb);
CREATE OR REPLACE TEMP TABLE cut_groups AS SELECT g, part, n_a, n_b FROM (SELECT g, min(start) AS start, count(*) AS n_a FROM a GROUP BY g) ga JOIN (SELECT g, count(*) AS n_b FROM b GROUP BY g) gb USING (g) ASOF JOIN parts p ON ga.start >= p.start;
CREATE OR REPLACE TEMP TABLE links AS SELECT part, a, b, sum(n)::BIGINT AS times FROM (SELECT g, a.id AS a, b.id AS b, a.n * b.n AS n FROM (SELECT g, id, count(*) AS n FROM a GROUP BY ALL) a JOIN (SELECT g, id, count(*) AS n FROM b GROUP BY ALL) b USING (g)) JOIN cut_groups USING (g) GROUP BY ALL"""
LINKED = "SELECT part, (a::BIGINT << 32) + b AS pair, times, 0::BIGINT AS bytes FROM links ORDER BY part"
#: With the bytes that both tokens of a pair cover: either the one begins within the other, or the other within it.
COVERED = """WITH overlaps_ AS (SELECT a.g, a.id AS a, b.id AS b, a.start AS start_a, a.stop AS stop_a, b.start AS start_b, b.stop AS stop_b FROM a ASOF JOIN b ON a.start >= b.start
  UNION ALL SELECT a.g, a.id, b.id, a.start, a.stop, b.start, b.stop FROM b ASOF JOIN a ON b.start >= a.start WHERE b.start > a.start),
covered AS (SELECT part, a, b, sum(least(stop_a, stop_b) - greatest(start_a, start_b))::BIGINT AS bytes FROM overlaps_ JOIN cut_groups USING (g) GROUP BY ALL)
SELECT part, (a::BIGINT << 32) + b AS pair, times, coalesce(bytes, 0) AS bytes FROM links LEFT JOIN covered USING (part, a, b) ORDER BY part"""


#: Each id with what may follow it.
DECIMAL = np.array([[f"{i}{mark}" for i in range(1 << 16)] for mark in ("", ",", "|", ";")], dtype=object)


class Aligned:
    """The alignment of distinct stretches: text and counts by stretch, and links (part, pair, times, bytes) by part. A pair is
    a's id times 2^32 plus b's; times counts the token pairs that share a group, bytes, if asked for, those bytes that both tokens
    cover."""

    def __init__(self, encoders: Encoders, parts: list[str], covered: bool):
        a, n_a, b, n_b = encoders.encode(parts)
        self.ok = encoders.whole(parts, a, n_a, b, n_b)
        good = np.flatnonzero(self.ok)
        con = duckdb.connect(config={"threads": 1})
        for name, ids, sizes, length in (("ta", a, n_a, encoders.length_a), ("tb", b, n_b, encoders.length_b)):
            tokens = ids[np.repeat(self.ok, sizes)]
            stop = length[tokens].cumsum()
            con.register(name, pa.table({"id": tokens, "start": stop - length[tokens], "stop": stop}))
        ends = np.cumsum([0, *(len(parts[i].encode()) + 1 for i in good)])
        con.register("parts", pa.table({"part": good, "start": ends[:-1]}))
        con.execute(ALIGN)
        n = len(parts)
        self.counts = {c: np.zeros(n, dtype=np.int64) for c in COUNTS}
        per = con.sql("SELECT part, sum(n_a)::BIGINT AS n_a, sum(n_b)::BIGINT AS n_b, count(*) AS n_groups, sum(n_a * n_b)::BIGINT AS n_links FROM cut_groups GROUP BY part").fetchnumpy()
        for c in COUNTS:
            self.counts[c][per["part"]] = per[c]
        self.text = self.written(con, n)
        links = con.sql(COVERED if covered else LINKED).fetchnumpy()
        self.part, self.pair, self.times, self.bytes = (np.asarray(links[c]).astype(np.int64) for c in ("part", "pair", "times", "bytes"))
        con.close()

    @staticmethod
    def written(con: duckdb.DuckDBPyConnection, n: int) -> list[str]:
        """Each stretch's groups as text: ids of one side joined by commas, sides by a bar, groups by semicolons."""
        t = con.sql("SELECT part, g, side, id FROM (SELECT g, 0 AS side, start, id FROM a UNION ALL SELECT g, 1, start, id FROM b) JOIN cut_groups USING (g) ORDER BY g, side, start").fetchnumpy()
        part, g, side, ids = (np.asarray(t[c]).astype(np.int64) for c in ("part", "g", "side", "id"))
        if not len(ids):
            return [""] * n
        after = np.zeros(len(ids), dtype=np.int64)  # 0 nothing, 1 comma, 2 bar, 3 semicolon
        same = part[1:] == part[:-1]
        after[:-1] = np.where(~same, 0, np.where(g[1:] != g[:-1], 3, np.where(side[1:] != side[:-1], 2, 1)))
        said = DECIMAL[after, ids].tolist()
        first = np.searchsorted(part, np.arange(n + 1)).tolist()
        return ["".join(said[i:j]) for i, j in zip(first, first[1:])]


def ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers from each start to before its stop."""
    n = stop - start
    return np.repeat(stop - n.cumsum(), n) + np.arange(n.sum())


def shrunk(numbers: np.ndarray) -> bytes:
    """Numbers under 2^32, mostly small: by planes of bytes, of which most are zero."""
    return zstandard.compress(np.asarray(numbers, dtype="<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def grown(numbers: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(numbers), dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def narrow(numbers: np.ndarray) -> np.ndarray:
    """Numbers in half the room if they fit."""
    return numbers.astype(np.int32) if numbers.max(initial=0) < 1 << 31 else numbers


#: Columns of the rows that are no documents. Links of some stretches, in order: how many each has, the place of each one's pair
#: among the batch's, and how often. A batch's pairs: in how many of its documents they are linked, how often, and the bytes that
#: both tokens cover.
LINKS = {"first_part": pa.int64(), "link_counts": pa.binary(), "link_place": pa.binary(), "link_times": pa.list_(pa.int64())}
PAIRS = {c: pa.list_(pa.int64()) for c in ("pair", "docs", "times", "bytes")}
KINDS = {pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}


class Batch:
    """The distinct stretches of a batch's documents so far, with what is known of each."""

    def __init__(self, encoders: Encoders, number: int, covered: bool = False):
        self.covered = covered
        self.encoders, self.number, self.places, self.pairs = encoders, number, {}, {}
        self.ok, self.text, self.counts = np.zeros(0, dtype=bool), [], np.zeros((len(COUNTS), 0), dtype=np.int64)
        self.part, self.place, self.times, self.bytes = (np.zeros(0, dtype=np.int32) for _ in range(4))
        self.occurs, self.docs = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def learn(self) -> Iterator[dict]:
        """Aligns the stretches that are new; the links of some of them at a time."""
        parts = list(self.places)[len(self.text) :]
        for i in range(0, len(parts), TOGETHER):
            first, new = len(self.text), Aligned(self.encoders, parts[i : i + TOGETHER], self.covered)
            pairs, at = np.unique(new.pair, return_inverse=True)
            place = np.array([self.pairs.setdefault(p, len(self.pairs)) for p in pairs.tolist()], dtype=np.int32)[at]
            self.ok, self.text, self.counts = np.concatenate([self.ok, new.ok]), self.text + new.text, np.concatenate([self.counts, np.stack([new.counts[c] for c in COUNTS])], axis=1)
            self.part, self.place = np.concatenate([self.part, (new.part + first).astype(np.int32)]), np.concatenate([self.place, place])
            self.times, self.bytes = np.concatenate([self.times, narrow(new.times)]), np.concatenate([self.bytes, narrow(new.bytes)])
            yield {"first_part": first, "link_counts": shrunk(np.bincount(new.part, minlength=len(new.text))), "link_place": shrunk(place), "link_times": new.times}

    def add(self, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        """A row per document, and those with the links of new stretches."""
        lists = listed(texts, self.places)
        own = list(self.learn())
        lists = [x if self.ok[x].all() else x[:0] for x in lists]
        self.occurs = np.concatenate([self.occurs, np.zeros(len(self.text) - len(self.occurs), dtype=np.int64)])
        self.docs = np.concatenate([self.docs, np.zeros(len(self.pairs) - len(self.docs), dtype=np.int64)])
        # distinct (document, stretch) and then (document, pair), all documents at once
        n = max(1, len(self.text))
        of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        held, times = np.unique(of * n + np.concatenate([np.zeros(0, dtype=np.int64), *lists]).astype(np.int64), return_counts=True)
        of, parts = held // n, held % n
        np.add.at(self.occurs, parts, times)
        first = np.searchsorted(self.part, np.arange(n + 1))
        size = first[parts + 1] - first[parts]
        m = max(1, len(self.pairs))
        pairs = np.unique(np.repeat(of, size) * m + self.place[ranges(first[parts], first[parts + 1])])
        self.docs += np.bincount(pairs % m, minlength=m)[: len(self.pairs)]
        text = self.text
        counts = [self.counts[:, x].sum(axis=1).tolist() for x in lists]
        columns = {"id": ids, **{c: [n[k] for n in counts] for k, c in enumerate(COUNTS)}, "parts": [shrunk(x) for x in lists]}
        columns["groups_sha256"] = [hashlib.sha256(";".join([text[p] for p in x.tolist()]).encode()).hexdigest() if len(x) else "" for x in lists]
        return self.rows(columns, own, ids.type)

    def close(self, kind: pa.DataType) -> pa.RecordBatch:
        """The row of the batch's pairs."""
        times, shared = np.zeros(len(self.pairs), dtype=np.int64), np.zeros(len(self.pairs), dtype=np.int64)
        np.add.at(times, self.place, self.times * self.occurs[self.part])
        np.add.at(shared, self.place, self.bytes * self.occurs[self.part])
        held = {c: x for c, x in (("pair", list(self.pairs)), ("docs", self.docs), ("times", times), ("bytes", shared))}
        return self.rows({"id": pa.nulls(0, kind)}, [held], kind)

    def rows(self, documents: dict, own: list[dict], kind: pa.DataType) -> pa.RecordBatch:
        d, n = len(documents["id"]), len(own)
        columns = {"batch": pa.array([self.number] * (d + n), pa.int64()), "id": pa.concat_arrays([documents["id"], pa.nulls(n, kind)])}
        for c, t in {**dict.fromkeys(COUNTS, pa.int64()), "groups_sha256": pa.string(), "parts": pa.binary()}.items():
            columns[c] = pa.array([*documents.get(c, []), *[None] * n], t)
        return pa.RecordBatch.from_pydict(columns | {c: pa.array([None] * d + [x.get(c) for x in own], t) for c, t in {**LINKS, **PAIRS}.items()})


def batches(docs: DataFrame, path: str, id_col: str, text_col: str, tokenizers: str, part_chars: int, most_stretches: int, covered: bool = False) -> DataFrame:
    """Writes the rows of all batches and reads them again. A batch is numbered by its partition and its place in it."""
    with open(os.path.join(tokenizers, FILE_A), encoding="utf-8") as f, open(os.path.join(tokenizers, FILE_B), "rb") as g:
        vocabularies = f.read(), g.read()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = to_arrow_type(rows.schema["id"].dataType)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders, number, batch = None, TaskContext.get().partitionId() << 32, None
        for ids, texts in in_parts(source, part_chars):
            encoders = encoders or Encoders(*vocabularies)
            batch = batch or Batch(encoders, number, covered)
            yield batch.add(ids.cast(kind), texts)
            if len(batch.places) >= most_stretches:
                yield batch.close(kind)
                batch, number = None, number + 1
        if batch:
            yield batch.close(kind)

    schema = f"batch long, id {rows.schema['id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, parts binary, " + ", ".join(f"{c} {KINDS[t]}" for c, t in {**LINKS, **PAIRS}.items())
    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def in_parts(source: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts, some rows at a time: a part ends with the text that brings it to so many characters."""
    for r in source:
        size, i = pc.utf8_length(r["text"].fill_null("")).to_numpy().astype(np.int64), 0
        while i < len(size):
            n = int(np.searchsorted(size[i:].cumsum(), chars)) + 1
            yield r["id"].slice(i, n), r["text"].slice(i, n)
            i += n


def exploded(rows: DataFrame) -> DataFrame:
    """batch, pair, docs, times, bytes: the pairs of each batch."""
    return rows.where("pair is not null").select("batch", F.explode(F.arrays_zip("pair", "docs", "times", "bytes")).alias("p")).select("batch", "p.*")


def corpus_counts(rows: DataFrame) -> DataFrame:
    """a, b, docs (how many documents hold the pair linked), times (links), bytes (that both tokens cover), best (docs are the
    most of a's pairs), as a table of its own."""
    path = scratch(rows.sparkSession, "pairs")
    exploded(rows).groupBy("pair").agg(*(F.sum(c).alias(c) for c in ("docs", "times", "bytes"))).withColumn("a", F.shiftright("pair", 32).cast("int")).write.parquet(path)
    counts = rows.sparkSession.read.parquet(path)
    # a row per id of A's vocabulary at most
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    return counts.join(F.broadcast(most), "a").select("a", b.alias("b"), "docs", "times", "bytes", (F.col("docs") == F.col("most")).alias("best"), "pair")


def translations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS, part_chars: int = PART_CHARS, most_stretches: int = MOST_STRETCHES) -> DataFrame:
    """The table from A's ids to B's: a, b, docs, times, bytes, best, as corpus_counts() says."""
    return corpus_counts(batches(docs, scratch(docs.sparkSession, "tokens"), id_col, text_col, tokenizers, part_chars, most_stretches, True)).drop("pair")


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS, part_chars: int = PART_CHARS, most_stretches: int = MOST_STRETCHES) -> DataFrame:
    """A row per document: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts that the tokens of a side do not spell (as those with U+2581), have no tokens: zeros and
    an empty groups_sha256. Repeated rows and null ids are documents each; other columns are not looked at; an empty table
    gives an empty result. Memory follows a batch's distinct stretches, and those of a very long text.
    """
    rows = batches(docs, scratch(docs.sparkSession, "tokens"), id_col, text_col, tokenizers, part_chars, most_stretches)
    own = exploded(rows).select("batch", "pair").join(corpus_counts(rows).select("pair", "docs", "best"), "pair").select(F.col("batch").alias("of"), "pair", "docs", "best")
    kind = rows.schema["id"].dataType
    arrow = to_arrow_type(kind)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        """The documents of a batch, with sums over what its stretches link."""
        documents, linked, paired = (left.filter(left[c].is_valid()) for c in ("parts", "first_part", "pair"))
        pair = paired["pair"].combine_chunks().flatten().to_numpy()
        docs_of, best_of = np.zeros(len(pair), dtype=np.int64), np.zeros(len(pair), dtype=np.int64)
        order = np.argsort(pair)
        at = order[np.searchsorted(pair[order], right["pair"].to_numpy())]
        docs_of[at], best_of[at] = right["docs"].to_numpy(), right["best"].to_numpy()
        lists = [grown(x.as_py()) for x in documents["parts"]]
        sizes = {first: grown(x.as_py()) for first, x in zip(linked["first_part"].to_pylist(), linked["link_counts"])}
        n = max([0, *(first + len(x) for first, x in sizes.items())])
        total, best = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for first, place, times in zip(linked["first_part"].to_pylist(), linked["link_place"], linked["link_times"]):
            part, place, times = first + np.repeat(np.arange(len(sizes[first])), sizes[first]), grown(place.as_py()), times.values.to_numpy()
            np.add.at(total, part, times * docs_of[place])
            np.add.at(best, part, times * best_of[place])
        out = {"id": documents["id"].cast(arrow)} | {c: documents[c] for c in COUNTS} | {"n_best": [int(best[x].sum()) for x in lists], "count_sum": [int(total[x].sum()) for x in lists], "groups_sha256": documents["groups_sha256"]}
        return pa.table(out, schema=pa.schema([("id", arrow), *((c, pa.int64()) for c in (*COUNTS, "n_best", "count_sum")), ("groups_sha256", pa.string())]))

    left = rows.select("batch", "id", *COUNTS, "groups_sha256", "parts", *LINKS, "pair")
    schema = f"id {kind.simpleString()}, " + ", ".join(f"{c} long" for c in (*COUNTS, "n_best", "count_sum")) + ", groups_sha256 string"
    return left.groupBy("batch").cogroup(own.groupBy("of")).applyInArrow(finish, schema).withColumnRenamed("id", id_col)
