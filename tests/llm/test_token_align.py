import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from millcheck.llm import token_align as ta

A = Tokenizer.from_file(f"{ta.TOKENIZERS}/{ta.FILE_A}")
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=f"{ta.TOKENIZERS}/{ta.FILE_B}")
BACK = ta.byte_alphabet()


def tokens(text):
    """(id, first byte, byte after the last) of both sides over the whole text at once, or nothing."""
    if not text:
        return [], []
    raw, sides = b" " + text.encode(), []
    for ids, spell in ((A.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(BACK[c] for c in A.id_to_token(i))), (B.encode(text), lambda i: bytes([int(B.id_to_piece(i)[3:-1], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode())):
        at, side = 0, []
        for i in ids:
            side.append((i, at, at + len(spell(i))))
            at = side[-1][2]
        if b"".join(map(spell, ids)) != raw:
            return [], []
        sides.append(side)
    return sides


def groups(text):
    a, b = tokens(text)
    ends = sorted({x[2] for x in a} & {x[2] for x in b})
    return [([x[0] for x in a if lo <= x[1] < hi], [x[0] for x in b if lo <= x[1] < hi]) for lo, hi in zip([0, *ends], ends)]


def brute(rows):
    found = [(i, groups(t)) for i, t in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in found]
    docs = Counter(p for c in links for p in c)
    most = {}
    for (x, _), n in docs.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (i, g), c in zip(found, links):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((str(i), sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), sum(n for p, n in c.items() if docs[p] == most[p[0]]), sum(n * docs[p] for p, n in c.items()), hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a   b c", "x\ny", "x \n y", "tab\there", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ lower block", "café naïve", "你好 世界", "\U0001f600 smile\U0001f600",
    "a" * 3000, "ab " * 500, "don't can't I'll", " nbsp  x", "é combining", "nul \x00 byte", "12345 67.89 3,000", "ﬁ ligature ①", "　 wide", "\r\n dos \r\n", "x y   z", "\x1c \x1c", "...   ...", "https://example.org/a?b=c&d=%20",
]


def test_stretches_are_encoded_like_whole_texts():
    r = random.Random(5)
    pieces = [*" \n\t  \x0b\x1f\u0085", "  ", "a", "bc", "The", "'s", "12", "é", "你", "!", "-", " ", "\U0001f600"]
    texts = [t for t in ODD if t] + ["".join(r.choice(pieces) for _ in range(r.randrange(1, 40))) for _ in range(3000)]
    lists = ta.listed(pa.array(texts), places := {})
    known = list(places)
    for t, codes in zip(texts, lists):
        parts = [known[c] for c in codes]
        assert parts == ta.stretches(t)
        assert " " + t == "".join(" " + p for p in parts)
        assert [i for p in parts for i in A.encode(" " + p, add_special_tokens=False).ids] == A.encode(" " + t, add_special_tokens=False).ids
        if "▁" not in t:
            assert [i for p in parts for i in B.encode(p)] == B.encode(t), t


@pytest.mark.parametrize(("chars", "most"), [(10, 1), (500, 60), (10**9, 10**9)])
def test_as_brute_force(spark, make, chars, most):
    """Whatever the batches."""
    r = random.Random(1)
    say = ["tokenization", "of", "the", "whole", "Text,", "café", "你好", "x1y2", "unbelievably", "naïveté", "(a|b)", "zzzzzz"]
    rows = [(i, " ".join(r.choice(say) + r.choice(["", "", "s", "\n", "-1"]) for _ in range(r.randrange(1, 60)))) for i in range(40)]
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [(3, rows[3][1]), (None, "null id"), (None, None)]
    assert got(ta.align(make(rows).repartition(3), part_chars=chars, most_stretches=most)) == brute(rows)


def test_test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(ta.align(docs)) == brute(rows)


def test_translations(spark, make):
    rows = [(1, "unbelievably naive"), (2, "unbelievably so"), (3, None), (4, "so so")]
    want, times = Counter(), Counter()
    for _, t in rows:
        c = Counter((x, y) for a, b in groups(t) for x in a for y in b)
        want.update(c.keys())
        times.update(c)
    found = ta.translations(make(rows)).collect()
    assert {(r.a, r.b): r.docs for r in found} == want and {(r.a, r.b): r.times for r in found} == times
    shared = Counter()
    for _, t in rows:
        a, b = tokens(t)
        for x in a:
            for y in b:
                if (n := min(x[2], y[2]) - max(x[1], y[1])) > 0:
                    shared[x[0], y[0]] += n
    assert {(r.a, r.b): r.bytes for r in found if r.bytes} == shared
    best = {r.a for r in found if r.best}
    assert best == {r.a for r in found}


def test_edges(spark, make):
    assert ta.align(make([])).count() == 0 and ta.translations(make([])).count() == 0
    assert [(r.n_a, r.n_links, r.groups_sha256) for r in ta.align(make([(1, None), (2, ""), (3, "▁")])).collect()] == [(0, 0, "")] * 3
    long = ta.align(make([(1, "word " * 200_000), (2, "z" * 100_000)])).collect()
    assert {r.doc_id for r in long} == {1, 2} and all(r.n_a > 0 and r.n_links > 0 for r in long)
