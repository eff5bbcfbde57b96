import math
import zlib
from collections import Counter

import numpy as np
import pytest

from millcheck.llm import bloom_lm as lm
from tests.llm.conftest import words


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def brute(rows, order):
    """(id, n_tokens, n_known, base score, score by exact counts turned to levels and back)."""
    learnt = [tokens(t) for i, t in rows if not held(i)]
    c = Counter(g for x in learnt for n in range(1, order + 1) for g in grams(x, n))
    n, v = sum(map(len, learnt)), len({w for x in learnt for w in x})
    about = lambda g: 0.0 if g not in c else c[g] if len(g) == 1 else float(lm.COUNT[lm.level(np.array([c[g]]))[0]])
    out = []
    for i, t in rows:
        x, total = tokens(t), 0.0
        for k, w in enumerate(x):
            p, got, history_of = (about((w,)) + 1) / (n + v + 1), about((w,)), None
            for m in range(2, order + 1):
                if k < m - 2:
                    break
                g = ([None] + x)[k + 2 - m : k + 2]
                history = len(learnt) if m == 2 and k == 0 else capped(g[:-1], about, len(learnt))
                got = min(about(tuple(g)), history) if got else 0.0
                p = (got + lm.MU * p) / (history + lm.MU)
            total += math.log10(p)
        known = sum(c[(w,)] > 0 for w in x)
        out.append((str(i), held(i), len(x), known, n, sum(math.log10((c[(w,)] + 1) / (n + v + 1)) for w in x), total))
    return sorted(out)


def capped(g, about, texts):
    """The estimate of a history: not above those of its own histories, and none where its end has none."""
    got = about(tuple(g[:1])) if g[0] is not None else texts
    ends = about((g[-1],))
    for m in range(2, len(g) + 1):
        got = min(about(tuple(g[:m])), got) if about(tuple(g[1:m])) else 0.0
    return got if ends or g[-1] is None else 0.0


def grams(x, n):
    """Of n tokens; a mark before the first counts as one from two on."""
    x = x if n == 1 else [None, *x]
    return [tuple(x[i : i + n]) for i in range(len(x) - n + 1)]


def got(df):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect())


def close(a, b, share=1.0):
    assert [x[:5] for x in a] == [x[:5] for x in b] and np.allclose([x[5] for x in a], [x[5] for x in b], rtol=1e-9)
    d = np.abs(np.array([x[6] for x in a]) - np.array([x[6] for x in b])) / np.array([x[2] for x in a])
    assert (d < 1e-9).mean() >= share and d.max() < 0.2


ROWS = [(i, " ".join(words(i % 50, 60, 90))) for i in range(120)] + [(200, None), (201, ""), (202, " \t\n"), (203, "ONE two"), (3, "again w1"), (None, "w1 w2 W3"), (None, None), (204, "É é x y"), (205, "zz " * 5000)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_as_brute_force(spark, make, order):
    """With bits to spare there are no false positives, and scores are those of exact counts."""
    close(got(lm.score(make(ROWS), order=order, bits_per_entry=300)), brute(ROWS, order), 0.99)


def test_filter_errs_little(spark, make):
    close(got(lm.score(make(ROWS))), brute(ROWS, 2), 0.2)


def test_slices_groups_and_batches_do_not_matter(spark, make):
    whole = got(lm.score(make(ROWS), order=2, slice_bytes=4000))
    parts = got(lm.score(make(ROWS).repartition(3), order=2, slice_bytes=4000, pass_bytes=3000, batch_chars=2000))
    assert len(whole) == len(parts) == len(ROWS) and [x[:5] for x in whole] == [x[:5] for x in parts]
    assert np.allclose([x[5:] for x in whole], [x[5:] for x in parts], rtol=1e-9)
    assert len(lm.groups_of([(i, 1000) for i in range(9)], 3000)) == 3 and lm.groups_of([], 5) == [[]] and lm.groups_of([(0, 9), (1, 9)], 5) == [[0], [1]]


def test_filter_levels():
    r = np.random.default_rng(1)
    keys = r.integers(0, 1 << 63, 60_000, dtype=np.uint64) * np.uint64(2)
    counts = np.minimum(r.zipf(1.5, 60_000), 10**5)
    of = lm.slice_of(np.sort(keys), 7)
    assert (np.diff(of) >= 0).all() and of.max() == 6
    at = lm.slice_of(keys, 7)
    bloom = lm.Filter(7, [(s, lm.built(keys[at == s], counts[at == s])) for s in range(7)])
    found = bloom.levels(keys)
    again = [lm.unpacked(*lm.packed(keys[at == s], counts[at == s])) for s in range(7)]
    assert [lm.built(*x) for x in again] == [lm.built(keys[at == s], counts[at == s]) for s in range(7)]
    assert (lm.grown(lm.shrunk(np.arange(0, 99_999, 7))) == np.arange(0, 99_999, 7)).all() and len(lm.grown(lm.shrunk(np.zeros(0, dtype=np.int32)))) == 0
    assert (found >= lm.level(counts)).all() and (found == lm.level(counts)).mean() > 0.97
    assert (bloom.levels(r.integers(0, 1 << 63, 60_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) > 0).mean() < 0.03
    some = lm.Filter(7, [(s, lm.built(keys[at == s], counts[at == s])) for s in (2, 3)])
    assert (some.levels(keys) == np.where((at == 2) | (at == 3), found, 0)).all()


def test_levels_stand_for_counts():
    c = np.arange(1, 5000)
    about = lm.COUNT[lm.level(c)]
    assert (about[:3] == [1, 2, 3]).all() and (np.abs(about / c - 1) < 0.26).all()


def test_probabilities_add_up(spark, make):
    """Over all continuations of a history, but for the width of the levels."""
    seen = [(i, " ".join(words(i, 300, 12))) for i in range(20)]
    vocabulary = [f"w{i}" for i in range(12)]
    asked = [(1000 + i, f"w3 {w}") for i, w in enumerate(vocabulary)]
    apart = [i for i in range(1000, 10_000) if held(i)]
    docs = [(i, t) for i, t in seen if not held(i)] + [(i, t) for i, (_, t) in zip(apart, asked)]
    by = {r.doc_id: r.score for r in lm.score(make(docs)).collect()}
    total = probability(docs, "w3", "")
    for i, w in zip(apart, vocabulary):
        total += 10 ** (by[i] - math.log10(probability(docs, None, "w3")) - math.log10(probability(docs, w, "")))
    assert abs(total - 1) < 0.25


def probability(docs, h, w):
    learnt = [tokens(t) for i, t in docs if not held(i)]
    c = Counter(g for x in learnt for n in (1, 2) for g in grams(x, n))
    about = lambda g: 0.0 if g not in c else c[g] if len(g) == 1 else float(lm.COUNT[lm.level(np.array([c[g]]))[0]])
    n, v = sum(map(len, learnt)), len({x for y in learnt for x in y})
    p = (about((w.encode(),)) + 1) / (n + v + 1)
    history = len(learnt) if h is None else about((h.encode(),))
    return (min(about((None if h is None else h.encode(), w.encode())), history) + lm.MU * p) / (history + lm.MU)


def test_held_out_text_is_better_explained(spark):
    rows = [r for r in lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out]
    assert len(rows) > 100 and sum(r.score for r in rows) > sum(r.base_score for r in rows) and np.mean([r.score > r.base_score for r in rows]) > 0.8


def test_edges(spark, make):
    assert lm.score(make([])).count() == 0
    only = next(i for i in range(100) if held(i))
    r = lm.score(make([(only, "a b")])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)
