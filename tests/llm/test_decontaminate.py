import random

from pyspark.sql import functions as F

from millcheck.llm import decontaminate as dc
from tests.llm.conftest import words


def brute(items, docs, similarity=0.8):
    v = dc.Vocabulary()
    out = set()
    for d, text in docs:
        t = dc.tokens(text, v).tolist()
        for i, item in items:
            p = dc.tokens(item, v).tolist()
            if p and distance(p, t) <= int((1 - similarity) * len(p) + 1e-9):
                out.add((d, i))
    return out


def distance(p, t):
    """Least edit distance of p to a stretch of t, by the plain table."""
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def edited(r, w, k):
    w = list(w)
    for _ in range(k):
        at = r.randrange(len(w))
        r.choice([lambda: w.__setitem__(at, "edit"), lambda: w.insert(at, "more"), lambda: w.pop(at)])()
    return w


def fixture():
    r = random.Random(5)
    items = [(i, " ".join(words(i, r.randrange(10, 60), 300))) for i in range(25)] + [(90, None), (91, "... !!"), (92, "short item"), (93, "")]
    docs = []
    for d in range(120):
        body = words(1000 + d, r.randrange(20, 300), 300)
        if d % 2 == 0:
            item = items[r.randrange(25)][1].split()
            body[r.randrange(len(body)) :][:0] = edited(r, item, int(r.random() * 0.24 * len(item)))
            at = r.randrange(len(body))
            body = body[:at] + edited(r, item, int(r.random() * 0.24 * len(item))) + body[at:]
        docs.append((d, " ".join(body)))
    docs += [(200, None), (201, ""), (202, items[0][1].upper().replace(" ", ",  ")), (203, "a Short item!")]
    return items, docs


def test_recall_against_brute_force(spark, make):
    items, docs = fixture()
    want = brute(items, docs)
    bench = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, id string")
    rows = dc.contaminations(make(docs), bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert got <= want and len(got) >= 0.97 * len(want) and (202, 0) in got and (203, 92) in got
    kept = dc.clean(make(docs), bench)
    assert kept.columns == make(docs).columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_bit_parallel_distance():
    r = random.Random(2)
    for _ in range(200):
        p, t = [r.randrange(4) for _ in range(r.randrange(1, 12))], [r.randrange(4) for _ in range(r.randrange(0, 20))]
        assert dc.best_end(p, t)[0] == distance(p, t)


def test_blocks_and_empty(spark, make):
    items, docs = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = {tuple(r) for r in dc.contaminations(make(docs[:40]), bench).collect()}
    dc_rows, size = set(), dc.BLOCK_ITEMS
    for block in dc.blocks(bench, "item_id", "text", 0.8, 7):
        dc_rows |= {(r[0], m.item_id, m.start, m.n_words, m.distance) for r in make(docs[:40]).select("doc_id", dc.matches(block, F.col("text")).alias("m")).collect() for m in r.m}
    assert dc_rows == one and size == dc.BLOCK_ITEMS
    assert dc.contaminations(make([]), bench).count() == 0 and dc.contaminations(make(docs[:3]), bench.limit(0)).count() == 0


def test_lsh_finds_and_selects():
    """Of windows at the least similarity nearly all are found, of unrelated ones nearly none."""
    import numpy as np

    r, v = random.Random(8), dc.Vocabulary()
    found = passed = n_unrelated = 0
    for k in range(100):
        n = r.choice([5, 10, 20, 50, 100])
        w = words(k, n, 5000)
        item = dc.tokens(" ".join(w), v)
        t = dc.tokens(" ".join(words(500 + k, n + 30, 5000) + edited(r, w, int(0.2 * n)) + words(900 + k, n + 30, 5000)), v)
        e = n // 5
        found += bool(dc.close(t, np.arange(n + 30 - e, n + 31 + e), item).any())
        passed += int(dc.close(t, np.arange(20), item).sum())
        n_unrelated += 20
    assert found >= 98 and passed <= 0.02 * n_unrelated, (found, passed)


def test_many_items_with_textual_ids(spark, make):
    items = [(f"item-{i}", " ".join(words(50_000 + i, 12, 3000))) for i in range(20_000)]
    r = random.Random(9)
    docs, want = [], set()
    for d in range(200):
        i = r.randrange(20_000)
        docs.append((d, " ".join(words(d, 40, 3000) + edited(r, items[i][1].split(), r.randrange(3)) + words(1000 + d, 40, 3000))))
        want.add((d, f"item-{i}"))
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = dc.contaminations(make(docs), bench)
    assert dict(rows.dtypes)["item_id"] == "string"
    assert len(want & {(x.doc_id, x.item_id) for x in rows.collect()}) >= 0.98 * len(want)
