import random
import re

import xxhash

from millcheck.llm import simhash
from millcheck.llm.common import components
from tests.llm.conftest import words


def fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def component_of(fps, ids):
    n = len(fps)
    comp = list(range(n))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                comp[root(i)] = root(j)
    least = {}
    for i in range(n):
        if ids[i] is not None:
            least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [least.get(root(i)) for i in range(n)]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_near_duplicates_match_brute_force(spark, make):
    rows = [(0, None), (1, ""), (2, "one two"), (3, "ONE two"), (3, "ONE two"), (None, "one two"), (4, "É x"), (5, "é x")]
    for g in range(12):
        base = words(g, 400)
        for k in range(6):
            w = list(base)
            for e in range(k):
                w[e * 7] = f"new{k}"
            rows.append((100 + 10 * g + k, " ".join(w)))
    rows.append((999, " ".join(words(99, 30_000))))
    got = simhash.near_duplicates(make(rows)).collect()
    fps = [fingerprint(t) for _, t in rows]
    want = component_of(fps, [i for i, _ in rows])
    assert sorted((str(r.doc_id), r.fp, str(r.component_id)) for r in got) == sorted((str(i), signed(f), str(c)) for (i, _), f, c in zip(rows, fps, want))
    kept = simhash.keep_one(make(rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want)) and kept[0].key == "key"


def test_empty(make):
    assert simhash.near_duplicates(make([])).count() == 0 and simhash.keep_one(make([])).count() == 0


def test_crowded_buckets_lose_no_link(spark):
    r = random.Random(1)
    fps = set()
    for _ in range(3):  # dense clusters, chains within them
        x = r.getrandbits(64)
        for _ in range(250):
            x ^= 1 << r.randrange(64)
            fps.add(x)
            y = x
            for _ in range(r.randrange(3)):
                y ^= 1 << r.randrange(40, 64)
            fps.add(y)
    base = r.getrandbits(64)
    fps |= {base ^ r.getrandbits(12) for _ in range(600)} | {r.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    assert len(fps) > 10 * simhash.BUCKET
    links = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()
    assert all(((a.a ^ a.b) & (1 << 64) - 1).bit_count() <= 3 for a in links)
    comp = {r.node: r.component for r in components(spark.createDataFrame([(x.a, x.b) for x in links], "a long, b long")).collect()}
    want = component_of(fps, list(range(len(fps))))
    first = {}
    for f, c in zip(fps, want):
        assert first.setdefault(c, comp.get(signed(f), signed(f))) == comp.get(signed(f), signed(f))
    assert len(set(first.values())) == len(first)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(201, 260)] + [(5, 5), (300, 301), (301, 300), (300, 301)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 200 for i in range(200, 260)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0
