import random
from fractions import Fraction

import pytest

from millcheck.llm import mixing


def targets(sizes, share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s else b""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    t, total, free = {}, Fraction(share) * sum(sizes.values()), set(names)
    while free:
        left = total - sum(t.values())
        over = {s for s in free if left * w[s] / sum(w[x] for x in free) > cap * sizes[s]}
        if not over:
            return t | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        t |= {s: Fraction(cap * sizes[s]) for s in over}
        free -= over
    return t


def seats(votes, n):
    got = {k: 0 for k in votes}
    for _ in range(n):
        k = max(sorted(votes), key=lambda k: Fraction(votes[k]) / (2 * got[k] + 1))
        got[k] += 1
    return got


@pytest.mark.parametrize("seed", range(4))
def test_apportionment_by_highest_quotients(spark, seed):
    r = random.Random(seed)
    votes = {i: r.choice([0, 1, 5, r.randrange(1, 5000)]) for i in range(r.randrange(1, 30))}
    n = r.randrange(0, 300) if any(votes.values()) else 0
    df = spark.createDataFrame([(k, float(v), n) for k, v in votes.items()], "tie int, v double, n long")
    got = {x.tie: x.quota for x in mixing.apportion(df, [], "n").collect()}
    assert got == seats(votes, n)


def test_mix(spark, make):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.choice([1, 30, 400])), f"s{i % 7}" if i % 11 else "hot") for i in range(400)] + [(1000, None, None), (1001, "", "s1"), (1002, "a b c", None), (None, "x y", "s2"), (5, "dup", "s2"), (5, "dup", "s2"), (2000, "big " * 5000, "hot")]
    docs = make(rows)
    got = mixing.mix(docs, block=16, shard=500).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for x in got:
        sizes[x.source] = sizes.get(x.source, 0) + x.size
        taken[x.source] = taken.get(x.source, 0) + x.taken
        target[x.source] = x.target
        assert 0 <= x.taken <= 2 * x.size
    want = targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(float(want[s])) and abs(taken[s] - target[s]) <= 16 * (2 + sizes[s] / 500)
    again = mixing.mix(docs.repartition(7), block=16, shard=500).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(make([])).count() == 0


def test_small_sources_come_near_their_targets(make):
    """Sources of 1 to 63 words beside larger ones, and each alone."""
    r = random.Random(6)
    rows = [(1000 * n + k, " ".join(["w"] * size), f"s{n:02}") for n in range(1, 64) for k, size in enumerate([n // 2, n - n // 2]) if size]
    rows += [(10**6 + i, "word " * r.randrange(50, 400), "zz") for i in range(200)]
    for case in (rows, *([x for x in rows if x[2] in keep] for keep in (("s30",), ("s20", "s40"), ("s01", "zz")))):
        got = {}
        for x in mixing.mix(make(case)).collect():
            assert 0 <= x.taken <= 2 * x.size
            got.setdefault(x.source, [x.target, 0])[1] += x.taken
        for s, (target, taken) in got.items():
            assert abs(taken - target) <= max(1.5, 0.1 * target), (s, target, taken)


def test_equal_rows_null_ids_and_empty_sources(make):
    rows = [(None, f"{i} b c", "s") for i in range(50)] + [(None, "x y z", "s")] * 40 + [(7, "x y z w", "s")] * 40 + [(i, None, "none") for i in range(30)] + [(1, "", "none")] * 5
    got = mixing.mix(make(rows), shard=50).collect()
    assert len(got) == len(rows) and all(0 <= x.taken <= 2 * x.size for x in got) and all(x.target == 0 == x.taken for x in got if x.source == "none")
    want = {x.source: x.target for x in got}["s"]
    assert abs(sum(x.taken for x in got) - want) <= 0.1 * want


def test_no_python_in_the_plan(spark, make):
    plan = mixing.mix(make([(1, "a", "s")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
