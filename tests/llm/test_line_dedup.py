import random

from hypothesis import given, settings
from hypothesis import strategies as st

from millcheck.llm import line_dedup as ld


def lines(text):
    return [x.strip(" \t\r\x0b\x0c") for x in (text or "").split("\n")]


def count(line):
    return line.count(" ") + 1 if line else 0


def brute(rows, least=5):
    """Each text against every earlier one, on plain lines: every common stretch of lines with enough words is gone, and
    blank lines between two that are."""
    first = {}
    for i, t in rows:
        first[t or ""] = min(i, first.get(t or "", i))
    order = sorted(first, key=lambda t: first[t])
    out = {}
    for n, t in enumerate(order):
        a, gone = lines(t), set()
        for b in map(lines, order[:n]):
            for x in range(len(a)):
                for y in range(len(b)):
                    k = 0
                    while x + k < len(a) and y + k < len(b) and a[x + k] == b[y + k]:
                        k += 1
                    if sum(map(count, a[x : x + k])) >= least:
                        gone |= {z for z in range(x, x + k) if a[z]}
        full = [i for i, x in enumerate(a) if x]
        for i, j in zip(full, full[1:]):
            if i in gone and j in gone:
                gone |= set(range(i, j))
        out[t] = sorted(gone)
    want = []
    for i, t in rows:
        t = t or ""
        whole = i != first[t] and sum(map(count, lines(t))) >= least
        want.append((i, list(range(len(lines(t)))) if whole else out[t]))
    return want


def sample(seed):
    r = random.Random(seed)
    pool = [" ".join(f"{a}{r.randrange(50)}" for a in "abcdefg"[: r.randrange(1, 7)]) for _ in range(60)]
    rows = [(i, "\n".join(r.choice(pool) if r.random() < 0.5 else f"unique line number {i} {k} here" for k in range(r.randrange(1, 15)))) for i in range(60)]
    return rows + [(100 + i, rows[i][1]) for i in range(5)] + [(200, None), (201, ""), (202, "\n \n"), (203, "a b c d e f\n\na b c d e f"), (204, rows[0][1] + "\n" + "new words that are not there")]


def test_matches_brute_force(spark, make):
    for seed in (1, 2):
        rows = sample(seed)
        got = sorted((r.doc_id, r.deleted) for r in ld.deletions(make(rows)).collect())
        assert got == sorted(brute(rows))


def test_blocks_of_short_lines_in_later_documents(make):
    block = "a b\n\nc d\ne f"
    rows = [(1, "a b\nfirst document has one line"), (2, "c d\nsecond document has another line"), (3, f"third document\n{block}"), (4, f"{block}\nfourth document, with the same block")]
    assert {r.doc_id: r.deleted for r in ld.deletions(make(rows)).collect()} == {1: [], 2: [], 3: [], 4: [0, 1, 2, 3]}


def test_apply(spark, make):
    rows = sample(3)
    docs = make(rows)
    got = {r.doc_id: r.text for r in ld.apply(docs).collect()}
    for i, gone in brute(rows):
        t = dict(rows)[i]
        left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        assert got.get(i) == (None if gone and not left.strip() else left)
    assert 200 in got and 201 in got and ld.apply(docs).columns == docs.columns


def test_null_and_repeated_ids(make):
    t = "one two three four five six\nseven eight nine ten eleven"
    got = sorted((str(r.doc_id), r.deleted) for r in ld.deletions(make([(None, t), (1, t), (1, t), (2, "x\n" + t)])).collect())
    assert got == [("1", []), ("1", []), ("2", [1, 2]), ("None", [0, 1])]
    assert ld.deletions(make([])).count() == 0 and ld.apply(make([])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.permutations(range(8)))
def test_patience_is_the_longest_rising_run(order):
    from itertools import combinations

    got = ld.patience(list(enumerate(order)))
    assert all(order[i] == j for i, j in got) and all(i < k and j < m for (i, j), (k, m) in zip(got, got[1:]))
    rising = lambda x: all(a < b for a, b in zip(x, x[1:]))
    assert len(got) == max(n for n in range(1, 9) if any(rising(x) for x in combinations(order, n)))


def test_blocks_in_any_order_and_number(make):
    """Documents of blocks from a pool, in any order, repeated, cut short and with blank lines between."""
    for seed in (1, 2, 3):
        r = random.Random(seed)
        pool = [[" ".join(f"{a}{r.randrange(200)}" for a in "abcdefg"[: r.randrange(1, 6)]) for _ in range(r.randrange(1, 5))] for _ in range(25)]
        rows = []
        for i in range(50):
            text = []
            for b in r.choices(pool, k=r.randrange(1, 8)):
                text += b[r.randrange(2) : len(b) - r.randrange(2)] + [""] * r.randrange(2) + [f"own {i}"] * r.randrange(2)
            rows.append((i, "\n".join(text)))
        assert sorted((x.doc_id, x.deleted) for x in ld.deletions(make(rows)).collect()) == sorted(brute(rows))


def test_moved_lines_are_told_apart(make):
    one, two, three = "one two three four five", "six seven eight nine ten", "eleven twelve thirteen fourteen fifteen"
    got = {r.doc_id: (r.deleted, r.n_links, r.n_moved) for r in ld.deletions(make([(1, f"{one}\n{two}\n{three}"), (2, f"{one}\nx\n{three}"), (3, f"{three}\ny\n{one}\n{two}")])).collect()}
    assert got == {1: ([], 0, 0), 2: ([0, 2], 1, 0), 3: ([0, 2, 3], 1, 1)}


def test_a_very_long_text(make):
    """A text of 20,000 lines that 2,000 earlier texts have a line of."""
    rows = [(i, f"line number {i} of a long text") for i in range(2000)] + [(5000, "\n".join(f"line number {i} of a long text" for i in range(20_000)))]
    got = {r.doc_id: r for r in ld.deletions(make(rows)).collect()}
    assert got[5000].deleted == list(range(2000)) and got[5000].n_links == 2000
    left = {r.doc_id: r.text for r in ld.apply(make(rows)).collect()}
    assert left[5000].count("\n") == 17_999
