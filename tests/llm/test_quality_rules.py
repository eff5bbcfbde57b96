import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millcheck.llm import quality_rules as q


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    upper = sum(x == x.upper() and x != x.lower() for x in w)
    alpha = sum(any(c.isalpha() for c in x) for x in w)
    bullets = sum(bool(re.match(r"[\x20\x09-\x0D]*[-*\u2022]", x)) for x in lines)
    ends = sum(bool(re.search(r"(\.\.\.|\u2026)[\x20\x09-\x0D]*\Z", x)) for x in lines)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(lines), upper, t.count("!"), alpha, bullets, ends


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="ab \n\t\x0b\x0c\r\x1f  #|é", max_size=80)))
def test_measures(text):
    assert q.measure(text) == brute(text)


def test_ledger_edges(spark, make):
    rows = [(1, None), (2, ""), (3, "word " * 60), (3, "word " * 60), (None, " ".join(f"word{i}" for i in range(60)))]
    got = {(r.doc_id, r.n_words): r.failure_bits for r in q.ledger(make(rows)).collect()}
    assert got[1, 0] == got[2, 0] == q.BIT["few_words"] and got[None, 60] == 0 and got[3, 60] & q.BIT["repeated_words"]
    assert q.ledger(make(rows)).count() == 5 and q.ledger(make([])).count() == 0
    kept = q.keep(make(rows))
    assert kept.columns == make(rows).columns and [r.doc_id for r in kept.collect()] == [None]


def test_ablations(spark, make):
    led = q.ledger(make([(1, "a b"), (2, "## " * 60), (3, " ".join(f"w{i}" for i in range(60)))]))
    rows = led.collect()
    for policy, names in q.POLICIES.items():
        got = {r.rule: (r.n_failed, r.n_only) for r in q.ablations(led, policy).collect()}
        for n in names:
            bits = [r.failure_bits & q.mask(policy) for r in rows]
            assert got[n] == (sum(bool(b & q.BIT[n]) for b in bits), sum(b == q.BIT[n] for b in bits))


def test_judged(spark, make):
    rows = [(1, "a b"), (2, "## " * 60), (3, " ".join(f"word{i}" for i in range(60))), (4, "A\xa0A bb cc"), (5, None), (6, " ".join(f"{i}" for i in range(1000, 1060)))]
    got = {r.doc_id: r for r in q.judged(make(rows), "base-1", "web-3").collect()}
    assert got[3].kept and got[3].only_rule is None and got[3].n_only is None and got[4].n_upper_words == 1
    assert (got[6].only_rule, got[6].n_only) == ("no_letters", 1)
    for i, r in got.items():
        bits = r.failure_bits & q.mask("web-3")
        assert (r.only_rule is not None) == (bits.bit_count() == 1)
        assert r.n_only == (sum((x.failure_bits & q.mask("web-3")) == bits for x in got.values()) if r.only_rule else None)


def test_clean_labels_are_kept(spark):
    d = "/root/testdata/sf0.01"
    x = spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    led = q.ledger(x.select("doc_id", "text")).join(x.select("doc_id", "quality"), "doc_id")
    base, kept = q.verdict(F.col("failure_bits"), "base-1"), q.verdict(F.col("failure_bits"), "web-3")
    r = led.groupBy("quality").agg(F.avg(kept.cast("int")).alias("kept"), F.avg((base & ~kept).cast("int")).alias("beyond")).collect()
    by = {x.quality: x for x in r}
    assert by[1].beyond == 0 and by[0].kept < 0.05


@pytest.mark.parametrize("policy", list(q.POLICIES))
def test_policies_name_rules(policy):
    assert set(q.POLICIES[policy]) <= set(q.BIT)
