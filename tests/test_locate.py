"""Tokens that show fields: by grams as by comparing all, and without the product of both."""

import random

import pytest

from millcheck.operators import lookup

FIELDS = "doc_id int, field_id int, text string, page int"
TOKENS = "doc_id int, at int, str string, page int, x double, y double, w double, h double"


def brute(fields, tokens):
    out = {}
    for d, i, text, page in fields:
        text = (text or "").strip(" ")
        best = None
        for td, at, s, tpage, *_ in tokens if text else []:
            if td != d or s is None:
                continue
            same, part = s.strip(" ") == text, len(s) >= 2 and (s in text or text in s)
            if same or part:
                here = page is not None and tpage == page
                k = (1 if same and here else 2 if part and here else 3 if same else 4, at)
                best = min(best or (9, 9), k)
        if best:
            out[d, i] = best[1]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_as_comparing_all(spark, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé ") for _ in range(r.randrange(0, 5 + seed)))
    # documents with few fields, many, and one without tokens
    fields = [(d, i, r.choice([word(), word(), word() + word(), None]), r.choice([1, 2, None])) for d, n in ((1, 3), (2, 16), (3, 17), (4, 60), (5, 2)) for i in range(n)]
    tokens = [(d, at, r.choice([word(), word(), word() * 2, None]), r.choice([1, 2]), 1.0, 1.0, 1.0, 1.0) for d in (1, 2, 3, 4) for at in range(70)]
    got = lookup.locate(spark.createDataFrame(fields, FIELDS), spark.createDataFrame(tokens, TOKENS)).collect()
    assert {(x.doc_id, x.field_id): x["at"] for x in got} == brute(fields, tokens) and len(got) > 20


def test_candidates_follow_the_matches(spark):
    """A document of 60,000 tokens and 3,000 fields: 180 million pairs, of which grams look at a few for each token."""
    n, m = 60_000, 3_000
    t = spark.range(n).selectExpr("1 as doc_id", "cast(id as int) as at", "concat('tok', id) as str", "1 as page", "1.0D as x", "1.0D as y", "1.0D as w", "1.0D as h")
    f = spark.range(m).selectExpr("1 as doc_id", "cast(id as int) as field_id", "concat('tok', id * 20 + 7) as text", "1 as page")
    found = lookup.locate(f, t).collect()
    assert len(found) == m and all(r["at"] == r.field_id * 20 + 7 for r in found)
    strs, texts = t.select("doc_id", t["str"].alias("l")), f.select("doc_id", f["text"].alias("s"))
    both = lookup.contained(texts, strs)
    assert both.count() >= m
    looked_at = max(int(x) for x in candidates(both))
    assert looked_at < 60 * n


def candidates(df):
    """Rows out of the joins of a plan that has run."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        name = p.nodeName()
        if "AdaptiveSparkPlan" in name:
            return walk(p.executedPlan())
        if "QueryStage" in name:
            return walk(p.plan())
        if "Join" in name and p.metrics().contains("numOutputRows"):
            out.append(p.metrics().apply("numOutputRows").value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(plan)
    return out
