"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations are bit operations.

The ledger has a row per document: the measurements and failure_bits, in which bit k is set if rule k fails. A policy
is a named version of a set of rules, so a change of policy reads only the ledger, never the texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millcheck.llm.common import WORD, cut, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_marks", "n_alpha_words", "n_bullet_lines", "n_cut_lines")
#: White space to Python that is none to a word of this library.
OTHER_SPACES = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
WORDS = re.compile(WORD)
SYMBOLS = "#*$%&|<>"

#: Rule k fails where its SQL condition on the measurements holds. New rules are appended, so bits keep their meaning.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("short_words", "word_chars < 3 * n_words"),
    ("long_words", "word_chars > 10 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 4 * n_lines"),
    ("upper_case", "10 * n_upper_words > 4 * n_words"),
    ("marks", "10 * n_marks > 3 * n_words"),
    ("no_letters", "10 * n_alpha_words < 7 * n_words"),
    ("bullets", "10 * n_bullet_lines > 9 * n_lines"),
    ("cut_lines", "10 * n_cut_lines > 3 * n_lines"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: Versioned policies: the rules that reject a document.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "web-1": ("few_words", "repeated_words", "short_words", "long_words", "symbols"),
    "web-2": ("few_words", "repeated_words", "short_words", "long_words", "symbols", "repeated_lines", "upper_case", "marks"),
    "web-3": tuple(name for name, _ in RULES),
}


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of one whole text; a null text measures as an empty one."""
    if not text:
        return (0,) * len(MEASURES)
    w = words(text)
    windows = list(zip(w, w[1:], w[2:]))
    n_repeat = 0
    if len(set(windows)) < len(windows):
        times, end = Counter(windows), 0
        for i, x in enumerate(windows):
            if times[x] > 1:
                n_repeat += i + 3 - max(i, end)
                end = i + 3
    seen, n_lines, n_dup, n_bullets, n_cut = set(), 0, 0, 0, 0
    for line in text.split("\n"):
        if inner := line.strip(" \t\r\x0b\x0c"):
            n_lines += 1
            n_dup += line in seen
            seen.add(line)
            n_bullets += inner.startswith(("-", "*", "\u2022"))
            n_cut += inner.endswith(("...", "\u2026"))
    spaces = sum(map(text.count, " \t\n\r\x0b\x0c"))
    plain = WORDS.findall(text) if OTHER_SPACES.search(text) else text.split()
    upper = sum(map(str.isupper, plain))
    alpha = sum(x.isalpha() or any(map(str.isalpha, x)) for x in plain)
    return len(w), len(text) - spaces, sum(map(text.count, SYMBOLS)), n_dup, n_repeat, n_lines, upper, text.count("!"), alpha, n_bullets, n_cut


@F.pandas_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def measured(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in texts:
        yield pd.DataFrame([measure(t) for t in part], columns=list(MEASURES), dtype="int64")


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def failure_bits(measures: str) -> Column:
    """All failures of the struct column of measurements, in one long."""
    bits = F.lit(0).cast("long")
    for name, condition in RULES:
        for m in MEASURES:
            condition = condition.replace(m, f"{measures}.{m}")
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id_col, the measurements, failure_bits.

    Null and empty texts measure zero everywhere, so they fail few_words alone. Null ids, repeated rows and texts of
    any length are measured like others; other columns of docs are not looked at. An empty table gives an empty ledger.
    """
    read = docs.select(F.col(id_col).alias("id"), measured(F.col(text_col)).alias("m"))
    return read.select(F.col("id").alias(id_col), "m.*", failure_bits("m").alias("failure_bits"))


def verdict(bits: Column, policy: str) -> Column:
    """True where no rule of the policy fails."""
    return bits.bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(led: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rule, n_failed, n_only (rejected by this rule alone, so kept if it were taken out).

    Adds up the distinct bit patterns first, of which there are at most two to the number of rules, whatever the input.
    """
    m = mask(policy)
    patterns = led.groupBy(F.col("failure_bits").bitwiseAND(F.lit(m).cast("long")).alias("bits")).count()
    rules = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).cast("long").alias("bit")) for n in POLICIES[policy]))
    each = patterns.select("bits", "count", F.explode(rules).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    only = F.col("bits") == F.col("r.bit")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0)).cast("long")
    return each.groupBy("r.rule").agg(total(hit).alias("n_failed"), total(only).alias("n_only"))


def judged(docs: DataFrame, base: str, policy: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger with base_failed and kept (the verdict of the policy), and for a document that one rule alone rejects
    the rule (only_rule) and how many others it alone rejects too (n_only): both null for other documents."""
    led = cut(ledger(docs, id_col, text_col))
    bits = F.col("failure_bits").bitwiseAND(F.lit(mask(policy)).cast("long"))
    only = F.create_map(*(x for name in POLICIES[policy] for x in (F.lit(BIT[name]).cast("long"), F.lit(name))))
    rows = led.select("*", (~verdict(F.col("failure_bits"), base)).alias("base_failed"), (bits == 0).alias("kept"), F.try_element_at(only, bits).alias("only_rule"))
    # a row per rule
    counts = F.broadcast(ablations(led, policy).select(F.col("rule").alias("only_rule"), "n_only"))
    return rows.join(counts, "only_rule", "left").select(*rows.columns, "n_only")


def keep(docs: DataFrame, policy: str = "web-3", text_col: str = "text") -> DataFrame:
    """The rows of docs that pass a policy, with all their columns as they are."""
    read = docs.select(F.struct("*").alias("row"), measured(F.col(text_col)).alias("m"))
    return read.where(verdict(failure_bits("m"), policy)).select("row.*")
