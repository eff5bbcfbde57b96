import random
import re

import corpus_pipeline
from millcheck.llm import quality_rules
from tests.llm.conftest import words
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_line_dedup import brute as repeated
from tests.llm.test_simhash import component_of, fingerprint


def fixture():
    r = random.Random(7)
    items = [(i, " ".join(words(900 + i, 30, 3000))) for i in range(5)]
    rows = []
    for d in range(60):
        w = words(d, r.randrange(60, 300), 3000)
        w = [f"word{x}" for x in w]
        t = "\n".join(" ".join(w[k : k + 12]) for k in range(0, len(w), 12))
        rows.append([d, t])
    common = "this line of words is found in many of the documents"
    for d in range(0, 60, 3):
        rows[d][1] += "\n" + common
    for d in range(5):
        rows.append([100 + d, rows[d][1]])
        rows.append([110 + d, rows[10 + d][1].replace("\n", " ")])
    rows[20][1] += "\n" + items[2][1]
    rows += [[200, None], [201, "short"], [202, "## " * 80], [203, "JUNK!! " * 80]]
    return items, [(d, t, f"s{d % 4}") for d, t in rows]


def test_stages_match_brute_force(spark, make, tmp_path):
    items, rows = fixture()
    d = str(tmp_path / "sf")
    make(rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    want = {i: t for i, t, _ in rows}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        got = {r.doc_id: r for r in out.collect()}
        if name == "quality rules":
            bits = {i: quality_rules.measure(t) for i, t in want.items()}
            names = quality_rules.MEASURES
            bad = lambda m: any(eval(c.replace("AND", "and"), {}, dict(zip(names, m))) for _, c in quality_rules.RULES)  # noqa: E731, S307
            want = {i: t for i, t in want.items() if not bad(bits[i])}
        elif name == "line dedup":
            gone = dict(repeated(list(want.items())))
            want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in want.items()}
            want = {i: t for i, t in want.items() if t.strip()}
            assert all(r.n_chars == len(r.text) for r in got.values())
        elif name == "near duplicates":
            ids = sorted(want)
            want = {i: want[i] for i in set(component_of([fingerprint(want[i]) for i in ids], ids))}
        elif name == "decontamination":
            hit = {i for i, _ in leaks(items, list(want.items()))}
            assert 20 in hit
            want = {i: t for i, t in want.items() if i not in hit}
        else:
            assert {i: r.size for i, r in got.items()} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in want.items()}
            assert sum(r.taken for r in got.values()) > 0.9 * sum({r.source: r.target for r in got.values()}.values())
            break
        assert out.columns == columns and {i: r.text for i, r in got.items()} == want, name
        docs = out
    run = corpus_pipeline.run(spark, d).collect()
    assert {(r.doc_id, r.taken) for r in run} == {(i, r.taken) for i, r in got.items()}


def test_empty(spark, make, tmp_path):
    d = str(tmp_path / "sf")
    make([]).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
