"""Secret scan: wide candidate patterns, then a random forest that removes false positives.

The forest learns from labelled findings: length, character transitions, dictionary coverage, words of the path and
neighbouring words. findings.tsv has some written by hand, in four languages; synthetic makes more by rule. Findings
name where a secret is and a digest of it, never the secret.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}={0,2}")
DIGIT = re.compile(r"[0-9]")
PREFIX = re.compile(r"(AKIA|ASIA|ghp_|gho_|xox[abp]-|sk_live_|sk-|eyJ|AIza|glpat-)")
#: A name with a secret word that something is assigned to, and the value: quoted, or up to a space or a mark that ends one.
ASSIGNS = re.compile(r"(?:passw|pwd|secret|token|api_?key|access|auth|bearer|credential|private|key|aws|login)[A-Za-z0-9_-]{0,40}[\"']?\s{0,4}[:=]\s{0,4}", re.I)
QUOTED = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'")
BARE = re.compile(r"[^\s\"'`,;&<>)\]}]*")
LEAST = 4
#: A private key with what encloses it, up to its end or, without one, the last line that can be of it.
KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(?:(?:(?!-----)[\s\S])*?-----END (?:[A-Z]+ )?PRIVATE KEY-----|(?:\s*[A-Za-z0-9+/=]{16,})*)")
NEAR = 40
TREES, DEPTH = 40, 8
#: Labelled findings made by synthetic(): bounds what the forest is fitted on.
LABELLED = 4000
#: How often a finding written by hand counts.
WRITTEN = 5

# Words of ordinary text and code, words by secrets, words by what only looks like one, and words of paths.
DICTIONARY = (
    "the and for that with this from have not are was but all can had her one our out day get has him his how man new now old see two way who did its let put say she too use "
    "about after again also back because before between both call come could each even find first give good great hand here high home into just know last leave life like line little long look made make many may more most move much must name need never next number only open other over own part people place point right same school seem should show small some state still such take tell than their them then there these they thing think time turn under very want water well went were what when where which while will word work world would write year "
    "der die und das ist nicht von mit auf ein eine sich dem den des auch als aus bei nach wie oder aber wenn nur noch wird sind haben kann mehr zum zur ueber unter passwort benutzer datei seite server jahr zeit "
    "les des est une que qui dans pour pas sur avec son par mais ses cette tout plus fait sont aux bien sans peut nous vous leur mot passe clef page serveur utilisateur fichier temps annee "
    "los las una por con para del que como mas pero sus esta este entre cuando muy sin sobre tambien hasta hay donde quien desde todo clave usuario archivo pagina servidor tiempo texto "
    "data file user test example value index page image version release update build config default service server client code function class method object string number array list table column error message request response report document article content title link http https www com org net html json"
).split()
SECRET_WORDS = ("password", "passwort", "kennwort", "mot de passe", "clave", "contrasena", "passwd", "pwd", "secret", "token", "apikey", "api_key", "access", "auth", "bearer", "credential", "private", "key", "aws", "login")
HARMLESS_WORDS = ("commit", "sha", "md5", "hash", "checksum", "uuid", "guid", "id", "version", "phone", "tel", "call", "card", "isbn", "order", "serial", "example", "sample", "placeholder", "http", "https", "www", "file", "image", "build", "date")
PATH_WORDS = ("test", "tests", "example", "examples", "sample", "spec", "fixture", "mock", "doc", "docs", "readme")

WORDS = frozenset(DICTIONARY)
PAIRS = Counter(a + b for w in DICTIONARY for a, b in zip(f" {w}", f"{w} "))
FEATURES = 18


def kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def covered(s: str) -> float:
    """Share of a text's letters that dictionary words of 3 letters or more cover, longest first from the left."""
    s, n, at = s.lower(), 0, 0
    while at < len(s):
        size = next((k for k in range(min(9, len(s) - at), 2, -1) if s[at : at + k] in WORDS), 0)
        n += size
        at += size or 1
    return n / max(1, len(s))


def features(candidate: str, left: str, right: str, path: str | None) -> list[float]:
    """FEATURES numbers about a candidate and what is around it; left and right are up to NEAR characters."""
    n, kinds = len(candidate), [kind(c) for c in candidate]
    share = [kinds.count(k) / n for k in range(4)]
    times = Counter(candidate)
    entropy = -sum(x / n * math.log2(x / n) for x in times.values())
    moves = sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1)
    low = candidate.lower()
    likely = sum(math.log((PAIRS[a + b] + 0.1) / 100) for a, b in zip(low, low[1:])) / max(1, n - 1)
    before = [w for w in re.split(r"[^a-z0-9_]+", left.lower()) if w][-3:]
    near = " ".join(before)
    around = f"{near} {right[:12].lower()}"
    last = left.rstrip()[-1:] if left.rstrip(" \"'") == left.rstrip() else left.rstrip(" \"'")[-1:]
    parts = re.split(r"[^a-z0-9]+", (path or "").lower())
    return [
        float(n), *share, entropy, moves, likely, covered(candidate), float(re.fullmatch(r"[0-9a-fA-F]+", candidate) is not None), float(PREFIX.match(candidate) is not None or candidate.startswith("-----BEGIN")),
        float(any(w in near for w in SECRET_WORDS)), float(any(w in before for w in HARMLESS_WORDS)), float(last in "=:" and last != ""), float(left.endswith(('"', "'", "`"))), float("example" in around or "xxxx" in low or "changeme" in low or "1234" in low),
        float(any(w in parts for w in PATH_WORDS)), len(times) / n,
    ]


def synthetic(n: int = LABELLED, seed: int = 42) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings (candidate, left, right, path, 1 for a secret) made by rule, half of them secrets."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choices(alphabet, k=k))
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    upper, hexes = lower.upper(), "0123456789abcdef"
    prose = lambda k: " ".join(r.choices(DICTIONARY, k=k))
    some = lambda *options: r.choice(options)
    path = lambda: some("", f"src{r.randrange(40)}", f"src/{r.choice(DICTIONARY)}.py", f"config/{r.choice(DICTIONARY)}.yaml", f"tests/{r.choice(DICTIONARY)}.py", f"docs/{r.choice(DICTIONARY)}.md")
    out = []
    for i in range(n):
        before, after = f"{prose(r.randrange(1, 5))} ", f" {prose(3)}"
        if i % 2:
            name = some("token", "password", "secret", "api_key", "access_token", "client_secret", "auth", "private_key", "passwd")
            assign = some(f"{name}=", f"{name} = ", f'{name} = "', f'{name}: "', f"{name}: ", f"{name} '")
            mixed = upper + lower + digits
            c, assign = some(
                (pick(hexes, some(16, 18, 20, 24, 32, 40, 64)), assign), (pick(mixed, r.randrange(14, 48)), assign), (pick(mixed + "+/", 40), assign), ("AKIA" + pick(upper + digits, 16), some(assign, "", "", "key ")), ("AKIA" + pick(upper, 16), some(assign, "", "key ")), (pick(upper + lower, r.randrange(14, 40)), assign),
                (pick(mixed + "!@#$%^*?.~", r.randrange(8, 20)), assign), (some("!", "@", "$", "-").join(w.title() for w in r.choices(DICTIONARY, k=3)).replace("i", some("i", "!", "1")) + some("!", "$", "7", "#"), assign), (pick(lower, 3) + some(*"$!@#%") + pick(digits + lower, 6), assign),
                ("ghp_" + pick(mixed, 36), some(assign, "", "")), ("sk_live_" + pick(mixed, 24), some(assign, "")), ("eyJ" + pick(mixed, 40), some(assign, "bearer ", "")),
                (f"-----BEGIN {some('', 'RSA ', 'EC ')}PRIVATE KEY-----\n" + "\n".join(pick(mixed + "+/", 64) for _ in range(r.randrange(2, 26))) + "\n-----END PRIVATE KEY-----", some("", assign)),
            )
            where = some(f"src{r.randrange(40)}", f"src/{r.choice(DICTIONARY)}.py", f"config/{r.choice(DICTIONARY)}.env", "")
            out.append((c, f"{before}{assign}"[-NEAR:], f'{'"' if assign.endswith('"') else ""}{after}', where, 1))
        else:
            told = some("password: ", "token = ", "auth: ", "secret=", "api_key = ", "access: ", "key: ")
            c, left = some(
                ("".join(w.title() for w in r.choices(DICTIONARY, k=r.randrange(2, 5))), some("", "class ", "function ", told)), (some("-", "_", "/").join(r.choices(DICTIONARY, k=r.randrange(3, 6))), some("", "see ", told)), (some("required", "undefined", "disabled", "optional", "<password>", "${PASSWORD}", "********", "your-password", "changeme", "os.environ.get(", "settings.token", "https://www.example.com"), told),
                (" ".join(r.choices(DICTIONARY, k=r.randrange(2, 6))).ljust(8, "s"), told + some('"', "'")), ("".join(r.choices(DICTIONARY, k=2)).ljust(8, "s"), told), (pick(digits, some(12, 13, 15, 16, 19)), some("", "", "card ", "order ", "isbn ", "id ")), (pick(hexes, some(32, 40, 64)), some("commit ", "sha ", "md5: ", "hash ", "checksum: ")),
                ("-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), some("uuid ", "id ", "guid: ", "")), ("".join(w.title() for w in r.choices(DICTIONARY, k=4)) + pick(digits, r.randrange(1, 4)), some("", "class ", "function ")),
                ("_".join(r.choices(DICTIONARY, k=3)) + pick(digits, r.randrange(1, 4)), some("", "file ", "test ")), ("/".join(["www", *r.choices(DICTIONARY, k=3)]) + pick(digits, 2), some("https://", "see ", "")),
                (pick(digits, 4) + "-" + pick(digits, 2) + "-" + pick(digits, 2) + "-" + pick(digits, 4), some("date ", "", "version ")), (some("your-token-here-1234", "changeme12345", "xxxxxxxxxxxxxxxx1", "password12345", "example-key-0000"), some("password=", "token = ", "api_key: ")),
                ("-".join([pick(digits, 3), pick(digits, 3), pick(digits, 4)]), some("phone ", "tel ", "call ", "")), (pick(lower, r.randrange(9, 20)) + pick(digits, r.randrange(1, 4)) + pick(lower, r.randrange(2, 9)), ""),
            )
            out.append((c, f"{before}{left}"[-NEAR:], after, path(), 0))
    return out


def written() -> list[tuple[str, str, str, str, int]]:
    """The findings of findings.tsv, like those of synthetic. All secrets in it are made up."""
    rows = (line.split("\t") for line in Path(__file__).with_name("findings.tsv").read_text(encoding="utf-8").splitlines())
    return [(c, left[-NEAR:], right[:NEAR], path, int(y)) for y, c, left, right, path in rows]


def train(spark: SparkSession, labelled: list[tuple[str, str, str, str, int]] | None = None, seed: int = 42) -> RandomForestClassificationModel:
    """A forest fitted on labelled findings, which must be of both kinds; by default on those made by rule and, WRITTEN
    times, on those written by hand."""
    labelled = synthetic() + WRITTEN * written() if labelled is None else labelled
    if len({y for *_, y in labelled}) < 2:
        raise ValueError("findings of both kinds are needed")
    rows = [(features(c, left, right, path), float(y)) for c, left, right, path, y in labelled]
    df = spark.createDataFrame(rows, "f array<double>, label double").select(array_to_vector("f").alias("features"), "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed).fit(df)


def assigned(text: str) -> set[tuple[int, int]]:
    """Spans of what is assigned to secret words. A value may hold further assignments: of a chain of them without quotes the
    outermost value and the innermost are spans, those between are not, so all spans together are as long as the text a few
    times over."""
    spans, chains, end = set(), {}, 0
    for m in ASSIGNS.finditer(text):
        at = m.end()
        if text[at : at + 1] in ("'", '"'):
            quoted = QUOTED.match(text, at)
            if quoted and quoted.end() - at - 2 >= LEAST:
                spans.add((at + 1, quoted.end() - 1))
        else:
            # a value within one without quotes ends with it, so each run is read once
            end = end if at < end else BARE.match(text, at).end()
            if end - at >= LEAST:
                chains[end] = chains.get(end, ())[:1] + (at,)
    return spans | {(at, stop) for stop, starts in chains.items() for at in starts}


def proposed(text: str) -> list[tuple[int, int]]:
    """Spans that can be secrets: private keys, what is assigned to a secret word, and runs that have a digit, mix case or begin as
    known keys do. A run within an assigned value is one more span, as a value may be a link or another assignment."""
    spans = assigned(text)
    spans.update(m.span() for m in KEY_BLOCK.finditer(text))
    for m in CANDIDATE.finditer(text):
        c = m[0]
        if DIGIT.search(c) or (c != c.lower() and c != c.upper()) or PREFIX.match(c):
            spans.add(m.span())
    return sorted(spans)


def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        out = []
        for row, text, path in zip(part["id"], part["text"], part["path"]):
            for start, end in proposed(text):
                c = text[start:end]
                out.append((row, start, len(c), c, features(c, text[max(0, start - NEAR) : start], text[end : end + NEAR], path)))
        yield pd.DataFrame(out, columns=["id", "start", "length", "candidate", "f"])


def scan(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """A row per candidate of the whole text: id_col, start (code points), length, digest (SHA-256), probability,
    is_secret.

    Null and empty texts have none, a null path is an empty one; null ids and repeated rows give rows like others.
    Candidates are private keys, what is assigned to a secret word, from 4 characters, and runs of 12 or more with a digit, mixed case
    or a known prefix. Other columns are not looked at; an empty table gives none.
    """
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), path.alias("path")).where(F.col("text").isNotNull())
    id_type = docs.schema[id_col].dataType.simpleString()
    found = rows.mapInPandas(candidates, f"id {id_type}, start int, length int, candidate string, f array<double>")
    scored = model.transform(found.select("*", array_to_vector("f").alias("features")))
    p = vector_to_array("probability")[1]
    return scored.select(F.col("id").alias(id_col), "start", "length", F.sha2("candidate", 256).alias("digest"), F.round(p, 6).alias("p")).select(id_col, "start", "length", "digest", F.col("p").alias("probability"), (F.col("p") >= 0.5).alias("is_secret"))
