"""Secret scans: candidates by their form, false positives removed by a random forest."""

from __future__ import annotations

import math
import random
import re
import string
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir, staged
from .common import most_frequent, sliced

MARK = "[secret]"
#: Characters before and after a candidate in which its neighbouring words are looked for.
REACH = 60

# Forms of keys that are public knowledge, and words that speak for or against a secret.
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----")
RUN = re.compile(r"[A-Za-z0-9+/_~-]{16,}(?:\.[A-Za-z0-9_-]{10,}){0,2}={0,2}")
# A whole name and its sign, then a value to its closing quote in the line or, without one, to white space. Nothing is gone over twice.
ASSIGNED = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]++)[ \t\"']*+(?::=|=>|[=:])\s*+")
VALUE = re.compile(r"\"((?:[^\"\\\n]|\\.)++)\"|'((?:[^'\\\n]|\\.)++)'|[\"']?(\S++)")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "sk_live_", "sk-", "xoxb-", "xoxp-", "AIza", "eyJ", "glpat-", "npm_", "SG.")
SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "key", "credential", "auth", "bearer", "private", "access")
HARMLESS_WORDS = ("commit", "sha", "sha1", "sha256", "md5", "hash", "checksum", "digest", "integrity", "etag", "revision", "uuid", "guid", "id", "version", "build", "base64", "example", "sample", "placeholder", "dummy", "fake", "phone", "tel", "card", "order", "file", "path", "url", "href", "src")
TEST_PATHS = ("test", "spec", "fixture", "mock", "example", "sample", "doc", "lock", ".min.", "vendor")
LIVE_PATHS = (".env", "config", "settings", "credentials", "deploy", "secrets", ".yml", ".yaml", ".ini", ".properties")
PLACEHOLDERS = ("changeme", "your", "example", "placeholder", "xxxx", "none", "null", "todo", "default", "dummy", "insert", "redacted")

HEX = re.compile(r"[0-9a-fA-F]+\Z")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
NAME = re.compile(r"[A-Za-z0-9_-]+")
LETTERS = re.compile(r"[a-z]+")
KEYWORD = re.compile("|".join(map(re.escape, SECRET_WORDS)))


def candidates(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in characters, in order and without overlaps: private-key blocks, values given to a name that speaks of a secret, and runs of 16 or more letters, digits and joining signs that aren't all letters of one case."""
    text = text or ""
    out = [(m.start(), m.end(), "block") for m in PEM.finditer(text)] if "PRIVATE KEY" in text else []
    if "=" in text or ":" in text:
        end = 0
        for m in ASSIGNED.finditer(text):
            if m.start(1) >= end and KEYWORD.search(m[1].lower()) and (v := VALUE.match(text, m.end())):
                a, z = v.span(v.lastindex)
                z = a + len(text[a:z].rstrip("\"'")) if v.lastindex == 3 else z
                if z - a >= 6:
                    out.append((a, z, "assigned"))
                    end = z
    for m in RUN.finditer(text):
        w = m.group()
        if not w.islower() and not w.isupper() and not w.istitle() or any(c in w for c in string.digits):
            out.append((*m.span(), "run"))
    rank = {"block": 0, "assigned": 1, "run": 2}
    kept: list[tuple[int, int, str]] = []
    for c in sorted(out, key=lambda c: (c[0], rank[c[2]], -c[1])):
        while kept and c[0] < kept[-1][1] and rank[c[2]] < rank[kept[-1][2]]:
            kept.pop()
        if not kept or c[0] >= kept[-1][1]:
            kept.append(c)
    return kept


class Features:
    """What the forest sees of a candidate. ``words``: the dictionary, from which character transitions are counted too."""

    NAMES = (
        "length", "digits", "uppers", "lowers", "others", "entropy", "changes", "transitions", "distinct", "hex", "coverage", "longest_same", "uuid",
        "assigned", "quoted", "prefix", "placeholder", "secret_before", "harmless_before", "harmless_after", "secret_after", "test_path", "live_path", "known_neighbours", "hash_length",
    )

    def __init__(self, words: list[str]):
        self.words = {w for w in words if len(w) >= 4}
        self.known = set(words)
        self.longest = min(24, max(map(len, self.words), default=0))
        counts: Counter[str] = Counter()
        for w in words:
            counts.update(a + b for a, b in zip(f"^{w}", f"{w}$", strict=True))
        firsts: Counter[str] = Counter()
        for pair, n in counts.items():
            firsts[pair[0]] += n
        self.transition = {p: math.log((n + 0.5) / (firsts[p[0]] + 20)) for p, n in counts.items()}
        self.unseen = math.log(0.5 / 5000)

    def coverage(self, value: str) -> float:
        """The largest share of the value's characters that dictionary words can cover without overlaps."""
        value, covered = value.lower(), 0
        for m in LETTERS.finditer(value):
            a, z = m.span()
            best = [covered]  # up to each place of the run, from what is covered before it
            for j in range(a + 1, z + 1):
                best.append(max(best[-1], max((best[i - a] + j - i for i in range(max(a, j - self.longest), j - 3) if value[i:j] in self.words), default=0)))
            covered = best[-1]
        return covered / max(1, len(value))

    def of(self, before: str, value: str, after: str, path: str | None, kind: str) -> list[float]:
        n = len(value)
        counts = Counter(value)
        digits, uppers, lowers = sum(map(str.isdigit, value)), sum(map(str.isupper, value)), sum(map(str.islower, value))
        kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
        low = value.lower()
        pairs = [a + b for a, b in zip(low, low[1:], strict=False)]
        same = longest = 1
        for a, b in zip(value, value[1:], strict=False):
            same = same + 1 if a == b else 1
            longest = max(longest, same)
        ahead, behind = (NAME.findall(x.lower()) for x in (before, after))
        ahead, behind, path = ahead[-3:], behind[:3], (path or "").lower()
        near = ahead[-2:] + behind[:2]
        return [
            float(min(n, 4096)), digits / n, uppers / n, lowers / n, (n - digits - uppers - lowers) / n,
            -sum(c / n * math.log2(c / n) for c in counts.values()), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
            sum(self.transition.get(p, self.unseen) for p in pairs) / max(1, len(pairs)), len(counts) / n, float(bool(HEX.match(value))), self.coverage(value), longest / n, float(bool(UUID.match(value))),
            float(kind != "run"), float(before[-1:] in "\"'" and before != ""), float(kind == "block" or value.startswith(PREFIXES)), float(any(p in low for p in PLACEHOLDERS)),
            float(any(KEYWORD.search(w) for w in ahead)), float(any(w in HARMLESS_WORDS for w in ahead)), float(any(w in HARMLESS_WORDS for w in behind)), float(any(KEYWORD.search(w) for w in behind)),
            float(any(p in path for p in TEST_PATHS)), float(any(p in path for p in LIVE_PATHS)), sum(w in self.known for w in near) / max(1, len(near)), float(n in (32, 40, 64, 128)),
        ]


def dictionary(df: DataFrame, text: str = "text", most: int = 20_000) -> list[str]:
    """The words of 3 to 24 letters that the most rows hold, over all rows: ``most`` at most, which bounds what is sent to the driver and the executors."""
    words = df.select(F.explode(F.array_distinct(F.split(F.lower(F.col(text)), r"\P{L}+"))).alias("word"))
    return most_frequent(words.filter(F.length("word").between(3, 24)).groupBy("word").agg(F.count("*").alias("n")), most)


def labelled_findings(spark: SparkSession, words: list[str], n: int = 6_000, seed: int = 11) -> DataFrame:
    """``n`` findings with their labels, for where no reviewed ones are at hand: (before, value, after, path, kind, label).

    Secrets are made in the public forms of keys, and as values given to telling names; false positives are hashes, ids, numbers, names,
    paths, placeholders, and keys in tests. Their neighbours are words of the dictionary."""
    words = words or ["the", "and", "with", "from"]

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([_finding(random.Random(f"{seed} {k}"), words) for k in pdf.id], columns=["before", "value", "after", "path", "kind", "label"])

    return spark.range(0, n, 1, 4).mapInPandas(made, "before string, value string, after string, path string, kind string, label int")


def _finding(rng: random.Random, words: list[str]) -> tuple[str, str, str, str, str, int]:
    def of(letters: str, least: int, most: int | None = None) -> str:
        return "".join(rng.choices(letters, k=rng.randint(least, most or least)))

    def some(k: int) -> str:
        return " ".join(rng.choice(words) for _ in range(k))

    hexes, alnum, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    path = rng.choice(["", "", "", f"src{rng.randint(0, 99)}", f"{rng.choice(words)}/{rng.choice(words)}.py", "app/config.yml", ".env", "deploy/settings.ini"])
    before, after, quote = some(3) + " ", " " + some(3), rng.choice(["", '"', "'"])
    sign = rng.choice([" = ", "=", ": ", ":", " => "])
    if rng.random() < 0.5:
        form = rng.randrange(9)
        bare = [lambda: "AKIA" + of(upper, 16), lambda: rng.choice(["ghp_", "gho_"]) + of(alnum, 36), lambda: "sk_live_" + of(alnum, 24, 40), lambda: f"xoxb-{of(string.digits, 11)}-{of(alnum, 24)}", lambda: "AIza" + of(alnum + "-_", 35), lambda: f"eyJ{of(alnum, 30, 60)}.eyJ{of(alnum, 30, 90)}.{of(alnum + '-_', 43)}"]
        if form < len(bare):
            value = bare[form]()
            name, kind = rng.choice([("", "run"), ("", "run"), (f"{rng.choice(['api_key', 'token', 'access_key'])}{sign}{quote}", "assigned")])
        elif form == 6:
            value, name, kind = f"-----BEGIN {rng.choice(['RSA ', 'EC ', ''])}PRIVATE KEY-----\n{of(alnum + '+/', 200, 900)}\n-----END PRIVATE KEY-----", "", "block"
        else:
            value = rng.choice([lambda: of(hexes, 16, 64), lambda: of(alnum, 10, 48), lambda: of(alnum + "+/", 20, 64) + "==", lambda: of(alnum + "!@#$%^&*", 8, 24), lambda: rng.choice(words).title() + of(string.digits, 2, 6) + of("!@#$%", 1, 2), lambda: of(hexes, 40), lambda: of(hexes, 16, 20)])()
            name, kind = rng.choice(["password", "passwd", "db_password", "secret", "client_secret", "token", "auth_token", "TOKEN", "PASSWORD", "api-key", "ACCESS_TOKEN", "pwd"]) + sign + quote, "assigned"
        return before + name, value, (quote if name else "") + after, path, kind, 1
    form = rng.randrange(10)
    kind, name = "run", ""
    if form == 0:
        name, value = rng.choice(["commit ", "sha1 ", "sha256: ", "md5: ", "checksum ", "revision ", "etag: ", "digest ", "integrity sha512-", "hash "]), of(hexes, rng.choice([32, 40, 64]))
    elif form == 1:
        name, value = rng.choice(["", "id ", "uuid: ", "guid ", "id="]), str(uuid.UUID(int=rng.getrandbits(128)))
    elif form == 2:
        name, value = rng.choice(["", "tel ", "order ", "card ", "id "]), of(string.digits, 16, 20)
    elif form == 3:
        value = rng.choice(words) + "".join(w.title() for w in rng.choices(words, k=3)) + rng.choice(["", "2", "64"])
    elif form == 4:
        value = rng.choice("_-").join([*rng.choices(words, k=4), of(string.digits, 1, 4)])
    elif form == 5:
        value = "/".join([*rng.choices(words, k=4), of(string.digits, 1, 4)])
    elif form == 6:
        kind, name = "assigned", rng.choice(["password", "token", "secret", "api_key"]) + sign + quote
        value = rng.choice(["changeme", "your_token_here", "YOUR-API-KEY-HERE", "xxxxxxxxxxxxxxxx", "${SECRET_VALUE}", "<password>", "example-password", "placeholder", "os.environ", "getenv()", "undefined", "redacted"])
    elif form == 7:
        kind, name, value = "assigned", rng.choice(["password", "token", "secret", "key"]) + rng.choice([": ", " = "]), rng.choice([w for w in rng.choices(words, k=8) if len(w) >= 6] or ["monday"]) + rng.choice(["", ".", ","])
    elif form == 8:
        name, value = rng.choice(["base64,", "data:image/png;base64,", "src="]), of(alnum + "+/", 60, 400) + rng.choice(["", "=", "=="])
    else:
        kind, name, path = "assigned", rng.choice(["password", "token", "secret"]) + sign + quote, rng.choice(["tests/fixtures/users.py", "docs/example.md", "spec/mock_server.rb", "package-lock.json", "vendor/lib.min.js"])
        value = of(alnum, 10, 40)
    return before + name, value, (quote if kind == "assigned" else "") + after, path, kind, 0


def train(findings: DataFrame, words: list[str], trees: int = 40, depth: int = 10, seed: int = 5) -> dict:
    """A forest from labelled findings (before, value, after, path, kind, label), as arrays of nodes: at most ``trees * 2^(depth + 1)``, whatever the number of findings.

    Findings with a null or empty value or a null label are left out. Without any, every candidate counts as a secret."""
    spark = findings.sparkSession
    shared = spark.sparkContext.broadcast(words)  # bounded by the dictionary's size

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        see = Features(shared.value)
        for cols in batches:
            yield pd.Series([see.of(b or "", v, a or "", p, k or "run") for b, v, a, p, k in zip(*cols, strict=True)])

    known = findings.filter(F.col("label").isNotNull() & (F.length("value") > 0))
    rows = known.select(array_to_vector(features("before", "value", "after", "path", "kind")).alias("features"), F.col("label").cast("double").alias("label")).persist()
    if rows.isEmpty():
        return {"words": words, "trees": []}
    path = f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}"
    RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=seed).fit(rows).write().save(path)
    rows.unpersist()
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex", F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("at"), "nodeData.impurityStats")
    by: dict[int, list] = {}
    for r in nodes.collect():
        stats = list(r["impurityStats"])
        by.setdefault(r["treeID"], []).append((r["id"], r["leftChild"], r["rightChild"], r["featureIndex"], r["at"] or 0.0, stats[1] / sum(stats) if len(stats) > 1 else 0.0))
    return {"words": words, "trees": [tuple(np.array(x) for x in zip(*sorted(t), strict=True)) for _, t in sorted(by.items())]}


def forest_scores(trees: list, x: np.ndarray) -> np.ndarray:
    """The mean over the trees of the share of secrets in a row's leaf."""
    if not trees:
        return np.ones(len(x))
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for _, left, right, feature, at, share in trees:
        node = np.zeros(len(x), np.int64)
        while (inner := left[node] >= 0).any():
            goes = x[rows, np.maximum(feature[node], 0)] <= at[node]
            node = np.where(inner, np.where(goes, left[node], right[node]), node)
        total += share[node]
    return total / len(trees)


FOUND = "n_candidates long, n_secrets long, top_score double, spans array<struct<start:int,stop:int,kind:string,score:double>>, redacted string"


def scanner(spark: SparkSession, model: dict, threshold: float = 0.5, redacted: bool = False):
    """A function from (text, path) to ``FOUND``: how many candidates and secrets, the highest score (0 without candidates), and the secrets' places in characters.

    Whole texts are read, each once, in the task that holds them. Null and empty texts have no candidates; a null path
    is an empty one. ``redacted`` (null unless asked for): the text with each secret replaced by a mark."""
    shared = spark.sparkContext.broadcast(model)  # dictionary and forest, both of bounded size
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))

    @F.arrow_udf(FOUND)
    def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        m = shared.value
        see = Features(m["words"])
        for texts, paths in sliced(batches):
            texts, paths = texts.to_pylist(), paths.to_pylist()
            found = [candidates(t) for t in texts]
            x = [see.of(t[max(0, a - REACH) : a], t[a:z], t[z : z + REACH], p, kind) for t, p, c in zip(texts, paths, found, strict=True) for a, z, kind in c]
            scores = iter(forest_scores(m["trees"], np.array(x)).tolist() if x else [])
            rows: list[tuple] = []
            for t, c in zip(texts, found, strict=True):
                own = [(a, z, kind, next(scores)) for a, z, kind in c]
                hits = [h for h in own if h[3] >= threshold]
                clean = t
                if redacted and hits:
                    parts, at = [], 0
                    for a, z, *_ in hits:
                        parts += [t[at:a], MARK]
                        at = z
                    clean = "".join([*parts, t[at:]])
                rows.append((len(c), len(hits), max((h[3] for h in own), default=0.0), [dict(zip(("start", "stop", "kind", "score"), h, strict=True)) for h in hits], clean if redacted else None))
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), spans_type, pa.string())
            yield pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["n_candidates", "n_secrets", "top_score", "spans", "redacted"])

    return scan


def model_for(df: DataFrame, text: str = "text", findings: DataFrame | None = None) -> dict:
    """A model by the words of ``df``, from ``findings`` or, if none are given, from made ones."""
    words = dictionary(df, text)
    return train(staged(labelled_findings(df.sparkSession, words), "findings") if findings is None else findings, words)


def scans(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source", findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(key, n_candidates, n_secrets, top_score, spans) for every row; repeated rows are scanned each, an empty table gives no rows, further columns are ignored."""
    scan = scanner(df.sparkSession, model_for(df, text, findings), threshold)
    return df.select(key, scan(text, path).alias("x")).select(key, "x.n_candidates", "x.n_secrets", "x.top_score", "x.spans")


def redacted(df: DataFrame, text: str = "text", path: str = "source", findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """All rows, each secret in the text replaced by ``MARK``; columns as they came, null texts null."""
    scan = scanner(df.sparkSession, model_for(df, text, findings), threshold, redacted=True)
    clean = scan(F.col(text), F.col(path)).getField("redacted")
    return df.select(*(clean.alias(text) if c == text else F.col(c) for c in df.columns))
