"""Each operator against a plain version on small tables, with nulls, empty and long texts, repeated rows and clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import common, decontaminate, jaccard, langid, mixing, quality, repeats, secrets, sharding, topk
from ledgerline.llm.common import joined

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, rep long"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A stored table of documents with copies, near copies, shared passages and odd rows."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(900)]

    def text(n):
        return " ".join(rng.choice(words, n))

    texts = [text(int(n)) for n in rng.integers(3, 260, 60)]
    passage = text(110)
    for k in range(8):
        texts.append(f"{text(20)} {passage} {text(15)}")
    for k in range(10):
        w = texts[k].split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [texts[5]] * 4 + ["", None, None, " \n\t ", "Ab", "ab", "x" * 3000, "ab" * 900, "naïve Σίσυφος 😀 " * 60, text(4), "A b C d", "a b c d", texts[0].upper()]
    rows = [(k, t, "en", "src", len(t or ""), 0, 0) for k, t in enumerate(texts)]
    rows += [(7, texts[7], "en", "src", 0, 0, 0), (None, texts[6], "en", None, None, None, None)]
    path = str(tmp_path_factory.mktemp("t") / "documents")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def rows_of(stored):
    return [(r.doc_id, r.text) for r in stored.collect()]


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard(spark, stored):
    docs = [(d, shingle_set(t)) for d, t in rows_of(stored)]
    parent = {d: d for d, _ in docs if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(docs):
        for b, t in docs[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    want = sorted((str(d), len(s), None if d is None else root(d)) for d, s in docs)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.similar_groups(stored).collect())
    assert got == want
    assert len({c for *_, c in got}) < len(got) - 10
    assert jaccard.similar_groups(stored.limit(0)).count() == 0


def test_jaccard_many_near_copies(spark):
    rng = np.random.default_rng(5)
    base = [f"t{k}" for k in range(60)]
    texts = []
    for _ in range(120):
        w = list(base)
        for k in rng.integers(0, 60, 2):
            w[k] = f"u{rng.integers(0, 4)}"
        texts.append(" ".join(w))
    docs = [(k, shingle_set(t)) for k, t in enumerate(texts)]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(docs):
        for b, t in docs[:i]:
            if 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {k: root(k) for k in range(len(docs))}


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeats(stored, hot):
    bodies = [(d, (t or "").encode()) for d, t in rows_of(stored)]
    seen = Counter(b[i : i + 400] for _, b in bodies for i in range(len(b) - 399))
    want = []
    for d, b in bodies:
        mark = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                mark[i] += 1
                mark[i + 400] -= 1
        gone = np.cumsum(mark)[: len(b)] > 0
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        kept = bytes(np.frombuffer(b, "u1")[~gone]) if len(b) else b""
        want.append((str(d), len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    where = defaultdict(set)
    words = [WORD.findall(b.decode()) for _, b in bodies]
    for k, w in enumerate(words):
        for i in range(len(w) - 50):
            where[tuple(w[i : i + 51])].add(k)
    for k, w in enumerate(words):
        want[k] += (len({j for i in range(len(w) - 50) if len(where[tuple(w[i : i + 51])]) > 1 for j in range(i, i + 51)}),)
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage_words) for r in repeats.without_repeats(stored, most_group=hot).collect()]
    assert sorted(got) == sorted(want)
    assert repeats.without_repeats(stored.limit(0)).count() == 0


def test_equal_contexts_are_not_compared(spark, monkeypatch):
    """Copies of a passage are told by marks: neither their contexts nor their windows are made, but where they differ."""
    rng = np.random.default_rng(21)
    passage = " ".join(f"w{k}" for k in rng.integers(0, 9000, 2000))
    docs = spark.createDataFrame([(k, f"{k} begins {passage} {k} ends") for k in range(40)] + [(40, "z" * 500)], "doc_id long, text string")
    made, plain = Counter(), repeats.staged

    def counted(df, name):
        out = plain(df, name)
        made[name] += out.count()
        return out

    monkeypatch.setattr(repeats, "staged", counted)
    got = {r.doc_id: r for r in repeats.without_repeats(docs).collect()}
    assert all(got[k].n_removed >= len(passage) and got[k].n_passage_words == 2001 for k in range(40))
    assert got[40].n_removed == 500
    assert made["repeat-windows"] < 40 * 2000 / 8 and made["repeat-contexts"] < 40 * 20


def test_copies_of_texts_leave_by_bitmaps(spark, monkeypatch):
    """Whole texts are told apart without a shuffle of all their anchors, and hashes that come once are no row of a grouping."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 9000, 300)) for _ in range(20)]
    docs = spark.createDataFrame([(k, texts[k % 20]) for k in range(30)], "doc_id long, text string")
    asked, plain = [], repeats.joined

    def seen(df, *args, **named):
        asked.append((df.columns, args[1]))
        return plain(df, *args, **named)

    monkeypatch.setattr(repeats, "joined", seen)
    got = {r.doc_id: r for r in repeats.without_repeats(docs).collect()}
    assert all(got[k].n_removed == (len(texts[k % 20]) if k % 20 < 10 else 0) for k in range(30))
    assert [c for c, keys in asked if keys == ["sha", "n"]] and not any("hash" in c for c, keys in asked if keys == ["sha", "n"])


def test_recurring_hashes(spark):
    rng = np.random.default_rng(4)
    once, often = rng.integers(-(1 << 63), 1 << 63, 4000), np.repeat(rng.integers(-(1 << 63), 1 << 63, 300), rng.integers(2, 9, 300))
    df = spark.createDataFrame([(int(x),) for x in rng.permutation(np.concatenate([once, often, [-1, -1, 0, 0]]))], "hash long").repartition(7)
    got = Counter(r.hash for r in repeats.recurring(df, "hash").collect())
    want = Counter([*often.tolist(), -1, -1, 0, 0])
    assert not want - got and sum((got - want).values()) < 5
    assert repeats.recurring(df.limit(0), "hash").count() == 0


@pytest.mark.parametrize("most", [4096, 0])
def test_rows_by_bitmaps(spark, most):
    ids = [0, 1, 7, 8, 63, 64, 4095, 32767, 32768, 40_000, (5 << 33) + 12]
    df = spark.createDataFrame([(k,) for k in [*range(130), *range(32_700, 32_800), 40_000, 5 << 33, (5 << 33) + 12]], "row long")
    some = spark.createDataFrame([(k,) for k in ids], "row long")
    rest = {r.row for r in common.without(df, some, "row", most).collect()}
    assert rest == {r.row for r in df.collect()} - set(ids)
    if most:
        assert {r.row for r in common.among(df, some, F.col("row")).collect()} == {r.row for r in df.collect()} & set(ids)


@pytest.mark.parametrize("period", range(1, 9))
def test_short_periods(period):
    rng = np.random.default_rng(period)
    noise = rng.integers(0, 256, 3000).astype("u1")
    for start in (0, 17, 391, 1200):
        b = noise.copy()
        b[start : start + 401 + period] = np.resize(noise[start : start + period], 401 + period)
        assert any(a <= start and z >= start + 401 + period for a, z in repeats._monotonous(b, 400))
    assert repeats._monotonous(noise, 400) == []


def test_maximal_repeats():
    body = b"xABCDEFy zABCDEFw qABCDr"
    at = [m.start() for m in re.finditer(b"BC", body)]
    tree = repeats.IntervalTree([body[:p][::-1] for p in at], [body[p:] for p in at], 4)
    found = {(body[at[who[0]] - before : at[who[0]] + after], len(who)) for before, after, who in tree.repeats()}
    assert (b"ABCDEF", 2) in found
    assert (b"ABCD", 3) in found


def test_topk(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 8)).astype("f4")
    v[50:80] = v[50]
    rows = [(int(k), [float(x) for x in e]) for k, e in enumerate(v)] + [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8), (403, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, row int")
    e = np.floor(256 * v.astype("f8")).astype(int)
    want = []
    for q in range(0, 400, 50):
        scores = sorted((-int(e[q] @ e[c]), c) for c in range(400) if c != q)[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scores)]
    for limits in ({}, {"block": 100, "query_block": 3}, {"block": 20, "query_block": 2, "chunk": 3}):
        got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, **limits).collect()]
        assert sorted(got) == want
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(df, F.lit(False)).count() == 0
    assert topk.top_k(df.filter("vec_id < 3"), F.col("vec_id") % 50 == 0).count() == 2


def test_topk_of_odd_rows(spark):
    """Null ids take no part; rows of one id are each other's candidates; short, empty, equal and zero vectors count; own column names may clash."""
    rows = [(None, [1.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, []), (3, [2.0]), (4, [0.0, 0.0]), (5, [-1.0, -1.0])]
    df = spark.createDataFrame([(i, v, 9, 9, True) for i, v in rows], "vec_id long, embedding array<double>, id int, cell int, is_query boolean")
    full = [(i, (v + [0.0, 0.0])[:2]) for i, v in rows if i is not None]
    want = []
    for a, (i, x) in enumerate(full):
        best = sorted((-int(65536 * (x[0] * y[0] + x[1] * y[1])), j) for b, (j, y) in enumerate(full) if a != b)
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best[:3])]
    for block in (1, 2, 4096):
        assert sorted(tuple(r) for r in topk.top_k(df, F.lit(True), k=3, block=block).collect()) == sorted(want)


def _clusters(n, dims, spread, seed=4):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(40, dims))
    return np.floor(256 * (middles[rng.integers(0, 40, n)] + spread * rng.normal(size=(n, dims)))).astype(np.int64)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_cover_tree(spread):
    """Covering, separation, nesting, falling radii; every point in one leaf."""
    data = np.concatenate([_clusters(1500, 6, spread), np.tile(_clusters(1, 6, 0), (80, 1))]).astype("f8")
    t = topk.CoverTree(data)
    leaves = []
    for a in range(len(t.radius)):
        own = t.order[t.start[a] : t.stop[a]]
        far = np.linalg.norm(data[own] - data[t.centers[a]], axis=1)
        assert t.centers[a] in own and np.isclose(far.max(), t.radius[a])
        kids = np.arange(t.first[a], t.first[a] + t.children[a])
        if not len(kids):
            leaves += list(own)
            continue
        c = data[t.centers[kids]]
        gaps = np.linalg.norm(c[:, None] - c[None], axis=2)[np.triu_indices(len(c), 1)]
        assert t.centers[kids[0]] == t.centers[a] and (gaps > t.radius[a] / t.base).all()
        assert (t.radius[kids] <= t.radius[a] / t.base).all()
        assert sorted(own) == sorted(p for k in kids for p in t.order[t.start[k] : t.stop[k]])
    assert sorted(leaves) == list(range(len(data))) and len(t.radius) > 20


def test_dual_search_prunes():
    """On clustered vectors a small share of the pairs is tested, none with floors out of reach; bounds hold for every pair of nodes."""
    data, ids = _clusters(2000, 16, 0.03), np.arange(2000)
    top = np.sqrt((data**2).sum(axis=1).max())
    refs, q = topk.References(data, ids, ids, top), ids % 10 == 0
    found = topk.DualSearch(data[q], ids[q], refs, 5)
    scores = data[q] @ data.T
    own = scores.copy()
    own[np.arange(q.sum()), ids[q]] = -(1 << 60)
    assert (np.lexsort((np.broadcast_to(ids, own.shape), -own), axis=1)[:, :5] == found.best).all()
    assert found.tested < 0.1 * scores.size
    again = topk.DualSearch(data[q], ids[q], refs, 5, found.scores[:, -1])
    assert (again.best == found.best).all() and again.tested <= found.tested
    none = topk.DualSearch(data[q], ids[q], refs, 5, np.full(int(q.sum()), 1 << 40))
    assert none.tested == 0 and (none.best < 0).all()
    for a in range(len(found.tree.radius)):
        bounds = found._bounds(a, np.arange(len(refs.tree.radius)))
        for b, bound in enumerate(bounds):
            assert scores[np.ix_(found._points(a), refs.tree.order[refs.tree.start[b] : refs.tree.stop[b]])].max() <= bound


def test_decontamination(spark, stored):
    texts = rows_of(stored)
    item = " ".join(next(t for d, t in texts if d == 3).split()[:14])
    items = [(1, item), (2, "A B c"), (3, None), (4, ""), (10, item + " more words here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall(low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    want = []
    for d, t in texts:
        w, hit, seen = word.findall(low(t)), set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    seen |= ids
        want.append((str(d), len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit)))
    for limits in ({}, {"most_windows": 1}):  # the set in the expression, and the join
        got = [(str(r[0]), *r[1:]) for r in decontaminate.contamination(stored, bench, **limits).collect()]
        assert sorted(got) == sorted(want)
        clean = decontaminate.without_documents(stored, bench, **limits)
        assert clean.columns == stored.columns
        assert clean.count() == sum(not w[-1] for w in want)
    cut = decontaminate.without_spans(stored, bench)
    assert cut.count() == len(texts)
    assert not any(r.contaminated for r in decontaminate.contamination(cut, bench).filter("doc_id = 3").collect())
    assert decontaminate.contamination(stored, bench.limit(0)).filter("contaminated").count() == 0


def test_rare_languages(spark):
    blank = "\u2003"  # parts words as ASCII's does
    texts = {"en": f"the{blank}walls are green and old", "de": "die Mauern sind schön\x1cund alt", "fi": "talon seinät ovat vihreitä"}
    rows = [(k, texts["en" if k % 2 else "de"], "en" if k % 2 else "de") for k in range(600)] + [(1000, texts["fi"], "fi")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pieces = sorted({w for t in texts.values() for w in langid.words_of(t)} | set("abcdefghijklmnopqrstuvwxyzäö") | {langid.START})
    learnt = langid.train(docs, pieces, most=40, least=5)
    assert learnt["langs"] == ["de", "en", "fi"]
    assert np.allclose(np.exp(learnt["prior"]), [300 / 601, 300 / 601, 1 / 601])
    lang = langid.identifier(spark, learnt)
    assert {(r.lang, r.x.lang) for r in docs.select("lang", lang("text").alias("x")).collect()} == {(x, x) for x in texts}


def test_decontamination_clashing_names(spark):
    names = ["doc_id", "text", "words", "Hits", "found", "row", "hit", "doc", "window", "key", "a.b"]
    docs = spark.createDataFrame([(k, t, *(f"{c}{k}" for c in names[2:])) for k, t in enumerate(["x one two y", "clean", None, ""])], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names[2:]))
    bench = spark.createDataFrame([("i", "One Two")], "item_id string, text string")
    rows = [tuple(r) for r in docs.collect()]
    for limits in ({}, {"most_windows": 0}):
        kept = decontaminate.without_documents(docs, bench, **limits)
        assert kept.columns == names
        assert sorted(map(tuple, kept.collect())) == rows[1:]
        cut = decontaminate.without_spans(docs, bench, **limits)
        assert cut.columns == names
        assert sorted(map(tuple, cut.collect())) == [(0, "x y", *rows[0][2:]), *rows[1:]]
        hits = decontaminate.with_hits(docs, bench, **limits)
        assert hits.columns == [c for c in names if c not in ("words", "Hits")] + ["words", "hits"]
        assert [(r.words, [h.window for h in r.hits], r["a.b"]) for r in hits.orderBy("doc_id").collect()][:2] == [(["x", "one", "two", "y"], ["one two"], "a.b0"), (["clean"], [], "a.b1")]
    for key in ("row", "key", "window"):
        assert sorted((r[key], r.contaminated) for r in decontaminate.contamination(docs, bench, key=key).collect()) == [(f"{key}{k}", k == 0) for k in range(4)]


def test_shards(stored):
    got = sorted((r.shard, r.slot, -1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in sharding.byte_shards(stored, shards=4).collect())
    texts = rows_of(stored)
    assert sorted((d, s, c) for _, _, d, s, c in got) == sorted((-1 if d is None else d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    assert [d for _, _, d, *_ in got] == sorted(d for _, _, d, *_ in got)
    for shard in range(4):
        assert [s for n, s, *_ in got if n == shard] == list(range(sum(n == shard for n, *_ in got)))
    sums = [sum(x[3] for x in got if x[0] == n) for n in range(4)]
    assert max(sums) - min(sums) <= 2 * max(x[3] for x in got)
    assert sharding.byte_shards(stored.limit(0)).count() == 0


def test_secrets(spark):
    keys = ['x AKIA' + "Q7" * 8 + " y", 'the token = "' + "0a1b2c3d4e" * 4 + '" of', "password=5f3a9c01be77d2e4aa", "commit " + "0a1b2c3d4e" * 4, "plain words only", "", None, "4031065727380220 the 63@mail3.example.com", "password: changeme"]
    docs = spark.createDataFrame([(k, t, None if k == 1 else "src1", k) for k, t in enumerate(keys)], "doc_id long, text string, source string, row long")
    got = {r.doc_id: r for r in secrets.scans(docs).collect()}
    assert [got[k].n_secrets for k in range(len(keys))] == [1, 1, 1, 0, 0, 0, 0, 0, 0]
    for k in range(3):
        s = got[k].spans[0]
        assert keys[k][s.start : s.stop] in ("AKIA" + "Q7" * 8, "0a1b2c3d4e" * 4, "5f3a9c01be77d2e4aa")
    clean = secrets.redacted(docs)
    assert clean.columns == docs.columns
    assert {r.doc_id: r.text for r in clean.collect()} == {k: t if k > 2 else ["x [secret] y", 'the token = "[secret]" of', "password=[secret]"][k] for k, t in enumerate(keys)}
    assert secrets.scans(docs.limit(0)).count() == 0


def test_forest_learns(spark):
    words = ["hello", "world", "where", "there", "monday"]
    rows = secrets.labelled_findings(spark, words, 1500)
    model = secrets.train(rows.filter("hash(value) % 4 <> 0"), words, trees=15)
    held = rows.filter("hash(value) % 4 = 0").collect()
    see = secrets.Features(words)
    scores = secrets.forest_scores(model["trees"], np.array([see.of(r.before, r.value, r.after, r.path, r.kind) for r in held]))
    assert np.mean((scores >= 0.5) == np.array([r.label == 1 for r in held])) > 0.9
    assert secrets.train(rows.limit(0), words)["trees"] == []


def labelled(spark):
    rng = np.random.default_rng(4)
    good, bad = ([f"{p}{k}" for k in range(60)] for p in "gb")
    return [(k, " ".join(rng.choice(good if k % 2 else bad, 40)), k % 2, ["de", "en"][k % 2], k) for k in range(400)]


def test_quality(spark):
    rows = labelled(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string, label int, lang string, row long")
    w = quality.train(df.filter("doc_id % 4 <> 2"))
    odd = spark.createDataFrame([(k, t) for k, t in enumerate(["", None, "g1 " * 20_000])], "doc_id long, text string")
    score = quality.scorer(spark, w)
    assert df.filter("doc_id % 4 = 2 or doc_id % 4 = 1").select(((score("text") >= 0.5).cast("int") == F.col("label")).alias("ok")).filter("ok").count() == 200
    assert all(0 <= r[0] <= 1 for r in odd.select(score("text")).collect())
    assert np.all(quality.train(df.limit(0)) == 0)


def test_language(spark):
    pieces = ["▁", *"abcdefghijklmnopqrstuvwxyz", "▁the", "th", "er", "und", "▁und", "ei"]
    unit = langid.Pieces(pieces)
    probs = np.full((len(pieces) + 2, 1), 1 / len(pieces))
    probs[-1], probs[-2] = langid.UNKNOWN, 0

    def brute(word):
        ways = [0.0] * len(word) + [1.0]
        for i in range(len(word) - 1, -1, -1):
            ways[i] = sum((probs[unit.places[word[i:j]], 0] if word[i:j] in unit.places else langid.UNKNOWN if j == i + 1 else 0) * ways[j] for j in range(i + 1, len(word) + 1))
        return ways[0]

    for w in ("▁the", "▁undther", "▁éa", "▁"):
        assert math.isclose(langid.word_scores(unit, probs, [w])[w][0], math.log(brute(w)), rel_tol=1e-9)
    docs = spark.createDataFrame([(k, t, x, 1) for k, (t, x) in enumerate([("the other there", "en"), ("und ein bein", "de")] * 20)], "doc_id long, text string, lang string, row int")
    lang = langid.identifier(spark, langid.train(docs, pieces))
    got = spark.createDataFrame([("there",), ("ein und",), ("12 34",), ("",), (None,), ("the " * 40_000,)], "text string").select(lang("text").alias("x")).collect()
    assert [r.x.lang for r in got] == ["en", "de", "und", "und", "und", "en"]
    none = langid.identifier(spark, langid.train(docs.limit(0), pieces))
    assert docs.select(none("text").lang).distinct().collect()[0][0] == "und"


def test_language_model(spark, stored):
    docs = stored
    held = F.coalesce(F.col("doc_id") % 10 == 0, F.lit(False))
    texts = [(-1 if d is None else d, WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))) for d, t in rows_of(docs)]
    counts = Counter(w for d, ws in texts if d % 10 for w in [*ws, ""])
    n, v = sum(counts.values()), len(counts)
    want = sorted((d, d % 10 == 0, len(ws) + 1, sum(counts[w] > 0 for w in [*ws, ""]), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*ws, ""])) for d, ws in texts)
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in mixing.scores(docs, held).collect())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-6)
    assert all(g[6] < 0 for g in got)
    assert sum(g[6] for g in got) > sum(g[5] for g in got) * 1.3
    assert mixing.scores(docs.limit(0), held).count() == 0


def test_language_model_learns_what_follows(spark):
    rng = np.random.default_rng(8)
    pairs = [(f"head{k}", f"tail{(k * 7) % 40}") for k in range(40)]
    texts = [" ".join(w for k in rng.integers(0, 40, 60) for w in pairs[k]) for _ in range(120)]
    texts[1] = " ".join(rng.permutation(texts[0].split()))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in mixing.scores(docs, F.col("doc_id") < 2).collect()}
    assert math.isclose(got[0].base_score, got[1].base_score, rel_tol=1e-9)
    assert got[0].score > got[1].score * 0.8
    size = len(texts[0]) + 2
    assert math.isclose(got[0].bits_per_byte, -got[0].score * math.log2(10) / size, rel_tol=1e-9)


def test_language_model_predicts_whole_words(spark):
    rng = np.random.default_rng(9)
    after = rng.permutation(512)
    texts = [" ".join(w for k in rng.integers(0, 512, 100) for w in (f"head{k}", f"tail{after[k]}")) for _ in range(300)]
    texts[1] = " ".join(rng.permutation(texts[0].split()))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in mixing.scores(docs, F.col("doc_id") < 2).collect()}
    # of two words the second follows from the first: its code of about 10 bits costs next to nothing
    assert got[0].score > got[0].base_score * 0.65 and got[0].score > got[1].score * 0.6


def test_language_model_bytes():
    for text in ("A\u00a0b\u3000c \u00c9\x0bD\x1ce\x85f\tg\r\n\x0c h", "", "  ", "\u0130I"):
        assert [w.decode() for w in mixing.tokens(text.encode())] == WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text))
    assert mixing.tokens(None) == []


def test_language_model_code():
    weights = [5, 1, 1, 9, 30, 2]
    code = mixing.Code(weights)
    paths = {}
    for k in range(len(weights)):
        at = slice(code.offset[k], code.offset[k] + code.length[k])
        paths[k] = tuple(zip(code.node[at].tolist(), code.bit[at].tolist(), strict=True))
    assert sum(2.0 ** -len(p) for p in paths.values()) == 1
    assert len({tuple(b for _, b in p) for p in paths.values()}) == len(weights) and len(paths[4]) == 1
    # a node stands for the bits before it
    before = {node: tuple(b for _, b in p[:k]) for p in paths.values() for k, (node, _) in enumerate(p)}
    assert all(before[node] == tuple(b for _, b in p[:k]) for p in paths.values() for k, (node, _) in enumerate(p)) and len(before) == len(weights) - 1
    cut = mixing.Code(weights, 2)
    assert cut.length.max() == 2
    assert math.isclose(sum(2.0 ** -int(n) * 10**r for n, r in zip(cut.length, cut.rest, strict=True)), 1)
    assert all(cut.bit[cut.offset[k] : cut.offset[k] + cut.length[k]].tolist() == [b for _, b in paths[k][: cut.length[k]]] for k in paths)
    assert mixing.table_bits(30_000_000_000) > mixing.table_bits(25_000_000) > mixing.table_bits(1000)


def test_language_model_against_plain_counts(spark):
    """Counts, mixer and scores of a tiny table, each worked out bit by bit."""
    rng = np.random.default_rng(5)
    texts = [rng.choice([2, 3, 4, 5], 30).tolist() + [mixing.END] for _ in range(4)]
    code = mixing.Code([1, 4, 30, 20, 10, 5])
    lengths = np.array([len(t) for t in texts])
    flat = np.concatenate(texts)
    contexts = mixing.token_contexts(flat, np.cumsum(lengths) - lengths, lengths)
    seen, total = Counter(), 0.0
    slow = []
    for t in texts:
        for k, item in enumerate(t):
            last, before = (t[k - j] if k >= j else mixing.END for j in (1, 2))
            for b in range(int(code.length[item])):
                at = code.offset[item] + b
                for c, ctx in enumerate(((), (last,), (last, before), (before,))):
                    seen[c, ctx, int(code.node[at]), int(code.bit[at])] += 1
                slow.append([(c, ctx, int(code.node[at]), int(code.bit[at])) for c, ctx in enumerate(((), (last,), (last, before), (before,)))])
    counts = np.zeros(2 * (mixing.PREDICTORS << 16), np.uint32)
    quick = []
    for _, node, bit, at in mixing.planes(code, flat, contexts, 16):
        np.add.at(counts, (2 * at + bit).ravel(), 1)
        quick += [(a, int(b), int(n)) for a, b, n in zip(at.T.tolist(), bit, node, strict=True)]
    assert len(quick) == len(slow)
    for (at, bit, node), keys in zip(quick, slow, strict=True):
        assert (node, bit) == keys[0][2:]
        assert [int(counts[2 * a + bit]) for a in at] == [seen[k] for k in keys]
    packed = counts[::2] << np.uint32(16) | counts[1::2]
    ready, mixer = mixing.Ready(packed), mixing.Mixer()
    for owner, node, bit, at in mixing.planes(code, flat, contexts, 16):
        x, gate = ready.inputs(at, 16)
        p = mixer.refined(node & 255, mixer.mixed(x, gate))
        for j in range(len(owner)):
            dot = sum(float(np.float32(0.2)) * math.log((seen[k[0], k[1], k[2], 1] + 0.05) / (seen[k[0], k[1], k[2], 0] + 0.05)) for k in slow[j])
            assert math.isclose(p[j], 1 / (1 + math.exp(-dot)), abs_tol=5e-3)


def test_workers_give_freed_memory_back():
    import pyarrow as pa

    def held():
        return sum(map(int, re.findall(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    kept = [pa.array([f"a text of some length {k} {n}" * 20 for k in range(2000)]) for n in range(60)]
    small = [bytearray(60_000) for _ in range(1500)]
    last = small[-1]
    del kept, small
    before = held()
    jaccard.released()
    assert held() < before - 20 and len(last) == 60_000


def test_language_model_counts_pieces_and_distinct_contexts_once():
    """Counting by outcomes of pieces, and by distinct contexts with their numbers, is counting bit by bit."""
    rng = np.random.default_rng(6)
    code = mixing.Code([1, 4, *(int(2000 / k) for k in range(1, 60))])
    lengths = np.array([40, 1, 300, 60])
    flat = np.minimum(rng.zipf(1.3, lengths.sum()) + 1, 60).astype("u4")
    starts = np.cumsum(lengths) - lengths
    contexts = mixing.token_contexts(flat, starts, lengths)
    slow = np.zeros(2 * (mixing.PREDICTORS << 16), np.int64)
    for _, _, bit, at in mixing.planes(code, flat, contexts, 16):
        np.add.at(slow, (2 * at + bit).ravel(), 1)
    items, own, place = mixing.distinct(flat, starts, lengths)
    assert len(items) < len(flat) and (items[place] == flat).all() and (own[:, place] == contexts).all()
    for stream in ((flat, contexts, None), (items, own, np.bincount(place))):
        got = list(mixing._counted(SimpleNamespace(value=code), 16, 4, lambda _, s=stream: iter([s]))([None]))
        for name, k in (("zeros", 0), ("ones", 1)):
            assert (np.concatenate([np.frombuffer(mixing._unzip(r[name][0]), "<u4") for r in got]) == slow[k::2]).all()
    some = np.arange(len(flat)) % 3 > 0
    items, own, place = mixing.distinct(flat, starts, lengths, some)
    assert (items[place] == flat[some]).all() and (own[:, place] == contexts[:, some]).all()
    large = np.array([1 << 22, 3, 1 << 22, 3], "u4")
    items, own, place = mixing.distinct(large, np.array([0]), np.array([4]))
    assert (items[place] == large).all() and (own[:, place] == mixing.token_contexts(large, np.array([0]), np.array([4]))).all()


def _block(texts, held):
    lengths = np.array([len(t) for t in texts])
    whole = np.zeros((6, len(texts)), "<i8")
    whole[2], whole[3] = held, lengths
    body = np.array([len(texts)], "<i8").tobytes() + whole.tobytes() + np.zeros((2, len(texts)), "<f8").tobytes() + np.concatenate(texts).astype("<u4").tobytes()
    return pd.DataFrame({"docs": [mixing._zip(body)]}), lengths


def test_language_model_learns_from_all_training_tokens_in_bounded_memory(monkeypatch):
    """Contexts are made for some tokens at a time; all training tokens are there, equal ones once with their number; to learn from a bit that stands for many is to learn from each."""
    monkeypatch.setattr(mixing, "MADE", 50)
    rng = np.random.default_rng(7)
    texts = [np.append(np.minimum(rng.zipf(1.3, n) + 1, 60), mixing.END) for n in (400, 0, 300, 90)]
    pdf, lengths = _block(texts, [0, 0, 1, 0])
    flat, train = np.concatenate(texts).astype("u4"), np.repeat([True, True, False, True], lengths)
    contexts = mixing.token_contexts(flat, np.cumsum(lengths) - lengths, lengths)
    want = Counter(zip(flat[train].tolist(), *contexts[:, train].tolist(), strict=True))
    for stream in (mixing.trained_tokens, mixing.mixed_tokens):
        got, n = Counter(), []
        for items, own, weights in stream(pdf):
            got.update(dict(zip(zip(items.tolist(), *own.tolist(), strict=True), weights.tolist(), strict=True)))
            n.append(len(items))
        assert got == want and max(n) == 50 and sum(n) == len(want)
    assert not list(mixing.mixed_tokens(_block(texts, [1] * 4)[0]))

    size = 500
    node, bit, gate = rng.integers(0, 256, size).astype("u2"), rng.integers(0, 2, size).astype("u1"), rng.integers(0, mixing.GATES + 1, size).astype("u1")
    x, times = [rng.normal(size=size).astype("f4") for _ in range(mixing.PREDICTORS)], rng.integers(1, 9, size)
    one, each = mixing.Mixer(), mixing.Mixer()
    one.learn(node, bit, [y.copy() for y in x], gate, times=times.astype("f4"))
    each.learn(*(np.repeat(y, times) for y in (node, bit)), [np.repeat(y, times) for y in x], np.repeat(gate, times))
    for a, b in zip(one.state(), each.state(), strict=True):
        assert np.allclose(a, b, atol=1e-5)


def test_bits_left_out_are_tabled():
    """What a bit is learnt from, its own count left out, is looked up, as is how often its contexts came without it."""
    rng = np.random.default_rng(8)
    code, bits = mixing.Code(rng.integers(1, 500, 300).tolist()), 12
    zeros, ones = rng.integers(1, 40, (2, mixing.PREDICTORS << bits)).astype("u4")
    left = mixing.Left(zeros << np.uint32(16) | ones)
    items = rng.integers(0, 300, 500).astype("u4")
    contexts = np.concatenate([np.zeros((1, 500), "u8"), rng.integers(0, 1 << 40, (mixing.PREDICTORS - 1, 500)).astype("u8")])
    _, n, piece, line = next(mixing.lines(code, items, contexts, bits, 1))
    x, gate = left.of_pieces(code, piece, line, bits)
    live = code.slots[piece].ravel() > 0
    _, _, bit, at = next(mixing.planes(code, items, contexts, bits))
    z, o = zeros[at] - (bit == 0), ones[at] - (bit == 1)
    assert np.allclose(np.stack(x)[:, live], np.log((o + mixing.PRIOR) / (z + mixing.PRIOR)), atol=1e-5)
    one, two = (mixing.LEVELS[(z + o)[k]].astype(int) for k in mixing.GATED)
    assert (gate[live] == 6 * one + two).all() and (gate[~live] == mixing.GATES).all()


def test_language_model_spreads_words_with_one_head(spark):
    n = Counter(mixing.bucket_of(f"http://host/{k}".encode(), 16) for k in range(4000))
    assert len(n) == 16 and max(n.values()) < 500
    docs = spark.createDataFrame([(0, "日本語" * 60_000), (1, " ".join(f"http://host/{k}" for k in range(3000))), (2, "日本語")], "doc_id long, text string")
    got = {r.doc_id: r for r in mixing.scores(docs, F.col("doc_id") == 2).collect()}
    assert got[1].n_tokens == 3001 and got[0].bits_per_byte < 1 and all(r.score < 0 for r in got.values())


def test_secret_candidates_are_whole():
    for text, value in [
        ('AUTH_TOKEN_FOR_STAGING_SERVICE = "hunter2!x"', "hunter2!x"),
        ("password" + " " * 24 + "= hunter2!x", "hunter2!x"),
        ("password:          hunter2!x", "hunter2!x"),
        ('password = "ab=cd:ef9!"', "ab=cd:ef9!"),
        ("password=abcdef=Rest12!x and", "abcdef=Rest12!x"),
        ("secret: 'two words 1' x", "two words 1"),
        ('token = "open12', "open12"),
        ('{"password":"a\\\\"b12345"}', 'a\\\\"b12345'),
    ]:
        text, value = text.replace("\\\\", "\\"), value.replace("\\\\", "\\")
        assert [text[a:z] for a, z, _ in secrets.candidates(text)] == [value], text
    assert secrets.candidates("token=" * 200_000 + "end") != []
    see = secrets.Features(["hello", "world"])
    assert see.coverage("1" * 2048 + "hello" * 400 + "1" * 48) == 2000 / 4096
    assert see.coverage("a1" * 100_000) == 0
    assert see.coverage("xhello-worldx") == 10 / 13


def test_hot_keys_are_joined_whole(spark):
    rows = [(1, k) for k in range(3000)] + [(2 + k // 2, k) for k in range(100)] + [(None, 5)]
    df = spark.createDataFrame(rows, "key long, row long")
    counts = df.groupBy("key").agg(F.count("*").alias("k"), F.min("row").alias("first")).filter("k > 1")
    want = [(a, b, 3000 if a == 1 else 2, 0 if a == 1 else (a - 2) * 2) for a, b in rows if a is not None]
    got = joined(df, counts, ["key"])
    assert sorted(map(tuple, got.select("key", "row", "k", "first").collect())) == sorted(want)
    left = joined(df, counts, ["key"], how="left")
    assert left.columns == got.columns and left.count() == len(rows)
    assert left.filter("key is null").first().k is None
