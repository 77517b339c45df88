"""Language identification by unigram pieces, summed over all segmentations."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, sliced

#: Starts a word in the vocabulary.
START = "▁"
#: The probability of a letter that is no piece, in any language.
UNKNOWN = 1e-10
LETTER = re.compile(r"[^\W\d_]")
#: For Java's regular expressions, what str.split() parts words by.
SPACES = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a public sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Pieces:
    """Forward and backward sums over all ways to cut words into pieces. No piece goes over white space, so that a text's probability is the product of its words'."""

    def __init__(self, pieces: list[str], longest: int = 16):
        self.places = {p: k for k, p in enumerate(pieces) if len(p) <= longest}
        self.longest = max(map(len, self.places), default=1)
        # with the beginnings of pieces that are none themselves: beyond what no piece begins with, nothing is looked up
        self.begun = {p[:k]: -2 for p in self.places for k in range(1, len(p))} | self.places

    def cuts(self, words: list[str]) -> np.ndarray:
        """For words of one length n, the places of their pieces: [word, end, length - 1], or -1 for letters that are no piece and -2 for none."""
        get, n = self.begun.get, len(words[0])
        deep = min(n, self.longest)
        out = np.full((len(words), n, deep), -2, np.int32)
        for k, w in enumerate(words):
            row = out[k]
            for i in range(n):
                for j in range(i + 1, min(n, i + deep) + 1):
                    p = get(w[i:j])
                    if j == i + 1 and (p is None or p < 0):
                        row[i, 0] = -1
                    if p is None:
                        break
                    if p >= 0:
                        row[j - 1, j - i - 1] = p
        return out

    @staticmethod
    def forward(cuts: np.ndarray, probs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the segmentations of each prefix, [word, end, language], each end scaled by 10 to the logs that are returned too. ``probs``: [piece, language] with two more rows, for letters that are no piece and for none."""
        w, n, deep = cuts.shape
        a, logs = np.zeros((w, n + 1, probs.shape[1])), np.zeros((w, n + 1, probs.shape[1]))
        a[:, 0] = 1
        for j in range(1, n + 1):
            for k in range(1, min(deep, j) + 1):
                a[:, j] += a[:, j - k] * np.exp(logs[:, j - k] - logs[:, j - 1]) * probs[cuts[:, j - 1, k - 1]]
            scale = a[:, j].copy()
            a[:, j] = 1
            logs[:, j] = logs[:, j - 1] + np.log(scale)
        return a, logs


def _by_length(words: list[str], most: int = 400_000) -> Iterator[list[str]]:
    """Words of one length at a time, in parts whose tables of cuts stay small."""
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for n, group in groups.items():
        step = max(1, most // (n * min(n, 16)))
        yield from (group[k : k + step] for k in range(0, len(group), step))


def word_scores(pieces: Pieces, probs: np.ndarray, words: list[str]) -> dict[str, np.ndarray]:
    """Natural logarithms of the words' probabilities, one for each language."""
    out = {}
    for group in _by_length(words):
        _, logs = pieces.forward(pieces.cuts(group), probs)
        out.update(zip(group, logs[:, -1], strict=True))
    return out


def expected(pieces: Pieces, probs: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected piece counts, [piece, language], given words' counts [word, language]: forward and backward sums."""
    at = {w: k for k, w in enumerate(words)}
    out = np.zeros_like(probs)
    for group in _by_length(words):
        cuts = pieces.cuts(group)
        w, n, deep = cuts.shape
        _, logs = pieces.forward(cuts, probs)
        back = np.full((w, n + 1, probs.shape[1]), -np.inf)
        back[:, n] = 0
        for i in range(n - 1, -1, -1):
            for k in range(1, min(deep, n - i) + 1):
                back[:, i] = np.logaddexp(back[:, i], np.log(probs[cuts[:, i + k - 1, k - 1]], where=probs[cuts[:, i + k - 1, k - 1]] > 0, out=np.full((w, probs.shape[1]), -np.inf)) + back[:, i + k])
        c = counts[[at[x] for x in group]]
        for j in range(1, n + 1):
            for k in range(1, min(deep, j) + 1):
                p = cuts[:, j - 1, k - 1]
                with np.errstate(divide="ignore"):
                    share = np.exp(logs[:, j - k] + np.log(probs[p]) + back[:, j] - logs[:, n])
                np.add.at(out, p, share * c)
    return out


def words_of(text: str) -> list[str]:
    return [START + w for w in text.lower().split()]


def train(labelled: DataFrame, pieces: list[str], key: str = "doc_id", text: str = "text", label: str = "lang", most: int = 8_000, least: int = 200, rounds: int = 2, prior: float = 0.02) -> dict:
    """Piece probabilities of each language, by expectation maximisation.

    Learns from a sample of about ``most`` labelled rows (a documented bound; all, if there are fewer), picked by
    their keys' hashes; a label whose share of it were under ``least`` rows gives that many, or all it has, so that none is lost in a
    large table. Priors are by all labelled rows. Word counts are summed by a shuffle; each round spreads the distinct words over tasks, which
    return expected counts of pieces, and the driver gets their sums: a number for each piece and language. Null labels
    are left out. Without any labelled row, no language is known."""
    rows = labelled.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    rows = bounded_sample(rows, "key", most, of="lang", counts=share, least=least)
    words = rows.select("lang", F.explode(F.split(F.lower("text"), SPACES)).alias("word")).filter(F.col("word") != "")
    words = words.groupBy("lang", F.concat(F.lit(START), "word").alias("word")).agg(F.count("*").alias("n")).persist()
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    column = {x: k for k, x in enumerate(langs)}
    unit = Pieces(pieces)
    probs = np.full((len(pieces) + 2, max(1, len(langs))), 1 / len(pieces))
    probs[-1], probs[-2] = UNKNOWN, 0  # the rows that places -1 and -2 mean
    for _ in range(rounds if langs else 0):

        def sums(batches: Iterator[pd.DataFrame], probs=probs) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(probs)
            for pdf in batches:
                names, codes = np.unique(pdf.word.to_numpy(object), return_inverse=True)
                counts = np.zeros((len(names), probs.shape[1]))
                np.add.at(counts, (codes, pdf.lang.map(column).to_numpy()), pdf.n.to_numpy())
                total += expected(unit, probs, list(names), counts)
            i, j = np.nonzero(total)
            yield pd.DataFrame({"piece": i, "lang": j, "n": total[i, j]})

        got = words.mapInPandas(sums, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros_like(probs)
        for r in got:
            counts[r["piece"], r["lang"]] = r["n"]
        probs = counts + prior
        probs[-2:] = 0
        probs /= probs.sum(axis=0)
        probs[-1] = UNKNOWN
    words.unpersist()
    total = sum(share.values()) or 1
    return {"langs": langs, "pieces": pieces, "probs": probs.astype("f4"), "prior": np.log([share.get(x, 0) / total for x in langs])}


#: A worker's kept words: their rows in the table of logarithms, and whose model they are of.
_kept: dict[str, int] = {}
_kept_for: list = [None]
_logs: list[np.ndarray] = [np.empty((0, 1))]


def identify(model: dict, doc_logs: np.ndarray) -> tuple[str, float]:
    z = doc_logs + model["prior"]
    z = np.exp(z - z.max())
    best = int(np.argmax(z))
    return model["langs"][best], float(z[best] / z.sum())


def identifier(spark, model: dict, most_kept: int = 800_000):
    """A function from a text column to (lang, score): the likeliest language, and its probability given the text.

    A text that is null or has no letter is ``und`` with score 0, as any text is while no language is known. Ties go to the first language in order.
    Whole texts count; each worker keeps the words it has seen last."""
    shared = spark.sparkContext.broadcast(model)  # pieces times languages
    token = uuid.uuid4().hex

    def scored(texts: list[str | None]) -> list[tuple[str, float]]:
        m = shared.value
        if _kept_for[0] != token:
            _kept_for[0] = token
            _kept.clear()
            _logs[0] = np.empty((0, 1))
            m["unit"], m["double"] = Pieces(m["pieces"]), m["probs"].astype("f8")
        elif "unit" not in m:
            m["unit"], m["double"] = Pieces(m["pieces"]), m["probs"].astype("f8")
        out: list = []
        docs = [words_of(t) if t and m["langs"] and LETTER.search(t) else [] for t in texts]
        new = set().union(*docs).difference(_kept)
        if len(_kept) + len(new) > len(_logs[0]):
            _kept.clear()
            new = set().union(*docs)
            _logs[0] = np.empty((max(most_kept, len(new)), m["double"].shape[1]))
        if new:
            found = word_scores(m["unit"], m["double"], list(new))
            first = len(_kept)
            _logs[0][first : first + len(found)] = list(found.values())
            _kept.update(zip(found, range(first, first + len(found)), strict=True))
        place, logs = _kept.__getitem__, _logs[0]
        out += [identify(m, logs[list(map(place, d))].sum(axis=0)) if d else ("und", 0.0) for d in docs]
        return out

    @F.arrow_udf("lang string, score double")
    def lang(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # many texts at once: the sums go over all their new words of one length
        for texts in sliced(batches, 1000):
            got = scored(texts.to_pylist())
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["lang", "score"])

    return lang
