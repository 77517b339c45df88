"""Byte-pair encoding and decoding with a transducer of frequent words."""

from __future__ import annotations

import atexit
import hashlib
import json
import os
import shutil
import struct
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import most_frequent, sliced
from .lexicon import Lexicon, compile_lexicon

#: Unicode's White_Space, which the tokenizer's \s means. str.split() also splits at U+001C to U+001F.
SPACE = regex.compile("[" + "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]+")
ODD = regex.compile("[\x1c-\x1f]")


def _byte_letters() -> list[str]:
    """The printable letter for each byte: itself where it's printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder by a tokenizers file of the kind ``word_bpe_49k.json``: NFC, white space dropped, small letters, words by a pattern, bytes as letters, merges by rank with an end-of-word mark, no decoder (tokens joined by a blank)."""

    def __init__(self, path: str, lexicon: Lexicon | None = None, most_kept: int = 120_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (vocab | self.special).items()}
        self._first = [vocab[c] for c in _byte_letters()]
        self._last = [vocab[c + end] for c in _byte_letters()]
        self._ranks = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self._ranks[vocab[a] << 20 | vocab[b]] = rank << 20 | vocab[a + b]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._words = regex.compile(split["pattern"]["Regex"])
        self._specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.lexicon, self._kept, self._older, self._most = lexicon, {}, {}, most_kept

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word, by merges alone: again and again the pair of least rank, the leftmost first."""
        ids = [self._first[b] for b in word]
        ids[-1] = self._last[word[-1]]
        if len(ids) > 256:
            return self._merge_long(ids)
        get, never = self._ranks.get, 1 << 60
        pairs = [get(a << 20 | b, never) for a, b in zip(ids, ids[1:], strict=False)]
        while pairs and (best := min(pairs)) < never:
            i = pairs.index(best)
            ids[i : i + 2] = [best & 0xFFFFF]
            del pairs[i]
            if i:
                pairs[i - 1] = get(ids[i - 1] << 20 | ids[i], never)
            if i < len(pairs):
                pairs[i] = get(ids[i] << 20 | ids[i + 1], never)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges in n log n steps: pairs in a heap by rank and place, ids linked with their neighbours. A pair that has changed since it was put there is passed over."""
        get, n = self._ranks.get, len(ids)
        before, after = [*range(-1, n - 1)], [*range(1, n + 1)]
        heap = [(best, i) for i in range(n - 1) if (best := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            best, i = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j == n or get(ids[i] << 20 | ids[j]) != best:
                continue
            ids[i], ids[j], after[i] = best & 0xFFFFF, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (new := get(ids[a] << 20 | ids[b])) is not None:
                    heappush(heap, (new, a))
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> list[int]:
        body = word.encode("utf-8")
        found = self.lexicon.get(body) if self.lexicon is not None else None
        return self.merge(body) if found is None else found

    def words(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        return self._words.findall(self._normal(text))

    @staticmethod
    def _normal(text: str) -> str:
        # each letter for itself: no final sigma
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _chunks(self, text: str) -> list[str]:
        text = self._normal(text)
        return SPACE.split(text) if ODD.search(text) else text.split()

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        """Of two generations of kept chunks the younger one is asked first, by the caller; it becomes the older one when it's half of what is kept, so that chunks in use stay."""
        out = self._kept.get(chunk) or self._older.get(chunk)
        if out is None:
            words = self._words.findall(chunk)
            if len(words) == 1 and words[0] == chunk:
                ids, names = self.word(chunk), self.names
                out = struct.pack(f"<{len(ids)}I", *ids), " ".join([names[i] for i in ids])
            else:  # with other signs: its words may be kept
                kept, older = self._kept, self._older
                parts = [kept.get(w) or older.get(w) or self._chunk(w) for w in words]
                out = b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts])
        if 2 * len(self._kept) >= self._most:
            self._kept, self._older = {}, self._kept
        self._kept[chunk] = out
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the whole text; none for null."""
        return np.frombuffer(self.coded(text)[0], "<u4")

    def coded(self, text: str | None) -> tuple[bytes, str]:
        """The ids as little-endian 32-bit numbers, and their decoded text. No word goes over white space, so what lies between is coded on its own and kept for the next time."""
        ids, texts = [], []
        parts = self._specials.split(text or "") if "<|" in (text or "") else [text or ""]
        for k, part in enumerate(parts):
            if k % 2:
                ids.append(np.array([self.special[part]], "<u4").tobytes())
                texts.append(part)
                continue
            get, new = self._kept.get, self._chunk
            got = [get(c) or new(c) for c in self._chunks(part)]
            ids += [a for a, _ in got]
            texts += [b for _, b in got if b]
        return b"".join(ids), " ".join(texts)

    def decode(self, ids) -> str:
        """The tokens of the ids, special ones too, joined by a blank; unknown ids are left out."""
        return " ".join(self.names[i] for i in map(int, ids) if i in self.names)


def frequent_words(df: DataFrame, path: str, text: str = "text", most: int = 50_000, flush: int = 100_000, least: int = 3) -> list[str]:
    """The words with the highest counts over all texts, ``most`` at most.

    Counts are gathered in each task and flushed at ``flush`` different words, without those seen under ``least`` times since the last flush
    (lossy counting: a word's count is low by less than ``least`` a flush), then summed by a shuffle. ``most`` bounds what comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, seen = _codec(path, None), Counter()

        def out(least: int) -> pa.RecordBatch:
            found = Counter()
            for c, n in seen.items():
                if n >= least:
                    for w in codec.words(c):
                        found[w] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in batch["text"]:
                seen.update((t.as_py() or "").lower().split())
                if len(seen) >= flush:
                    yield out(least)
        yield out(least)

    counts = df.select(F.col(text).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return most_frequent(counts, most)


_codecs: dict = {}


def _codec(path: str, lexicon: str | None, most_kept: int = 120_000) -> Codec:
    """One codec for each worker process and lexicon file."""
    key = path, lexicon, most_kept
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(path, Lexicon(SparkFiles.get(lexicon)) if lexicon else None, most_kept)
    return _codecs[key]


def ship_lexicon(df: DataFrame, path: str, text: str = "text", most: int = 50_000) -> str:
    """Compile the texts' frequent words and let Spark bring the file to every executor, now or later; returns its name there."""
    codec = Codec(path)
    file = compile_lexicon({w.encode("utf-8"): codec.merge(w.encode("utf-8")) for w in frequent_words(df, path, text, most)})
    name = f"lexicon-{uuid.uuid4().hex}"
    folder = os.path.realpath(tempfile.mkdtemp(prefix="lexicon-"))
    atexit.register(shutil.rmtree, folder, True)  # the driver serves the file from here as long as it runs
    with open(os.path.join(folder, name), "wb") as f:
        f.write(file)
    df.sparkSession.sparkContext.addFile(os.path.join(folder, name))
    return name


def tokenizer(lexicon: str, path: str):
    """A function from a text column to (ids: binary, little-endian 32-bit; decoded: string). ``path``: the tokenizer's file, on every machine."""

    @F.arrow_udf("ids binary, decoded string")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(path, lexicon)
        for texts in sliced(batches):
            coded = [codec.coded(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([c[k] for c in coded], kind) for k, kind in enumerate((pa.binary(), pa.string()))], ["ids", "decoded"])

    return code


def digests(lexicon: str, path: str, most_kept: int = 400_000):
    """A function from a text column to (n_tokens, ids_sha256, decoded_sha256), without moving ids and texts out of the task. A worker keeps ``most_kept`` chunks of text with their ids, about 300 bytes each."""

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(path, lexicon, most_kept)
        for texts in batches:
            rows = []
            for t in texts:
                ids, decoded = codec.coded(t.as_py())
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()))
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest
