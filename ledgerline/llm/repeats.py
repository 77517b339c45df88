"""Long repeats by enhanced suffix arrays over content-picked suffixes, and passages of many words that documents share."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import drop, staged
from .common import among, joined, marked, without

GRAM, WORD_GRAM = 32, 8
WORD = re.compile("[^\x20\x09-\x0d]+")
_PLACE = (1 << 20) - 1
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_M, _X = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_words: dict[str, int] = {}


def _hashed(h: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` items from each place, from those of single items, by doubling."""
    out, done, step = None, 0, 1
    while True:
        if width & step:
            part = h[done : len(h) - (width - done - step)] if width > done + step else h[done:]
            out = part if out is None else out[: len(part)] * _X + (part ^ (part >> np.uint64(29)))
            done += step
        if done == width:
            return out * _X
        h = h[:-step] * _M + h[step:]
        h ^= h >> np.uint64(31)
        step *= 2


def _bytes(b: np.ndarray) -> np.ndarray:
    h = (b.astype(np.uint64) + np.uint64(1)) * _X
    return h ^ (h >> np.uint64(29))


def _word_hashes(text: str) -> np.ndarray:
    words = WORD.findall(text)
    if len(_words) > 100_000:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    m = x
    while step * 2 <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    rest = width - step
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def _monotonous(b: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Stretches of a period up to 8 bytes that hold more than one window of that period: every byte is repeated in the stretch itself."""
    out, body = [], b.tobytes()
    step = max(1, length - 16)  # such a stretch holds one of these places and the eight bytes from it
    for d in range(1, 9):
        if length > 16 and not any(body[p : p + 8] == body[p + d : p + d + 8] for p in range(0, len(body), step)):
            continue
        breaks = np.flatnonzero(b[:-d] != b[d:])
        edges = np.concatenate([[-1], breaks, [len(b) - d]])
        for k in np.flatnonzero(np.diff(edges) > length):
            out.append((int(edges[k]) + 1, int(edges[k + 1]) + d))
    return out


def anchors(items: np.ndarray, length: int, gram: int, single, sure: list[tuple[int, int]] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes, and the first and last window that each serves.

    A window (``length`` items) is served by its gram of least hash, the leftmost of equals; that depends on
    the window's items alone, so equal windows are served at the same distance. Windows deep in a stretch of a short period (``sure``)
    need none: the stretch covers itself, and the windows near its ends stand for them."""
    parts, block, width = [], (1 << 19), length - gram + 1
    for start in range(0, max(0, len(items) - length + 1), block):
        h = _hashed(single(items[start : start + block + length - 1]), gram)
        key = h & ~np.uint64(_PLACE) | np.arange(len(h), dtype=np.uint64)
        m = _window_min(key, width)
        for a, z in sure:
            inner = slice(max(0, a + 512 - start), max(0, z - length - 512 - start))
            m[inner] = _NONE
        first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        last = np.append(first[1:], len(m)) - 1
        v = m[first]
        keep = v != _NONE
        v, first, last = v[keep], first[keep], last[keep]
        parts.append(((v & np.uint64(_PLACE)).astype(np.int64) + start, (v & ~np.uint64(_PLACE)).view(np.int64), first + start, last + start))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 4


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class IntervalTree:
    """The common-prefix intervals of suffixes from equal grams, scanned by a stack, smaller sets merged into larger ones.

    ``lefts`` are the bytes before each suffix, reversed; ``rights`` the bytes from it. An interval of depth r holds all suffixes
    whose first r bytes agree. Its members stand in the order of their lefts, so those that share a left extension are neighbours."""

    def __init__(self, lefts: list[bytes], rights: list[bytes], length: int):
        self.n, self.length = len(rights), length
        self.item = sorted(range(self.n), key=lefts.__getitem__)
        self.rank = [0] * self.n
        for k, i in enumerate(self.item):
            self.rank[i] = k
        left = [lefts[i] for i in self.item]
        #: common left extension of each rank with the next
        self.shared = np.array([common_prefix(a, b) for a, b in zip(left, left[1:], strict=False)] + [0], np.int64)
        self.order = sorted(range(self.n), key=rights.__getitem__)
        self.depths = [common_prefix(rights[a], rights[b]) for a, b in zip(self.order, self.order[1:], strict=False)]

    @staticmethod
    def _merged(one: list[int], two: list[int]) -> list[int]:
        large, small = (one, two) if len(one) >= len(two) else (two, one)
        if len(small) * 8 > len(large):
            return sorted(large + small)
        for x in small:
            large.insert(bisect_left(large, x), x)
        return large

    def scan(self) -> Iterator[tuple[int, list[int]]]:
        """(depth, members as ranks in order) of each interval, deepest first on each path; members change when the scan goes on."""
        stack: list[tuple[int, list[int]]] = []
        if not self.n:
            return
        run = [self.rank[self.order[0]]]
        for k in range(1, self.n + 1):
            depth = self.depths[k - 1] if k < self.n else -1
            while stack and stack[-1][0] >= depth:
                d, other = stack.pop()
                run = self._merged(other, run)
                if not (stack and stack[-1][0] == d) and d > depth:
                    yield d, run
            if k < self.n:
                stack.append((depth, run))
                run = [self.rank[self.order[k]]]

    def runs(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Maximal repeats of ``length`` bytes at least: (bytes before, bytes after, all their occurrences as ranks). A run of neighbours in an interval counts where their extensions differ beyond what they share, so that none can be lengthened."""
        for depth, members in self.scan():
            at = np.array(members)
            shared = np.minimum.reduceat(self.shared[: at[-1]], at[:-1])
            need = max(0, self.length - depth)
            if shared.max() < need:
                continue
            stack: list[tuple[int, int]] = []  # extension, first member
            for k, e in enumerate([*shared.tolist(), -1]):
                start = k
                while stack and stack[-1][0] > e:
                    ext, start = stack.pop()
                    if ext >= need:
                        yield ext, depth, at[start : k + 1]
                if not stack or stack[-1][0] < e:
                    stack.append((e, start))

    def repeats(self) -> Iterator[tuple[int, int, list[int]]]:
        """As ``runs``, occurrences as places in what was given."""
        for before, after, ranks in self.runs():
            yield before, after, [self.item[x] for x in ranks]

    def covered(self) -> np.ndarray:
        """For each suffix the bytes before and after it that its repeats cover; -1, -1 if it has none."""
        most = np.full((self.n, 2), -1, np.int64)
        for before, after, ranks in self.runs():
            most[ranks] = np.maximum(most[ranks], (before, after))
        out = np.empty_like(most)
        out[self.item] = most
        return out


def _marks(body: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of a digest of each piece of ``body``."""
    return np.frombuffer(b"".join([hashlib.blake2b(body[a:z], digest_size=8).digest() for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]), np.int64)


def _scanned(length: int, passage: int):
    """Documents with their size, SHA-256, number of words and, as arrays, anchors: of windows of bytes (place, and how far their windows reach before and after it) and of windows of words (first and last window). An anchor's mark, beside its hash, tells what its windows hold: its context."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packed = zstandard.ZstdCompressor(level=1).compress
        for whole in batches:
            for start in range(0, len(whole), 500):
                pdf = whole.iloc[start : start + 500].reset_index(drop=True)
                out = []
                for text in pdf.text:
                    body = text.encode("utf-8", "surrogatepass")
                    b, words = np.frombuffer(body, np.uint8), _word_hashes(text)
                    sure = _monotonous(b, length) if len(b) >= length else []
                    place, h, first, last = anchors(b, length, GRAM, _bytes, sure)
                    _, wh, wfirst, wlast = anchors(words, passage, WORD_GRAM, lambda x: x)
                    mark = _marks(body, first, last + length) ^ (place - first)
                    wmark = _marks(words.tobytes(), 8 * wfirst, 8 * (wlast + passage))
                    columns = (np.concatenate(x) for x in ((h, wh ^ 1), (mark, wmark), (place, wfirst), (place - first, wlast), (last + length - place, np.full(len(wh), -1))))
                    out.append((packed(body), len(body), len(words), hashlib.sha256(body).digest(), *columns, [x for s in sure for x in s]))
                yield pd.concat([pdf[["row", "doc"]], pd.DataFrame(out, columns=["body", "n", "n_words", "sha", "hash", "mark", "place", "before", "after", "sure"])], axis=1)

    return run


SCANNED = "row long, doc {key}, body binary, n long, n_words long, sha binary, hash array<long>, mark array<long>, place array<long>, before array<long>, after array<long>, sure array<long>"
CONTEXTS = "key long, low int, high int, mark binary, row long, place long, left binary, right binary"
DISTINCT = "key long, k long, low int, high int, row long, place long, left binary, right binary"
#: Slots of the bitmap that tells hashes which recur: 4,096 bitmaps of 32,768, 16 MB. Where many share a slot, more is compared, to the same result.
SLOTS = 1 << 27
#: Bits of a hash by which tasks tell whether it recurs; the low ones are its slot.
TOLD = 36


def _slot(name: str) -> Column:
    return F.shiftright(name, 20).bitwiseAND(SLOTS - 1)


def _dealt(deal: int):
    """A task's hashes as sorted numbers of ``TOLD`` bits, the slot's first, in 2^``deal`` parts; each twice if it came more often. They travel as differences, in planes of bytes."""

    def parted(held: list[np.ndarray]) -> pa.RecordBatch:
        told = np.concatenate(held).view("u8") >> np.uint64(20) & np.uint64((1 << TOLD) - 1)
        beyond = np.uint64(TOLD - SLOTS.bit_length() + 1)
        told = np.sort((told & np.uint64(SLOTS - 1)) << beyond | told >> np.uint64(SLOTS.bit_length() - 1))
        told = told[np.concatenate([[True] * 2, told[2:] != told[:-2]])[: len(told)]]
        packed, part, body = zstandard.ZstdCompressor(level=1).compress, [], []
        cuts = np.searchsorted(told, np.arange((1 << deal) + 1, dtype="u8") << np.uint64(TOLD - deal))
        for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if z > a:
                steps = np.diff(told[a:z], prepend=np.uint64(0)).astype("<u8")
                part.append(k)
                body.append(packed(steps.view("u1").reshape(-1, 8)[:, :5].T.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(body, pa.binary())], ["part", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            n += len(held[-1])
            if n > 4_000_000:
                yield parted(held)
                held, n = [], 0
        if n:
            yield parted(held)

    return run


def _twice(pdf: pd.DataFrame) -> pd.DataFrame:
    """Bitmaps of the slots of numbers that came more than once, see ``common.bitmaps``."""
    unpacked, found = zstandard.ZstdDecompressor().decompress, []
    for body in pdf.body:
        planes = np.frombuffer(unpacked(body), "u1").reshape(5, -1)
        steps = np.zeros((planes.shape[1], 8), "u1")
        steps[:, :5] = planes.T
        found.append(np.cumsum(steps.view("<u8").ravel(), dtype="u8"))
    told = np.sort(np.concatenate(found))
    slots = np.unique(told[1:][told[1:] == told[:-1]] >> np.uint64(TOLD - SLOTS.bit_length() + 1)).astype("i8")
    parts, cuts = np.unique(slots >> 15, return_index=True)
    out = []
    for part, own in zip(parts.tolist(), np.split(slots & 32767, cuts[1:]), strict=True) if len(parts) else ():
        flags = np.zeros(32768, bool)
        flags[own] = True
        out.append((part, np.packbits(flags, bitorder="little").view(">i8").astype("i8")))
    return pd.DataFrame(out, columns=["__part", "__bits"])


def recurring(df: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose hash in ``column`` occurs more than once, with few others: told by ``TOLD`` bits of it, which need a fraction of the bytes that grouping takes, and kept by the bitmap of their slots."""
    deal = min(12, max(2, (df.count() >> 18).bit_length()))
    maps = df.select(column).mapInArrow(_dealt(deal), "part int, body binary").groupBy("part").applyInPandas(_twice, "__part long, __bits array<long>")
    return marked(df, staged(maps, "bitmaps"), _slot(column))


def _mark(key: int, left: bytes, right: bytes) -> bytes:
    """Tells contexts of a group by 128 bits."""
    return hashlib.blake2b(left + right, digest_size=16, salt=int(key).to_bytes(8, "little", signed=True), person=len(left).to_bytes(8, "little")).digest()


def _framed(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "low", "high", "mark", "row", "place", "left", "right"])


def _contexts(length: int):
    """A row for each anchor of bytes: what its windows hold of what is before it, reversed, and of what is from it on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, unpacked = ["key", "k", "low", "high", "row", "place", "left", "right"], zstandard.ZstdDecompressor().decompress
        for pdf in batches:
            out = []
            for row, body, *at in zip(pdf.row, map(unpacked, pdf.body), pdf.hash, pdf.contexts, pdf.place, pdf.before, pdf.after, strict=True):
                for h, k, p, before, after in zip(*at, strict=True):
                    if after >= 0:
                        out.append((h, k, 0, length - GRAM, row, p, body[p - before : p][::-1], body[p : p + after]))
                if len(out) > 5_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)

    return run


def _halved(length: int):
    """Contexts of a group that is too large for one tree, under longer keys: windows with few bytes before the anchor agree in more bytes from it on, the others in more bytes before it. Each half's windows lie within its cut contexts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, low, high, row, place, left, right in zip(pdf.key, pdf.low, pdf.high, pdf.row, pdf.place, pdf.left, pdf.right, strict=True):
                mid = (low + high) // 2
                for a, z, agreed in ((low, mid, right[: length - mid]), (mid + 1, high, left[: mid + 1])):
                    le, ri = left[:z], right[: length - a]
                    if a <= z and len(le) >= a and len(ri) >= length - z:
                        own = hashlib.blake2b(agreed, digest_size=8, key=int(key).to_bytes(8, "little", signed=True), salt=int(a).to_bytes(8, "little")).digest()
                        own = int.from_bytes(own, "little", signed=True)
                        out.append((own, a, z, _mark(own, le, ri), row, place, le, ri))
            yield _framed(out)

    return run


def _columns(parts: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("window", "row", "start", "wide"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))


def _windows(passage: int):
    """(hash, row, start, wide) of the windows of words of anchors; ``wide``: more than one document has the anchor's context."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpacked = zstandard.ZstdDecompressor().decompress
        out, held = [], 0  # many texts' windows go on in one batch
        for pdf in batches:
            for row, body, first, last, after, wide in zip(pdf.row, pdf.body, pdf.place, pdf.before, pdf.after, pdf.wide, strict=True):
                words = np.flatnonzero(after == -1)
                if len(words):
                    hashes = _hashed(_word_hashes(unpacked(body).decode("utf-8", "surrogatepass")), passage).view(np.int64)
                    n = (last - first + 1)[words]
                    starts = np.repeat(first[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    out.append((hashes[starts], np.full(len(starts), row), starts, np.repeat(wide[words].astype(bool), n)))
                    held += len(starts)
                if held > 100_000:
                    yield _columns(out)
                    out, held = [], 0
        if out:
            yield _columns(out)

    return run


def _group_spans(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        keys, row, place = pdf.key.to_numpy(), pdf.row.to_numpy(), pdf.place.to_numpy()
        left, right = pdf.left.tolist(), pdf.right.tolist()
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        cover = [IntervalTree(left[a:z], right[a:z], length).covered() for a, z in zip(cuts, cuts[1:], strict=False)]
        before, after = np.concatenate(cover).T
        got = after >= 0
        return pd.DataFrame({"row": row[got], "start": (place - before)[got], "end": (place + after)[got]}, dtype="int64")

    return run


def _spans(distinct: DataFrame, length: int, most_group: int) -> DataFrame:
    """(row, start, end) of what repeats cover around the anchors of distinct contexts; ``k``: how many have the key."""
    spec = "row long, start long, end long"
    found = []
    while True:
        small = distinct.filter(F.col("k") <= most_group)
        bucket = F.pmod(F.xxhash64("key"), F.lit(max(1, small.count() // 5_000)))
        small = small.select("key", "row", "place", "left", "right", bucket.alias("bucket"))
        found.append(staged(small.groupBy("bucket").applyInPandas(_group_spans(length), spec), "repeat-spans"))
        large = distinct.filter(F.col("k") > most_group)
        if large.isEmpty():
            drop(distinct)
            return reduce(DataFrame.unionByName, found)
        contexts = staged(large.drop("k").mapInPandas(_halved(length), CONTEXTS), "repeat-contexts")
        same = staged(contexts.groupBy("mark").agg(F.count("*").alias("k"), F.min(F.struct("row", "place")).alias("first")).filter("k > 1"), "repeat-marks")
        marked = staged(joined(contexts, same, ["mark"], how="left"), "repeat-marked")
        drop(distinct, contexts, same)
        # equal contexts cover each other; one of them goes on
        found.append(marked.filter("k is not null").select("row", (F.col("place") - F.octet_length("left")).alias("start"), (F.col("place") + F.octet_length("right")).alias("end")))
        rest = marked.filter("k is null or (first.row = row and first.place = place)").drop("k", "first", "mark")
        groups = staged(rest.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1"), "repeat-groups")
        distinct = staged(joined(rest, groups, ["key"]), "repeat-contexts")


def _united(starts, ends) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], z)
        else:
            out.append((a, z))
    return out


def _removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    unpacked = zstandard.ZstdDecompressor().decompress
    for pdf in batches:
        out = []
        for row, body, start, end in zip(pdf.row, map(unpacked, pdf.body), pdf.start, pdf.end, strict=True):
            kept, at, spans = [], 0, _united(start, end)
            for a, z in spans:
                kept.append(body[at:a])
                at = z
            kept.append(body[at:])
            out.append((row, sum(z - a for a, z in spans), len(spans), b"".join(kept)))
        yield pd.DataFrame(out, columns=["row", "n_removed", "n_spans", "kept"])


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, passage: int = 51, most_group: int = 5_000, keep_bytes: bool = False) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that starts anywhere else too, in the same document or another.

    Returns key, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, n_passage_words and, with ``keep_bytes``,
    ``kept``, the remaining bytes of documents that lost any (null: all remain). n_passage_words counts the words inside runs of
    ``passage`` words (parted by ASCII blanks) that another document has too; such a run may be shorter than ``length`` bytes, and then is counted only. Null
    texts are empty; texts shorter than ``length`` lose nothing; repeated rows of that length lose all.

    1. Each document gives its anchors: the grams that serve its windows, of bytes and of words, each with a mark of its context, all that its windows hold. Equal whole texts are told by SHA-256; one of each
    takes part, the others leave by bitmaps. 2. Grams that occur once serve no repeat; most leave by a bitmap of those that recur, found by shortened hashes. Equal contexts, told by hash and mark, cover each other without their texts; one of each goes on, if
    its gram has others too: its document is joined with its text and gives the
    suffix from each anchor and what is before it, as far as its windows reach. 3. Distinct contexts of
    equal grams meet in a bucket of bounded size, where an interval tree over their enhanced suffix array gives the maximal repeats with all their
    occurrences. A gram with more than ``most_group`` distinct contexts is parted by longer keys (by what its windows have on one side, halved
    again and again, nine times at most), until each part fits a tree. 4. Windows of words of distinct contexts are counted by 64-bit hashes, those that recur by shortened ones. 5. Spans
    are united a document at a time and cut. Grams, contexts and texts that fill more than a thousandth of the rows are joined by broadcast."""
    docs = df.select(F.col(key).alias("doc"), F.coalesce(text, F.lit("")).alias("text")).select(F.monotonically_increasing_id().alias("row"), "doc", "text")
    seen = staged(docs.mapInPandas(_scanned(length, passage), SCANNED.format(key=df.schema[key].dataType.simpleString())), "repeat-anchors")
    texts = staged(seen.groupBy("sha", "n").agg(F.min("row").alias("first"), F.count("*").alias("copies")).filter("copies > 1"), "repeat-copies")
    light = seen.select("row", "doc", "n", "n_words", "sha", "sure")
    named = staged(joined(light, texts, ["sha", "n"], k="copies", how="left"), "repeat-named")
    later = F.col("first") != F.col("row")  # not for texts that occur once
    firsts = without(seen.select("row", "hash", "mark", "place", "before", "after"), named.filter(later), "row")
    each = firsts.select("row", F.explode(F.arrays_zip("hash", "mark", "place", "before", "after")).alias("x")).select("row", "x.*")
    each = staged(each.withColumn("at", F.monotonically_increasing_id()), "repeat-grams")
    known = named.withColumn("sure", F.when(~F.coalesce(later, F.lit(False)), F.col("sure"))).drop("first")
    again = staged(recurring(each, "hash"), "repeat-again")
    drop(texts, each)
    marks = staged(again.groupBy("hash", "mark").agg(F.count("*").alias("k"), F.min("row").alias("a"), F.max("row").alias("z"), F.min("at").alias("first")), "repeat-marks")
    groups = marks.groupBy("hash").agg(F.count("*").alias("contexts")).filter("contexts > 1")
    several = staged(joined(marks, staged(groups, "repeat-groups"), ["hash"], k="contexts", how="left").filter("k > 1 or contexts > 1"), "repeat-several")
    words = F.col("after") == -1
    held = joined(again, several, ["hash", "mark"])
    covered = F.when(words, F.col("a") != F.col("z")).otherwise(F.col("k") > 1)  # passages count if another document has them
    compared = F.col("contexts").isNotNull() & ((F.col("at") == F.col("first")) | (words & ~covered))
    held = staged(held.select("row", "hash", "contexts", "place", "before", "after", words.alias("words"), covered.alias("covered"), compared.alias("compared")).filter("covered or compared"), "repeat-held")
    drop(again, marks, several)

    at = held.filter("compared").groupBy("row").agg(F.collect_list(F.struct("hash", "contexts", "place", "before", "after", F.col("covered").alias("wide"))).alias("at"))
    at = staged(at.select("row", "at.hash", "at.contexts", "at.place", "at.before", "at.after", "at.wide"), "repeat-compared")
    touched = staged(among(seen.select("row", "body"), at, F.col("row")).join(at, "row"), "repeat-texts")
    drop(at)

    windows = staged(touched.mapInPandas(_windows(passage), "window long, row long, start long, wide boolean"), "repeat-windows")
    shown = staged(recurring(windows, "window"), "repeat-shown")
    often = shown.groupBy("window").agg(F.count("*").alias("k"), F.min("row").alias("a"), F.max("row").alias("z"), F.max("wide").alias("wide")).filter("k > 1 and (a <> z or wide)").select("window", "k")
    often = staged(often, "repeat-passages")
    runs = held.filter("words and covered").select("row", F.col("place").alias("start"), (F.col("before") + passage).alias("end"))
    runs = runs.unionByName(joined(shown, often, ["window"]).select("row", "start", (F.col("start") + passage).alias("end")))
    inside = F.expr("aggregate(s, named_struct('n', 0L, 'upto', 0L), (x, r) -> named_struct('n', x.n + greatest(0L, r.end - greatest(r.start, x.upto)), 'upto', greatest(x.upto, r.end)), x -> x.n)")
    shared = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("s"))
    shared = staged(shared.select("row", inside.alias("inside")), "repeat-inside")
    drop(windows, shown, often)

    spans = _spans(staged(touched.mapInPandas(_contexts(length), DISTINCT), "repeat-contexts"), length, most_group)
    equal = held.filter("covered and not words").select("row", (F.col("place") - F.col("before")).alias("start"), (F.col("place") + F.col("after")).alias("end"))
    stretches = known.filter(F.size("sure") > 0)
    own = stretches.select("row", F.explode(F.expr("transform(sequence(0, size(sure) div 2 - 1), i -> struct(sure[2 * i] as start, sure[2 * i + 1] as end))")).alias("s")).select("row", "s.start", "s.end")
    spans = spans.unionByName(equal).unionByName(own).groupBy("row").agg(F.collect_list("start").alias("start"), F.collect_list("end").alias("end"))
    spans = staged(spans, "repeat-united")
    cut = among(seen.select("row", "body"), spans, F.col("row")).join(spans, "row").mapInPandas(_removed, "row long, n_removed long, n_spans long, kept binary")
    cut = staged(cut.select("row", "n_removed", "n_spans", F.sha2("kept", 256).alias("cut_sha"), *(["kept"] if keep_bytes else [])), "repeat-cut")
    drop(seen, touched, held, spans)
    out = known.join(cut, "row", "left").join(shared, "row", "left")
    all_gone = (F.col("copies") > 1) & (F.col("n") >= length)
    kept = [F.when(all_gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if keep_bytes else []
    return out.select(
        F.col("doc").alias(key),
        F.col("n").alias("n_bytes"),
        F.when(all_gone, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("cut_sha", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when((F.col("copies") > 1) & (F.col("n_words") >= passage), F.col("n_words")).otherwise(F.coalesce("inside", F.lit(0))).alias("n_passage_words"),
        *kept,
    )
