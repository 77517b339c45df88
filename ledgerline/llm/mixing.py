"""Language-model scores by logistic mixing of hashed-context bit predictors."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import staged
from .common import most_frequent, released

#: Predictors of a token's bits: behind nothing, the last token, the last two, and the one before the last. Of a letter's: behind the last 1, 2, 3 and 5 bytes of the word.
PREDICTORS, ORDERS = 4, (1, 2, 3, 5)
#: The predictors whose counts choose the weights.
GATED = (1, 2)
PRIOR = 0.05
INPUTS = PREDICTORS + 1
GATES = 6 * 6
#: Symbols of the token code: a word that is spelled, and the end of a text.
SPELLED, END = 0, 1
#: Bits of a path whose counts stand in one line of a table, so that an item's bits are near each other in memory.
LINE = 4
#: Bits that are worked on at once, and that the mixer learns from in one step.
STEP = 1 << 15
#: Distinct tokens whose contexts are made at once, and those that stay neighbours where the mixer learns from them.
MADE, NEIGHBOURS = 1 << 17, 32
_M, _X, _Y = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


def _zip(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x)


def _unzip(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8, A-Z made small. Of bytes, ``lower`` knows ASCII letters only, and ``split`` parts at ``[\\x20\\x09-\\x0D]+``."""
    return (text or b"").lower().split()


class Numbers(dict):
    """Words as numbers, in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def bucket_of(word: bytes, buckets: int) -> int:
    """By the whole word, so that words with a common head are spread."""
    return zlib.crc32(word) % buckets


BLOCKS = "block long, bucket int, first long, words binary, counts binary, docs binary"


def _pieces(pdf: pd.DataFrame, most_docs: int, most_bytes: int) -> Iterator[pd.DataFrame]:
    sizes = np.fromiter((len(t or b"") for t in pdf.text), np.int64, len(pdf)).cumsum()
    start = 0
    while start < len(pdf):
        base = sizes[start - 1] if start else 0
        stop = min(start + most_docs, max(start + 1, int(np.searchsorted(sizes, base + most_bytes))))
        yield pdf.iloc[start:stop]
        start = stop


def _blocks(buckets: int, most_bytes: int, most_docs: int = 8192):
    """Documents as blocks: for each bucket a block's distinct words (sorted, joined by blanks) with their counts in training texts; and the documents themselves, as numbers of words, in the order of buckets and words. The end of a text is the empty word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for pdf in _pieces(whole, most_docs, most_bytes):
                known = Numbers({b"": 0})
                used = []
                for text in pdf.text:
                    found = tokens(text)
                    found.append(b"")
                    used.append(np.fromiter(map(known.__getitem__, found), np.uint32, len(found)))
                words = list(known)
                own = np.array([bucket_of(w, buckets) for w in words])
                order = np.array(sorted(range(len(words)), key=words.__getitem__))
                order = order[np.argsort(own[order], kind="stable")]
                place = np.empty(len(words), np.uint32)
                place[order] = np.arange(len(words))
                lengths = np.array([len(u) for u in used])
                flat = place[np.concatenate(used)]
                train = np.repeat(~pdf.held_out.to_numpy(bool), lengths)
                counts = np.bincount(flat[train], minlength=len(words)).astype("<u4")
                cuts = np.searchsorted(own[order], np.arange(buckets + 1))
                # a word and the blank behind it; the end counts as one
                long = np.array([len(words[k]) + 1 for k in order])
                sizes = np.add.reduceat(long[flat], np.cumsum(lengths) - lengths)
                head = np.concatenate([[len(pdf)], pdf.doc.fillna(0).to_numpy("i8"), pdf.doc.isna().to_numpy("i8"), pdf.held_out.to_numpy("i8"), lengths, sizes])
                rows = [(block, -1, 0, None, None, _zip(head.astype("<i8").tobytes() + flat.astype("<u4").tobytes()))]
                for b, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if z > a:
                        rows.append((block, b, int(a), _zip(b" ".join([words[k] for k in order[a:z]]) + b" "), _zip(counts[a:z].tobytes()), None))
                del known, used, words, own, order, place, flat, train, long, head
                yield pd.DataFrame(rows, columns=["block", "bucket", "first", "words", "counts", "docs"])
                block += 1
                del rows
        released()

    return run


MERGED = "bucket int, n long, v long, words binary, counts binary, blocks array<long>, firsts array<long>, places array<binary>"


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket's distinct words with their counts in all training texts, and where each block's words are among them."""
    lists = [_unzip(w)[:-1].split(b" ") for w in pdf.words]
    words = sorted(set().union(*lists))
    at = {w: k for k, w in enumerate(words)}
    counts, places = np.zeros(len(words), np.int64), []
    for own, c in zip(lists, pdf.counts, strict=True):
        p = np.fromiter(map(at.__getitem__, own), np.uint32, len(own))
        counts[p] += np.frombuffer(_unzip(c), "<u4")
        places.append(_zip(np.diff(p, prepend=np.uint32(0)).astype("<u4").tobytes()))
    return pd.DataFrame([(int(pdf.bucket.iloc[0]), int(counts.sum()), int((counts > 0).sum()), _zip(b" ".join(words) + b" "), _zip(counts.astype("<i8").tobytes()), pdf.block.tolist(), pdf["first"].tolist(), places)], columns=["bucket", "n", "v", "words", "counts", "blocks", "firsts", "places"])


class Code:
    """Symbols as paths of bits: a Huffman code of their weights. A path's bits stand at ``offset``, each with the node it is decided at.

    With ``most``, longer paths end after so many bits, at a class of symbols; ``rest`` is log10 of a symbol's share of its class by weight."""

    def __init__(self, weights: list[int], most: int | None = None):
        heap = [(w, k) for k, w in enumerate(weights)]
        heapq.heapify(heap)
        parent = np.zeros(2 * len(weights), np.int64)
        side = np.zeros(2 * len(weights), np.uint8)
        top = len(weights)
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = top
            side[j] = 1
            heapq.heappush(heap, (a + b, top))
            top += 1
        depth = np.zeros(top, np.int64)
        for k in range(top - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        self.length = depth[: len(weights)]
        self.offset = np.cumsum(self.length) - self.length
        self.node, self.bit = np.zeros(self.length.sum(), np.uint32), np.zeros(self.length.sum(), np.uint8)
        at, here = self.offset + self.length - 1, np.arange(len(weights))
        for k in range(int(self.length.max(initial=0))):  # from the leaves up
            live = self.length > k
            self.bit[at[live]], self.node[at[live]] = side[here[live]], parent[here[live]] - len(weights)
            here = parent[here]
            at = at - 1
        self.rest = np.zeros(len(weights))
        if most:
            self._cut(np.array(weights, float), most)
        self._lined()

    def _cut(self, weights: np.ndarray, most: int) -> None:
        length = np.minimum(self.length, most)
        offset = np.cumsum(length) - length
        at = np.repeat(self.offset - offset, length) + np.arange(length.sum())
        bit = self.bit[at]
        # the bits before it, behind a one, name a node
        prefix, node, live = np.ones(len(weights), np.int64), np.zeros(len(bit), np.uint32), np.arange(len(weights))
        for k in range(most):
            live = live[length[live] > k]
            node[offset[live] + k] = prefix[live]
            prefix[live] = 2 * prefix[live] + bit[offset[live] + k]
        self.rest = np.log10(weights / np.bincount(prefix, weights)[prefix])
        self.length, self.offset, self.node, self.bit = length, offset, node, bit

    def _lined(self) -> None:
        """Paths in pieces of ``LINE`` bits: those of an item stand at ``first``, each with the node it begins at, and with its bits' nodes, bits and slots in a row. A bit's slot names, within its piece, the bits before it, behind a one; there is none behind a path's end. A piece's outcome is the name of the bits it ends with, behind a one. ``cells`` has a bit's node for the mixer, or 256 behind a path's end; ``turns`` a bit's slot and then the bit, or 0. ``signs`` has 1 for a one, -1 for a zero, or 0."""
        self.pieces = -(-self.length // LINE)
        self.first = np.cumsum(self.pieces) - self.pieces
        place = np.arange(len(self.bit)) - np.repeat(self.offset, self.length)
        to = np.repeat(LINE * self.first, self.length) + place
        shape = (int(self.pieces.sum()), LINE)
        self.nodes, self.bits, self.slots = np.zeros(shape, "u4"), np.zeros(shape, "u1"), np.zeros(shape, "u1")
        self.nodes.ravel()[to], self.bits.ravel()[to], self.slots.ravel()[to] = self.node, self.bit, 1
        for k in range(1, LINE):
            self.slots[:, k] *= 2 * self.slots[:, k - 1] + self.bits[:, k - 1]
        self.start = self.nodes[:, 0].astype(np.uint64) * _X
        self.outcomes = (2 * self.slots.astype(np.int64) + self.bits).max(axis=1)
        self.cells = np.where(self.slots > 0, self.nodes & np.uint32(255), 256).astype("u2")
        self.turns = 2 * self.slots + self.bits
        self.signs = np.where(self.slots > 0, np.where(self.bits > 0, 1, -1), 0).astype("i1")
        self.own = np.where(self.slots > 0, np.where(self.bits > 0, 1, 1 << 16), 0).astype("<u4")


def lines(code: Code, items: np.ndarray, contexts: np.ndarray, bits: int, least: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """The items' pieces in steps of ``STEP`` bits: (first item, pieces of each item, piece, where the piece's line begins in each table from ``least`` on). A context is hashed with the node that a piece of a path begins at; the piece's nodes are neighbours."""
    ends = np.cumsum(code.length[items])
    total = int(ends[-1]) if len(ends) else 0
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(STEP, total, STEP)), [len(items)]]))
    for a, z in zip(cuts, cuts[1:], strict=False):
        own = items[a:z]
        n = code.pieces[own]
        piece = np.repeat(code.first[own] - (np.cumsum(n) - n), n)
        piece += np.arange(len(piece))
        start = code.start.take(piece)
        yield int(a), n, piece, [_line(np.repeat(contexts[k, a:z], n), start, k, bits) for k in range(least, PREDICTORS)]


def _line(context: np.ndarray, start: np.ndarray, k: int, bits: int) -> np.ndarray:
    line = context ^ start
    line *= _M
    line >>= np.uint64(64 - bits + LINE)
    line = line.view(np.int64)
    line <<= LINE
    line += k << bits
    return line


def _spots(line: np.ndarray, slots: np.ndarray) -> np.ndarray:
    at = np.repeat(line, LINE)
    at += slots
    return at


def _alone(code: Code, bits: int) -> np.ndarray:
    """The places of all the code's bits for the first predictor where it sees nothing: they depend on the piece alone."""
    return _spots(_line(np.zeros(len(code.start), np.uint64), code.start, 0, bits), code.slots.ravel())


def planes(code: Code, items: np.ndarray, contexts: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The items' bits, one by one, in steps: (item of each bit, node, bit, the predictors' places in the tables)."""
    lengths = code.length[items]
    for a, n, piece, line in lines(code, items, contexts, bits):
        slots = code.slots.take(piece, axis=0).ravel()
        live = np.flatnonzero(slots)
        z = a + len(n)
        yield np.repeat(np.arange(a, z), lengths[a:z]), code.nodes.take(piece, axis=0).ravel().take(live), code.bits.take(piece, axis=0).ravel().take(live), np.stack([_spots(x, slots).take(live) for x in line])


def _before(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """The last token and the one before it, plus one; a text begins behind ends."""
    out = []
    for k in (1, 2):
        ids = np.full(len(flat), END + 1, np.uint64)
        ids[k:] = flat[:-k]
        ids[k:] += np.uint64(1)
        for j in range(k):
            ids[starts[lengths > j] + j] = END + 1
        out.append(ids)
    return out


def _contexts(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    return np.stack([np.zeros(len(last), np.uint64), last * _Y, (last + before * _M) * _X, before * _M + np.uint64(7)])


def token_contexts(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What each predictor sees before each token."""
    return _contexts(*_before(flat, starts, lengths))


#: Bits of a token's number in a key of three.
WIDE = np.uint64(21)


def keyed(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, some: np.ndarray | None = None) -> np.ndarray | None:
    """Each token (of those marked by ``some``, or all) with the two before it as a number; equal contexts are neighbours in its order. None if there are more than two million words, which don't fit it."""
    if int(flat.max(initial=0)) >= (1 << int(WIDE)) - 1:
        return None
    keys, before = _before(flat, starts, lengths)
    for x in (before, flat):
        keys <<= WIDE
        keys |= x
    return keys if some is None else keys[some]


def unkeyed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(items, contexts) of ``keyed`` tokens."""
    least = np.uint64((1 << int(WIDE)) - 1)
    return (keys & least).astype(np.uint32), _contexts(keys >> WIDE + WIDE, keys >> WIDE & least)


def _placed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the place of each among them."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    keys = keys[new]
    place = np.empty(len(order), np.uint32)
    place[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return keys, place


def distinct(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens behind the same two (of those marked by ``some``, or all), sorted so that equal contexts are together: (items, contexts, the place of each token among them). Predictors see no more than two tokens."""
    keys = keyed(flat, starts, lengths, some)
    if keys is None:
        contexts, own = token_contexts(flat, starts, lengths), slice(None) if some is None else some
        return flat[own], contexts[:, own], np.arange(len(flat[own]))
    keys, place = _placed(keys)
    return *unkeyed(keys), place


def letter_contexts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' bytes, each word closed by a blank; what each predictor sees before each byte, of its word alone; and the bytes of each word."""
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    flat = np.frombuffer(b" ".join([*words, b""]), np.uint8)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    h, out = np.zeros(len(flat), np.uint64), []
    for k in range(1, max(ORDERS) + 1):
        back = np.where(place >= k, np.concatenate([np.zeros(min(k, len(flat)), np.uint8), flat[:-k]]).astype(np.uint64) + np.uint64(1), np.uint64(0))
        h = (h ^ back) * _X
        h ^= h >> np.uint64(31)
        if k in ORDERS:
            out.append(h * _Y + np.uint64(k))
    return flat, np.stack(out), lengths


def _read(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a coded block its documents' whole numbers (a row each: key, no key, held out, tokens, size, known), their sums (base score, spelling) and the tokens."""
    body = _unzip(body)
    k = int(np.frombuffer(body, "<i8", 1)[0])
    return np.frombuffer(body, "<i8", 6 * k, 8).reshape(6, k), np.frombuffer(body, "<f8", 2 * k, 8 + 48 * k).reshape(2, k), np.frombuffer(body, "<u4", offset=8 + 64 * k)


Stream = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]


def trained_tokens(pdf: pd.DataFrame, mixed: bool = False) -> Stream:
    """(items, contexts, weights) of training documents: a block's equal tokens behind the same two once, weighted by their number, some at a time. They are sorted; ``mixed``: in runs of ``NEIGHBOURS``, which are shuffled."""
    for body in pdf.docs:
        whole, _, flat = _read(body)
        lengths = whole[3]
        starts, train = np.cumsum(lengths) - lengths, np.repeat(whole[2] == 0, lengths)
        keys = keyed(flat, starts, lengths, train)
        if keys is None:
            yield flat[train], token_contexts(flat, starts, lengths)[:, train], np.ones(int(train.sum()), np.int64)
            continue
        del flat, train
        keys.sort()
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
        n = np.diff(first, append=len(keys))
        keys = keys[first]
        del first
        if mixed:
            runs = np.random.default_rng(len(keys)).permutation(-(-len(keys) // NEIGHBOURS))
            order = (runs[:, None] * NEIGHBOURS + np.arange(NEIGHBOURS)).ravel()
            order = order[order < len(keys)]
            keys, n = keys[order], n[order]
            del order
        for a in range(0, len(keys), MADE):
            yield *unkeyed(keys[a : a + MADE]), n[a : a + MADE]


def mixed_tokens(pdf: pd.DataFrame) -> Stream:
    """``trained_tokens`` in an order to learn from."""
    return trained_tokens(pdf, True)


def trained_letters(known: dict[bytes, int]) -> Callable[[pd.DataFrame], Stream]:
    """(items, contexts, weights) of the training words that are spelled, each once and weighted by its count."""

    def stream(pdf: pd.DataFrame) -> Stream:
        for row in pdf.itertuples():
            counts = np.frombuffer(_unzip(row.counts), "<i8")
            mine = [(w, min(int(c), MOST)) for w, c in zip(_unzip(row.words)[:-1].split(b" "), counts, strict=True) if c and w not in known]
            for start in range(0, len(mine), 4096):
                some = mine[start : start + 4096]
                flat, contexts, lengths = letter_contexts([w for w, _ in some])
                yield flat, contexts, np.repeat(np.array([c for _, c in some], np.int64), lengths)

    return stream


def _unfolded(tally: np.ndarray) -> np.ndarray:
    """From how often each of a line's outcomes came: zeros and ones at each place, in turns. An outcome is counted at all bits that lead to it."""
    tally = tally.reshape(-1, 2 << LINE)
    for p in range((1 << LINE) - 1, 1, -1):
        tally[:, p] += tally[:, 2 * p] + tally[:, 2 * p + 1]
    return tally.reshape(-1, 2)


def _counted(code, bits: int, parts: int, stream):
    """Counts of zeros and ones at each place of the tables, over all that the task has. A piece of a path is counted once, by its outcome; those of a predictor that sees nothing are counted by the piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, tally = PREDICTORS << bits, None
        of = stream() if isinstance(stream, Later) else stream
        for pdf in batches:
            for items, contexts, weights in of(pdf):
                if tally is None:
                    tally = np.zeros(2 * places, np.uint32)
                    came = np.zeros(len(code.value.start), np.int64)
                alone = not contexts[0].any()
                for a, n, piece, line in lines(code.value, items, contexts, bits, int(alone)):
                    outcome = code.value.outcomes.take(piece)
                    more = np.uint32(1) if weights is None else np.repeat(weights[a : a + len(n)], n).astype(np.uint32)
                    for at in line:
                        at <<= 1
                        at += outcome
                        np.add.at(tally, at, more)
                    if alone:
                        came += np.bincount(piece, None if weights is None else more, len(came)).astype(np.int64)
        if tally is not None:
            first = _line(np.zeros(len(came), np.uint64), code.value.start, 0, bits)
            np.add.at(tally, 2 * first + code.value.outcomes, came.astype(np.uint32))
            cuts = np.linspace(0, places >> LINE, parts + 1).astype(int) << LINE
            for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                zeros, ones = _unfolded(tally[2 * a : 2 * z]).T
                yield pd.DataFrame({"part": [k], "zeros": [_zip(zeros.tobytes())], "ones": [_zip(ones.tobytes())]})
                del zeros, ones
        del tally
        released()

    return run


class Later:
    """A stream made where it is used, from a broadcast value."""

    def __init__(self, make, value):
        self.make, self.value = make, value

    def __call__(self):
        return self.make(self.value.value)


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The tasks' counts together, zeros in the upper and ones in the lower half of a number; counts beyond ``MOST`` keep their ratio."""
    total = [sum(np.frombuffer(_unzip(x), "<u4").astype("i8") for x in pdf[c]) for c in ("zeros", "ones")]
    over = np.maximum(np.maximum(*total) / MOST, 1)
    z, o = (np.maximum(np.rint(t / over), t > 0).astype("<u4") for t in total)  # what was seen stays seen
    return pd.DataFrame({"part": [pdf.part.iloc[0]], "counts": [_zip((z << np.uint32(16) | o).tobytes())]})


MOST = 65535
LOGS = np.log(np.arange(MOST + 1) + PRIOR).astype("f4")
#: 0, 1, 2-3, 4-15, 16-255 and more.
LEVELS = np.searchsorted([1, 2, 4, 16, 256], np.arange(2 * MOST + 1), side="right").astype("u1")


class Ready:
    """What scoring reads of the counts: log odds at all places; in the last three bits of their fractions, how often the contexts ``GATED`` were seen, as levels."""

    def __init__(self, counts: np.ndarray, in_place: bool = False):
        self.odds, self.alone = counts.view("f4") if in_place else np.empty(len(counts), "f4"), None
        places = len(counts) // PREDICTORS
        for k in range(PREDICTORS):
            for a in range(k * places, (k + 1) * places, 1 << 20):
                z = min(a + (1 << 20), (k + 1) * places)
                zeros, ones = counts[a:z] >> 16, counts[a:z] & MOST
                odds = LOGS[ones] - LOGS[zeros]
                if k in GATED:
                    odds[odds == 0] = 1e-6  # else the level would be a subnormal number
                    own = odds.view("u4")
                    own &= np.uint32(0xFFFFFFF8)
                    own |= LEVELS[zeros + ones]
                self.odds[a:z] = odds

    def gate(self, x: list[np.ndarray]) -> np.ndarray:
        one, two = (x[k].view("u4") & np.uint32(7) for k in GATED)
        one *= np.uint32(6)
        one += two
        return one

    def inputs(self, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        x = np.ones((INPUTS, at.shape[1]), "f4")
        self.odds.take(at, out=x[:-1], mode="clip")
        return x, self.gate(x)

    def of_pieces(self, code: Code, piece: np.ndarray, line: list[np.ndarray], bits: int) -> tuple[list[np.ndarray], np.ndarray]:
        """``inputs`` of all bits of pieces, without the constant; with a line too few, those of the predictor that sees nothing come first."""
        slots, x = code.slots.take(piece, axis=0).ravel().astype(np.int64), []
        if len(line) < PREDICTORS:
            if self.alone is None:
                self.alone = self.odds.take(_alone(code, bits)).reshape(-1, LINE)
            x = [self.alone.take(piece, axis=0).ravel()]
        x += [self.odds.take(_spots(at, slots)) for at in line]
        return x, self.gate(x)


class Left:
    """What learning reads of the counts, where each bit is left out of them: at twice a place, and one more for a one, the log odds without that bit, with levels as in ``Ready``."""

    def __init__(self, counts: np.ndarray):
        self.odds, self.alone = np.empty(2 * len(counts), "f4"), None
        places = len(counts) // PREDICTORS
        for k in range(PREDICTORS):
            for a in range(k * places, (k + 1) * places, 1 << 20):
                z = min(a + (1 << 20), (k + 1) * places)
                zeros, ones = (counts[a:z] >> 16).astype("i4"), (counts[a:z] & MOST).astype("i4")
                levels = LEVELS.take(np.maximum(zeros + ones - 1, 0))
                for bit in (0, 1):
                    odds = LOGS.take(np.maximum(ones - bit, 0)) - LOGS.take(np.maximum(zeros - 1 + bit, 0))
                    if k in GATED:
                        odds[odds == 0] = 1e-6
                        own = odds.view("u4")
                        own &= np.uint32(0xFFFFFFF8)
                        own |= levels
                    self.odds[2 * a + bit : 2 * z : 2] = odds

    def of_pieces(self, code: Code, piece: np.ndarray, line: list[np.ndarray], bits: int) -> tuple[list[np.ndarray], np.ndarray]:
        """As ``Ready.of_pieces``, each bit left out; behind a path's end the gate is ``GATES``."""
        turns, x = code.turns.take(piece, axis=0).ravel().astype(np.int64), []
        if len(line) < PREDICTORS:
            if self.alone is None:
                at = _alone(code, bits)
                at <<= 1
                at += code.bits.ravel()
                self.alone = self.odds.take(at).reshape(-1, LINE)
            x = [self.alone.take(piece, axis=0).ravel()]
        for at in line:
            at <<= 1
            at = np.repeat(at, LINE)
            at += turns
            x.append(self.odds.take(at))
        gate = x[GATED[0]].view("u4") & np.uint32(7)
        gate *= np.uint32(6)
        gate += x[GATED[1]].view("u4") & np.uint32(7)
        gate = gate.astype("u1")
        gate[turns == 0] = GATES
        return x, gate


def _odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    odds = np.add(ones, np.float32(PRIOR), dtype="f4", casting="same_kind")
    odds /= np.add(zeros, np.float32(PRIOR), dtype="f4", casting="same_kind")
    return np.log(odds, out=odds)


def _left_out(counts: np.ndarray, spots: Iterator[np.ndarray], own: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The predictors' log odds, and the gate, where ``own`` (zeros in the upper half, ones in the lower) is in the counts and must be left out."""
    x, levels = [], []
    for at in spots:
        seen = counts.take(at)
        seen -= np.minimum(own >> np.uint32(16), seen >> np.uint32(16)) << np.uint32(16) | np.minimum(own & np.uint32(MOST), seen & np.uint32(MOST))
        z, o = seen >> np.uint32(16), seen & np.uint32(MOST)
        x.append(_odds(z, o))
        z += o
        levels.append(z)
    one, two = (LEVELS.take(levels[k]) for k in GATED)
    one *= np.uint8(6)
    one += two
    return x, one


def _unpacked(parts: list[bytes], bits: int, form: str):
    counts, a = np.zeros(PREDICTORS << bits, "<u4"), 0
    for x in parts:
        part = np.frombuffer(_unzip(x), "<u4")
        counts[a : a + len(part)] = part
        a += len(part)
    return Ready(counts, in_place=True) if form == "ready" else Left(counts) if form == "left" else counts


class Packed:
    """Counts that travel compressed; where they are read they are an array, or ``Ready`` or ``Left``."""

    def __init__(self, *args):
        self.args = args

    def __reduce__(self):
        return _unpacked, self.args


def _squash(x: np.ndarray) -> np.ndarray:
    """Of numbers from -12 to 12."""
    out = np.negative(x)
    np.exp(out, out=out)
    out += 1
    return np.divide(1, out, out=out)


KNOTS = np.linspace(-12, 12, 33)
LEAST, WIDTH = float(KNOTS[0]), float(KNOTS[1] - KNOTS[0])
#: What is left of a cell after so many bits.
LEFT = 0.98 ** np.arange(STEP)


class Mixer:
    """Weights for each gate, learnt online, and a table by node and log odds that refines what they give."""

    def __init__(self):
        self.w = np.full((GATES, INPUTS), 0.2, "f4")
        self.w[:, -1] = 0
        self.table = np.repeat(_squash(KNOTS)[None], 256, axis=0).astype("f4")
        self.taught, self.visits = np.zeros(GATES), np.zeros(self.table.size)

    def mixed(self, x: np.ndarray | list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        gate = gate.astype(np.int64)
        out = self.w[:, -1].take(gate, mode="clip")
        for k in range(PREDICTORS):
            w = self.w[:, k].take(gate, mode="clip")
            w *= x[k]
            out += w
        return np.clip(out, -12, 12, out=out)

    def refined(self, node: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """The probability of a one: the mean of the mixture's and the table's, straight between its knots."""
        t = (mixed - LEAST) / WIDTH
        k = np.minimum(t.astype(np.int32), len(KNOTS) - 2)
        f = t - k.astype("f4")
        at = (node * len(KNOTS) + k).astype(np.int64)
        flat = self.table.ravel()
        p = flat.take(at)
        p += (flat.take(at + 1) - p) * f
        return np.clip((p + _squash(mixed)) / 2, 1e-7, 1 - 1e-7)

    def learn(self, node: np.ndarray, bit: np.ndarray, x: list[np.ndarray], gate: np.ndarray, rate: float = 0.3, times: np.ndarray | None = None) -> None:
        """One step: each gate's weights by its bits' mean, and each of the table's cells as by its bits one after the other. What has gate ``GATES`` is no bit. A bit may stand for as many equal ones as ``times`` says."""
        n = np.bincount(gate, minlength=GATES)[:GATES]
        order = np.argsort(gate, kind="stable")[: n.sum()]
        node, bit, x = node.take(order), bit.take(order), [y.take(order) for y in x]
        mixed = np.repeat(self.w[:, -1], n)
        for k in range(PREDICTORS):
            w = np.repeat(self.w[:, k], n)
            w *= x[k]
            mixed += w
        np.clip(mixed, -12, 12, out=mixed)
        wrong = bit - _squash(mixed)
        some = np.flatnonzero(n)
        starts = (np.cumsum(n) - n)[some]
        if times is not None:
            times = times.take(order)
            wrong *= times
            n = np.zeros(GATES)
            n[some] = np.add.reduceat(times, starts, dtype="f8")
        self.w[some, -1] += rate * np.add.reduceat(wrong, starts) / (n[some] + 16)
        for k in range(PREDICTORS):
            x[k] *= wrong
            self.w[some, k] += rate * np.add.reduceat(x[k], starts) / (n[some] + 16)
        self.taught += n
        mixed -= np.float32(LEAST)
        mixed *= np.float32(1 / WIDTH)
        k = np.rint(mixed, out=mixed).astype(np.int64)
        k += node * np.int64(len(KNOTS))
        size = self.table.size
        both = np.bincount(2 * k + bit, times, minlength=2 * size).reshape(-1, 2)
        n = both.sum(axis=1).astype(np.int64)
        flat = self.table.ravel()
        flat += (1 - LEFT.take(n, mode="clip")) * (both[:, 1] / np.maximum(n, 1) - flat)
        self.visits += n

    def state(self) -> tuple[np.ndarray, np.ndarray]:
        """All weights and cells in a row, and how many bits each has learnt from."""
        return np.concatenate([self.w.ravel(), self.table.ravel()]).astype("f8"), np.concatenate([np.repeat(self.taught, INPUTS), self.visits])

    def load(self, sums: np.ndarray, n: np.ndarray) -> None:
        """Means of many mixers' states by what each has learnt from; what none has learnt stays."""
        start, _ = self.state()
        self.taught, self.visits = n[: self.w.size : INPUTS], n[self.w.size :]
        flat = np.where(n > 0, sums / np.maximum(n, 1), start).astype("f4")
        self.w, self.table = flat[: self.w.size].reshape(self.w.shape), flat[self.w.size :].reshape(self.table.shape)


def _learnt(code, counts, bits: int, stream, each: bool, parts: int = 8):
    """A mixer that has walked all that the task has, in order, each bit left out of the counts it is predicted from: its state, times what it has learnt from, in parts. ``each``: a weight stands for so many equal items, of which one is left out at a time; else they are left out together, and learnt from once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mixer, c = Mixer(), code.value
        of = stream() if isinstance(stream, Later) else stream
        for pdf in batches:
            for items, contexts, weights in of(pdf):
                plain = each and not contexts[0].any()
                for a, n, piece, line in lines(c, items, contexts, bits, int(plain)):
                    times = np.repeat(weights[a : a + len(n)], n)
                    if each:
                        times = np.repeat(times.astype("f4"), LINE)
                        x, gate = counts.value.of_pieces(c, piece, line, bits)
                    else:
                        slots = c.slots.take(piece, axis=0).ravel().astype(np.int64)
                        own = c.own.take(piece, axis=0).ravel() * np.repeat(times, LINE).astype("<u4")
                        x, gate = _left_out(counts.value, (_spots(at, slots) for at in line), own)
                        gate[slots == 0] = GATES
                    mixer.learn(c.cells.take(piece, axis=0).ravel(), c.bits.take(piece, axis=0).ravel(), x, gate, times=times if each else None)
        state, n = mixer.state()
        cut = [np.array_split(y, parts) for y in (state * n, n)]
        yield pd.DataFrame({"part": range(parts), "sums": [y.tobytes() for y in cut[0]], "n": [y.tobytes() for y in cut[1]]})
        released()

    return run


def _averaged(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"part": [pdf.part.iloc[0]], **{c: [sum(np.frombuffer(x, "f8") for x in pdf[c]).tobytes()] for c in ("sums", "n")}})


class Model:
    """A code, the tables of its bits, and the mixer: what scoring needs, as broadcasts."""

    def __init__(self, data: DataFrame, stream, code: Code, bits: int, tasks: int, taught=None):
        """``taught``: a stream to learn from, if other than what is counted; its weights stand for equal items."""
        sc = data.sparkSession.sparkContext
        parts = max(16, (PREDICTORS << bits) >> 17)
        self.bits, self.code = bits, sc.broadcast(code)
        some = data.coalesce(tasks)
        got = some.mapInPandas(_counted(self.code, bits, parts, stream), "part int, zeros binary, ones binary").groupBy("part").applyInPandas(_summed, "part int, counts binary").orderBy("part").collect()
        tables = [bytes(r["counts"]) for r in got]
        counts = sc.broadcast(Packed(tables, bits, "left" if taught is not None else "plain"))
        mixer = Mixer()
        got = some.mapInPandas(_learnt(self.code, counts, bits, taught or stream, taught is not None), "part int, sums binary, n binary").groupBy("part").applyInPandas(_averaged, "part int, sums binary, n binary").orderBy("part").collect()
        if got:
            mixer.load(*(np.concatenate([np.frombuffer(r[c], "f8") for r in got]) for c in ("sums", "n")))
        counts.destroy()
        self.mixer, self.ready = sc.broadcast(mixer), sc.broadcast(Packed(tables, bits, "ready"))

    def scorer(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """In a task: log10 of the probability of each item."""
        code, ready, mixer, bits = self.code, self.ready, self.mixer, self.bits

        def logs(items: np.ndarray, contexts: np.ndarray) -> np.ndarray:
            c, out = code.value, np.zeros(len(items))
            plain = not contexts[0].any()
            for a, n, piece, line in lines(c, items, contexts, bits, int(plain)):
                cells = c.cells.take(piece, axis=0).ravel()
                one = mixer.value.refined(cells & np.uint16(255), mixer.value.mixed(*ready.value.of_pieces(c, piece, line, bits)))
                sign = c.signs.take(piece, axis=0)
                right = one.reshape(-1, LINE) * sign.astype("f4")
                right += (sign < 1).astype("f4")
                all_right = right[:, 0] * right[:, 1] * right[:, 2] * right[:, 3]  # 1e-28 at least
                ends = np.cumsum(n)
                some = np.flatnonzero(n)
                if len(some):
                    out[a + some] = np.add.reduceat(np.log10(all_right), (ends - n)[some], dtype="f8")
            return out + code.value.rest[items]

        return logs


def _valued(known, spell):
    """For each block that has words of a bucket, in the block's order: their counts, their symbols, and log10 of the probability of their spelling, if they are spelled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = known.value.get
        for pdf in batches:
            for row in pdf.itertuples():
                counts, words = np.frombuffer(_unzip(row.counts), "<i8"), _unzip(row.words)[:-1].split(b" ")
                codes = np.array([get(w, SPELLED) for w in words], "<u4")
                spelled, mine = np.zeros(len(words), "<f4"), np.flatnonzero(codes == SPELLED)
                for start in range(0, len(mine), 4096):
                    some = mine[start : start + 4096]
                    flat, contexts, lengths = letter_contexts([words[k] for k in some])
                    spelled[some] = np.add.reduceat(spell(flat, contexts), np.cumsum(lengths) - lengths)
                got = []
                for block, first, place in zip(row.blocks, row.firsts, row.places, strict=True):
                    p = np.cumsum(np.frombuffer(_unzip(place), "<u4"), dtype=np.uint32)
                    got.append((block, int(first), _zip(counts[p].tobytes() + codes[p].tobytes() + spelled[p].tobytes()), None))
                yield pd.DataFrame(got, columns=["block", "first", "values", "docs"])
        released()

    return run


def _coded(n: int, v: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """A block's documents with the sums that need their words' counts and spelling alone, and their tokens as symbols."""
        parts = [_unzip(x) for x in pdf[pdf.docs.isna()].sort_values("first")["values"]]
        counts, codes, spelled = (np.concatenate([np.frombuffer(x, t, len(x) // 16, len(x) // 16 * at) for x in parts]) for t, at in (("<i8", 0), ("<u4", 8), ("<f4", 12)))
        body = _unzip(pdf.docs.dropna().iloc[0])
        k = int(np.frombuffer(body, "<i8", 1)[0])
        whole, flat = np.frombuffer(body, "<i8", 5 * k, 8).reshape(5, k), np.frombuffer(body, "<u4", offset=8 + 40 * k)
        starts = np.cumsum(whole[3]) - whole[3]
        base = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))
        known = np.add.reduceat((counts > 0)[flat].astype("i8"), starts)
        sums = np.stack([np.add.reduceat(base[flat], starts), np.add.reduceat(spelled.astype("f8")[flat], starts)])
        blob = np.array([k], "<i8").tobytes() + np.vstack([whole, known]).astype("<i8").tobytes() + sums.astype("<f8").tobytes() + codes[flat].astype("<u4").tobytes()
        return pd.DataFrame({"docs": [_zip(blob)]})

    return run


def _scored(logs):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for body in pdf.docs:
                whole, (base, spelled), flat = _read(body)
                doc, unnamed, held, lengths, sizes, known = whole
                starts = np.cumsum(lengths) - lengths
                keys = keyed(flat, starts, lengths)
                if keys is None:
                    each = logs(flat, token_contexts(flat, starts, lengths))
                else:
                    keys, place = _placed(keys)
                    each = np.concatenate([logs(*unkeyed(keys[a : a + MADE])) for a in range(0, len(keys), MADE)]).take(place)
                    del place
                score = np.add.reduceat(each, starts) + spelled
                del keys, each
                yield pd.DataFrame({"doc": doc, "unnamed": unnamed == 1, "held_out": held == 1, "n_tokens": lengths, "n_known": known, "base_score": base, "score": score, "bits_per_byte": -score * np.log2(10) / sizes})
        released()

    return run


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, n) of the words of training texts."""
    for pdf in batches:
        for row in pdf.itertuples():
            counts = np.frombuffer(_unzip(row.counts), "<i8")
            got = pd.DataFrame({"word": _unzip(row.words)[:-1].split(b" "), "n": counts})
            yield got[(got.n > 1) & (got.word != b"")]


def table_bits(size: int) -> int:
    """Bits of each predictor's table, so that places grow with the input; 2^22 at most, which an executor's workers can hold (67 MB for all)."""
    return min(22, max(18, int(size).bit_length() - 6))


def scores(df: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", most_words: int = 65_536) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte).

    A text is a run of words, A-Z small, and an end. Words are written in bits: the ``most_words`` most frequent ones of the training texts by a
    Huffman code of their counts, the other words by a sign and then letter by letter, in a Huffman code of bytes. Each bit's probability is a mixture of
    predictors that have counted zeros and ones, in all training texts, at the bit's node behind hashed contexts (``PREDICTORS``, ``ORDERS``);
    a word's letters see their own word only, so that each distinct word is spelled once however often it occurs. The mixture's weights are chosen by a gate and
    learnt online, as is a table that refines them, in each task over all bits of its training texts, each bit left out of the counts it is
    predicted from; the tasks' weights are averaged by what they have learnt from. ``score`` is log10 of the product over a text's bits, ``bits_per_byte``
    the same by the bytes of its words and blanks.

    Words from everywhere meet in a bucket for their counts; a frequent
    word is a single row of a bucket, however often it occurs. Blocks of documents are cut at 16 MB, or less where there would be few. Repeated rows are scored each; null keys stay null; an empty table gives no rows."""
    sc = df.sparkSession.sparkContext
    size = int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    cores = sc.defaultParallelism
    buckets = max(64, size // 12_000_000)
    spread = max(2 * cores, buckets)  # given outright: few bytes are much work here
    docs = df.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("binary").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    blocks = staged(docs.mapInPandas(_blocks(buckets, min(1 << 24, max(1 << 20, size // (4 * cores)))), BLOCKS), "lm-blocks")
    words = staged(blocks.filter(F.col("bucket") >= 0).repartition(spread, "bucket").groupBy("bucket").applyInPandas(_merge, MERGED), "lm-words")
    n, v = (x or 0 for x in words.agg(F.sum("n"), F.sum("v")).first())
    ends = docs.filter(~F.col("held_out")).count()
    training = words.select("words", "counts")
    chosen = most_frequent(training.mapInPandas(_listed, "word binary, n long"), most_words, counts=True)
    known = sc.broadcast({b"": END} | {bytes(w): k + 2 for k, (w, _) in enumerate(chosen)})
    tasks = cores * max(1, round(size / 64_000_000 / cores))  # few: each sends whole tables
    bits = table_bits(size)

    letters = np.ones(256, np.int64)
    for w, _ in chosen:
        letters += np.bincount(np.frombuffer(bytes(w) + b" ", np.uint8), minlength=256)
    spelling = Model(training, Later(trained_letters, known), Code(letters.tolist()), max(16, bits - 2), tasks)
    spelled = n - ends - sum(c for _, c in chosen)
    values = words.select("words", "counts", "blocks", "firsts", "places").mapInPandas(_valued(known, spelling.scorer()), "block long, first long, values binary, docs binary")
    both = values.unionByName(blocks.filter(F.col("bucket") < 0).select("block", F.lit(-1).cast("long").alias("first"), F.lit(None).cast("binary").alias("values"), "docs"))
    coded = staged(both.repartition(spread, "block").groupBy("block").applyInPandas(_coded(n, v), "docs binary"), "lm-coded")
    model = Model(coded, trained_tokens, Code([max(1, spelled), max(1, ends), *(c for _, c in chosen)]), bits, tasks, mixed_tokens)
    out = coded.mapInPandas(_scored(model.scorer()), "doc long, unnamed boolean, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return out.select(F.when(~F.col("unnamed"), F.col("doc")).alias(key), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
