"""Minimal acyclic transducer: words to numbers, common suffixes shared, in one file that workers map into memory."""

from __future__ import annotations

import mmap
import struct
import zlib

import numpy as np

MAGIC = b"LEXICON2"
#: Bits of the filter that most other words don't pass.
FILTER = 20


class _State:
    __slots__ = ("arcs", "final", "number", "words")

    def __init__(self):
        self.arcs: dict[int, _State] = {}
        self.final, self.number, self.words = False, -1, 0

    def signature(self):
        return self.final, tuple((c, id(s)) for c, s in self.arcs.items())


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The file of a transducer from words to id lists.

    Words are added in byte order; a state that can't change any more is replaced by an equal one, if there is, so
    that the automaton is minimal. An arc carries how many words precede it in its state, and the sum over a word's
    arcs is its number, by which its ids are found: outputs so don't hinder the sharing of suffixes."""
    root, known, path, last = _State(), {}, [], b""

    def settle(down_to: int) -> None:
        while len(path) > down_to:
            parent, c, child = path.pop()
            child.words = child.final + sum(s.words for s in child.arcs.values())
            parent.arcs[c] = known.setdefault(child.signature(), child)

    words = sorted(entries)
    for w in words:
        same = 0
        while same < min(len(w), len(last)) and w[same] == last[same]:
            same += 1
        settle(same)
        state = path[-1][2] if path else root
        for c in w[same:]:
            child = _State()
            state.arcs[c] = child
            path.append((state, c, child))
            state = child
        state.final, last = True, w
    settle(0)

    states, todo = [], [root]
    root.number = 0
    while todo:
        s = todo.pop()
        states.append(s)
        for t in s.arcs.values():
            if t.number < 0:
                t.number = 0
                todo.append(t)
    for k, s in enumerate(states):
        s.number = k
    labels, targets, skips, firsts, finals = bytearray(), [], [], [0], bytearray()
    for s in states:
        before = int(s.final)
        for c, t in sorted(s.arcs.items()):
            labels.append(c)
            targets.append(t.number)
            skips.append(before)
            before += t.words
        firsts.append(len(labels))
        finals.append(s.final)
    ids = [entries[w] for w in words]
    offsets = np.cumsum([0, *map(len, ids)])
    marks = bytearray(1 << (FILTER - 3))
    for w in words:
        h = zlib.crc32(w) & ((1 << FILTER) - 1)
        marks[h >> 3] |= 1 << (h & 7)
    parts = [np.array(x, "<u4").tobytes() for x in (firsts, targets, skips, offsets, [i for x in ids for i in x])] + [bytes(finals), bytes(labels), bytes(marks)]
    return MAGIC + struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)


class Lexicon:
    """A compiled lexicon, mapped from its file. Nothing is read before it's needed."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        assert self._map[:8] == MAGIC
        sizes, view, at = struct.unpack("<8Q", self._map[8:72]), memoryview(self._map), 72
        parts = []
        for k, n in enumerate(sizes):
            parts.append(view[at : at + n].cast("I") if k < 5 else at)
            at += n
        self._firsts, self._targets, self._skips, self._offsets, self._ids, self._finals, self._labels, self._marks = parts

    @property
    def states(self) -> int:
        return len(self._firsts) - 1

    def __len__(self) -> int:
        return len(self._offsets) - 1

    def get(self, word: bytes) -> list[int] | None:
        """The ids of a word; none if it isn't in the lexicon."""
        h = zlib.crc32(word) & ((1 << FILTER) - 1)
        if not self._map[self._marks + (h >> 3)] >> (h & 7) & 1:
            return None
        find, labels, firsts, state, number = self._map.find, self._labels, self._firsts, 0, 0
        for k in range(len(word)):
            a = find(word[k : k + 1], labels + firsts[state], labels + firsts[state + 1])
            if a < 0:
                return None
            number += self._skips[a - labels]
            state = self._targets[a - labels]
        if not self._map[self._finals + state]:
            return None
        return list(self._ids[self._offsets[number] : self._offsets[number + 1]])
