"""Encoding of whole texts by a tokenizers model through a cache of the text's chunks.

A chunk is a stretch of text between blanks, across whose ends the model never merges, so that the ids of a text are
those of its chunks one after the other. Each distinct chunk is encoded once for a Python worker; the rest is numpy
work on 64-bit hashes of the chunks. A second, independent 64-bit hash of every occurrence is compared with the one of
the chunk that was encoded; where they differ (two chunks with one hash), the texts at hand are encoded without the
cache. Before the index of all chunks, which needs the occurrences sorted, comes a table of the chunks met last, with a
place for each value of a hash's low bits, where most occurrences are found.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import numpy as np

from plenum.llm.textbytes import BYTE_CODE, CHECK_CODE, SAME, coded_words, groups

#: Longest chunk that the cache keeps, and how many of them it keeps before it starts anew.
KEPT_BYTES, KEPT_CHUNKS, KEPT_MARKS = 64, 1_600_000, 50_000
#: Places of the table of chunks met last, a power of two.
RECENT = 1 << 18
#: Bytes of text that are looked up at once.
GROUP_BYTES = 1 << 20
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True
_END = re.compile(rb"[ \t\n\r]")


class ChunkEncoder:
    """encode: the ids of each of some chunks. parts: a chunk as a word and the marks behind it (or empty), which the
    model encodes apart; most new chunks are known words with other marks. blank: the bytes that stand between chunks. kept: how
    many chunks the cache holds."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], parts: Callable[[str], tuple[str, str]] | None = None, end: re.Pattern = _END, blank: np.ndarray = BLANK, kept: int = KEPT_CHUNKS):
        self._encode, self._parts, self._end, self._blank, self._kept = encode, parts, end, blank, kept
        self._reset()

    def _reset(self) -> None:
        #: The slot of a chunk's hash; a slot's row of ids and second hash.
        self._index: dict[int, int] = {}
        self._rows, self._checks, self._slots = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.uint64), 0
        self._ids = np.zeros(1 << 16, np.uint32)
        self._ends = np.zeros(1 << 12, np.int64)
        self._n = 0
        self._marks: dict[str, list[int]] = {}
        #: The chunks met last: hash and slot (-1: none).
        self._recent, self._recent_slots = np.zeros(RECENT, np.uint64), np.full(RECENT, -1, np.int32)

    def _hashes(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (hashes, checks), starts = coded_words(raw, at, SAME, self._blank, (BYTE_CODE, CHECK_CODE))
        return hashes, checks, starts

    def _name(self, keys: list[int], checks: list[int], rows: np.ndarray) -> None:
        n, high = self._slots, self._slots + len(keys)
        if high > len(self._rows):
            more = max(len(self._rows), len(keys))
            self._rows = np.concatenate([self._rows, np.zeros(more, np.int64)])
            self._checks = np.concatenate([self._checks, np.zeros(more, np.uint64)])
        self._rows[n:high], self._checks[n:high] = rows, np.array(checks, np.uint64)
        self._index.update(zip(keys, range(n, high)))
        self._slots = high

    def _learn(self, keys: list[int], checks: list[int], chunks: list[str]) -> None:
        if self._parts is None:
            self._name(keys, checks, self._add(self._encode(chunks)))
            return
        words, marks = zip(*map(self._parts, chunks))
        raw = np.frombuffer(" ".join(words).encode("utf-8", "surrogatepass"), np.uint8)
        word_keys, word_checks, _ = (x.tolist() for x in self._hashes(raw, np.array([0, len(raw)])))
        new = {k: (w, c) for k, c, w in zip(word_keys, word_checks, words) if k not in self._index}
        if new:
            self._name(list(new), [c for _, c in new.values()], self._add(self._encode([w for w, _ in new.values()])))
        for mark in set(marks) - self._marks.keys():
            self._marks[mark] = self._encode([mark])[0] if mark else []
        plain, more = [], []
        for key, check, word_key, word_check, word, mark in zip(keys, checks, word_keys, word_checks, words, marks):
            slot = self._index[word_key]
            row = int(self._rows[slot])
            if int(self._checks[slot]) != word_check:  # another word with the same hash
                more.append((key, check, self._encode([word])[0] + self._marks[mark]))
            elif mark:
                more.append((key, check, self._ids[self._ends[row] : self._ends[row + 1]].tolist() + self._marks[mark]))
            elif key not in self._index:
                plain.append((key, check, row))
        if plain:
            self._name(*zip(*plain))
        if more:
            self._name([k for k, *_ in more], [c for _, c, _ in more], self._add([x for *_, x in more]))

    def _add(self, ids: list[list[int]]) -> np.ndarray:
        """The rows that hold the ids from now on."""
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) + self._ends[self._n]
        low, high, n = int(self._ends[self._n]), int(ends[-1]), self._n + len(ids)
        if high > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros(max(len(self._ids), high - low), np.uint32)])
        if n + 1 > len(self._ends):
            self._ends = np.concatenate([self._ends, np.zeros(max(len(self._ends), len(ids)), np.int64)])
        self._ids[low:high] = np.fromiter(chain.from_iterable(ids), np.uint32, high - low)
        self._ends[self._n + 1 : n + 1] = ends
        rows, self._n = np.arange(self._n, n), n
        return rows

    def _uncached(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, ends, data = [], [], raw.tobytes()
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            chunks = [c.decode("utf-8", "replace") for c in self._end.split(data[a:b]) if c]
            ids += chain.from_iterable(self._encode(chunks)) if chunks else []
            ends.append(len(ids))
        return np.array(ids, np.uint32), np.array(ends, np.int64)

    def _some(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes, checks, starts = self._hashes(raw, at)
        place = (hashes & np.uint64(RECENT - 1)).astype(np.int64)
        slot = self._recent_slots[place].astype(np.int64)
        rest = np.flatnonzero((self._recent[place] != hashes) | (slot < 0))
        keys, first, which = np.unique(hashes[rest], return_index=True, return_inverse=True)
        first, keys = rest[first], keys.tolist()
        found = list(map(self._index.get, keys))
        long: list[int] = []
        if None in found:
            new = [i for i, x in enumerate(found) if x is None]
            begin = starts[first[new]]
            stop = at[np.searchsorted(at, begin, "right")]
            data = raw.tobytes()
            chunks = []
            for i, a, b in zip(new, begin.tolist(), stop.tolist()):
                m = self._end.search(data, a, b)
                chunk = data[a : m.start() if m else b]
                chunks.append(chunk.decode("utf-8", "replace"))
                if len(chunk) > KEPT_BYTES:
                    long.append(keys[i])
            self._learn([keys[i] for i in new], checks[first[new]].tolist(), chunks)
            found = list(map(self._index.__getitem__, keys))
        if keys:
            slot[rest] = np.array(found, np.int64)[which]
            place = place[first]
            self._recent[place], self._recent_slots[place] = hashes[first], slot[first]
        if not np.array_equal(self._checks[slot], checks):
            return self._uncached(raw, at)
        row = self._rows[slot]
        low, size = self._ends[row], self._ends[row + 1] - self._ends[row]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self._ids[np.repeat(low - ends[:-1], size) + np.arange(ends[-1])]
        for key in long:
            del self._index[key]
        if self._slots > self._kept or self._ends[self._n] > 8 * self._kept or len(self._marks) > KEPT_MARKS:
            self._reset()
        return ids, ends[np.searchsorted(starts, at[1:])]

    def encode(self, raw: np.ndarray, at: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a byte buffer in order, each row closed by ``end_id`` if given, and each row's end in
        them. ``raw`` and ``at`` are as textbytes.buffers() returns them."""
        ids, ends, total = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        for low, high in groups(at, GROUP_BYTES):
            own, stops = self._some(raw[at[low] : at[high]], at[low : high + 1] - at[low])
            if end_id is not None:
                own = np.insert(own, stops, end_id)
                stops = stops + np.arange(1, len(stops) + 1)
            ids.append(own)
            ends.append(stops + total)
            total += len(own)
        return np.concatenate(ids), np.concatenate(ends)
