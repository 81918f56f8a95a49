"""Vectorised words, shingles and character n-grams over the UTF-8 buffers of Arrow string columns.

No Python string is made: an Arrow string column already is one byte buffer and one offset array, and numpy works on
those. All hashes are 64-bit polynomial hashes over random byte codes, mixed at the end; they are the same on every
machine and in every run.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Other codes of the bytes, for a second, independent hash.
CHECK_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes handled at once; arrays made on the way take some 40 times as much.
SLICE_BYTES = 1 << 18

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything ASCII that is neither a letter nor a digit; bytes of other scripts count as letters.
NON_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = _BASE ** np.arange(256, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = _BASE ** np.arange(max(n, 2 * len(_powers)), dtype=np.uint64)
    return _powers


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def give_back() -> None:
    """Return freed memory to the system, where the C library can: the driver and the workers live on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: What this worker keeps from task to task, by name: how to let it go.
_kept: dict[str, Callable[[], None]] = {}


def keep(name: str, forget: Callable[[], None]) -> None:
    """This worker keeps something from task to task, until a ``trimmed`` task begins that doesn't use ``name``."""
    _kept[name] = forget


def let_go(but: str | None) -> None:
    for name in [n for n in _kept if n != but]:
        _kept.pop(name)()


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], uses: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; when a task ends, what it has freed goes back to the system, and when it begins, what
    other operators have kept is let go (``uses``: what this one keeps itself). Workers are used again for other stages,
    and what each of them would hold on to adds up."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(uses)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def groups(at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes together, or of one larger row."""
    low = 0
    while low < len(at) - 1:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield low, high
        low = high


def _word_slice(raw: np.ndarray, cuts: np.ndarray, letter: np.ndarray, space: np.ndarray, codes: tuple[np.ndarray, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    full = ~space[raw]
    first = full.copy()
    first[1:] &= ~full[:-1]
    cuts = cuts[cuts < len(raw)]
    first[cuts] = full[cuts]
    starts = np.flatnonzero(first)
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in codes], starts
    lengths = np.diff(starts, append=len(raw))
    place = powers(int(lengths.max()))[np.arange(starts[0], len(raw)) - np.repeat(starts, lengths)]
    place[~full[starts[0] :]] = 0
    own = letter[raw[starts[0] :]]
    return [mix(np.add.reduceat(code[own] * place, starts - starts[0])) for code in codes], starts


def words(raw: np.ndarray, at: np.ndarray, letter: np.ndarray = LOWER, space: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows, in order, and for each row the number of its first word (one more at the end)."""
    hashes, starts = placed_words(raw, at, letter, space)
    return hashes, np.searchsorted(starts, at)


def placed_words(raw: np.ndarray, at: np.ndarray, letter: np.ndarray = LOWER, space: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows, in order, and the byte at which each begins.

    A row of many megabytes is cut at separators, so that memory stays at a few bytes for each of its words."""
    (hashes,), starts = coded_words(raw, at, letter, space, (BYTE_CODE,))
    return hashes, starts


def coded_words(raw: np.ndarray, at: np.ndarray, letter: np.ndarray, space: np.ndarray, codes: tuple[np.ndarray, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """The same with a hash for each table of byte codes."""
    hashes, starts, low = [[np.zeros(0, np.uint64)] for _ in codes], [np.zeros(0, np.int64)], 0
    while low < len(raw):
        high = min(len(raw), low + 4 * SLICE_BYTES)
        while high < len(raw):
            back = np.flatnonzero(space[raw[low:high]])
            inner = at[(at > low) & (at < high)]
            if len(back) or len(inner):
                high = low + max(back[-1] + 1 if len(back) else 0, inner[-1] - low if len(inner) else 0)
                break
            high = min(len(raw), high + 4 * SLICE_BYTES)
        found, s = _word_slice(raw[low:high], at[(at >= low) & (at < high)] - low, letter, space, codes)
        for whole, part in zip(hashes, found):
            whole.append(part)
        starts.append(s + low)
        low = high
    return [np.concatenate(h) for h in hashes], np.concatenate(starts)


def shingles(word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one row; of its whole sequence if it has fewer words; none without words."""
    if not len(word):
        return word
    k, length = min(k, len(word)), k if len(word) >= k else -len(word)
    total = np.zeros(len(word) - k + 1, np.uint64)
    for j in range(k):
        total += word[j : len(word) - k + 1 + j] * powers(k + 2)[j + 1]
    return mix(total + np.uint64(length & 0xFFFF))
