"""Benchmark decontamination by spaced seeds (Ma, Tromp and Li 2002).

A seed is a fixed mask over a few tokens; it looks at some positions and ignores the others, so that a hash under it
survives substitutions in those. The masks together lose nothing: wherever the substitutions are in a window that counts
as an overlap (below; of 12 to 20 tokens), some mask has a place in it where it looks at equal tokens only. Every window of every benchmark item and every document is hashed under each mask.
A filter of the benchmark's hashes (three bits each, its size bounded by ``MAX_BITS``) passes over documents in one
scan; what it lets through meets the benchmark's hashes in an exact join. Each hit names a document, an item and a
diagonal; there the tokens themselves are compared: a document overlaps an item if in some window of ``WINDOW`` tokens
(the whole item, if that is shorter) at least four fifths are equal. Items of fewer than ``SPAN`` tokens are looked for
by plain hashes of five tokens (of all, if they have fewer) and must be found whole and equal. ``overlaps`` reports
items of every length; ``clean`` lets documents stay that hold items of fewer than ``least_tokens`` (five) tokens only,
because a word or two in common doesn't mean that a benchmark has leaked.

Tokens are runs of letters and digits, in lower case (A-Z). Benchmark items with equal tokens are one for the search
and all reported. A passage that a third of all documents hold costs a hit row for each and no group of them is ever
collected; documents with a hot hash are dealt to ``SALTS`` tasks, where they meet the few items that have it. Very long
and repetitive texts: a document sends each of its hashes once, with the list of its places, and meets an item in one
row, so that the work grows with the document's length (times the item's), not with its square.

Null or empty texts on either side: no overlap. Null doc_id or item_id: kept and reported as null. Repeated rows: each
is reported. Empty tables: no overlaps. Extra columns are kept by ``clean``, whatever their names. A document's key is
its doc_id and the MD5 of its text; rows that agree in both are one document here, reported once and removed together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.key_filter import key_filter
from plenum.llm.scratch import materialise
from plenum.llm.textbytes import LOWER, NON_WORD, buffers, groups, mix, powers, trimmed, words

SPAN, WINDOW, LEAST_SHARE = 12, 20, (4, 5)
#: Positions looked at: six of at most ``SPAN``, three ways; found by enumeration so that every pattern of substitutions
#: that best_window accepts leaves one whole (2 of 12 to 14 tokens, 3 of 15 to 19, 4 of 20).
MASKS = ("1110111", "11010010011", "11010001101")
SHORT = 5
#: Tasks that the documents with one hash are dealt to.
SALTS = 16
MIN_BITS, MAX_BITS, BITS_PER_HASH = 1 << 22, 1 << 28, 64


def item_masks(tokens: int) -> list[int]:
    """The masks under which an item is looked for; numbers from len(MASKS) on are plain ones of five tokens down to
    one."""
    return list(range(len(MASKS))) if tokens >= SPAN else [len(MASKS) + SHORT - min(SHORT, tokens)]


def seed_hashes(word: np.ndarray, mask: int) -> np.ndarray:
    """Hashes of all windows of one text under a mask."""
    plain = SHORT - mask + len(MASKS)
    taken = [i for i, c in enumerate(MASKS[mask]) if c == "1"] if mask < len(MASKS) else list(range(plain))
    count = len(word) - (len(MASKS[mask]) if mask < len(MASKS) else plain) + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(count, mask + 1, np.uint64)
    for i in taken:
        total += word[i : i + count] * powers(SPAN + 2)[i + 1]
    return mix(total)


def _digest(word: np.ndarray) -> int:
    return int(mix(word * np.uint64(3) + np.arange(len(word), dtype=np.uint64)).sum().view(np.int64))


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    raw, at = buffers(column)
    for low, high in groups(at):
        word, first = words(raw[at[low] : at[high]], at[low : high + 1] - at[low], LOWER, NON_WORD)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            yield word[a:b]


def benchmark_items(bench: DataFrame) -> DataFrame:
    """(key, own, hs, ps): the distinct items' tokens, packed, and their windows' hashes and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 200):
                keys, own, hs, ps = [], [], [], []
                for word in _texts(batch.column(0).slice(low, 200)):
                    found = [seed_hashes(word, m) for m in item_masks(len(word))] if len(word) else [np.zeros(0, np.uint64)]
                    keys.append(_digest(word))
                    own.append(word.tobytes())
                    hs.append(np.concatenate(found).view(np.int64).tolist())
                    ps.append([i for f in found for i in range(len(f))])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(own, pa.binary()), pa.array(hs, pa.list_(pa.int64())), pa.array(ps, pa.list_(pa.int32()))], ["item", "own", "hs", "ps"])

    texts = bench.select(F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    return texts.mapInArrow(run, "item long, own binary, hs array<long>, ps array<int>").where(F.size("hs") > 0).dropDuplicates(["item"])


def _filter(hashes: DataFrame) -> np.ndarray:
    """The bits of the benchmark's hashes as 64-bit words, joined on the cluster."""
    n, size = hashes.count(), MIN_BITS
    while size < MAX_BITS and size < BITS_PER_HASH * n:
        size *= 2
    bit = F.explode(F.array(*[F.expr(f"cast(shiftrightunsigned(h, {64 - size.bit_length() + 1 - s}) & {size - 1} as int)") for s in (0, 9, 18)]))
    bits = hashes.select(bit.alias("bit")).groupBy(F.expr("shiftright(bit, 6)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("v"))
    out = np.zeros(size // 64, np.uint64)
    for batch in bits.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    return out


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    size = len(bits) * 64
    ok = np.ones(len(h), bool)
    for s in (0, 9, 18):
        bit = (h >> np.uint64(64 - size.bit_length() + 1 - s)) & np.uint64(size - 1)
        ok &= (bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return ok


def _key() -> Column:
    return F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def candidates(docs: DataFrame, bits: np.ndarray, masks: list[int]) -> DataFrame:
    """(key, doc_id, own, hs, ps) of the documents of which some window passes the filter: each hash once, with the
    list of its places."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, word in enumerate(_texts(batch.column(2))):
                hs, ps = [], []
                for m in masks:
                    h = seed_hashes(word, m)
                    at = np.flatnonzero(_passes(shared.value, h))
                    if len(at):
                        order = at[np.argsort(h[at], kind="stable")]
                        own, first = np.unique(h[order], return_index=True)
                        hs += own.view(np.int64).tolist()
                        # The whole of a very short item: its first place will do.
                        ps += [x[: 1 if m > len(MASKS) else None].tolist() for x in np.split(order, first[1:])]
                if hs:
                    rows.append({"key": batch.column(0)[i].as_py(), "doc_id": batch.column(1)[i].as_py(), "own": word.tobytes(), "hs": hs, "ps": ps})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.string()), ("doc_id", pa.int64()), ("own", pa.binary()), ("hs", pa.list_(pa.int64())), ("ps", pa.list_(pa.list_(pa.int32())))]))

    rows = docs.select(_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(run), "key string, doc_id long, own binary, hs array<long>, ps array<array<int>>")


def best_window(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(document place, equal tokens, window) of the best window on a diagonal if it is an overlap."""
    low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    window = min(len(item), WINDOW)
    if high - low < window:
        return None
    equal = np.concatenate([[0], np.cumsum(doc[low + diagonal : high + diagonal] == item[low:high])])
    found = equal[window:] - equal[:-window]
    at = int(found.argmax())
    share = LEAST_SHARE if len(item) >= SPAN else (1, 1)
    if found[at] * share[1] < window * share[0]:
        return None
    return low + diagonal + at, int(found[at]), window


def best_overlap(doc: np.ndarray, item: np.ndarray, met: list[tuple[list[int], list[int]]]) -> tuple[int, int, int] | None:
    """The best window of all diagonals that hits name: places in the document and in the item for each hash. There
    are at most as many diagonals as tokens in both, however often a text repeats itself."""
    places = [np.unique(np.subtract.outer(np.array(ps), np.array(ats))) for ps, ats in met]
    found = [w for d in np.unique(np.concatenate(places)).tolist() if (w := best_window(doc, item, d))]
    return max(found, key=lambda w: (w[1], -w[0]), default=None)


OVERLAPS = "key string, doc_id long, item long, place int, equal int, window int"


def overlaps(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(key, doc_id, item_id, place, equal, window): every document and item that overlap, by their best window; key
    is that of a document (the module's docstring)."""
    docs = docs.select("doc_id", "text")
    items = materialise(benchmark_items(bench), "items")
    hashes = items.select("item", "own", F.posexplode("hs").alias("i", "h"), "ps").select("item", "own", "h", F.col("ps")[F.col("i")].alias("at"))
    hashes = hashes.groupBy("item", "h").agg(F.first("own").alias("own"), F.collect_list("at").alias("ats"))
    lengths = items.select(F.least(F.length("own") / 8, F.lit(SPAN)).cast("int").alias("n")).distinct().collect()  # twelve rows at most
    masks = sorted({m for r in lengths for m in item_masks(r["n"])})
    found = materialise(candidates(docs, _filter(hashes.select("h")), masks), "hits")
    # A hash that many documents hold is dealt to SALTS tasks; the benchmark's side is repeated for each of them.
    hits = found.select("key", F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt"), "ps", F.posexplode("hs").alias("i", "h"))
    hits = hits.select("key", "salt", "h", F.col("ps")[F.col("i")].alias("ps"))
    salted = hashes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("long"))
    met = hits.join(salted, ["h", "salt"]).groupBy("key", "item").agg(F.first("own").alias("own"), F.collect_list(F.struct("ps", "ats")).alias("met"))
    texts = found.select("key", "doc_id", F.col("own").alias("doc")).dropDuplicates(["key"])
    pairs = met.join(texts, "key").select("key", "doc_id", "item", "met", "doc", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(len(batch)):
                key, doc_id, item, hit, doc, own = (c[i].as_py() for c in batch.columns)
                if best := best_overlap(np.frombuffer(doc, np.uint64), np.frombuffer(own, np.uint64), [(m["ps"], m["ats"]) for m in hit]):
                    rows.append((key, doc_id, item, *best))
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["key", "doc_id", "item", "place", "equal", "window"])

    named = pairs.mapInArrow(trimmed(run), OVERLAPS)
    # Items with equal tokens were searched once; all of them are named.
    names = bench.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    return named.join(item_keys(names), "item").select("key", "doc_id", "item_id", "place", "equal", "window")


def item_keys(names: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_digest(w) for w in _texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64())], ["item_id", "item"])

    return names.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, item long")


def clean(docs: DataFrame, bench: DataFrame, least_tokens: int = SHORT) -> DataFrame:
    """``docs`` without the documents that overlap some item of at least ``least_tokens`` tokens."""
    bad = materialise(overlaps(docs, bench).where(F.col("window") >= least_tokens).select("key").distinct(), "bad")
    # Only rows that a filter can't clear are shuffled. The row is one struct, so that no column of it clashes with ours.
    rows = docs.select(_key().alias("key"), F.struct("*").alias("row"))
    flagged = key_filter(bad, "key").flagged(rows, ["key"], "met")
    kept = flagged.where("met").join(bad, "key", "left_anti").select("row")
    return flagged.where("not met").select("row").unionByName(kept).select("row.*")
