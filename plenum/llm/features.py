"""Hashed features of whole texts for the classifiers, by position in the byte buffer of an Arrow column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from plenum.llm.textbytes import BYTE_CODE, SLICE_BYTES, WHITE, give_back, words

_CODE32 = (BYTE_CODE >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
#: How far the classes' counts matter in calibration.
EVEN = 0.7
#: Bytes of texts that a sample for training holds at most.
SAMPLE_BYTES = 96 << 20
_CHOSEN = [StructField("label", IntegerType()), StructField("size", IntegerType())]
_A, _B = np.uint32(0x01000193 * 2 + 1), np.uint32(0x9E3779B1)


def pieces(raw: np.ndarray, at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, cuts, rows): stretches of about ``limit`` bytes; a long row is cut at white space and its stretches
    carry the same row number, so that whole texts are read in bounded memory."""
    cuts, rows = [], []
    for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        while b - a > limit:
            c = a + limit
            back = np.flatnonzero(WHITE[raw[c - 4096 : c]])
            c = c - 4096 + int(back[-1]) + 1 if len(back) else c
            cuts.append(a)
            rows.append(row)
            a = c
        cuts.append(a)
        rows.append(row)
    cuts.append(len(raw))
    edge, number = np.array(cuts), np.array(rows)
    low = 0
    while low < len(number):
        high = max(low + 1, int(np.searchsorted(edge, edge[low] + limit, "right")) - 1)
        yield raw[edge[low] : edge[high]], edge[low : high + 1] - edge[low], number[low:high]
        low = high


def characters(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each UTF-8 character, its code): one code for each character, however many bytes it has."""
    code = _CODE32[raw]
    if not (raw & 0x80).any():
        return np.arange(len(raw)), code
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    if not len(starts) or starts[0] != 0:
        starts = np.append(0, starts)
    place = (np.arange(len(raw)) - np.repeat(starts, np.diff(starts, append=len(raw)))).astype(np.uint32)
    return starts, np.add.reduceat(code * (place * _B + np.uint32(1)), starts, dtype=np.uint32)


def gram_buckets(raw: np.ndarray, at: np.ndarray, letter: np.ndarray, blank: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n (byte places, buckets) of the n-grams of characters that lie inside one word, its borders counting as
    blanks."""
    if not len(raw):
        return
    plain = letter[raw].copy()
    plain[blank[raw]] = 0x20
    starts, code = characters(plain)
    gap = np.concatenate([[0], np.cumsum(plain[starts] == 0x20)])
    inside = np.searchsorted(at, starts, "right")
    for n in sizes:
        count = len(code) - n + 1
        if count <= 0:
            continue
        h = code[:count].copy()
        for j in range(1, n):
            h *= _A
            h += code[j : j + count]
        h ^= h >> np.uint32(15)
        h *= _B
        # no blank strictly inside, and one row
        ok = inside[:count] == inside[n - 1 :]
        if n > 2:
            ok &= gap[n - 1 : n - 1 + count] == gap[1 : 1 + count]
        places = np.flatnonzero(ok)
        yield starts[places], (h[places] ^ np.uint32(n * 0x51ED27)) >> np.uint32(32 - bits)


def word_buckets(raw: np.ndarray, at: np.ndarray, letter: np.ndarray, blank: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each row, bucket of each word)."""
    word, first = words(raw, at, letter, blank)
    return word, first, (word >> np.uint64(64 - bits)).astype(np.uint32)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, most_bytes: int = SAMPLE_BYTES) -> list[tuple[bytes, int]]:
    """At most ``rows`` (text, label) of the folds that may be learnt from, chosen by a hash of doc_id over the whole
    table, in a fixed order. A text that would take the sample over ``most_bytes`` is left out whole, and the next ones
    are tried. Rows without a label or with another one than 0 or 1 are not used."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label"), fold.alias("fold"))
    known = known.where(F.col("label").isin(0, 1) & (F.col("fold") != held_out)).select("id", "label")
    known = known.orderBy(F.xxhash64("id"), "id", "label").limit(rows)
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("words"))
    sizes = texts.select("id", F.octet_length("words").alias("size")).join(F.broadcast(known), "id")
    order = [F.xxhash64("id"), "id", "label", "size"]
    chosen, held = [], 0
    for r in sizes.orderBy(*order).limit(rows).collect():  # numbers only; the texts come when their bytes are known
        if held + r["size"] <= most_bytes:
            chosen.append((r["id"], r["label"], r["size"]))
            held += r["size"]
    wanted = docs.sparkSession.createDataFrame(chosen, StructType([StructField("id", docs.schema["doc_id"].dataType), *_CHOSEN])).distinct()
    found = texts.withColumn("size", F.octet_length("words")).join(F.broadcast(wanted), ["id", "size"])
    found = found.orderBy(*order, "words").limit(len(chosen)) if chosen else found.limit(0)
    return [(bytes(r["raw"]), r["label"]) for r in found.select(F.encode("words", "UTF-8").alias("raw"), "label").collect()]


def platt(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the logistic curve over logits of texts that were not learnt from (Platt 1999). A class of
    n texts weighs as n ** ``EVEN``, between what it is (1) and the same as the other (0); targets are drawn in from 0 and 1 by
    the counts, so that the slope stays finite."""
    n1, n0 = int(labels.sum()), int((labels == 0).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(labels == 1, n1 ** (EVEN - 1), n0 ** (EVEN - 1)) / (n1**EVEN + n0**EVEN)
    scale = max(1e-6, float(np.abs(logits).mean()))
    x = np.stack([logits / scale, np.ones(len(logits))], 1)
    theta = np.zeros(2)
    for _ in range(100):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + 1e-4 * theta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]) / scale, float(theta[1])


def calibrated(sample: list[tuple[bytes, int]], train: Callable, parts: int = 4, few: int = 2000):
    """The model that ``train`` makes of the sample, with the ``curve`` that turns its logits into probabilities. The
    curve is fitted on logits of texts that were not learnt from: those of one part of the sample by a model of the
    others, or of each part in turn where the sample has fewer than ``few`` texts."""
    model = train(sample)
    logits, labels = [np.zeros(0)], [np.zeros(0, np.int64)]
    for part in range(parts if len(sample) < few else 1):
        inner, rest = [x for i, x in enumerate(sample) if i % parts != part], sample[part::parts]
        if len({y for _, y in inner}) == 2 and rest:
            other = train(inner)
            ends = np.cumsum([0, *(len(t) for t, _ in rest)])
            logits.append(other.logits(np.frombuffer(b"".join(t for t, _ in rest), np.uint8), ends))
            labels.append(np.array([y for _, y in rest]))
    model.curve = platt(np.concatenate(logits), np.concatenate(labels))
    give_back()
    return model


def held_out(folds: int, fold: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
