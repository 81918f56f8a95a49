"""Toxicity: a factorization machine over hashed terms (Rendle 2010).

Terms are the distinct words and in-word character n-grams of the lower-cased text, hashed to buckets. The score is the
logistic of w0 + sum of w_i + sum over pairs of <v_i, v_j>: the factors v learn what two terms mean together, such as
an insult next to a group's name, which no sum of single weights can. Linear weights are learnt by follow-the-
regularised-leader with an L1 term, which leaves all but the telling terms at exactly zero (as do terms of fewer than
``LEAST`` texts of the sample). Factors, learnt by AdaGrad, belong to terms with a weight and to words that tell nothing
by themselves but do together: of the ``PAIR_WORDS`` most frequent words the pairs whose label shares in the texts with
both, one and none of them differ from a sum of the two words' effects by ``PAIR_Z`` standard errors. (Factors for all
words were tried: they learnt the noise of the labels and lowered the recall on held-out rows from 0.93 to 0.78 at the
same false positives.) The model is the mean of ``RUNS`` runs over the texts in other orders, which is a machine too.
Training is on a bounded sample of labelled rows (``SAMPLE_ROWS``, chosen by a hash over the whole table); the logit is
calibrated on texts of it that were not learnt from (``features.calibrated``).

A term counts once however often it occurs, so a text's length doesn't dilute or add to its score. Whole texts are
scored, in slices of bounded memory; a slice yields only its terms that have a weight or factors.

Null or empty text: no terms, so the score is what w0 alone gives. Repeated rows: the same score each. No labelled
rows: score 0.5 everywhere. Extra columns are kept; one named like the new column (``score``, or another name given to
``score()``) is replaced. Null doc_id: scored like others, never learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from plenum.llm.features import calibrated, gram_buckets, labelled_sample, pieces, word_buckets
from plenum.llm.quality import with_score
from plenum.llm.textbytes import LOWER, NON_WORD

SAMPLE_ROWS, BITS, FACTORS, EPOCHS, RUNS, LEAST = 6000, 20, 4, 2, 3, 5
GRAMS = (4, 5)
ALPHA, BETA, L1, L2, FACTOR_RATE, FACTOR_L2 = 1.0, 1.0, 8.0, 0.1, 0.02, 0.001
#: Words whose pairs are looked at, texts that each combination must be in, and how far a pair must stand out.
PAIR_WORDS, PAIR_TEXTS, PAIR_Z = 512, 10, 6.0
THRESHOLD = 0.3


def _terms(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of the terms with repeats, in several lots."""
    _, first, bucket = word_buckets(raw, at, LOWER, NON_WORD, BITS)
    yield np.repeat(np.arange(len(at) - 1), np.diff(first)), bucket
    for places, found in gram_buckets(raw, at, LOWER, NON_WORD, GRAMS, BITS):
        yield np.searchsorted(at, places, "right") - 1, found


@dataclass
class Model:
    #: Number of each bucket's term, 0 for none; weights and factors by number.
    number: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    start: float
    curve: tuple[float, float] = (1.0, 0.0)

    def score(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        slope, offset = self.curve
        return 1 / (1 + np.exp(-np.clip(slope * self.logits(raw, at) + offset, -40, 40)))

    def logits(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        kept, n = [np.zeros(0, np.int64)], len(self.weights)
        for data, cuts, rows in pieces(raw, at):
            for row, bucket in _terms(data, cuts):
                term = self.number[bucket]
                hit = np.flatnonzero(term)
                kept.append(rows[row[hit]].astype(np.int64) * n + term[hit])
        row, term = np.divmod(np.unique(np.concatenate(kept)), n)
        rows = len(at) - 1
        total = self.start + np.bincount(row, self.weights[term], rows)
        for f in range(self.factors.shape[1]):
            v = self.factors[term, f]
            total += 0.5 * (np.bincount(row, v, rows) ** 2 - np.bincount(row, v * v, rows))
        return np.clip(total, -40, 40)


def texts_with(ids: list[np.ndarray], size: int) -> np.ndarray:
    """In how many texts each bucket is."""
    out = np.zeros(size, np.int32)
    for own in ids:
        out[own] += 1
    return out


def interacting(words: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """For each bucket: is it a word that tells something only together with another one?"""
    out, n = np.zeros(size, bool), len(words)
    met = texts_with(words, size)
    met[met > n - PAIR_TEXTS] = 0
    own = np.argsort(-met, kind="stable")[:PAIR_WORDS]
    own = own[met[own] >= 2 * PAIR_TEXTS]
    if not len(own):
        return out
    x = np.stack([np.isin(own, w) for w in words]).astype(np.float32)
    y = labels.astype(np.float32)
    both, of_both, single, of_single = x.T @ x, x.T @ (x * y[:, None]), x.sum(0), x.T @ y
    one, of_one = single[:, None] - both, of_single[:, None] - of_both
    none, of_none = n - single[:, None] - single + both, y.sum() - of_single[:, None] - of_single + of_both
    contrast = variance = 0.0
    for sign, count, hits in ((1, both, of_both), (-1, one, of_one), (-1, one.T, of_one.T), (1, none, of_none)):
        share = (hits + 0.5) / (count + 1)
        contrast, variance = contrast + sign * share, variance + share * (1 - share) / (count + 1)
    enough = np.minimum(np.minimum(both, none), np.minimum(one, one.T)) >= PAIR_TEXTS
    out[own[(enough & (np.abs(contrast) >= PAIR_Z * np.sqrt(variance))).any(0)]] = True
    return out


def train(sample: list[tuple[bytes, int]], seed: int = 11) -> Model:
    size = 1 << BITS
    if not sample:
        return Model(np.zeros(size, np.int32), np.zeros(1, np.float32), np.zeros((1, FACTORS), np.float32), 0.0)
    terms, words, labels = [], [], [y for _, y in sample]
    for text, _ in sample:
        raw = np.frombuffer(text, np.uint8)
        lots = [[b for _, b in _terms(data, cuts)] for data, cuts, _ in pieces(raw, np.array([0, len(raw)]))]
        words.append(np.unique(np.concatenate([lot[0] for lot in lots])))
        terms.append(np.unique(np.concatenate([b for lot in lots for b in lot])))
    paired, often = interacting(words, np.array(labels), size), texts_with(terms, size) >= LEAST
    del words
    # From here on terms go by their number among those that are often enough.
    bucket, place = np.flatnonzero(often), np.cumsum(often, dtype=np.int32) - 1
    for i, ids in enumerate(terms):
        terms[i] = place[ids[often[ids]]]
    texts, paired, met_terms = list(zip(terms, labels)), paired[bucket], len(bucket)
    share = (sum(labels) + 0.5) / (len(texts) + 1)
    runs = [_run(texts, paired, met_terms, float(np.log(share / (1 - share))), seed + i) for i in range(RUNS)]
    # The mean of the runs' logits is a machine again: mean weights, and all factors side by side, scaled.
    w = np.mean([r[0] for r in runs], 0)
    factors = np.concatenate([r[1] * ((r[0] != 0) | paired)[:, None] for r in runs], 1) / np.float32(RUNS**0.5)
    on = np.flatnonzero((w != 0) | factors.any(1))
    number = np.zeros(size, np.int32)
    number[bucket[on]] = np.arange(1, len(on) + 1)
    return Model(number, np.concatenate([[0], w[on]]), np.concatenate([np.zeros((1, factors.shape[1]), np.float32), factors[on]]), float(np.mean([r[2] for r in runs])))


def _run(texts: list[tuple[np.ndarray, int]], paired: np.ndarray, size: int, start: float, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, factors and w0 learnt from the texts in one random order."""
    rng = np.random.Generator(np.random.PCG64(seed))
    z, n = np.zeros(size, np.float32), np.zeros(size, np.float32)
    factors = rng.normal(0, 0.01, (size, FACTORS)).astype(np.float32)
    factors[paired] *= 10
    met = np.full((size, FACTORS), 1e-2, np.float32)

    def weight(ids: np.ndarray) -> np.ndarray:
        own = z[ids]
        return np.where(np.abs(own) <= L1, 0, -(own - np.sign(own) * L1) / ((BETA + np.sqrt(n[ids])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in rng.permutation(len(texts)):
            ids, label = texts[i]
            w = weight(ids)
            on = ids[(w != 0) | paired[ids]]
            v = factors[on]
            both = v.sum(0)
            logit = start + w.sum() + 0.5 * float((both * both - (v * v).sum(0)).sum())
            wrong = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label
            grown = np.sqrt(n[ids] + wrong * wrong)
            z[ids] += wrong - (grown - np.sqrt(n[ids])) / ALPHA * w
            n[ids] += wrong * wrong
            start -= 0.01 * wrong
            if len(on) > 1:
                step = wrong * (both - v) + FACTOR_L2 * v
                met[on] += step * step
                factors[on] -= FACTOR_RATE * step / np.sqrt(met[on])
    return weight(np.arange(size)), factors, start


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, rows: int = SAMPLE_ROWS) -> Model:
    return calibrated(labelled_sample(docs, labels, "toxic", folds, held_out, rows), train)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``; the model's size is bounded by ``BITS``."""
    return with_score(docs, model, text, name)
