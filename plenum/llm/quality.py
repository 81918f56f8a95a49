"""Quality classifier: supervised subword embeddings (Joulin et al. 2017).

Every word, word pair and character n-gram of a text is hashed to a bucket with a learned vector; a text is the average of
its features' vectors, and a softmax over a linear layer gives the class. A word that follows itself shares one pair
bucket with all others that do. Vectors and layer are trained by stochastic gradient descent in numpy on a bounded
sample of labelled rows (``SAMPLE_ROWS``, chosen by a hash over the whole table); the steps of the vectors are scaled
by how often their bucket was met, so that rare and frequent features learn alike.

The logit is then calibrated (``features.calibrated``) on texts of the sample that were not learnt from, so that 0.3
means the same for a small sample as for a large one.

Averaging and the layer are both linear, so the layer is folded into the vectors after training: scoring looks up one
number for each feature. Whole texts are scored, in slices of bounded memory. Inputs are the text's bytes and nothing
else.

Null or empty text: no features, so the score is what the bias alone gives. Repeated rows: the same score each. No
labelled rows: score 0.5 everywhere. Extra columns are kept; one named like the new column (``score``, or another name
given to ``score()``) is replaced. Null doc_id: scored like others, never learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from plenum.llm.features import calibrated, gram_buckets, labelled_sample, pieces, word_buckets
from plenum.llm.textbytes import SAME, WHITE, buffers, mix, trimmed

SAMPLE_ROWS, BITS, DIMENSIONS, EPOCHS, LEAST_STEPS, RATE = 4000, 18, 8, 4, 3000, 0.5
GRAMS = (3, 4, 5)
THRESHOLD = 0.3
_REPEAT = np.uint64(0x2545F4914F6CDD1D)


def _features(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of each feature, its bucket), in several lots."""
    word, first, bucket = word_buckets(raw, at, SAME, WHITE, BITS)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    yield row, bucket
    if len(word) > 1:
        pair = np.where(word[1:] == word[:-1], _REPEAT, mix(word[:-1] * np.uint64(3) + word[1:]))
        same = row[1:] == row[:-1]
        yield row[1:][same], (pair[same] >> np.uint64(64 - BITS)).astype(np.uint32)
    for places, found in gram_buckets(raw, at, SAME, WHITE, GRAMS, BITS):
        yield np.searchsorted(at, places, "right") - 1, found


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    curve: tuple[float, float] = (1.0, 0.0)

    def score(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        slope, offset = self.curve
        return 1 / (1 + np.exp(-np.clip(slope * self.logits(raw, at) + offset, -40, 40)))

    def logits(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
        for data, cuts, rows in pieces(raw, at):
            for row, bucket in _features(data, cuts):
                np.add.at(total, rows, np.bincount(row, self.weights[bucket], len(rows)))
                np.add.at(count, rows, np.bincount(row, minlength=len(rows)))
        return total / np.maximum(count, 1) + self.bias


def train(sample: list[tuple[bytes, int]], seed: int = 7) -> Model:
    """Stochastic gradient descent, one text at a time."""
    if not sample:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    texts = []
    for text, label in sample:
        raw = np.frombuffer(text, np.uint8)
        bags = [b for data, cuts, _ in pieces(raw, np.array([0, len(raw)])) for _, b in _features(data, cuts)]
        bucket, count = np.unique(np.concatenate(bags), return_counts=True)
        texts.append((bucket, (count / max(1, count.sum())).astype(np.float32), label))
    rng = np.random.Generator(np.random.PCG64(seed))
    vectors = rng.normal(0, 0.1, (1 << BITS, DIMENSIONS)).astype(np.float32)
    layer = rng.normal(0, 0.5, (2, DIMENSIONS)).astype(np.float32)
    bias = np.log(np.bincount([y for *_, y in texts], minlength=2) + 1.0).astype(np.float32)
    met = np.full(1 << BITS, 1e-6, np.float32)
    epochs = max(EPOCHS, LEAST_STEPS // len(texts))
    steps, done = epochs * len(texts), 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            bucket, share, label = texts[i]
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = share @ vectors[bucket]
            logits = layer @ hidden + bias
            wrong = np.exp(logits - logits.max())
            wrong /= wrong.sum()
            wrong[label] -= 1
            back = layer.T @ wrong
            met[bucket] += share * share
            vectors[bucket] -= (rate * share / np.sqrt(met[bucket]))[:, None] * back
            layer -= 0.1 * rate * np.outer(wrong, hidden)
            bias -= 0.1 * rate * wrong
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, rows: int = SAMPLE_ROWS) -> Model:
    return calibrated(labelled_sample(docs, labels, "quality", folds, held_out, rows), train)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``. The model, a megabyte whatever the corpus, is broadcast."""
    return with_score(docs, model, text, name)


def with_score(docs: DataFrame, model, text: str, name: str) -> DataFrame:
    """``docs`` with the column ``name`` that model.score() gives for the text's bytes."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [StructField(f.name, f.dataType, True) for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.score(*buffers(batch.column(batch.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(trimmed(run), StructType([*fields, StructField(name, DoubleType())]))
