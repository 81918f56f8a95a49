"""Models inside tasks: loaded once for each Python worker, fed by batches of bounded size, failures as nulls.

A model comes as ``load``, a function without arguments that is called in the worker the first time it is needed; what
it returns stays there for all later batches and tasks. Texts of an Arrow batch are ordered by length, so that those
of a call are about equally long, and a call holds at most ``TOKENS`` tokens (words, padded to the longest) and
``TEXTS`` texts. If a call fails, its texts are tried one by one; a text that fails by itself gets null.

``HashedVectors`` is a small model of this kind that is trained here: words hashed to buckets, weighted by their
rarity in a table of texts. Training is one aggregation; the model has the size of its buckets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType, _parse_datatype_string

from plenum.functions import text as T

#: Padded tokens and texts of one call of a model.
TOKENS, TEXTS = 16384, 64

_loaded: dict[str, object] = {}


def loaded(name: str, load: Callable[[], object]) -> object:
    """The worker's model of this name."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def calls(texts: Sequence[str], tokens: int = TOKENS, most: int = TEXTS) -> Iterator[list[int]]:
    """The places of the texts of each call: by length, bounded; a text that is longer than a call is alone."""
    sizes = [len(t.split()) + 1 for t in texts]
    now: list[int] = []
    for i in sorted(range(len(texts)), key=lambda i: (sizes[i], i)):
        if now and (len(now) == most or (len(now) + 1) * sizes[i] > tokens):
            yield now
            now = []
        now.append(i)
    if now:
        yield now


def results(apply: Callable[[list[str]], Sequence], texts: Sequence[str], tokens: int = TOKENS, most: int = TEXTS) -> list:
    """What the model gives for each text, null where it fails."""
    out: list = [None] * len(texts)

    def call(places: list[int]) -> None:
        try:
            found = list(apply([texts[i] for i in places]))
            if len(found) != len(places):
                raise ValueError("a model must give one result for each text")
        except Exception:  # noqa: BLE001  whatever a model raises
            for i in places if len(places) > 1 else ():
                call([i])
            return
        for i, x in zip(places, found):
            out[i] = x

    for places in calls(texts, tokens, most):
        call(places)
    return out


def applied(rows: DataFrame, column: str, kind: str | DataType, text: Column, name: str, load: Callable[[], Callable[[list[str]], Sequence]], tokens: int = TOKENS, most: int = TEXTS) -> DataFrame:
    """``rows`` with ``column``: what the model ``name`` gives for ``text`` (null text: as empty)."""
    kind = _parse_datatype_string(kind) if isinstance(kind, str) else kind
    taken = [c for c in rows.columns if c != column]
    kinds = StructType([*rows.select(*taken).schema.fields, StructField(column, kind)])
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            if len(batch):
                model = model or loaded(name, load)
                found = results(model, batch.column(batch.num_columns - 1).to_pylist(), tokens, most)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([None if x is None else np.asarray(x).tolist() for x in found], arrow)], [*batch.schema.names[:-1], column])

    return rows.select(*taken, F.coalesce(text, F.lit("")).alias("_text_of_model")).mapInArrow(run, kinds)


def embedded(rows: DataFrame, name: str, load: Callable[[], Callable[[list[str]], Sequence]], mode: str = "passage", column: str = "embedding_he", text: str = "text") -> DataFrame:
    """``rows`` with the vectors of a model, which sees the text behind "passage: " or "query: "; rows for which it
    fails are dropped."""
    return applied(rows, column, "array<float>", F.concat(F.lit(f"{mode}: "), F.coalesce(text, F.lit(""))), name, load).where(F.col(column).isNotNull())


def scorer(name: str, load: Callable[[], Callable[[list[str]], Sequence]]) -> Callable[[Column], Column]:
    """A text column to a model's numbers, for ``fusion.reranked``."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(name, load)
        for texts in batches:
            # Rows that are not to be scored come as nulls and stay so.
            held = texts.notna()
            found = pd.Series([None] * len(texts), texts.index, dtype="float64")
            found[held] = [np.nan if x is None else float(x) for x in results(model, texts[held].tolist())]
            yield found

    return score


@dataclass(frozen=True)
class HashedVectors:
    """Vectors of ``dims`` numbers of length one: each word adds its bucket's weight, with a sign, to one of them."""

    weights: np.ndarray = field(repr=False)
    dims: int = 64

    def places(self, word: str) -> tuple[int, int, float]:
        """Bucket, dimension and sign of a word."""
        h = int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
        bucket = h % len(self.weights)
        return bucket, bucket % self.dims, 1.0 if h // len(self.weights) % 2 else -1.0

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out, known = [], {}
        for text in texts:
            v = np.zeros(self.dims)
            for word in re.split(r"[\W_]+", re.sub(r"^(passage|query): ", "", text).lower()):
                if word:
                    if word not in known:
                        bucket, i, sign = self.places(word)
                        known[word] = (i, sign * self.weights[bucket])
                    i, x = known[word]
                    v[i] += x
            size = np.linalg.norm(v)
            out.append(v / size if size else v)
        return out


def bucket_of(word: Column, buckets: int) -> Column:
    return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def train_vectors(texts: DataFrame, text: str = "text", buckets: int = 4096, dims: int = 64) -> HashedVectors:
    """A model whose buckets weigh ln((1 + texts) / (1 + texts with a word of the bucket)). One row for each bucket
    comes to the driver."""
    own = texts.select(F.array_distinct(F.transform(T.tokens(F.coalesce(text, F.lit(""))), lambda w: bucket_of(w, buckets))).alias("b"))
    held = dict(own.select(F.explode("b").alias("b")).groupBy("b").count().collect())
    n = texts.count()
    return HashedVectors(np.array([np.log((1 + n) / (1 + held.get(b, 0))) for b in range(buckets)]), dims)
