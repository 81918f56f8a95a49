"""The corpus pipeline: each stage applies one of the training-data operators to all its predecessor kept.

Columns beyond those of ``documents`` are carried along, whatever their names, up to the last stage, which returns
doc_id, n_tokens and ids. Cases that all stages define alike:

- Null and empty texts: scored like a text without features by the first two stages (so all of them stay or all go),
  never near copies, never contaminated, encoded as no ids. Null doc_id: the row goes through every stage on its own
  text and is never dropped as a near copy.
- Very long texts: read whole by every stage.
- Repeated rows and ties: equal texts get equal scores; of equal or near texts the smallest doc_id stays, of rows that
  share it the least by text; a row that is repeated exactly stays once.
- Empty table: every stage returns no rows, with the same columns. No labels, or none that tell anything: a model that
  has learnt no term rejects nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm import decontaminate, jaccard_join, quality, sentencepiece_codec, toxicity
from plenum.llm.entry import tokenizer_file
from plenum.llm.scratch import materialise, small_batches, unused
from plenum.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _prepare(spark: SparkSession) -> None:
    ship(spark)
    small_batches(spark)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    _prepare(spark)
    model, name = quality.fit(docs, _table(spark, sf_dir, "labels")), unused(docs, "score")
    return quality.score(docs, model, name=name).where(F.col(name) >= quality.THRESHOLD).drop(name)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    _prepare(spark)
    model, name = toxicity.fit(docs, _table(spark, sf_dir, "labels")), unused(docs, "score")
    if not model.weights.any():
        return docs
    return toxicity.score(docs, model, name=name).where(F.col(name) < toxicity.THRESHOLD).drop(name)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8) stays."""
    _prepare(spark)
    return jaccard_join.one_of_each(docs, 5, 4, 5)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    _prepare(spark)
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of what is left."""
    _prepare(spark)
    rows = docs.select("doc_id", "text")
    found = sentencepiece_codec.encode(rows, tokenizer_file("piece_bpe_32k.model"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_copies", no_near_copies),
    ("decontamination", no_benchmark),
    ("sentencepiece", tokens),
]

#: Trained models and similarity classes over word shingles are not SQL; tests/llm holds the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
