"""Models in tasks: one load for each worker, calls of bounded size, failures as nulls, the trained vectors."""

import os
import re

import numpy as np
from pyspark.sql import functions as F

from plenum.operators import fusion, models
from plenum.plans import modelled


def test_calls_are_bounded_and_complete():
    texts = ["w " * n for n in (1, 50, 3, 900, 2, 2, 7, 40, 1, 1)]
    got = list(models.calls(texts, tokens=100, most=3))
    assert sorted(i for c in got for i in c) == list(range(10))
    assert all(len(c) <= 3 and (len(c) == 1 or len(c) * max(len(texts[i].split()) + 1 for i in c) <= 100) for c in got)


def test_a_failing_text_costs_only_itself():
    seen = []

    def model(texts):
        seen.append(len(texts))
        if any("bad" in t for t in texts):
            raise RuntimeError
        return [len(t) for t in texts]

    assert models.results(model, ["a", "bad", "ccc", ""]) == [1, None, 3, 0] and seen == [4, 1, 1, 1, 1]
    assert models.results(lambda texts: [1], ["a", "b"]) == [1, 1] and models.results(model, []) == []


def test_a_worker_loads_a_model_once(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda texts: [[float(len(t)), 1.0] if "fail" not in t else 1 / 0 for t in texts]

    rows = spark.range(400).select("id", F.when(F.col("id") % 50 == 7, "fail").otherwise(F.concat(F.lit("text "), "id")).alias("text"), F.lit(1).alias("v")).repartition(12)
    got = models.embedded(rows, f"test-{tmp_path}", load, column="v").collect()
    assert {r.id for r in got} == {i for i in range(400) if i % 50 != 7} and all(r.v[0] == len(f"passage: text {r.id}") for r in got)
    again = models.embedded(rows.withColumn("text", F.lit(None).cast("string")), f"test-{tmp_path}", load, mode="query").collect()
    assert {tuple(r.embedding_he) for r in again} == {(7.0, 1.0)}
    loads = open(log).read().split()
    assert len(loads) == len(set(loads))


def test_rerank_scores_the_head_only(spark):
    rows = spark.createDataFrame([(i, f"t{i} " + "x" * 600, 1.0 - i / 100) for i in range(30)], "segment_id int, text string, score double")
    score = models.scorer("head", lambda: lambda texts: [-float(t.split()[0][1:]) if len(t) <= 512 else 1 / 0 for t in texts])
    got = fusion.reranked(rows, score, head=5).collect()
    assert [r.segment_id for r in got] == list(range(30)) and [r.rerank_score for r in got[:6]] == [0, -1, -2, -3, -4, None]
    other = models.scorer("tail", lambda: lambda texts: [float(t.split()[0][1:]) for t in texts])
    assert [r.segment_id for r in fusion.reranked(rows, other, head=5).collect()] == [4, 3, 2, 1, 0, *range(5, 30)]


def test_reranked_query_by_brute_force(spark, data):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    model = modelled._model(spark, data)
    q = model([modelled.RERANK_QUERY])[0]
    got = modelled.rerank_head(spark, data).collect()
    head, rest = got[:20], got[20:]
    assert all(r.rerank_score is None for r in rest) and [r.rank for r in rest] == sorted((r.rank for r in rest), reverse=True)
    assert min(r.rank for r in head) >= max((r.rank for r in rest), default=0)
    want = [round(float(model([texts[r.segment_id][:512]])[0] @ q), 6) for r in head]
    assert np.allclose([r.rerank_score for r in head], want, atol=1e-6) and want == sorted(want, reverse=True)


def test_weights_are_inverse_frequencies(spark):
    texts = ["a b", "a a c", "", None]
    model = models.train_vectors(spark.createDataFrame([(t,) for t in texts], "text string"), buckets=64, dims=8)
    for word, n in (("a", 2), ("b", 1)):
        bucket = model.places(word)[0]
        held = sum(any(model.places(w)[0] == bucket for w in re.findall(r"\w+", t or "")) for t in texts)
        assert held >= n and np.isclose(model.weights[bucket], np.log(5 / (1 + held)))
    assert np.allclose(np.linalg.norm(model(["a b c"])[0]), 1) and not model(["", "--"])[0].any()
