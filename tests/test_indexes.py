"""Stored indexes: the same rows as scans, few buckets and cells read, measured recall, hand-traced distance ranks."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.functions import query as Q
from plenum.operators import search, text_index, vector_index
from plenum.plans import indexes
from plenum.sources import documents, store


@pytest.fixture(scope="module")
def texts(spark):
    """Short and long texts of few words (many ties), Hebrew among them, and rows without text."""
    rng, words = np.random.default_rng(4), [*"abcdefgh", "the", "foo-bar", "הכנסת", "ובכנסת", "כנסת"]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(1, 60)), p=_skewed(len(words)))), f"src{i % 3}", i % 7 == 0 or None) for i in range(900)]
    rows += [(900 + i, "the " * 300 + "a b " * i, "src1", None) for i in range(12)] + [(950, None, "src0", None), (951, "", "src0", None), (952, " -- ", "src0", None)]
    return documents.with_tokens(spark.createDataFrame(rows, "id long, text string, station string, is_noise boolean")).cache()


def _skewed(n):
    p = 1 / np.arange(1, n + 1)
    return p / p.sum()


@pytest.fixture(scope="module")
def postings(spark, texts):
    path = store.fresh(spark, "tokens")
    text_index.write_tokens(texts, path, buckets=8, block=16)
    return text_index.read(spark, path, buckets=8)


@pytest.fixture(scope="module")
def grams(spark, texts):
    path = store.fresh(spark, "grams")
    text_index.write_trigrams(texts, path, buckets=8, listed=10)
    return text_index.read(spark, path, buckets=8)


QUERIES = ["a", "a h", "g OR h", '"a b" the', '"a b c"', "a NOT b", "d -the", "הכנסת", "foo-bar", "foo-bar OR h", "-a", "zzz", "a zzz", "a OR zzz", '"a a"', "", "כנסת OR g NOT f"]


def test_postings_give_what_a_scan_gives(texts, postings):
    for i, text in enumerate(QUERIES):
        parsed, variants, station = Q.parse(text), Q.morphology(text), (None, "src1")[i % 2]
        for by_distance in (False, True) if i < 4 else (True,):
            want = search.keyword_query(texts, parsed, variants, 12, station=station, by_distance=by_distance)
            got = text_index.keyword_query(postings, parsed, variants, 12, by_distance, station)
            assert [tuple(r) for r in got.collect()] == [(r.id, r.rank) for r in want.collect()], (text, by_distance)


def test_plain_queries(texts, postings):
    for text in ("the a", "a b c", "A, The!", "nothing"):
        for by_distance in (False, True):
            want = search.keyword(texts, text, 15, by_distance=by_distance)
            got = text_index.keyword(postings, text, 15, by_distance)
            assert [tuple(r) for r in got.collect()] == [(r.id, r.rank) for r in want.collect()]


def test_positional_match_is_the_array_predicate(texts):
    """The compiled query over positions matches the rows that the predicate over token arrays matches."""
    for text in QUERIES[3:14]:
        parsed = Q.parse(text)
        want = {r.id for r in texts.where(Q.predicate(search.stored_tokens(texts), parsed) & ~F.col("is_noise").eqNullSafe(True)).collect()}
        assert {r.id for r in search.keyword_query(texts, parsed, None, 5000, by_distance=True).collect()} == want


def _weight(d):
    return 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))


def test_distance_ranks_by_hand(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "a x b"), (3, "a b a"), (4, "a " + "x " * 150 + "b"), (5, "a"), (6, "a a")], "id int, text string")
    of = lambda q: {r.id: r.rank for r in search.keyword_query(rows, Q.parse(q), by_distance=True).collect()}
    both = {r.id: r.rank for r in search.keyword(rows, "a b", by_distance=True).collect()}
    assert both[1] == pytest.approx(0.0991032, abs=1e-6) and both[2] == pytest.approx(_weight(2), abs=1e-6)
    assert both[3] == pytest.approx(1 - (1 - _weight(1)) ** 2, abs=1e-6)  # pairs (0, 1) and (2, 1)
    assert both[4] == pytest.approx(Q.LEAST_RANK) and set(both) == {1, 2, 3, 4}
    assert of('"a b"') == pytest.approx({1: both[1], 3: both[3]})
    # A single token, and a choice of tokens, go by frequency; an excluded token makes the query a conjunction.
    one = 0.1 / 1.64493406685
    assert of("a")[5] == pytest.approx(one, abs=1e-7) and of("a")[6] == pytest.approx(one * 1.25, abs=1e-7)
    assert of("a OR b")[1] == pytest.approx(one, abs=1e-7) and of("a OR b")[5] == pytest.approx(one / 2, abs=1e-7)
    assert of("a NOT b") == pytest.approx({5: Q.LEAST_RANK, 6: Q.LEAST_RANK})


def test_bounds_hold(spark):
    """A block's bound is never below the rank of any row with no more occurrences."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(150):
        places = rng.permutation(int(rng.integers(4, 40)))
        m, n = int(rng.integers(1, 1 + len(places) // 2)), int(rng.integers(1, 1 + len(places) // 2))
        rows.append((i, sorted(map(int, places[:m])), sorted(map(int, places[m : m + n]))))
    query = Q.compiled_plain("a b")
    frame = spark.createDataFrame(rows, "id int, a array<int>, b array<int>")
    rank = query.rank_by_distance({"a": F.col("a"), "b": F.col("b")})
    got = frame.select(rank.alias("r"), query.distance_bound({"a": F.size("a"), "b": F.size("b")}).alias("m")).collect()
    assert all(r.r <= r.m for r in got) and any(r.m < 0.9 for r in got)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_searches_read_few_buckets(spark, data):
    for found in (indexes.keyword_index_plain(spark, data), indexes.trigram_index_topk(spark, data)):
        plan = _plan(found)
        assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|INSET|=)", plan) and re.search(r"PushedFilters: \[[^\]]*In\((token|gram)", plan)
        assert "documents.parquet" not in plan and "text_search" not in plan


def test_blocks_below_the_floor_are_not_evaluated(spark, postings, monkeypatch):
    """What is evaluated after the first blocks shrinks as the floor rises."""
    met = []
    whole = text_index._evaluated

    def counted(some, *rest):
        met.append(some.select("block").distinct().count())
        return whole(some, *rest)

    monkeypatch.setattr(text_index, "_evaluated", counted)
    text_index.keyword(postings, "the", 5, by_distance=False).collect()
    blocks = postings.of("token", ["the"]).select("block").distinct().count()
    assert met[0] <= 2 * 5 and sum(met) < blocks


@pytest.mark.parametrize("threshold", [0.05, 0.3, 1.0])
def test_trigrams_give_what_a_scan_gives(texts, grams, threshold):
    for text, station in (("a b c", None), ("the", "src1"), ("הכנסת", None), ("zzz", None)):
        want = [(r.id, r.similarity) for r in search.trigram(texts, text, 15, threshold, station=station).collect()]
        assert [tuple(r) for r in text_index.trigram(grams, text, 15, threshold, station).collect()] == want
    with pytest.raises(ValueError):
        text_index.trigram(grams, "a", 15, 0.0)


def test_rows_of_postings_are_bounded(postings, grams):
    assert postings.rows.agg(F.max("n")).first()[0] <= 4 * 16
    assert grams.rows.agg(F.max(F.size("postings"))).first()[0] <= 4 * 10


def test_indexes_of_nothing(spark, texts):
    none = texts.where("false")
    path, other = store.fresh(spark, "none"), store.fresh(spark, "none")
    text_index.write_tokens(none, path)
    text_index.write_trigrams(none, other)
    kinds = "bucket int, token string, block long, most int, n int, postings array<struct<id: long, at: array<int>, station: string, is_noise: boolean>>"
    assert text_index.keyword(text_index.Postings(spark.read.schema(kinds).parquet(path)), "a").count() == 0
    vectors = spark.createDataFrame([], "id long, embedding_he array<float>")
    at = store.fresh(spark, "none")
    vector_index.write(vectors, at)
    index = vector_index.read(spark, at)
    assert vector_index.find(index, [1.0, 0.0]).count() == 0


# vectors


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 20))
    rows = [(i, (centres[i % 30] + 0.4 * rng.normal(size=20)).tolist(), f"src{i % 3}", i % 11 == 0 or None) for i in range(3000)]
    rows += [(3000 + i, rows[5][1], "src0", None) for i in range(60)] + [(4000, [0.0] * 20, "src0", None), (4001, None, "src0", None)]
    return spark.createDataFrame(rows, "id long, embedding_he array<float>, station string, is_noise boolean").cache()


@pytest.fixture(scope="module")
def index(spark, vectors):
    path = store.fresh(spark, "vectors")
    vector_index.write(vectors, path, cells=40)
    return vector_index.read(spark, path)


def test_every_vector_is_indexed(vectors, index):
    assert index.rows.count() == vectors.where("embedding_he IS NOT NULL").count() == sum(index.counts)
    assert index.rows.select("id").exceptAll(vectors.select("id")).count() == 0


def test_exact_path_is_the_exact_search(vectors, index):
    for at in (0, 5, 17):
        q = vectors.where(F.col("id") == at).first()["embedding_he"]
        for where in ({}, {"station": "src1"}):
            want = [(r.id, r.similarity) for r in search.semantic(vectors, q, 25, **where).collect()]
            assert [(r.id, r.similarity) for r in vector_index.find(index, q, 25, exact=True, **where).collect()] == want
            got = vector_index.find(index, q, 25, probes=40, ranked=1000, **where).collect()
            assert [(r.id, r.similarity) for r in got] == want and not any(r.is_noise for r in got)


def test_recall_of_single_searches(vectors, index):
    met = total = 0
    for row in vectors.where("id % 20 = 0 AND id < 600").collect():
        want = {r.id for r in search.semantic(vectors, row.embedding_he, 20).collect()}
        got = {r.id for r in vector_index.find(index, row.embedding_he, 20, probes=6).collect()}
        met, total = met + len(want & got), total + len(want)
    assert met / total >= 0.9


def test_probed_cells_prune_the_scan(vectors, index):
    q = vectors.first()["embedding_he"]
    plan = _plan(vector_index.find(index, q, probes=3))
    assert len(re.findall(r"PartitionFilters: \[[^\]]*cell#\d+ IN", plan)) >= 2
    scans = re.findall(r"ReadSchema: (\S+)", plan)
    assert any("embedding_he" not in s for s in scans)


def test_many_queries_in_blocks(spark, vectors, index, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_FLOATS", 64 * 20)
    asked = vectors.where("id % 20 = 0 OR id >= 3000").select(F.col("id").alias("query_id"), F.col("embedding_he").alias("vector"))
    m = {r.id: np.array(r.embedding_he, float) for r in vectors.where("embedding_he IS NOT NULL").collect()}
    ids = np.array(sorted(m))
    units = vector_index.unit(np.array([m[i] for i in ids]))
    exact, near = (vector_index.find_all(index, asked, 20, probes).collect() for probes in (40, 6))
    got = {}
    for r in exact:
        got.setdefault(r.query_id, {})[r.place] = (r.id, r.similarity)
    want = {}
    for q in (r.query_id for r in asked.collect() if r.query_id in m):
        sims = units @ vector_index.unit(m[q][None])[0]
        order = np.lexsort((ids, -np.round(sims, 9)))[:20]
        want[q] = [int(ids[i]) for i in order]
        assert np.allclose([got[q][k][1] for k in range(1, 21)], sims[order], atol=1e-6)
        assert len({x for x, _ in got[q].values()}) == 20
    hits = {(q, i) for q, own in want.items() for i in own}
    # Copies of one vector tie; any twenty of them are right, so they are left out of the recall.
    free = {q for q in want if q < 3000 and q % 30 != 5}
    assert sum((r.query_id, r.id) in hits for r in near if r.query_id in free) / sum(20 for _ in free) >= 0.9


def test_recall_of_the_registered_query(spark):
    got = indexes.vector_index_recall(spark, "/root/testdata/sf0.01").agg(F.sum("found"), F.sum("nearest"), F.count("*")).first()
    assert got[2] == 25 and got[0] / got[1] >= 0.9


def test_tables_are_made_anew_when_their_source_changes(spark, tmp_path):
    made = []
    source, write = str(tmp_path / "t.parquet"), lambda to: made.append(to)
    spark.range(3).write.parquet(source)
    first = store.once(spark, "x", [source], write)
    assert store.once(spark, "x", [source], write) == first and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(source)
    assert store.once(spark, "x", [source], write) != first and len(made) == 2
