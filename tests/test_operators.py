import itertools
import random

import numpy as np
import pytest
from plenum.functions import vector as V
from plenum.operators import fusion, indexing, intervals, noise, search
from pyspark.sql import functions as F

LONG = "one two three four five six seven eight nine ten eleven"


def signal(spark, rows, kind):
    return spark.createDataFrame([(s, LONG, i + 1, v) for i, (s, v) in enumerate(rows)], f"segment_id string, text string, rank_in_signal int, {kind} double")


def test_fusion(spark):
    both = {n: signal(spark, [("S", 0.6)], "similarity") for n in ("sent_he", "seg_he")}
    assert round(fusion.merge(both).first().score, 7) == 0.0245902
    assert fusion.merge({"sent_kw": signal(spark, [("S", 0.06)], "rank")}).count() == 0
    kw = {n: signal(spark, [("S", 0.06)], "rank") for n in ("sent_kw", "seg_kw")}
    row = fusion.merge(kw).first()
    assert round(row.score, 7) == 0.0147541 and row.signal_list == "seg_kw+sent_kw" and row.match_type == "hybrid"
    rows = {r.segment_id: r.score for r in fusion.merge({"seg_he": signal(spark, [("A", 0.9), ("A", 0.8), ("B", 0.7), (None, 0.9)], "similarity")}).collect()}
    assert round(rows["B"], 6) == round(0.8 / 63, 6) and set(rows) == {"A", "B"}


@pytest.mark.parametrize("best, n", [(0.24, 0), (0.25, 1)])
def test_gate(spark, best, n):
    assert fusion.gated(signal(spark, [("A", best)], "similarity")).count() == n


def test_exclusion_and_rerank(spark):
    rows = spark.createDataFrame([("a", "Foo bar", 3.0), ("b", "baz", 2.0), ("c", "qux quux", 1.0)], "segment_id string, text string, score double")
    assert [r.segment_id for r in fusion.without(rows, ["FOO"]).orderBy("segment_id").collect()] == ["b", "c"]
    assert [r.segment_id for r in fusion.reranked(rows, F.length, head=2).collect()] == ["a", "b", "c"]


def test_speakers_and_noise(spark):
    segs = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 2000.0, 2010.0)], "media_id int, segment_index int, start double, end double")
    turns = spark.createDataFrame([(1, 0.0, 4.0, "A"), (1, 4.0, 9.0, "B"), (1, 9.0, 10.0, "A")], "media_id int, s double, e double, speaker string")
    got = [(r.speaker, r.speaker_confidence) for r in intervals.assign_speakers(segs, turns).orderBy("segment_index").collect()]
    assert got == [("A", 0.5), ("UNKNOWN", 0.0)]
    sents = segs.withColumnRenamed("segment_index", "sentence_index").where("sentence_index = 0")
    spans = lambda rows: spark.createDataFrame(rows, "media_id int, s double, e double, label string, span_index int")
    assert [r.noise_type for r in intervals.noisy_sentences(sents, spans([(1, 0.0, 4.0, "music", 0), (1, 4.0, 6.0, "noise", 1)])).collect()] == ["music"]
    assert intervals.noisy_sentences(sents, spans([(1, 0.0, 5.0, "music", 0)])).count() == 0


def test_bucketed_overlap_is_complete(spark):
    rng = random.Random(5)
    span = lambda: (lambda a: (a, a + rng.choice([1.0, 50.0, 900.0])))(rng.uniform(0, 3000))
    left, right = [(1, *span()) for _ in range(60)], [(1, *span()) for _ in range(60)]
    got = intervals.overlapping(spark.createDataFrame(left, "k int, start double, end double"), spark.createDataFrame(right, "k int, s double, e double"), "k")
    want = sorted((a, b, s, e) for _, a, b in left for _, s, e in right if a < e and s < b)
    assert sorted((r.start, r.end, r.s, r.e) for r in got.collect()) == want


def test_long_spans_make_few_rows(spark):
    left = spark.createDataFrame([(1, 0.0, 1e9), (1, 5.0, 6.0), (2, 3.0, 9.0)], "k int, start double, end double")
    right = spark.createDataFrame([(1, float(i), float(i) + 2) for i in range(0, 400, 7)] + [(1, 1e9 - 1, 1e12), (2, 9.0, 10.0)], "k int, s double, e double")
    got = sorted(map(tuple, intervals.overlapping(left, right, "k").select("start", "s").collect()))
    assert got == sorted([(0.0, float(i)) for i in range(0, 400, 7)] + [(0.0, 1e9 - 1)] + [(5.0, float(i)) for i in range(0, 400, 7) if i < 6 and i + 2 > 5])
    levels = list(range(intervals.LEVELS + 1))
    rows = intervals._bucketed(left, "start", "end", levels, ("own", "level", "bucket")).groupBy("k", "start").count()
    assert max(r["count"] for r in rows.collect()) <= 2 * len(levels)


def test_merge_adjacent_and_bins(spark):
    rows = spark.createDataFrame([(1, 0.0, 2.0, "music"), (1, 2.5, 4.0, "music"), (1, 6.0, 7.0, "music")], "k int, start double, end double, label string")
    assert sorted((r.start, r.end) for r in intervals.merge_adjacent(rows, "k").collect()) == [(0.0, 4.0), (6.0, 7.0)]
    media = spark.createDataFrame([(1, 3.0)], "k int, duration double")
    speech = spark.createDataFrame([(1, 0.0, 1.0)], "k int, start double, end double")
    labels = spark.createDataFrame([(1, 0.5, 2.0, "music", 0)], "k int, start double, end double, label string, span_index int")
    for wins, first in ((False, [("speech", 0.0, 1.1), ("music", 1.1, 2.1)]), (True, [("speech", 0.0, 0.5), ("music", 0.5, 2.1)])):
        got = intervals.runs(intervals.label_bins(speech, labels, media, "k", wins), "k")
        assert sorted((r.label, r.start, r.end) for r in got.collect()) == sorted([*first, ("silence", 2.1, 3.1)])


def _breaks(opens, closes, n):
    """The breaks of n sentences as intervals: from an opening cue to the first closing cue among the 61 sentences
    behind it; without one, and if there are so many, 61 sentences, and the one behind them opens nothing."""
    found, free = [], 0
    for begin in sorted(opens):
        if begin < free:
            continue
        ends = [c for c in closes if begin < c <= begin + 61]
        if ends:
            found.append(range(begin, min(ends) + 1))
            free = min(ends) + 1
        elif begin + 61 < n:
            found.append(range(begin, begin + 61))
            free = begin + 62
        else:
            break
    return {i for own in found for i in own}


def test_ad_breaks(spark):
    rng = random.Random(1)
    cases = [[(rng.random() < 0.05, rng.random() < p) for _ in range(150)] for p in (0.0, 0.01, 0.05, 0.2)] + [[(False, False)] * 3 + [(True, False), (False, False), (False, True)], [(True, False)] + [(False, False)] * 99, [(True, False)] + [(False, False)] * 9]
    rows = spark.createDataFrame([(k, i, a, b) for k, c in enumerate(cases) for i, (a, b) in enumerate(c)], "k int, i int, a boolean, b boolean")
    got = noise.in_break(rows, "k", "i", F.col("a"), F.col("b")).where("in_break").collect()
    for k, c in enumerate(cases):
        assert {r.i for r in got if r.k == k} == _breaks([i for i, x in enumerate(c) if x[0]], [i for i, x in enumerate(c) if x[1]], len(c))


def test_breaks_are_streamed(spark):
    """No array of a key's rows is made; breaks go over the ends of batches, but not over those of keys."""
    rng = random.Random(2)
    cues = [(k, i, rng.random() < 0.05, rng.random() < 0.03) for k in (None, 1, 2) for i in range(400 if k != 1 else 5)]
    of = lambda k, at: [c[1] for c in cues if c[0] == k and c[at]]
    want = {(k, i) for k in (None, 1, 2) for i in _breaks(of(k, 2), of(k, 3), 400 if k != 1 else 5)}
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(size)
    try:
        spark.conf.set(size, 7)
        found = noise.in_break(spark.createDataFrame(cues, "k int, i int, a boolean, b boolean").repartition(3), "k", "i", F.col("a"), F.col("b"))
        rows = found.collect()
    finally:
        spark.conf.set(size, kept)
    assert len(rows) == len(cues) and {(r.k, r.i) for r in rows if r.in_break} == want
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()


def _speech(p, size=512, rate=16000, least=0.25, silence=0.1):
    """Speech of a row of probabilities, by its runs: a quiet run ends it where it begins if the part behind its first
    window lasts ``silence``, and a shorter one at the very end with its last window; what is between such runs counts
    if it lasts ``least``."""
    runs, at = [], 0
    for loud, own in itertools.groupby(p, lambda x: x >= 0.5):
        length = len(list(own))
        long, last = (length - 1) * size >= silence * rate, at + length == len(p)
        runs.append((loud, not loud and (long or last), at if loud or long else at + length - 1))
        at += length
    spans = []
    for ending, own in itertools.groupby(runs, lambda r: r[1]):
        begin = next((start for loud, _, start in own if loud), None)
        if not ending and begin is not None:
            end = next((start for _, ends, start in runs if ends and start > begin), len(p))
            spans.append((begin * size, end * size))
    return [(a, b) for a, b in spans if b - a >= least * rate]


def test_speech_spans(spark):
    rng = np.random.default_rng(2)
    cases = [np.repeat(rng.random(40) > 0.5, rng.integers(1, 14, 40)).astype(float).tolist() for _ in range(12)] + [[0.0], [1.0] * 30]
    rows = spark.createDataFrame([(k, i, float(x)) for k, c in enumerate(cases) for i, x in enumerate(c)], "k int, i int, p double")
    got = [(r.k, r.start, r.end) for r in intervals.speech_spans(rows, "k").collect()]
    assert sorted(got) == sorted((k, *s) for k, c in enumerate(cases) for s in _speech(c))


def test_segments_and_topics(spark):
    rng = np.random.default_rng(4)
    rows = [(int(m), i, i * 20.0, i * 20.0 + 20, (rng.normal(size=4) + [3 * (i // 7 % 2), 0, 0, 0]).tolist()) for m in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "media_id int, sentence_index int, start double, end double, embedding_he array<double>")

    def expected(own):
        out, cur, index = [], [], 0
        for _, _, start, end, v in own:
            if cur:
                mean, v2 = np.mean([x[4] for x in cur][-6:], axis=0), np.array(v)
                sim = mean @ v2 / np.linalg.norm(mean) / np.linalg.norm(v2)
                if (sim < 0.55 and len(cur) >= 3) or end - cur[0][2] >= 300:
                    index, cur = index + 1, []
            cur.append((0, 0, start, end, v))
            out.append(index)
        return out

    got = {(r.media_id, r.sentence_index): r.segment_index for r in indexing.segments(df).collect()}
    for m in range(3):
        assert [got[m, i] for i in range(40)] == expected([r for r in rows if r[0] == m])
    topics = {(r.media_id, r.sentence_index): r.topic for r in indexing.topics(df, "media_id", ["sentence_index"], id_column="sentence_index", threshold=0.8).collect()}
    for m in range(3):
        centers, counts = [], []
        for r in (x for x in rows if x[0] == m):
            v = np.array(r[4])
            near = [c @ v / np.linalg.norm(c) / np.linalg.norm(v) for c in centers]
            at = int(np.argmax(near)) if near else -1
            if at >= 0 and near[at] >= 0.8:
                centers[at], counts[at] = (centers[at] * counts[at] + v) / (counts[at] + 1), counts[at] + 1
            else:
                at = len(centers)
                centers.append(v)
                counts.append(1)
            assert topics[m, r[1]] == at


def test_centroid_and_noise_null(spark):
    topics = spark.createDataFrame([("t", [1.0, 0.0], 1)], "topic_id string, centroid array<double>, segment_count int")
    assert tuple(search.joined_topic(topics, "t", [0.0, 1.0]).first()) == ("t", [0.5, 0.5], 2)
    rows = spark.createDataFrame([(1, None), (2, True), (3, False)], "id int, is_noise boolean")
    assert [r.id for r in search.not_noise(rows).orderBy("id").collect()] == [1, 3]
    assert spark.range(1).select(V.cosine(V.literal([0.0, 0.0]), V.literal([1.0, 0.0])).alias("c")).first().c == 0.0
