"""Phrase lists in one pass, the detections of the noise filter, breaks that carry their rows."""

from pyspark.sql import functions as F

from plenum.functions import constants as C
from plenum.functions import text as T
from plenum.operators import noise, phrases

LISTS = {"a": ("ab", "abc", "bc", "c d"), "b": ("abc", "zz", ""), "none": ()}
TEXTS = ["abc", "xabcx ab", "bc d", "zzz", "", None, "ab c d" * 5000, "שלום abc"]


def test_overlapping_phrases_are_all_found(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").withColumn("a", F.lit("old"))
    got = {r.i: (r.a, r.b, r.none) for r in phrases.counted(rows, LISTS, F.col("text")).collect()}
    want = {i: tuple(sum(bool(p) and p in (t or "") for p in own) for own in LISTS.values()) for i, t in enumerate(TEXTS)}
    assert got == want and phrases.counted(rows.where("false"), LISTS, F.col("text")).count() == 0


def test_counts_are_those_of_the_column_function(spark):
    lists = {"ads": C.FILTER_AD_PHRASES, "opens": C.FILTER_AD_STARTS}
    texts = [" ".join(C.FILTER_AD_PHRASES[:k]) + " ועוד " + C.FILTER_AD_STARTS[k % len(C.FILTER_AD_STARTS)] * (k % 2) for k in range(len(C.FILTER_AD_PHRASES))]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    found = phrases.counted(rows, lists, F.lower("text")).withColumns({f"{n}_": T.hits(F.lower("text"), own) for n, own in lists.items()})
    assert all((r.ads, r.opens) == (r.ads_, r.opens_) for r in found.collect())


def test_detections_by_priority(spark):
    o, c, (a, b, *_), j = C.FILTER_AD_STARTS[0], C.FILTER_AD_ENDS[0], C.FILTER_AD_PHRASES, C.FILTER_JINGLES[0]
    said = [o, "in between", c, "after it", f"{a} {b}", f"only {a}", j, f"{j} for long", f"{a} {b} {j}", "music", None]
    rows = spark.createDataFrame([("m", i, t, 10.0 * i, 10.0 * i + (20 if i == 7 else 8)) for i, t in enumerate(said)], "media_id string, sentence_index int, text string, start_time double, end_time double")
    audio = spark.createDataFrame([("m", i, "music") for i in (1, 6, 9)], "media_id string, sentence_index int, noise_type string")
    got = {r.sentence_index: r.noise_type for r in noise.detections(rows, audio).collect()}
    assert got == {0: "commercial", 1: "commercial", 2: "commercial", 4: "commercial", 6: "jingle", 8: "commercial", 9: "music"}
    assert {r.sentence_index for r in noise.detections(rows).collect()} == set(got) - {9}


def test_breaks_carry_their_rows_through_one_shuffle(spark):
    rows = spark.createDataFrame([(k, i, f"text {k} {i}", ["x", None]) for k in ("a", None) for i in range(200)], "k string, i int, text string, more array<string>")
    out = noise.with_breaks(rows, "k", "i", F.col("i") % 50 == 3, F.col("i") % 50 == 9)
    assert out.columns == ["k", "i", "text", "more", "in_break"] and out.drop("in_break").exceptAll(rows).count() == 0 and out.count() == 400
    assert {(r.k, r.i) for r in out.where("in_break").collect()} == {(k, i) for k in ("a", None) for i in range(200) if 3 <= i % 50 <= 9}
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
