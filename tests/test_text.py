import random

from plenum.functions import text as T
from plenum.operators import indexing
from pyspark.sql import functions as F


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_clean_and_split(spark):
    text = "שלום שלום שלום עולם!!!! כןןןן בדיקה.  מה נשמע? טוב"
    assert one(spark, T.clean_asr, text) == "שלום עולם!! כןן בדיקה. מה נשמע? טוב"
    rows = spark.createDataFrame([(1, 0.0, 10.0, "abc. defgh."), (2, 1.111, 2.0, "one part"), (3, 0.0, 1.0, "aa"), (4, 0.0, 1.0, None)], "k int, start double, end double, text string")
    got = [tuple(r) for r in indexing.sentences(rows, ["k"]).select("k", "part", "start", "end", "text").orderBy("k", "part").collect()]
    assert got == [(1, 0, 0.0, 4.0, "abc."), (1, 1, 4.0, 10.0, "defgh."), (2, 0, 1.111, 2.0, "one part")]


CLEANED = [
    ("aaab bbb!", "aab bb!"),
    ("go go go now", "go now"),
    ("go go now", "go go now"),
    ("no no no no, yes", "no, yes"),
    (" a \n\t b ", "a b"),
    ("in. in. in. out", "in. in. in. out"),
    ("ab ab abc", "ab ab abc"),
    ("", ""),
]


def test_clean_by_its_rules(spark, data):
    """Hand-traced cases; on the table, what the rule promises of every result."""
    assert [one(spark, T.clean_asr, t) for t, _ in CLEANED] == [want for _, want in CLEANED]
    for r in spark.read.parquet(f"{data}/documents.parquet").select("text", T.clean_asr(F.col("text")).alias("c")).collect():
        words = r.c.split(" ")
        assert r.c == " ".join(r.c.split()) and set(r.c) <= {*r.text, " "}
        assert not any(a == b == c for a, b, c in zip(r.c, r.c[1:], r.c[2:]))
        assert not any(a.isalnum() and a == b == c for a, b, c in zip(words, words[1:], words[2:]))


def test_junk_and_similarity(spark):
    assert [one(spark, T.is_junk, t) for t in ("ab", "aaaa", "a a a", "abc", "   ")] == [True, True, True, False, True]
    assert one(spark, lambda c: T.similarity(T.trigrams(c), T.trigrams(F.lit("word"))), "word") == 1.0
    assert one(spark, lambda c: T.similarity(T.trigrams(c), T.trigrams(F.lit(""))), "") == 0.0


def test_repeats(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 40))) for _ in range(60)]

    def most(t):
        w = t.split()
        grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)]
        return max(map(grams.count, grams), default=0)

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.most_repeats(T.words(F.col("t"))).alias("m"), T.repeats(T.words(F.col("t"))).alias("three"), T.repeats(T.words(F.col("t")), 2, 4).alias("four")).collect()
    assert all(r.m == most(r.t) and r.three == (r.m >= 3) for r in got)
    pairs = lambda t: [" ".join(p) for p in zip(t.split(), t.split()[1:])]
    assert all(r.four == (max(map(pairs(r.t).count, pairs(r.t)), default=0) >= 4) for r in got)


def test_turns_skip_blanks(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 1.0, "x", "A", 0.9), (1, 1, 1.0, 2.0, " ", "B", 0.1), (1, 2, 2.0, 3.0, "y", "A", 0.5), (1, 3, 3.0, 4.0, "z", None, None)], "media_id int, position int, start double, end double, text string, speaker string, speaker_confidence double")
    got = [tuple(r) for r in indexing.turns(rows).select("turn", "speaker", "start", "end", "text", "speaker_confidence").orderBy("turn").collect()]
    assert got == [(0, "A", 0.0, 3.0, "x y", 0.5), (1, "UNKNOWN", 3.0, 4.0, "z", 0.0)]


def test_highlight_and_minutes(spark):
    assert one(spark, lambda c: T.highlight(c, "a.b"), "xA.B a.b axb") == "x<mark>A.B</mark> <mark>a.b</mark> axb"
    assert one(spark, lambda c: T.minutes(F.lit(125.9)), "") == "2:05"
