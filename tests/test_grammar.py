import pytest

from plenum.functions import query as Q
from plenum.functions import text as T
from pyspark.sql import functions as F


def test_phrases_terms_and_exclusions():
    p = Q.parse('"כיפת ברזל" NOT חמאס -איראן טיל')
    assert (p.phrases, p.terms, p.excluded, p.operator, p.has_operators) == (["כיפת ברזל"], ["טיל"], ["חמאס", "איראן"], "and", True)
    assert Q.tsquery(p) == "((('כיפת' <-> 'ברזל') & 'טיל') & !'חמאס') & !'איראן'"


@pytest.mark.parametrize(
    "text, terms, excluded, operator, operators, ts",
    [
        ("a OR b", ["a", "b"], [], "or", True, "'a' | 'b'"),
        ("a AND b", ["a", "b"], [], "and", False, "'a' & 'b'"),
        ("-foo", [], ["foo"], "and", True, ""),
        ("x NOT", ["x", "NOT"], [], "and", False, "'x' & 'NOT'"),
        ("a או b", ["a", "b"], [], "or", True, "'a' | 'b'"),
        ("", [], [], "and", False, ""),
    ],
)
def test_operators(text, terms, excluded, operator, operators, ts):
    p = Q.parse(text)
    assert (p.terms, p.excluded, p.operator, p.has_operators, Q.tsquery(p)) == (terms, excluded, operator, operators, ts)


def test_expansion():
    assert Q.expand("Iron Dome")[1] == ["כיפת ברזל"]
    assert Q.expand("trump budget") == ("trump budget טראמפ תקציב", ["טראמפ", "תקציב"])
    assert "חרד" in Q.morphology("חרדים") and Q.morphology("abc") == set()
    assert len(Q.variants_of("חרדים", Q.morphology("חרדים"))) <= Q.MAX_VARIANTS


def test_predicate_and_rank(spark):
    rows = spark.createDataFrame([(1, "a b c"), (2, "b a"), (3, "c"), (4, ""), (5, None)], "i int, text string").withColumn("t", T.tokens(F.col("text")))
    hits = lambda q: [r.i for r in rows.where(Q.predicate(F.col("t"), Q.parse(q))).orderBy("i").collect()]
    assert hits('"a b"') == [1] and hits("a b") == [1, 2] and hits("a OR c") == [1, 2, 3] and hits("a -c") == [2] and hits("-a") == []
    rank = rows.where("i = 3").select(Q.rank(F.col("t"), ["c"]).alias("r")).first().r
    assert round(rank, 4) == 0.0608
