import pytest

from plenum.plans import registry
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, data, duck, name):
    assert_same(registry.queries()[name](spark, data), duck, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, data, name):
    assert registry.queries()[name](spark, data).count() > 0


def test_sentences_of_all_conversations(spark, data):
    rows = registry.queries()["segment_sentences_all"](spark, data)
    turns = spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn").collect()
    begun = {r.conv_id for r in turns if r.turn == 0}
    assert {(r.segment_id, r.sentence_index) for r in rows.collect()} == {(r.conv_id, r.turn) for r in turns if r.conv_id in begun}


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns


def test_topk_plan_has_no_full_sort(spark, data):
    plan = registry.queries()["semantic_topk"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


@pytest.mark.parametrize("name", ["keyword_plain", "keyword_phrase", "trigram_topk", "hybrid_rrf"])
def test_searches_read_stored_tokens(spark, data, name):
    """No text is cut into words or trigrams when a query runs, but for the few rows that fusion weighs."""
    plan = registry.queries()[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    before = plan.split("Relation")[0] if name != "hybrid_rrf" else ""
    assert "text_search" in plan or "text_trigrams" in plan
    assert "split(" not in before


def test_api_nests_sentences_in_order(spark):
    from plenum import api

    segs = spark.createDataFrame([(i, 1, f"common word{i} and more of it here", [1.0, i / 10], i) for i in range(6)], "segment_id int, topic_id int, text string, embedding_he array<double>, segment_time int")
    sents = spark.createDataFrame([(i * 10 + j, i, j, f"part {j} of common {i}", [1.0, 0.0]) for i in range(5) for j in (1, 0)], "id int, segment_id int, sentence_index int, text string, embedding_he array<double>")
    for mode in ("hybrid", "semantic", "keyword"):
        got = api.run(api.Request("common", mode, limit=4), api.Index(sents, segs), lambda _: [1.0, 0.0]).collect()
        assert len(got) == 4 and [r.score for r in got] == sorted((r.score for r in got), reverse=True)
        assert all([s.sentence_index for s in r.sentences] == ([0, 1] if r.segment_id < 5 else []) for r in got)


def test_expanded_tokens_are_used_where_they_are_stored(spark):
    from plenum.operators import search
    from plenum.sources import documents

    rows = documents.with_tokens(spark.createDataFrame([(1, "ובממשלה של הכנסת"), (2, "plain words only")], "id int, text string"))
    assert [r.text_search_expanded is None for r in rows.orderBy("id").collect()] == [False, True]
    assert [r.id for r in search.keyword(rows, "כנסת").collect()] == [1] and [r.id for r in search.keyword(rows, "words").collect()] == [2]
