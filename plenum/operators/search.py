"""Searches over sentences, segments and topics: exact vector top-k, text match and rank, trigram similarity.

Every search filters before it ranks and ends in one ``orderBy().limit()``, which Spark runs as a top-k in each task
and a merge of k rows for each; ties go by id. Media are joined by key; Spark broadcasts them if their size allows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions import constants as C
from plenum.functions import query as Q
from plenum.functions import text as T
from plenum.functions import vector as V


def not_noise(rows: DataFrame) -> DataFrame:
    """is_noise is not true; a null passes. In this form it reaches the Parquet scan."""
    return rows.where(~F.col("is_noise").eqNullSafe(True)) if "is_noise" in rows.columns else rows


def good_enough(rows: DataFrame, threshold: float = C.QUALITY_THRESHOLD) -> DataFrame:
    """The older quality filter: no score, or one over the threshold."""
    return rows.where(F.col("quality_score").isNull() | (F.col("quality_score") > threshold))


def only(rows: DataFrame, **equal: str | None) -> DataFrame:
    """Equality filters for the arguments that are set."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def on_day(rows: DataFrame, day: str, time: str = "segment_time") -> DataFrame:
    """Rows of one day (yyyy-mm-dd), by a range of the time itself, so that the filter reaches the scan."""
    start = F.lit(day).cast("date")
    return rows.where((F.col(time) >= start) & (F.col(time) < F.date_add(start, 1)))


def top(rows: DataFrame, by: str, n: int, id_column: str) -> DataFrame:
    return rows.orderBy(F.col(by).desc(), F.col(id_column)).limit(n)


def semantic(rows: DataFrame, vector: list[float], n: int = 20, threshold: float = C.SEMANTIC_THRESHOLD, id_column: str = "id", embedding: str = "embedding_he", station: str | None = None, media_type: str | None = None) -> DataFrame:
    """The n rows nearest to ``vector`` with a similarity over the threshold. Also the search of a second vector space,
    by ``embedding``; rows without a vector don't match."""
    kept = only(not_noise(rows), station=station, media_type=media_type).where(F.col(embedding).isNotNull())
    found = kept.withColumn("similarity", V.cosine_to(F.col(embedding), vector))
    return top(found.where(F.col("similarity") > threshold), "similarity", n, id_column)


def stored_tokens(rows: DataFrame) -> Column:
    """The tokens of the expanded text: the stored ones, or those of the plain text where these are null
    (``documents.with_tokens``); made from the text if the table has none."""
    if "text_search" in rows.columns:
        return F.coalesce("text_search_expanded", "text_search")
    return T.tokens(T.affix_expand(F.col("text")))


def keyword(rows: DataFrame, query: str, n: int = 20, id_column: str = "id", tokens: Column | None = None, station: str | None = None, media_type: str | None = None, by_distance: bool = False) -> DataFrame:
    """Rows with all of a plain query's tokens, by rank. ``tokens``: the token array; by default ``stored_tokens``.
    ``by_distance``: several tokens rank by how near they stand, otherwise by frequency."""
    tokens = stored_tokens(rows) if tokens is None else tokens
    if by_distance:
        return _by_distance(rows, tokens, Q.compiled_plain(query), n, id_column, station, media_type)
    return _ranked(rows, tokens, lambda t: Q.has_all(t, Q.plain(query)), Q.plain(query), n, id_column, station, media_type)


def keyword_query(rows: DataFrame, parsed: Q.Parsed, variants: set[str] | None = None, n: int = 20, id_column: str = "id", tokens: Column | None = None, station: str | None = None, media_type: str | None = None, by_distance: bool = False) -> DataFrame:
    """Rows that a parsed query matches, by rank."""
    tokens = stored_tokens(rows) if tokens is None else tokens
    if by_distance:
        return _by_distance(rows, tokens, Q.compiled(parsed, variants), n, id_column, station, media_type)
    wanted = [t for x in (*parsed.phrases, *parsed.terms) for t in Q.query_tokens(x)]
    return _ranked(rows, tokens, lambda t: Q.predicate(t, parsed, variants), wanted, n, id_column, station, media_type)


def _ranked(rows: DataFrame, tokens: Column, match: Callable[[Column], Column], wanted: list[str], n: int, id_column: str, station: str | None, media_type: str | None) -> DataFrame:
    # Tokens are made once for the match, and once more for the rows that match.
    kept = only(not_noise(rows), station=station, media_type=media_type).where(T.let(tokens, match))
    return top(kept.withColumn("rank", T.let(tokens, lambda t: Q.rank(t, wanted))), "rank", n, id_column)


def _by_distance(rows: DataFrame, tokens: Column, query: Q.Compiled, n: int, id_column: str, station: str | None, media_type: str | None) -> DataFrame:
    words = query.words()
    if not words:
        return top(rows.where("false").withColumn("rank", F.lit(0.0)), "rank", n, id_column)
    # Rows without any of the words are gone before positions are looked for.
    some = F.arrays_overlap(tokens, F.lit(words))
    kept = only(not_noise(rows), station=station, media_type=media_type).where(some)
    places = lambda t: F.struct(*[Q.positions(t, w).alias(f"w{i}") for i, w in enumerate(words)])
    over = lambda f: T.let(tokens, lambda t: T.let(places(t), lambda s: f({w: s[f"w{i}"] for i, w in enumerate(words)})))
    return top(kept.where(over(query.match)).withColumn("rank", over(query.rank_by_distance)), "rank", n, id_column)


def trigram(rows: DataFrame, query: str, n: int = 20, threshold: float = C.TRIGRAM_THRESHOLD, id_column: str = "id", station: str | None = None, media_type: str | None = None) -> DataFrame:
    """Rows whose trigram similarity to the query reaches the threshold; by the stored trigrams if there are any."""
    grams = F.col("text_trigrams") if "text_trigrams" in rows.columns else T.trigrams(F.col("text"))
    alike = T.let(grams, lambda g: T.similarity(g, T.trigrams(F.lit(query))))
    # The similarity is computed once for the filter, and once more for the rows that pass.
    kept = only(not_noise(rows), station=station, media_type=media_type).where(alike >= threshold)
    return top(kept.withColumn("similarity", alike), "similarity", n, id_column)


def by_topic(rows: DataFrame, topics: DataFrame, n: int = 20, id_column: str = "id", time: str = "segment_time") -> DataFrame:
    """The newest rows of the given topics."""
    kept = not_noise(rows).join(topics.select("topic_id").distinct(), "topic_id", "left_semi")
    return kept.orderBy(F.col(time).desc(), F.col(id_column)).limit(n)


def sentences_of(sentences: DataFrame, segments: DataFrame) -> DataFrame:
    """All sentences of the given segments, noise included, in order."""
    return sentences.join(segments.select("segment_id").distinct(), "segment_id", "left_semi").orderBy("segment_id", "sentence_index")


def enrich(results: DataFrame, sentences: DataFrame) -> DataFrame:
    """Each result with the array of its segment's sentences (empty if none). A segment has a few dozen sentences."""
    fields = [c for c in sentences.columns if c not in ("segment_id", "sentence_index")]
    own = sentences.join(results.select("segment_id").distinct(), "segment_id", "left_semi")
    nested = own.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("sentence_index", *fields))).alias("sentences"))
    out = results.join(nested, "segment_id", "left")
    empty = F.array().cast(nested.schema["sentences"].dataType)
    return out.withColumn("sentences", F.coalesce("sentences", empty))


def nearest_topic(topics: DataFrame, vector: list[float], threshold: float = C.TOPIC_SIMILARITY) -> DataFrame:
    """The nearest topic whose similarity reaches the threshold, or no row."""
    found = topics.withColumn("similarity", V.cosine_to(F.col("centroid"), vector)).where(F.col("similarity") >= threshold)
    return top(found, "similarity", 1, "topic_id")


def joined_topic(topics: DataFrame, topic_id, vector: list[float]) -> DataFrame:
    """``topics`` after a segment joined one: its centroid is the running mean, its count one more."""
    hit = F.col("topic_id") == topic_id
    mean = V.running_mean(F.col("centroid"), F.col("segment_count"), V.literal(vector))
    return topics.withColumns({"centroid": F.when(hit, mean).otherwise(F.col("centroid").cast("array<double>")), "segment_count": F.col("segment_count") + hit.cast("int")})


def expanded(rows: DataFrame, vector: list[float], n: int = 10, more: int = 20, threshold: float = 0.3, id_column: str = "id", embedding: str = "embedding_he", station: str | None = None, media_type: str | None = None) -> DataFrame:
    """The older two-step search: the n direct hits, then up to ``more`` rows of their topics that are not among the
    hits, whatever their similarity. Hits are found before station and media type are looked at, as are topics."""
    scored = rows.where(F.col(embedding).isNotNull()).withColumn("similarity", V.cosine_to(F.col(embedding), vector))
    near = scored.where(F.col("similarity") > threshold)
    direct = top(only(near, station=station, media_type=media_type), "similarity", n, id_column).withColumn("match_type", F.lit("direct"))
    best = near.where(F.col("topic_id").isNotNull()).groupBy("topic_id").agg(F.max("similarity").alias("_s"))
    topics = top(best, "_s", n, "topic_id").select("topic_id")
    hits = top(near, "similarity", n, id_column).select(id_column)
    around = only(scored, station=station, media_type=media_type).join(topics, "topic_id", "left_semi").join(hits, id_column, "left_anti")
    return direct.unionByName(top(around, "similarity", more, id_column).withColumn("match_type", F.lit("topic")))
