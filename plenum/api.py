"""The search call: one request in, one ranked DataFrame out. Models are injected."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.functions import constants as C
from plenum.functions import query as Q
from plenum.operators import fusion, search, text_index


@dataclass
class Request:
    query: str
    mode: str = "hybrid"
    station: str | None = None
    media_type: str | None = None
    limit: int = 20
    rrf_k: int = C.RRF_K
    weights: dict[str, float] = field(default_factory=dict)
    threshold: float = C.SEMANTIC_THRESHOLD
    #: Rank text matches that join tokens by their distance, or by frequency alone.
    by_distance: bool = True


@dataclass
class Index:
    """Sentences (id, segment_id, sentence_index, text, embedding_he, is_noise, media columns), segments (segment_id,
    topic_id, text, embedding_he, is_noise, segment_time, media columns). Both may hold the token columns that
    ``documents.with_tokens`` adds.

    Vectors may be tables of their own, with all but the texts: (id, segment_id, embedding_he, ...) and (segment_id,
    topic_id, segment_time, embedding_he, ...). Token postings, if given, are read in place of the texts' tokens."""

    sentences: DataFrame
    segments: DataFrame
    sentence_vectors: DataFrame | None = None
    segment_vectors: DataFrame | None = None
    sentence_postings: text_index.Postings | None = None
    segment_postings: text_index.Postings | None = None


def _once(rows: DataFrame) -> DataFrame:
    """A list of bounded length (the top of one signal), computed here and now: what follows can name it again without
    ranking anew, and it needs no shuffle from then on."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def _with_text(found: DataFrame, table: DataFrame, id_column: str) -> DataFrame:
    """A signal's rows with their texts (and segments): the list is broadcast, the texts stay where they are."""
    more = [c for c in ("segment_id", "text") if c not in found.columns]
    return table.select(id_column, *more).join(F.broadcast(found), id_column) if more else found


def run(request: Request, index: Index, encode: Callable[[str], list[float]], rerank=None) -> DataFrame:
    """Hybrid, semantic or keyword search, exclusion, optional rerank; each result with the array of its segment's
    sentences, where these have a sentence_index. Best first.

    Each signal is a top-k over vectors or tokens with the filters' columns; only its rows meet texts. A signal is
    computed once, and so are the results before they are nested."""
    if not request.query.strip():
        raise ValueError("the query is empty")
    if request.mode not in ("hybrid", "semantic", "keyword"):
        raise ValueError(f"unknown mode {request.mode}")
    parsed = Q.parse(request.query)
    expanded, _ = Q.expand(request.query)
    variants = Q.morphology(" ".join(parsed.terms))
    limit = max(1, min(request.limit, C.MAX_LIMIT))
    n = 2 * limit if request.mode == "hybrid" else limit
    where = {"station": request.station, "media_type": request.media_type}
    compiled = parsed.has_operators and bool(Q.tsquery(parsed, variants))
    sides = {
        "id": (index.sentences, index.sentence_vectors, index.sentence_postings),
        "segment_id": (index.segments, index.segment_vectors, index.segment_postings),
    }

    def by_words(id_column: str) -> DataFrame:
        table, _, postings = sides[id_column]
        if postings is not None:
            found = text_index.keyword_query(postings, parsed, variants, n, request.by_distance, **where) if compiled else text_index.keyword(postings, request.query, n, request.by_distance, **where)
            return _once(_with_text(found.withColumnRenamed("id", id_column), table, id_column))
        if compiled:
            found = search.keyword_query(table, parsed, variants, n, id_column, **where, by_distance=request.by_distance)
        else:
            found = search.keyword(table, request.query, n, id_column, **where, by_distance=request.by_distance)
        return _once(found.select(*dict.fromkeys([id_column, "segment_id", "text", "rank"])))

    def by_vector(id_column: str, vector: list[float]) -> DataFrame:
        table, vectors, _ = sides[id_column]
        rows = table if vectors is None else vectors
        found = search.semantic(rows, vector, n, request.threshold, id_column, **where)
        kept = [c for c in dict.fromkeys([id_column, "segment_id", "topic_id", "text", "similarity"]) if c in found.columns]
        return _once(_with_text(found.select(*kept), table, id_column))

    if request.mode == "keyword":
        out = by_words("segment_id").withColumn("score", F.col("rank"))
    elif request.mode == "semantic":
        out = by_vector("segment_id", encode(expanded)).withColumn("score", F.col("similarity"))
    else:
        vector = encode(expanded)
        near = lambda i: fusion.gated(fusion.ranked(by_vector(i, vector), [F.col("similarity").desc(), F.col(i)]))
        text = lambda i: fusion.ranked(by_words(i), [F.col("rank").desc(), F.col(i)])
        seg_he = near("segment_id")
        topics = seg_he.where(F.col("topic_id").isNotNull()).groupBy("topic_id").agg(F.min("rank_in_signal").alias("r")).orderBy("r", "topic_id").limit(10)
        rows = index.segments if index.segment_vectors is None else index.segment_vectors
        newest = search.by_topic(search.only(rows, **where), F.broadcast(_once(topics)), n, "segment_id")
        kept = [c for c in ("segment_id", "segment_time", "text") if c in newest.columns]
        around = fusion.ranked(_once(_with_text(newest.select(*kept), index.segments, "segment_id")), [F.col("segment_time").desc(), F.col("segment_id")])
        signals = {"sent_he": near("id"), "seg_he": seg_he, "sent_kw": text("id"), "seg_kw": text("segment_id"), "topic": around}
        out = fusion.merge(signals, limit, request.weights, request.rrf_k)
    if request.mode != "hybrid":
        out = out.orderBy(F.col("score").desc(), "segment_id")
    out = fusion.without(out, parsed.excluded)
    if rerank is not None:
        out = fusion.reranked(out, rerank)
    if "sentence_index" not in index.sentences.columns:
        return out
    # What comes out so far is one sorted list, so ids that grow within it keep its order over the join.
    placed = _once(out.withColumn("place", F.monotonically_increasing_id()))
    return search.enrich(placed, index.sentences.select("segment_id", "sentence_index", "text")).orderBy("place").drop("place")
