"""Inverted indexes: token postings with positions and block maxima, and trigram postings with set sizes.

Both are written once from a table and read by the terms of a query: a term's postings are in one bucket (a partition
of the table's folder), ordered by term, so that a query's scan is pruned to a few buckets and, inside their files, to
the row groups that hold its terms. The table itself is not read.

**Token postings.** Segments are dealt into blocks of some ``BLOCK`` segments of about the same length. A row holds the
postings of one token in one block: for each segment its id, positions and filter columns, and beside them the
greatest occurrence count, which bounds the rank that the block can reach. A top-k search first evaluates the few
blocks of the highest bounds; the k-th best rank there is a floor, and blocks whose bound is below it are not read.
A frequent token's postings are many rows of bounded size, spread by block, however many segments hold it.

**Trigram postings.** A row holds the segments of one trigram set size that have one trigram. A similarity of t
between sets of m and n needs t * m <= n <= m / t, which prunes rows by n, and a number of shared trigrams, which is
counted over the postings alone: the similarity is exact without the segments' own sets.

Null or empty texts have no postings and match nothing. Rows that share an id are told apart only by their filter
columns: ids must be unique. Empty table: an index without rows, which finds nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.functions import constants as C
from plenum.functions import query as Q
from plenum.functions import text as T
from plenum.operators import search

#: Buckets of terms, segments in a block, ids in a row of trigram postings.
BUCKETS, BLOCK, LISTED = 64, 128, 8192
#: Blocks that are evaluated first, for each result asked for.
FIRST_BLOCKS = 2
FILTERS = ("station", "media_type", "is_noise")


@dataclass(frozen=True)
class Postings:
    rows: DataFrame
    buckets: int = BUCKETS

    def of(self, column: str, terms: list[str]) -> DataFrame:
        """The postings of some terms, by filters that prune folders and row groups."""
        spark = self.rows.sparkSession
        own = spark.range(1).select(*[_bucket(F.lit(t), self.buckets).alias(f"b{i}") for i, t in enumerate(terms)]).first() if terms else []
        return self.rows.where(F.col("bucket").isin(sorted(set(own))) & F.col(column).isin(terms))


def read(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Postings:
    return Postings(spark.read.parquet(path), buckets)


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _classes(sized: DataFrame, by: str, each: int) -> tuple[dict[int, int], dict[int, int]]:
    """For each class of rows: the number of its first block, and its blocks of ``each`` rows. Classes are few."""
    first, count, total = {}, {}, 0
    for row in sized.groupBy(by).count().orderBy(by).collect():
        first[row[by]], count[row[by]] = total, max(1, math.ceil(row["count"] / each))
        total += count[row[by]]
    return first, count


def _pick(values: dict[int, int], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key) if values else F.lit(1)


def write_tokens(rows: DataFrame, path: str, id_column: str = "id", tokens: Column | None = None, buckets: int = BUCKETS, block: int = BLOCK) -> None:
    """Write the token postings of ``rows`` into folder ``path``. One shuffle: of postings, by bucket, token and block."""
    tokens = search.stored_tokens(rows) if tokens is None else tokens
    keep = [c for c in FILTERS if c in rows.columns]
    own = rows.select(F.col(id_column).alias("id"), *keep, tokens.alias("tokens")).where(F.size("tokens") > 0)
    # Four classes for each doubling of length: at most some hundred of them.
    own = own.withColumn("class", F.floor(4 * F.log2(F.size("tokens"))).cast("int"))
    first, count = _classes(own, "class", block)
    number = _pick(first, F.col("class")) + F.pmod(F.xxhash64("id"), _pick(count, F.col("class")))
    places = own.select("id", *keep, number.cast("long").alias("block"), F.posexplode("tokens").alias("p", "token"))
    places = places.withColumn("bucket", _bucket(F.col("token"), buckets)).repartitionByRange("bucket", "token", "block")
    each = places.groupBy("bucket", "token", "block", "id", *keep).agg(F.array_sort(F.collect_list("p")).alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("id", "at", *keep)))
    packed = each.groupBy("bucket", "token", "block").agg(F.max(F.size("at")).alias("most"), F.count("*").cast("int").alias("n"), listed.alias("postings"))
    packed.sortWithinPartitions("bucket", "token", "block").write.partitionBy("bucket").option("parquet.block.size", 1 << 24).parquet(path)


def write_trigrams(rows: DataFrame, path: str, id_column: str = "id", buckets: int = BUCKETS, listed: int = LISTED) -> None:
    """Write the trigram postings of ``rows`` into folder ``path``."""
    grams = F.col("text_trigrams") if "text_trigrams" in rows.columns else T.trigrams(F.col("text"))
    keep = [c for c in FILTERS if c in rows.columns]
    own = rows.select(F.col(id_column).alias("id"), *keep, grams.alias("grams")).withColumn("n", F.size("grams")).where("n > 0")
    own = own.withColumn("class", F.floor(8 * F.log2("n")).cast("int"))
    _, count = _classes(own, "class", listed)
    part = F.pmod(F.xxhash64("id"), _pick(count, F.col("class"))).cast("int")
    each = own.select("id", *keep, "n", part.alias("part"), F.explode("grams").alias("gram"))
    each = each.withColumn("bucket", _bucket(F.col("gram"), buckets)).repartitionByRange("bucket", "gram", "n", "part")
    packed = each.groupBy("bucket", "gram", "n", "part").agg(F.array_sort(F.collect_list(F.struct("id", *keep))).alias("postings"))
    packed.sortWithinPartitions("bucket", "gram", "n").write.partitionBy("bucket").option("parquet.block.size", 1 << 24).parquet(path)


def _kept(rows: DataFrame, station: str | None, media_type: str | None) -> DataFrame:
    return search.only(search.not_noise(rows), station=station, media_type=media_type)


def _evaluated(postings: DataFrame, words: list[str], match, rank, station: str | None, media_type: str | None) -> DataFrame:
    """(id, rank) of the segments in these postings that match."""
    each = postings.select("token", F.explode("postings").alias("x")).select("token", "x.*")
    at = {w: F.max(F.when(F.col("token") == w, F.col("at"))).alias(f"at_{i}") for i, w in enumerate(words)}
    wide = _kept(each, station, media_type).groupBy("id").agg(*at.values())
    columns = {w: F.col(f"at_{i}") for i, w in enumerate(words)}
    return wide.where(match(columns)).select("id", rank(columns).alias("rank"))


def _top(postings: Postings, query: Q.Compiled, n: int, by_distance: bool, station: str | None, media_type: str | None) -> DataFrame:
    words = query.words()
    if not words:
        return postings.rows.where("false").select(F.explode("postings").alias("x")).select("x.id", F.lit(0.0).alias("rank"))
    rank = query.rank_by_distance if by_distance else (lambda at: Q.frequency_rank({w: F.when(at[w].isNotNull(), F.size(at[w])).otherwise(0) for w in query.wanted}))
    own = postings.of("token", words)
    # The bound of each block, by the greatest count of each token in it; a block that lacks a needed token has none.
    most = {w: F.coalesce(F.max(F.when(F.col("token") == w, F.col("most"))), F.lit(0)).alias(f"m_{i}") for i, w in enumerate(words)}
    blocks = own.groupBy("block").agg(*most.values())
    counts = {w: F.col(f"m_{i}") for i, w in enumerate(words)}
    bound = query.distance_bound(counts) if by_distance else Q.frequency_rank({w: counts[w] for w in query.wanted})
    blocks = blocks.where(query.may_match(counts)).select("block", bound.alias("bound"))

    def evaluate(some: DataFrame) -> DataFrame:
        return _evaluated(some, words, query.match, rank, station, media_type)

    # A bounded number of blocks, so that their numbers and the floor pass through the driver.
    begin = [r["block"] for r in blocks.orderBy(F.col("bound").desc(), "block").limit(FIRST_BLOCKS * n).collect()]
    best = evaluate(own.where(F.col("block").isin(begin))).orderBy(F.col("rank").desc(), "id").limit(n).collect() if begin else []
    floor = best[-1]["rank"] if len(best) == n else -1.0
    more = blocks.where((F.col("bound") >= floor) & ~F.col("block").isin(begin)) if begin else blocks.where("false")
    found = evaluate(own.join(more.select("block"), "block", "left_semi"))
    return found.sparkSession.createDataFrame(best, found.schema).unionByName(found).orderBy(F.col("rank").desc(), "id").limit(n)


def keyword(postings: Postings, query: str, n: int = 20, by_distance: bool = True, station: str | None = None, media_type: str | None = None) -> DataFrame:
    """(id, rank) of the segments with all of a plain query's tokens, best first. ``by_distance``: rank by the
    distance of the tokens where the query joins several; otherwise by their frequency alone."""
    return _top(postings, Q.compiled_plain(query), n, by_distance, station, media_type)


def keyword_query(postings: Postings, parsed: Q.Parsed, variants: set[str] | None = None, n: int = 20, by_distance: bool = True, station: str | None = None, media_type: str | None = None) -> DataFrame:
    """(id, rank) of the segments that a parsed query matches, best first."""
    return _top(postings, Q.compiled(parsed, variants), n, by_distance, station, media_type)


def trigram(postings: Postings, query: str, n: int = 20, threshold: float = C.TRIGRAM_THRESHOLD, station: str | None = None, media_type: str | None = None) -> DataFrame:
    """(id, similarity) of the segments whose trigram similarity reaches the threshold, best first."""
    if threshold <= 0:
        raise ValueError("a threshold of zero matches segments without any of the query's trigrams")
    grams = postings.rows.sparkSession.range(1).select(T.trigrams(F.lit(query))).first()[0]
    m = len(grams)
    own = postings.of("gram", grams)
    low, high = math.ceil(threshold * m - 1e-9), math.floor(m / threshold + 1e-9)
    each = own.where(F.col("n").between(low, high)).select("n", F.explode("postings").alias("x")).select("n", "x.*")
    shared = _kept(each, station, media_type).groupBy("id", "n").agg(F.count("*").alias("c"))
    alike = F.col("c").cast("double") / (F.col("n") + F.lit(m) - F.col("c"))
    found = shared.withColumn("similarity", alike).where(F.col("similarity") >= threshold)
    return found.orderBy(F.col("similarity").desc(), "id").limit(n).select("id", "similarity")
