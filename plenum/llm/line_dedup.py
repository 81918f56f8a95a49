"""Lines that many documents share: found in one sorted stream of line hashes, returned as keep bitmaps.

A line's key is the line without white space at its ends and with A-Z in lower case. Each line becomes a row of two
64-bit hashes of its key, its document and its position. These rows are partitioned by ranges of the hashes and sorted
within a partition by hash, document and position; then one pass over the stream sees a key's first occurrence and each
document's, and so counts the key's documents. Only the places of lines that go leave the stream. They are gathered
for each document as a compressed bitmap: the lengths of its runs of kept and dropped lines in turn, the first one
kept (possibly empty) and the last one dropped; what follows stays. Texts meet their bitmaps by document at the end.

A key that a large part of all lines share would fill one range. Such keys are found first, by a frequency sketch of
bounded size: at most ``HOT`` keys, and every key with more than some 0.2 percent of all lines is among them. Their
documents are counted apart, exactly, in rows that are spread by key and document, and their places found by a join
with the at most ``HOT`` of them. Which way a key takes changes no result.

A document is a doc_id with a text; a row that is repeated exactly is one document, and each copy gets its bitmap. Null
and empty text: one empty line, whose key is too short to be dropped. Null doc_id: a document like others. Very long
texts: a row for each line. Ties (documents with one doc_id): by a hash of the text. Empty table: no rows. Extra columns
are kept by ``apply``; those with the names of the new columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenum.llm.scratch import materialise, unused

#: A key that so many documents hold, and that has so many code points, loses its lines.
LEAST_DOCS, LEAST_CHARS = 10, 1
#: Frequent keys that are counted apart at most, and keys that the sketch tracks.
HOT, TRACKED = 1000, 8192

# White space, and the letters that are lowered.
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def key_of(line: Column) -> Column:
    bare = F.btrim(line, F.lit(_SPACE))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _document(docs: DataFrame) -> tuple[Column, Column]:
    return F.col("doc_id").alias("d"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("t")


def _hashed(docs: DataFrame, least_chars: int) -> DataFrame:
    """(d, t, keys): each document's line hashes in order, null for keys that are too short."""
    two = lambda k: F.when(F.length(k) >= least_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b")))
    return docs.select(*_document(docs), F.transform(F.transform(lines_of(F.col("text")), key_of), two).alias("keys"))


def _frequent(rows: DataFrame) -> list[int]:
    """First hashes of keys that may have more than one in ``HOT`` of all lines; at most ``HOT`` of them."""
    found = rows.agg(F.expr(f"approx_top_k(a, {HOT}, {TRACKED})").alias("top"), F.count("*").alias("n")).first()
    return [x["item"] for x in found["top"] or [] if x["count"] * HOT > found["n"]]


def bitmaps(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, keep_first: bool = False) -> DataFrame:
    """(d, t, runs) of each document that loses lines: its doc_id, the hash of its text, its bitmap. ``keep_first``:
    the first of a key's lines, by document and position, stays."""
    hashed = materialise(_hashed(docs, least_chars), "lines")
    rows = hashed.select("d", "t", F.posexplode("keys").alias("p", "k")).where("k IS NOT NULL").select("k.a", "k.b", "d", "t", "p")
    hot = _frequent(rows)
    is_hot = F.col("a").isin(hot) if hot else F.lit(False)

    stream = rows.where(~is_hot).repartitionByRange("a", "b").sortWithinPartitions("a", "b", "d", "t", "p")
    by_key = Window.partitionBy("a", "b")
    in_order = by_key.orderBy("d", "t", "p")
    first = F.row_number().over(in_order) == 1
    opens = first | ~F.lag("d").over(in_order).eqNullSafe(F.col("d")) | (F.lag("t").over(in_order) != F.col("t"))
    stream = stream.withColumns({"first": first, "opens": opens.cast("int")}).withColumn("docs", F.sum("opens").over(by_key))
    gone = stream.where((F.col("docs") >= least_docs) & ~(F.col("first") & F.lit(keep_first))).select("d", "t", "p")

    if hot:
        common = rows.where(is_hot)
        held = common.groupBy("a", "b", "d", "t").agg(F.min("p").alias("p"))
        counts = held.groupBy("a", "b").agg(F.count("*").alias("docs"), F.min(F.struct("d", "t", "p")).alias("first"))
        often = counts.where(F.col("docs") >= least_docs).select("a", "b", "first")
        met = common.join(F.broadcast(often), ["a", "b"])
        if keep_first:
            met = met.where(~F.struct("d", "t", "p").eqNullSafe(F.col("first")))
        gone = gone.unionByName(met.select("d", "t", "p"))

    places = gone.groupBy("d", "t").agg(F.array_sort(F.collect_set("p")).alias("places"))
    behind = lambda p, i: p - F.coalesce(F.get(F.col("places"), i - 1), F.lit(-1)) - 1
    bits = F.array_join(F.transform("places", lambda p, i: F.concat(F.repeat(F.lit("1"), behind(p, i)), F.lit("0"))), "")
    runs = F.transform(F.regexp_extract_all("bits", F.lit("1+|0+"), F.lit(0)), F.length)
    runs = F.when(F.col("bits").startswith("0"), F.concat(F.array(F.lit(0)), runs)).otherwise(runs)
    return places.withColumn("bits", bits).select("d", "t", runs.alias("runs"))


def apply(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept (the text of the lines that stay) by the bitmaps ``found``."""
    rows = docs.drop(*(c for c in docs.columns if c.lower() in ("n_lines", "n_dropped", "kept")))
    d, t, runs, lines, flags, of_d, of_t = (unused(rows, f"_{x}") for x in ("d", "t", "runs", "lines", "flags", "map_d", "map_t"))
    left = rows.withColumns(dict(zip((d, t), _document(rows))))
    met = left.join(found.toDF(of_d, of_t, runs), F.col(d).eqNullSafe(F.col(of_d)) & (F.col(t) == F.col(of_t)), "left")
    stay = F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    met = met.withColumns({lines: lines_of(F.col("text")), flags: F.coalesce(stay, F.array().cast("array<boolean>"))})
    kept = F.array_join(F.zip_with(lines, flags, lambda line, stays: F.when(F.coalesce(stays, F.lit(True)), line)), "\n")
    dropped = F.size(F.filter(flags, lambda stays: ~stays))
    out = met.withColumns({"n_lines": F.size(lines).cast("long"), "n_dropped": dropped.cast("long"), "kept": kept})
    return out.drop(d, t, of_d, of_t, runs, lines, flags)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the hash of the text that is left."""
    found = apply(docs, bitmaps(docs))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


_CHARS = " || ".join(f"chr({ord(c)})" for c in _SPACE)
DEDUP_SQL = f"""
WITH lines AS (
  SELECT doc_id, p, line, translate(trim(line, {_CHARS}), '{_UPPER}', '{_LOWER}') AS k
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS p
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
often AS (
  SELECT k FROM lines WHERE length(k) >= {LEAST_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {LEAST_DOCS})
SELECT doc_id, count(*) AS n_lines, count(o.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE o.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN often o USING (k) GROUP BY doc_id
"""
