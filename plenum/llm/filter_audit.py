"""How quality filters act on one another: what each removes, and what others had removed before it, in every order.

Whether a document fails a filter doesn't depend on other filters, so each document has one mask of its failures, and
everything asked for is a sum over masks. Documents are reduced to counters of (part, mask): at most 2 ** filters rows
for each part, added up before they are shuffled. The orders are applied to these counters, not to documents.

Copies of an earlier text are found by sorting: rows are partitioned by ranges of text fingerprint and doc_id (full
texts are not sampled for the bounds), and sorted within a partition by fingerprint, full text and doc_id, so that each
row is compared with its predecessor. A group of equal texts may span partitions, however large it is. Each partition
therefore reports, for the texts under its first and its last fingerprint, the smallest doc_id it holds; a text that
an earlier partition ends with is known by joining those few rows, and settles the rows that open the next one.

Null text: as empty, so it fails the length filter and equals empty texts. Null doc_id: neither smaller nor larger than
others, so such a row is no copy and makes none. Rows with one doc_id: none is smaller than the other; each counts as a
document. Null ``lang``: the empty part. Labels: a document counts as good or toxic if any label of its doc_id says so.
Very long texts: whole. Extra columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenum.llm.scratch import materialise

# The five filters and their limits.
COPIES = "E"
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 200, 50, 3
SPACE, MARKS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"

_NONE = np.iinfo(np.int64).max
_ROWS = "part int, run int, doc_id long, lang string, mask int, head boolean, tail boolean, fingerprint binary, text string, low long"


def failures() -> dict[str, Column]:
    """The conditions, over columns text and words, that a text fails by; all but the copies."""
    n, different = F.size("words"), F.size(F.array_distinct("words"))
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * different < DISTINCT_PERCENT * n,
        "C": 100 * F.regexp_count("text", F.lit("[A-Z]")) > CAPITALS_PERCENT * F.length("text"),
        "D": F.col("text").rlike(MARKS),
    }


def fingerprint(text: Column) -> Column:
    """What texts are sorted by first; texts that share it are still told apart."""
    return F.unhex(F.md5(text))


def _bit(letter: str, letters: str) -> int:
    return 1 << letters.index(letter)


def _compare(copy: int):
    """Streams one sorted partition: a row for each document, then its edges."""

    def batch(part: int, n: int, **columns) -> pa.RecordBatch:
        kinds = {"part": pa.int32(), "run": pa.int32(), "doc_id": pa.int64(), "lang": pa.string(), "mask": pa.int32(), "head": pa.bool_(), "tail": pa.bool_(), "fingerprint": pa.binary(), "text": pa.string(), "low": pa.int64()}
        columns["part"] = pa.array(np.full(n, part, np.int32))
        return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(n, kind)).cast(kind) for k, kind in kinds.items()], list(kinds))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, low = TaskContext.get().partitionId(), -1, _NONE
        first = last = text = None
        #: Runs of equal texts under the first and the last fingerprint: run, fingerprint, text, smallest doc_id.
        heads: list[tuple] = []
        tails: list[tuple] = []
        for rows in batches:
            n = len(rows)
            if not n:
                continue
            prints, texts, docs = (rows.column(x) for x in ("fingerprint", "text", "doc_id"))
            ids = docs.fill_null(_NONE).to_numpy()
            begins = np.empty(n, bool)
            begins[0] = prints[0].as_py() != last or texts[0].as_py() != text
            begins[1:] = ~pc.and_(pc.equal(prints[1:], prints[:-1]), pc.equal(texts[1:], texts[:-1])).to_numpy(zero_copy_only=False)
            opened = np.flatnonzero(begins)
            # The smallest doc_id of each run that has rows here; the first one may go on from the batch before.
            lows = np.concatenate([[low], ids[opened]])
            which = np.cumsum(begins)
            again = (ids != _NONE) & (ids > lows[which])
            runs = run + which
            first = prints[0].as_py() if first is None else first
            at_first = pc.equal(prints, pa.scalar(first, prints.type)).to_numpy(zero_copy_only=False)
            # Edges: runs are kept while they are under the first fingerprint, or the last one seen.
            end = prints[n - 1].as_py()
            at_end = pc.equal(prints, pa.scalar(end, prints.type)).to_numpy(zero_copy_only=False)
            tails = tails if end == last else []
            for i in np.flatnonzero(begins & (at_first | at_end)).tolist():
                edge = (int(runs[i]), prints[i].as_py(), texts[i].as_py(), int(ids[i]))
                heads += [edge] if at_first[i] else []
                tails += [edge] if at_end[i] else []
            unsure = at_first & ~again & (ids != _NONE)
            masks = rows.column("mask").to_numpy() | np.where(again, copy, 0).astype(np.int32)
            yield batch(part, n, run=pa.array(runs, pa.int32(), mask=~unsure), doc_id=docs, lang=rows.column("lang"), mask=pa.array(masks))
            run, low, last, text = int(runs[-1]), int(lows[which[-1]]), end, texts[n - 1].as_py()
        for edges, head in ((heads, True), (tails, False)):
            edges = [e for e in edges if e[3] != _NONE]
            if edges:
                run_, print_, text_, low_ = zip(*edges)
                flag = pa.array([True] * len(edges))
                yield batch(part, len(edges), run=pa.array(run_), fingerprint=pa.array(print_, pa.binary()), text=pa.array(text_, pa.string()), low=pa.array(low_), **{"head" if head else "tail": flag})

    return compare


def masks(docs: DataFrame, part: str = "lang", filters: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, lang, mask) of each document: the bits of the filters it fails, in the order of their letters."""
    filters = failures() if filters is None else filters
    letters = "".join(filters) + COPIES
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("fingerprint", fingerprint(F.col("text"))).withColumn("place", F.monotonically_increasing_id())
    # ``place`` splits rows with one doc_id and text; no result depends on it.
    rows = rows.repartitionByRange("fingerprint", "doc_id", "place").sortWithinPartitions("fingerprint", "text", F.col("doc_id").asc_nulls_last())
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(fails, F.lit(_bit(x, letters))).otherwise(F.lit(0)) for x, fails in filters.items()])
    rows = rows.select("fingerprint", "text", "doc_id", "lang", mask.cast("int").alias("mask"))
    found = materialise(rows.mapInArrow(_compare(_bit(COPIES, letters)), _ROWS), "masks")
    tails = found.where("tail").groupBy("fingerprint", "text").agg(F.min("low").alias("least"))
    # At most a few rows for each partition: those under its first fingerprint.
    known = found.where("head").join(tails, ["fingerprint", "text"]).where("least < low").select("part", "run").distinct()
    own = found.where("mask IS NOT NULL").select("part", "run", "doc_id", "lang", "mask")
    met = own.join(F.broadcast(known.withColumn("known", F.lit(_bit(COPIES, letters)))), ["part", "run"], "left")
    return met.select("doc_id", "lang", F.col("mask").bitwiseOR(F.coalesce("known", F.lit(0))).alias("mask"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", filters: dict[str, Column] | None = None) -> DataFrame:
    """A row for each part, order of the filters, and step: what the step's filter removes, and what it would."""
    letters = "".join(failures() if filters is None else filters) + COPIES
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # Rows with one doc_id are added up before labels are looked for, and counters before parts are.
    own = masks(docs, part, filters).groupBy("doc_id", "lang", "mask").agg(F.count("*").alias("n"))
    own = own.join(marks, "doc_id", "left")
    lost = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0)))
    counters = own.groupBy("lang", "mask").agg(F.sum("n").alias("n"), lost("good").alias("good"), lost("toxic").alias("toxic"))

    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(letters), letter) - 1)
    rows = counters.select("*", F.explode(orders).alias("filter_order")).select("*", F.posexplode(F.split("filter_order", "")).alias("i", "letter"))
    before = F.aggregate(F.split(F.substring("filter_order", F.lit(1), F.col("i")), ""), F.lit(0), lambda s, x: s.bitwiseOR(F.when(x == "", 0).otherwise(bit(x))))
    rows = rows.withColumns({"own": bit(F.col("letter")), "before": before})
    fails, earlier = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda test, n="n": F.sum(F.when(test, F.col(n)).otherwise(F.lit(0))).cast("long")
    out = rows.groupBy(F.col("lang").alias("part"), "filter_order", (F.col("i") + 1).alias("step"), "letter").agg(
        total(~fails & ~earlier).alias("kept"),
        total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"),
        total(fails & ~earlier, "toxic").alias("toxic_lost"),
    )
    whole = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return out.withColumn("shapley", whole).drop("letter")


AUDIT_SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda w: w <> '') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
fails AS (
  SELECT doc_id, part, [len(w) < {LEAST_WORDS}, 100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w),
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {CAPITALS_PERCENT} * length(text),
         regexp_matches(text, '{MARKS}'), coalesce(least < doc_id, false)] AS f,
         coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false)::int AS good,
         coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false)::int AS toxic FROM docs),
counters AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, f),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, generate_subscripts([1, 2, 3, 4, 5], 1) AS i),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS o
  FROM letter a, letter b, letter c, letter d, letter e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT filter_order, o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
applied AS (
  SELECT part, filter_order, step, o[step] AS own, f[o[step]] AS fails,
         len(list_filter(o[1:step - 1], lambda i: f[i])) > 0 AS earlier,
         len(list_filter(f, lambda x: x)) = 1 AND f[o[step]] AS alone, n, good, toxic FROM counters, steps),
rows AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN NOT fails AND NOT earlier THEN n ELSE 0 END)::bigint AS kept,
         sum(CASE WHEN fails AND NOT earlier THEN n ELSE 0 END)::bigint AS removed, sum(CASE WHEN fails AND earlier THEN n ELSE 0 END)::bigint AS redundant,
         sum(CASE WHEN alone THEN n ELSE 0 END)::bigint AS unique_fails, sum(CASE WHEN fails AND NOT earlier THEN good ELSE 0 END)::bigint AS good_lost,
         sum(CASE WHEN fails AND NOT earlier THEN toxic ELSE 0 END)::bigint AS toxic_lost FROM applied GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::bigint AS shapley FROM rows
"""
