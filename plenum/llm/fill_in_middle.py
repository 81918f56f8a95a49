"""Fill-in-middle arrangements of whole texts (Bavarian et al. 2022), and the texts back from them.

A text is cut into units: runs of ASCII letters, and every other code point by itself. Two cuts, drawn from a hash of
seed and doc_id, make a prefix, a middle and a suffix, which are put in another order with a sentinel before each.
A share of the texts stays plain, and so does every text that is empty or holds a sentinel, so that each arrangement
can be parsed: a piece never holds a sentinel, and since sentinels begin with ``<`` and end with ``>``, none can arise
where a piece and a sentinel meet.

All of it is one projection of Spark SQL functions over the row: no shuffle and no Python, so a hot source or a text
that many rows share costs no more than other rows, and any executor can do any row again.

Null text: as empty, so it stays plain. Null doc_id: the seed alone is hashed. Repeated rows: equal results. Very long
texts: cut and arranged whole; a task holds the units of one text at a time. Empty table: no rows. Extra columns are
kept; those with the names of the new columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.scratch import unused

# The sentinels, and the pattern of a unit.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "[A-Za-z]+|[^A-Za-z]"

#: The seed; of a hundred texts so many are arranged, and of these so many with the suffix first.
SEED, ARRANGED, SUFFIX_FIRST = 1, 90, 20


def _draw(digest: Column, n: int) -> Column:
    """The n-th group of eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * n + 1, 8), 16, 10).cast("long")


def arrange(docs: DataFrame, seed: int = SEED, arranged: int = ARRANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` (doc_id, text) with n (units), form (plain, psm or spm), output, and prefix_chars and middle_chars (code
    points, null if plain)."""
    new = ("n", "form", "output", "prefix_chars", "middle_chars")
    rows = docs.drop(*(c for c in docs.columns if c.lower() in new))
    names = {x: unused(rows, f"_{x}") for x in ("text", "units", "h", "low", "high", "prefix", "middle", "suffix")}
    text, units, digest, low, high = (F.col(names[x]) for x in ("text", "units", "h", "low", "high"))
    rows = rows.withColumn(names["text"], F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = rows.withColumns({names["units"]: F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), names["h"]: F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)})
    rows = rows.withColumn("n", F.size(units).cast("long"))
    cut = [_draw(digest, i) % (F.col("n") + 1) for i in (0, 1)]
    rows = rows.withColumns({names["low"]: F.least(*cut).cast("int"), names["high"]: F.greatest(*cut).cast("int")})
    plain = (text == "") | (_draw(digest, 2) % 100 >= arranged)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | text.contains(sentinel)
    form = F.when(plain, "plain").when(_draw(digest, 3) % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    pieces = {"prefix": (F.lit(1), low), "middle": (low + 1, high - low), "suffix": (high + 1, F.size(units) - high)}
    joined = {names[x]: F.when(F.col("form") != "plain", F.array_join(F.slice(units, start, n), "")) for x, (start, n) in pieces.items()}
    rows = rows.withColumns(joined)
    marked = {x: F.concat(F.lit(s), F.col(names[x])) for x, s in (("prefix", PREFIX), ("suffix", SUFFIX), ("middle", MIDDLE))}
    output = F.when(F.col("form") == "psm", F.concat(marked["prefix"], marked["suffix"], marked["middle"])).when(F.col("form") == "spm", F.concat(marked["suffix"], marked["prefix"], marked["middle"])).otherwise(text)
    out = rows.withColumns({"output": output, "prefix_chars": F.length(names["prefix"]).cast("long"), "middle_chars": F.length(names["middle"]).cast("long")})
    return out.drop(*names.values())


def restore(form: Column, output: Column) -> Column:
    """The text of an arrangement: each sentinel stands in it exactly once."""

    def between(opens: str, closes: str) -> Column:
        return F.substring_index(F.substring_index(output, closes, 1), opens, -1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the hashes of the output and of the text restored from it."""
    found = arrange(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    found = found.withColumn("restored", restore(F.col("form"), F.col("output")))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ARRANGE_SQL = f"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS u,
         sha256('{SEED}:' || coalesce(doc_id::varchar, '')) AS d FROM documents),
draws AS (
  SELECT doc_id, text, u, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(d, i, 8))::bigint) AS h FROM units),
cuts AS (
  SELECT doc_id, text, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h[3] % 100 >= {ARRANGED} THEN 'plain'
              WHEN h[4] % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM draws),
pieces AS (
  SELECT *, array_to_string(u[1:low], '') AS p, array_to_string(u[low + 1:high], '') AS m, array_to_string(u[high + 1:n], '') AS s FROM cuts)
SELECT doc_id, n::bigint AS n, form, CASE WHEN form <> 'plain' THEN length(p)::bigint END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m)::bigint END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
              ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM pieces
"""
