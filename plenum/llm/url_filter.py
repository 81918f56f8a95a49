"""URL filters: a blocked Bloom filter of the listed canonical URLs, then an exact hash join.

A rule is (action, host, path) and stands for its host, all its subdomains and every path that begins with its own;
its canonical form is host + path. A URL's candidates are host suffix + path prefix for every label of its host and
every path length that occurs in the list. A candidate goes on only if the Bloom filter has it: one block of 256 bits
is looked up for each candidate, and four of its bits must be set. What passes meets the rules themselves in an exact
hash join, which removes false positives; the longest rule wins (then the longer host, then block over allow).

The filter is built by an aggregation on the cluster; its size follows from the number of rules and is limited by
``MAX_BLOCKS``, so broadcasting it has a proven bound (beyond it false positives grow and results stay the same).
The rules are broadcast up to ``BROADCAST_RULES`` and joined by a salted shuffle beyond, so that one rule that a
third of all URLs meet is no hot key. Rules are found once for each distinct (host, path). URLs that a bit filter of the
(host, path) with a rule clears, those without a host among them, get the default without a join; the others meet their
rule in a join of which both sides are plain scans, so that Spark can split a page that very many rows share.

Null URL, or one without "://": host and path are empty, no rule, verdict ``default``. Repeated rows stay repeated.
Empty host: no rule fits. Empty tables give no rows; an empty rule list gives the default. Extra columns are kept;
those called host, path, rule or verdict are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.key_filter import key_filter
from plenum.llm.scratch import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_RULE, MAX_BLOCKS, BROADCAST_RULES, SALTS = 16, 1 << 18, 100_000, 16
RULE_SCHEMA = "action string, host string, path string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _probe(rows: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with the block of their key and a mask of one bit for each of the block's four words, for ``key``."""
    bits = F.xxhash64(F.lit(7), "key")
    rows = rows.withColumns({"block": F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"), "bits": bits})
    return rows.withColumns({f"m{i}": F.expr(f"shiftleft(1L, cast(shiftrightunsigned(bits, {12 * i}) & 63 as int))") for i in range(4)}).drop("bits")


def bloom_filter(rules: DataFrame, n_rules: int) -> tuple[DataFrame, int]:
    """The filter's blocks that have bits (block, w0..w3), and how many blocks there are."""
    blocks = max(1, min(MAX_BLOCKS, math.ceil(n_rules * BITS_PER_RULE / 256)))
    own = _probe(rules.select(F.concat("host", "path").alias("key")), blocks)
    return own.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(4)]), blocks


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (its canonical form, else null) and verdict."""
    rules = rules.select("action", "host", "path").where(F.col("host").isNotNull() & F.col("path").isNotNull() & (F.col("host") != ""))
    n_rules = rules.count()
    # Distinct path lengths: as many as the longest listed path has characters at most.
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    host, path = host_and_path(F.col(url))
    # The input row is one struct, so that no column of it can clash with ours.
    rows = pages.select(host.alias("host"), path.alias("path"), F.struct("*").alias("row"))
    kept = [F.col("row").getField(c).alias(c) for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    none = rows.select(*kept, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if not n_rules:
        return none
    bloom, blocks = bloom_filter(rules, n_rules)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda p: p.isNotNull())
    seen = rows.select("host", "path").where("host <> ''").distinct()
    asked = seen.select("host", "path", F.explode(suffixes).alias("h"), prefixes.alias("p")).select("host", "path", "h", F.explode("p").alias("p"))
    asked = _probe(asked.withColumn("key", F.concat("h", "p")), blocks)
    possible = asked.join(F.broadcast(bloom), "block")
    for i in range(4):
        possible = possible.where(F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) != 0)
    listed = rules.select(F.col("host").alias("h"), F.col("path").alias("p"), "action").distinct()
    possible = possible.select("host", "path", "h", "p")
    if n_rules <= BROADCAST_RULES:
        hits = possible.join(F.broadcast(listed), ["h", "p"])
    else:
        listed = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        possible = possible.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
        hits = possible.join(listed.hint("shuffle_hash"), ["h", "p", "salt"])
    rule = F.concat("h", "p")
    order = F.struct(F.length(rule).alias("n"), F.length("h").alias("hn"), F.col("action").alias("action"), rule.alias("rule"))
    best = materialise(hits.groupBy("host", "path").agg(F.max(order).alias("best")), "rules")
    flagged = key_filter(best, "host", "path").flagged(rows, ["host", "path"], "met")
    ruled = flagged.where("met").join(best, ["host", "path"], "left")
    clear = flagged.where("not met").withColumn("best", F.lit(None).cast(best.schema["best"].dataType))
    out = clear.select("row", "host", "path", "best").unionByName(ruled.select("row", "host", "path", "best"))
    return out.select(*kept, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


# The rules of the registered query.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

JUDGE_SQL = f"""
WITH rules(action, host, path) AS (VALUES {", ".join(str(r) for r in RULES)}),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
split AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
urls AS (SELECT DISTINCT host, path FROM split),
best AS (SELECT u.host, u.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
  arg_max(r.action, length(r.host || r.path)) AS action
  FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY ALL)
SELECT s.page_id, s.host, s.path, b.rule, coalesce(b.action, 'allow') AS verdict
FROM split s LEFT JOIN best b ON s.host = b.host AND s.path = b.path
"""
