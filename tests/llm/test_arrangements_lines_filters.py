"""Fill-in-middle, line dedup and filter audit against brute force, on rows of every odd kind."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from plenum.llm import entry, fill_in_middle, filter_audit, line_dedup, sharding
from pyspark.sql import functions as F

LONG = "\n".join(f"Line {i % 900} of a long text, w{i}" if i % 3 else "  Shared LINE \t" for i in range(30000))
MANY = [(100 + i, f"shared line\nown line {i}\n\nÉcole {i % 3}\r\nTail #{i % 9}") for i in range(40)]
ODD = [(None, None), (None, "shared line"), (None, "shared line"), (1, ""), (2, None), (3, " \n\t \n"), (4, LONG), (5, "SHARED line\x0b\nb\nSHARED LINE"), (6, "x\nshared line"), (6, "x\nshared line"), (6, "y"), (7, "<P> a text with <S>a sentinel"), (8, "é ́ 你好　x <|endoftext|>  \x00 ñ <"), *MANY]
CLASH = ("n", "form", "Output", "prefix_chars", "middle_chars", "_text", "_units", "n_lines", "kept", "runs", "_runs", "d", "t", "_d", "_map_d", "a", "mask", "lang_", "fingerprint", "words", "place", "low", "part", "run")


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame([(d, t, (None, "", "en", "de")[i % 4]) for i, (d, t) in enumerate(ODD)], "doc_id long, text string, lang string")
    return rows.withColumns({c: F.lit("mine") for c in CLASH})


# fill in middle


def _arranged(doc, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", text, None, None
    if h[3] % 100 < 20:
        return len(units), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return len(units), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def test_arrangements_and_back(spark, odd):
    rng, letters = np.random.default_rng(3), list("ab<>PSM \né你𝄞")
    fuzz = [(i, "".join(rng.choice(letters, int(rng.integers(0, 60))))) for i in range(600)]
    for docs in (odd, spark.createDataFrame(fuzz, "doc_id long, text string")):
        found = fill_in_middle.arrange(docs)
        assert not set(docs.columns) - set(found.columns) - {"Output"}
        got = Counter(map(tuple, found.select("doc_id", "text", "n", "form", "output", "prefix_chars", "middle_chars").collect()))
        assert got == Counter((r.doc_id, r.text, *_arranged(r.doc_id, r.text)) for r in docs.collect())
        back = found.select("text", fill_in_middle.restore(F.col("form"), F.col("output")).alias("back")).collect()
        assert all(r.back == (r.text or "") for r in back)
    assert len({r.form for r in found.collect()}) == 3
    assert fill_in_middle.digests(odd.where("false")).count() == 0


def test_arrangements_need_no_python_and_no_exchange(spark, odd):
    plan = fill_in_middle.digests(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


# lines


def _deduped(rows, least_docs=10, least_chars=1, keep_first=False):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for doc, text in rows:
        for at, line in enumerate((text or "").split("\n")):
            held[key(line)].add((doc, text or "", at))
    often = {k for k, places in held.items() if len(k) >= least_chars and len({p[:2] for p in places}) >= least_docs}
    out = Counter()
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for at, x in enumerate(lines) if key(x) not in often or keep_first and _first(held[key(x)]) == (doc, text or "", at)]
        out[doc, len(lines), len(lines) - len(stay), "\n".join(stay)] += 1
    return out


def _first(places):
    """By document and position; the test's tables have no two texts of one document that open a shared key."""
    return min(places, key=lambda p: (p[0] is not None, p[0] or 0, p[1], p[2]))


@pytest.mark.parametrize("hot", [1, 20, 5000])
@pytest.mark.parametrize("keep_first", [False, True])
def test_lines_by_either_way(spark, odd, monkeypatch, hot, keep_first):
    """No key is counted apart, some are, or all: the same lines go."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rows = [r for r in ODD if r[0] is not None] if keep_first else ODD
    docs = odd.where("doc_id IS NOT NULL") if keep_first else odd
    found = line_dedup.apply(docs, line_dedup.bitmaps(docs, keep_first=keep_first))
    assert not {c for c in docs.columns if c not in ("n_lines", "kept")} - set(found.columns)
    assert Counter(map(tuple, found.select("doc_id", "n_lines", "n_dropped", "kept").collect())) == _deduped(rows, keep_first=keep_first)


def test_bitmaps_are_runs(spark):
    docs = spark.createDataFrame([(i, f"own {i}\nsame\nsame\nown again {i}\nother same") for i in range(12)] + [(50, "same\nown")], "doc_id long, text string")
    got = {r.d: r.runs for r in line_dedup.bitmaps(docs).collect()}
    assert got == {i: [1, 2, 1, 1] for i in range(12)} | {50: [0, 1]}
    assert line_dedup.bitmaps(docs, least_docs=14).count() == 0 and line_dedup.digests(docs.where("false")).count() == 0


def test_line_stream_has_one_exchange_and_no_python(spark, odd):
    plan = line_dedup.digests(odd)._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert "rangepartitioning" in initial and "Python" not in plan and "InArrow" not in plan
    assert not re.search(r"Window(?:(?!rangepartitioning).)*?hashpartitioning\(a#\d+L?, b#\d+L?, \d+\)(?:(?!Window).)*rangepartitioning", initial, re.S)


# filters


def _audited(rows, labels):
    texts = defaultdict(set)
    for doc, text, _ in rows:
        if doc is not None:
            texts[text or ""].add(doc)
    marks = {k: {d for d, quality, toxic in labels if (quality, toxic)[i] == 1} for i, k in enumerate(("good", "toxic"))}
    docs = []
    for doc, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc is not None and any(d < doc for d in texts[text]),
        }
        docs.append((lang or "", {k for k, v in fails.items() if v}, doc in marks["good"], doc in marks["toxic"]))
    out, removed = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, x in enumerate(order, 1):
                hit = [d for d in left if x in d[1]]
                redundant = sum(x in d[1] for d in gone)
                left, gone = [d for d in left if x not in d[1]], gone + hit
                alone = sum(d[1] == {x} for d in docs if d[0] == part)
                out[part, "".join(order), step] = [len(left), len(hit), redundant, alone, sum(d[2] for d in hit), sum(d[3] for d in hit)]
                removed[part, x] += len(hit)
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.mark.parametrize("one_fingerprint", [False, True])
def test_filters_in_every_order(spark, odd, monkeypatch, one_fingerprint):
    """Copies over many partitions, ties in doc_id, and texts that differ under one fingerprint."""
    if one_fingerprint:
        monkeypatch.setattr(filter_audit, "fingerprint", lambda text: F.unhex(F.md5(F.lit("x"))))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        copies = [(1000 + i % 290, f"Copied text {i % 3 if i % 3 < 2 else 0} with some words", "en") for i in range(300)]
        extra = spark.createDataFrame([*copies, (None, "Copied text 0 with some words", "de")], "doc_id long, text string, lang string")
        docs = odd.unionByName(extra, allowMissingColumns=True).repartition(5)
        labels = [(1000, 1, 0), (1000, 0, 0), (1001, 0, 1), (1, 1, 1), (5, None, 1), (None, 1, 1), (1005, 1, None), (9999, 1, 1)]
        frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        got = filter_audit.audit(docs, frame).collect()
        want = _audited([(r.doc_id, r.text, r.lang) for r in docs.collect()], [x for x in labels if x[0] is not None])
        assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in got} == want and len(got) == len(want)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_filters_on_nothing(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(odd.where("false"), labels).count() == 0
    assert filter_audit.audit(odd, labels).agg(F.sum("good_lost")).first()[0] == 0


def test_any_filters(spark, odd):
    """Other conditions than the contract's."""
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(odd, labels, filters={"X": F.length("text") > 100}).where("part = 'en'").collect()
    assert {r.filter_order for r in got} == {"XE", "EX"} and all(r.kept + r.removed + r.redundant >= 0 for r in got)


def test_shards_as_they_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(500)] + [(None, "none"), (7, "again")], "doc_id long, text string")
    sharding.write_shards(rows, "doc_id", str(tmp_path / "shards"))
    got = spark.read.parquet(str(tmp_path / "shards"))
    want = sharding.place(rows, "doc_id").select("doc_id", "text", "shard")
    assert got.select("doc_id", "text", "shard").exceptAll(want).count() == 0 and got.count() == 502


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_line_dedup", "op13_filter_audit"])
def test_stable_schema(spark, data, name):
    assert set(entry.oracle_sql()) >= {name} and entry.queries()[name](spark, data).count() > 0
