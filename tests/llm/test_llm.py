import hashlib
import itertools
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from plenum.llm import dac_tokens, decontaminate, entry, jaccard_join, license_scan, media, quality, sentencepiece_codec, sharding, toxicity, url_filter
from plenum.llm import components as components_module
from plenum.llm.components import components
from plenum.llm.key_filter import key_filter
from plenum.llm.textbytes import buffers
from pyspark.sql import functions as F
from tests.compare import assert_same

WORD_BPE, PIECE_BPE = entry.tokenizer_file("word_bpe_49k.json"), entry.tokenizer_file("piece_bpe_32k.model")
LONG = " ".join(f"w{i}" for i in range(30000))
ODD = [(None, None), (None, "same text of five words"), (1, ""), (2, None), (3, " \n\t "), (4, LONG), (5, "same text of five words"), (6, "Same Text of five words"), (6, "Same Text of five words"), (7, "x"), (8, "é ́ 你好　x <|endoftext|> <s> \x00 ñ")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names clash with results."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    clash = {c: F.lit("mine") for c in ("score", "slot", "shard", "licenses", "ids", "n", "rep", "key", "h", "item", "lid", "comp", "start", "component_id", "n_sentences", "sentence_ids", "gone")}
    return rows.withColumns(clash)


@pytest.fixture(scope="module")
def none(spark, odd):
    return odd.where("false")


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, data, duck, name):
    assert_same(entry.queries()[name](spark, data), duck, entry.oracle_sql()[name])


# quality and toxicity


@pytest.mark.parametrize("name, method, folds, fold, label", [("op1_quality_classifier", quality, 5, 0, "quality"), ("op9_toxicity", toxicity, 4, 2, "toxic")])
def test_classifier(spark, name, method, folds, fold, label):
    sf = "/root/testdata/sf0.01"
    rows = entry.queries()[name](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = rows.join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % folds == fold for r in got)
    right = [r.predicted == r[label] for r in got]
    assert np.mean(right) >= 0.9 and rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    clean = [r.predicted for r in got if r[label] == (name[2] == "1")]
    assert np.mean(clean) >= 0.95 if name[2] == "1" else np.mean([r.predicted for r in got if r.toxic == 0]) <= 0.05


@pytest.mark.parametrize("method, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifier_edges(spark, odd, none, method, label):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, 1), (7, 0), (8, None), (None, 1)], f"doc_id long, {label} int")
    model = method.fit(odd, labels, 7, 6)
    got = method.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 6}) == 1 and len({r.score for r in got if not (r.text or "").strip()}) == 1
    assert method.score(none, model).count() == 0
    untrained = method.fit(odd, labels.where("false"))
    assert {r.score for r in method.score(odd, untrained).collect()} == {0.5}


def test_long_texts_are_scored_whole(spark):
    sample = [(b"good words here and there", 1), (b"bad bad bad bad", 0)] * 20
    model = quality.train(sample)
    raw, at = buffers(pa.array(["good words here and there " * 90000]))
    short, its = buffers(pa.array(["good words here and there " * 900]))
    assert abs(model.score(raw, at)[0] - model.score(short, its)[0]) < 1e-3
    tox = toxicity.train([(b"text number %d" % (i % 7), 0) for i in range(40)] + [(b"vile text number %d" % (i % 7), 1) for i in range(40)])
    raw, at = buffers(pa.array(["text number 1 " * 90000 + "vile", "text number 1"]))
    score = tox.score(raw, at)
    assert score[0] > 0.5 > score[1]


# token files


def test_token_files(spark, odd, none):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORD_BPE)
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for doc, text in rows:
        ids = model.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(map(tuple, dac_tokens.encode_corpus(odd, WORD_BPE).collect()), key=lambda r: r[1])
    assert got == want
    assert dac_tokens.encode_corpus(none, WORD_BPE).count() == 0


def test_codes_give_any_token(spark):
    ids = np.random.default_rng(1).choice([0, 1, 255, 256, 65535, 65536, 2**32 - 1, 49407], 5000).astype(np.uint32)
    segment = dac_tokens.Segment(dac_tokens.pack(ids, [1, None], np.array([10, 5000])))
    assert (segment.all() == ids).all() and all(segment[i] == ids[i] for i in range(len(ids))) and segment.doc_ids == [1, None]
    assert len(dac_tokens.Segment(dac_tokens.pack(ids[:0], [], np.array([]))).all()) == 0
    with pytest.raises(IndexError):
        segment[5000]


# url filters


def test_url_rules_brute_force(spark):
    hosts = ["a.com", "com", "xcom", "b.a.com", "A.COM", "net", "c.org", ""]
    urls = [f"{s}://{h}{p}" for s in ("http", "") for h in hosts for p in ("", "/", "/en/", "/en/7?x#y", "/EN/", "?q=/en/", "#/en/", "/en", "/de/8/en/")] + [None, "", "no scheme", "http//x", "a://b://c/en/"]
    rules = [("block", "com", "/en/"), ("allow", "a.com", "/en/7"), ("block", "net", ""), ("allow", "a.com", "/"), ("block", "a.com", "/"), ("block", None, "/"), ("block", "", "/")]

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), len(h), a, h + p) for a, h, p in rules if h and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, "allow", None))
        return host, path, best[3], best[2]

    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, *urls[:3]])], "page_id long, url string").withColumn("rule", F.lit("mine"))
    listed = spark.createDataFrame(rules, url_filter.RULE_SCHEMA)
    for limit in (url_filter.BROADCAST_RULES, 0):
        url_filter.BROADCAST_RULES, kept = limit, url_filter.BROADCAST_RULES
        try:
            got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed).collect()}
        finally:
            url_filter.BROADCAST_RULES = kept
        assert got == {i: judge(u) for i, u in enumerate([*urls, *urls[:3]])}
    assert url_filter.judge(pages.where("false"), listed).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, listed.where("false")).collect()} == {"allow"}


# sharding


def test_sharding(spark, odd, none):
    names = sharding.shard_names()
    table = sharding.lookup_table(names)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(names[:-1])
    moved = sum(a != b for a, b in zip(table, fewer) if a != names[-1])
    assert moved < 0.1 * len(table)
    got = sharding.place(odd, "doc_id").collect()
    assert len(got) == len(ODD) and all(r.shard == table[r.slot] for r in got) and sharding.place(none, "doc_id").count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 2040)
    plan = sharding.place(odd.select("doc_id"), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BroadcastHashJoin" in plan


# licences


def test_licenses(spark, odd, none):
    s = license_scan.SENTENCES
    texts = ["A line.\n" + s[1], "\n".join([s[1], s[6], "other words.", s[7]]), s[8] + "\n" + s[9], s[8], s[12] + "\n" + s[13] + "\n" + s[12], "licensed UNDER the mit", None, "", "Text. All rights reserved. More", s[2] + "\n" + s[2]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.licenses for r in license_scan.scan(rows).collect()}
    assert got == {0: ["Apache-2.0"], 1: ["Apache-2.0"], 2: ["MIT"], 3: ["MIT"], 4: ["BSD-2-Clause", "BSD-3-Clause"], 5: [], 6: [], 7: [], 8: ["all-rights-reserved"], 9: ["MIT"]}
    assert license_scan.scan(odd).count() == len(ODD) and license_scan.scan(none).count() == 0


FULL = {
    "MIT": ["MIT License", "Copyright (c) 2020 Some One", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:', "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "Apache-2.0": ["Copyright 2020 Some One", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "    http://www.apache.org/licenses/LICENSE-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "BSD-2-Clause": ["Copyright (c) 2020, Some One", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "GPL-3.0-or-later": ["A program. Copyright (C) 2020 Some One", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
}
FULL["BSD-3-Clause"] = [*FULL["BSD-2-Clause"], "3. Neither the name of Some One nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]
FULL["BSD-4-Clause"] = [*FULL["BSD-2-Clause"], "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by Some One.", *[x.replace("3. Neither", "4. Neither") for x in FULL["BSD-3-Clause"][len(FULL["BSD-2-Clause"]) :]]]
FULL["GPL-2.0-or-later"] = [p.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2") for p in FULL["GPL-3.0-or-later"]]

_GNU = lambda kind, v, mark, end: f"A program. This library is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as published by the Free Software Foundation{end} either version {v} of the License, or (at your option) any later version."
FULL["LGPL-2.1-or-later"] = [_GNU("Lesser", "2.1", ";", ";"), "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."]
FULL["LGPL-3.0-or-later"] = [_GNU("Lesser", "3", ":", ",")]
FULL["AGPL-3.0-or-later"] = [_GNU("Affero", "3", ":", ",")]
FULL["GPL-2.0-only"] = ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."]
FULL["ISC"] = ["ISC License", "Copyright (c) 2020, Some One", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE.']
FULL["MPL-2.0"] = ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."]
FULL["Unlicense"] = ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."]
FULL["CC0-1.0"] = ["No Copyright", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law."]
FULL["BSL-1.0"] = ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"]
FULL["Zlib"] = ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"]
for _short, _name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    FULL[f"CC-{_short}-4.0"] = ["A picture", f"The picture is licensed under a Creative Commons {_name} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/."]
    FULL[f"CC-{_short}-3.0"] = [f"Except where noted this site is licensed under a Creative Commons {_name} 3.0 Unported License."]
NEAR_MISSES = [
    "Permission to use, copy, modify, and/or distribute this software is not granted for any purpose with or without fee.",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.",
    "The picture is licensed under a Creative Commons Attribution 2.0 Generic License.",
    "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by somebody else, either version 3 of the License, or any later version.",
    "This is free and unencumbered hardware released into the public domain.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this book",
]


def test_whole_licenses(spark):
    """Licences as they are printed: wrapped at any width, as a comment, on one line, and one behind the other."""
    rows = []
    for name, text in FULL.items():
        for width in (30, 60, 72, 80):
            wrapped = [textwrap.wrap(p, width) for p in text]
            rows.append((name, "\n\n".join("\n".join(p) for p in wrapped)))
            rows.append((name, "\r\n".join("# " + line for p in wrapped for line in [*p, ""])))
        rows += [(name, " ".join(text)), (name, "\n\n".join(text)), (f"{name},all-rights-reserved", "\n\n".join([*text, "All rights\nreserved.", *text]))]
    rows += [("BSD-2-Clause,BSD-3-Clause", "\n\n".join(FULL["BSD-2-Clause"] + FULL["BSD-3-Clause"])), ("", "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License\nof another kind")]
    rows += [("", text) for miss in NEAR_MISSES for text in (miss, "\n".join(textwrap.wrap(miss, 40)))]
    rows += [("ISC", "# SPDX-License-Identifier: ISC"), ("CC-BY-4.0", "The text is licensed under CC BY 4.0, as is the rest.")]
    got = license_scan.scan(spark.createDataFrame(rows, "want string, text string")).collect()
    assert [(r.text, ",".join(r.licenses)) for r in got if ",".join(r.licenses) != r.want] == [] and len(got) == len(rows)


# media


def test_media_round_trip(spark, odd, none):
    got = media.round_trip(odd).collect()
    want = Counter()
    for doc, text in ODD:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        wav = media.to_wav(raw)
        want[doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(wav), hashlib.sha256(wav).hexdigest()] += 1
    assert Counter(tuple(r)[:7] for r in got) == want and media.round_trip(none).count() == 0


def test_archive_ranges_and_damage(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i} " * 500) for i in range(40)], "doc_id long, text string").coalesce(1)
    path = str(tmp_path / "a")
    media.store(rows, path)
    whole = media.load(spark, path, rangeBytes="2000")
    assert whole.rdd.getNumPartitions() > 3 and whole.select("offset").distinct().count() == 40
    archive = next((tmp_path / "a").glob("*.zip"))
    (tmp_path / "a" / "left-by-a-failed-task.zip").write_bytes(archive.read_bytes())
    first = min(r.offset for r in whole.collect())
    data = bytearray(archive.read_bytes())
    data[first + 40] ^= 0xFF
    archive.write_bytes(data)
    again = media.load(spark, path).collect()
    assert len(again) == 40 and sum(r.error is not None for r in again) == 1
    with pytest.raises(Exception, match="damaged|invalid|incorrect|Error"):
        media.describe(media.load(spark, path)).count()


# sentencepiece


def test_sentencepiece(spark, odd, none):
    texts = [t for _, t in ODD if t is not None] + ["  a  b\nc ▁d", "\n\n x \n", "x   ", "😀 aa\x00b", "<unk> <0x41>"]
    assert sentencepiece_codec.parity(PIECE_BPE, texts) == []
    rows = sentencepiece_codec.decode(sentencepiece_codec.encode(odd, PIECE_BPE), PIECE_BPE).collect()
    assert len(rows) == len(ODD) and all(r.decoded == (r.text or "") for r in rows)
    assert all(r.round_trip for r in sentencepiece_codec.digests(odd, PIECE_BPE).collect())
    assert sentencepiece_codec.encode(none, PIECE_BPE).count() == 0
    model = sentencepiece_codec.codec(PIECE_BPE, 1)
    whole = [model.tokenizer.encode(t, add_special_tokens=False).ids for t in texts if t and len(t) < 1000]
    assert whole == [model.encode(pa.array([t]))[0].tolist() for t in texts if t and len(t) < 1000]


def test_sentencepiece_unigram():
    """A unigram model made by hand, in the protobuf's own form."""
    import struct

    def piece(text, score, kind):
        body = b"\n" + bytes([len(text.encode())]) + text.encode() + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind])
        return b"\n" + bytes([len(body)]) + body

    data = piece("<unk>", 0, 2) + b"".join(piece(f"<0x{i:02X}>", 0, 6) for i in range(256)) + b"".join(piece(t, s, 1) for t, s in (("▁", -3), ("a", -2), ("b", -2.5), ("ab", -2), ("▁ab", -1.5), ("c", -4)))
    data += b"\x12\x05\x18\x01\x98\x02\x01" + b"\x1a\x06\x18\x01\x20\x00\x28\x01"
    codec = sentencepiece_codec.Codec(data, 1)
    names = [p for p, *_ in codec.model.pieces]
    show = lambda t: [names[i] for i in codec.encode(pa.array([t]))[0]]
    assert show("ab abc") == ["▁ab", "▁ab", "c"] and show("a~") == ["▁", "a", "<0x7E>"]


# near copies


def _brute(rows, k, num, den):
    sets, by = {}, defaultdict(list)
    for d, t in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for e, i in Counter(e for x in s for e in by[x]).items():
            if den * i >= num * (len(s) + len(sets[e]) - i):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
        for x in s:
            by[x].append(d)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("k, num, den", [(4, 85, 100), (5, 4, 5)])
def test_jaccard_brute_force(spark, data, k, num, den):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs, k, num, den).collect()}
    assert got == _brute([(r.doc_id, r.text) for r in docs.collect()], k, num, den)


def test_jaccard_hot_groups(spark, monkeypatch):
    """Large groups of near copies and a passage that all share, with bounds small enough to split both."""
    monkeypatch.setattr(jaccard_join, "HOT", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rng = np.random.default_rng(7)
    base, rows = [f"b{i}" for i in range(60)], []
    for d in range(60):
        w = list(base) if d < 25 else [f"x{int(i)}" for i in rng.integers(0, 10**6, 40)]
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(0, len(w)))] = f"e{int(rng.integers(0, 10**6))}"
        rows.append((d, " ".join(w + [f"p{i}" for i in range(12)])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()}
    assert got == _brute(rows, 4, 85, 100)


def test_jaccard_edges(spark, odd, none):
    got = jaccard_join.join(odd).collect()
    assert len(got) == len(ODD)
    found = defaultdict(set)
    for r in got:
        found[r.doc_id].add((r.n_shingles, r.component_id))
    assert found[1] == found[2].__class__({(0, 1)}) and found[2] == {(0, 2)} and found[6] == {(1, 5)} and found[5] == {(1, 5)}
    assert found[None] == {(0, None), (1, 5)} and found[7] == {(1, 7)}
    assert jaccard_join.join(none).count() == 0
    kept = jaccard_join.one_of_each(odd).collect()
    assert sorted((r.doc_id for r in kept if r.doc_id), key=int) == [1, 2, 3, 4, 5, 7, 8] and kept[0].score == "mine"


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}
    assert components(links.where("false")).count() == 0


def test_components_make_a_row_of_each_link_once(spark, monkeypatch):
    """Repeated links go before the first round, and what the join makes is written before it is read several times."""
    counts, plans, large, small = [], [], components_module._large_star, components_module._small_star
    monkeypatch.setattr(components_module, "_large_star", lambda links, least: (counts.append(links.count()), large(links, least))[1])
    monkeypatch.setattr(components_module, "_small_star", lambda moved: (plans.append(moved._jdf.queryExecution().optimizedPlan().toString()), small(moved))[1])
    pairs = [(i, i + 1) for i in range(40)]
    links = spark.createDataFrame((pairs + [(b, a) for a, b in pairs]) * 5, "a long, b long")
    assert {r.node: r.component for r in components(links).collect()} == dict.fromkeys(range(41), 0)
    assert counts[0] == 40 and plans and not any("Join" in p for p in plans)


def test_key_filter_loses_nothing(spark):
    keys = spark.range(0, 3000, 3)
    kept = {r.id for r in key_filter(keys, "id").maybe(spark.range(6000).withColumns({"w": F.lit(1), "V": F.lit(2), "maybe": F.lit(3)}), "id").collect()}
    assert set(range(0, 3000, 3)) <= kept and len(kept) < 2000


# decontamination


def test_overlaps_brute_force(spark, data):
    docs, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    split = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    rows, items = docs.collect(), [(b.item_id, split(b.text)) for b in bench.collect()]
    rng = np.random.default_rng(3)
    extra = []
    for n, (_, w) in enumerate(items):
        v = list(w)
        for i in rng.choice(len(v), int(len(v) * 0.1), False):
            v[int(i)] = f"zz{n}"
        extra.append((10**6 + n, " ".join(["some words before"] + v + ["and after"])))
    whole = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    want = set()
    for d, t in [*((r.doc_id, r.text) for r in rows), *extra]:
        w = np.array(split(t), object)
        for i, b in items:
            size = min(len(b), decontaminate.WINDOW)
            for g in range(-len(b) + size, len(w) - size + 1):
                low, high = max(0, -g), min(len(b), len(w) - g)
                if high - low < size:
                    continue
                eq = np.concatenate([[0], np.cumsum(w[low + g : high + g] == np.array(b[low:high], object))])
                if (eq[size:] - eq[:-size]).max() * 5 >= size * 4:
                    want.add((d, i))
                    break
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(whole, bench).collect()}
    assert got <= want and len(want - got) <= 0.02 * len(want)
    left = {r.doc_id for r in decontaminate.clean(whole, bench).collect()}
    assert left == {r[0] for r in [*((r.doc_id, 0) for r in rows), *extra]} - {d for d, _ in got}


def test_seeds_lose_no_pattern():
    """All substitution patterns that count as an overlap, for items of one diagonal window."""
    for size in range(decontaminate.SPAN, decontaminate.WINDOW + 1):
        item = np.arange(1, size + 1, dtype=np.uint64)
        seeds = [decontaminate.seed_hashes(item, m) for m in range(len(decontaminate.MASKS))]
        for places in itertools.combinations(range(size), size - -(-size * 4 // 5)):
            doc = item.copy()
            doc[list(places)] += np.uint64(1000)
            assert decontaminate.best_window(doc, item, 0) is not None
            assert any((decontaminate.seed_hashes(doc, m) == h).any() for m, h in enumerate(seeds)), (size, places)


def test_overlaps_at_the_threshold(spark):
    items = {n: [f"i{n}t{j}" for j in range(n)] for n in (12, 13, 15, 16, 18, 20, 30)}
    rng, docs, want = np.random.default_rng(5), [], set()
    for n, w in items.items():
        size = min(n, decontaminate.WINDOW)
        most = size - -(-size * 4 // 5)
        for extra in (0, 1):
            for k in range(60):
                # The first ones lose their ends; beyond the window every token of a longer item is another one.
                places = {0, size - 1} if k == 0 and not extra else set(rng.choice(size, most + extra, False).tolist())
                v = ["zz" if j in places or j >= size else t for j, t in enumerate(w)]
                docs.append((len(docs), " ".join(["before", *v, "after"])))
                if not extra:
                    want.add((docs[-1][0], n))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_overlaps_edges(spark, odd, none):
    bench = spark.createDataFrame([(1, "same text of five words"), (2, "same text of five words"), (3, None), (4, ""), (None, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.overlaps(odd, bench).collect())
    assert set(got) == {(d, i) for d in (None, 5, 6) for i in (1, 2)} | {(4, None)}
    assert Counter(r.doc_id for r in decontaminate.clean(odd, bench).collect()) == Counter([None, 1, 2, 3, 7, 8])
    assert decontaminate.overlaps(none, bench).count() == 0 and decontaminate.overlaps(odd, bench.where("false")).count() == 0


# pipeline


def test_pipeline(spark, data):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{data}/documents.parquet")
    names, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        after = P.materialise(stage(spark, docs, data), name)
        assert after.columns == names
        ids = [r.doc_id for r in after.collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in docs.collect()}
        if name == "near_copies":
            brute = _brute([(r.doc_id, r.text) for r in docs.collect()], 5, 4, 5)
            assert set(ids) == {c for _, c in brute.values()}
        docs = after
    out = P.STAGES[-1][1](spark, docs, data).collect()
    codec = sentencepiece_codec.codec(PIECE_BPE, 1)
    assert len(out) == docs.count() and all(codec.encode(pa.array([texts[r.doc_id]]))[0].tolist() == r.ids and len(r.ids) == r.n_tokens for r in out)
