"""Licence recognition by sentence rules.

A text is cut into sentences at line ends and at marks followed by white space; a sentence is normalised (lower case,
everything but letters, digits and dots inside a number becomes one blank) and mapped to the identifier of a known
licence sentence. Licences are printed wrapped, so known sentences are also found across line ends, and those of
``WHOLE``, the licences' full sentences, also inside a longer piece. The identifiers of a text, in order, are matched against ordered rules: a rule is a list of
sentence identifiers that must follow one another directly among the text's known sentences. Longer rules claim their
sentences first, so that a notice is not also reported as a part of itself.

All of it is one projection of DataFrame functions over the row: no shuffle, nothing grouped, so one hot source or one
text that a third of all rows share costs no more than other rows. The sentence tables are constants of this module.
n_sentences counts the pieces between line ends and marks. ``SCAN_SQL`` restates the one-line forms (``SENTENCES`` and
``RULES``) only; texts with sentences of ``WHOLE``, or with wrapped ones, have more identifiers here.

Null or empty text: no sentences, no licences. Repeated sentences: identifiers repeat, each licence is reported once.
Ties between rules of one length: the earlier rule. Extra columns are kept; those with the names of the new columns
are replaced. Empty table: no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.scratch import unused

# The known licence sentences of one-line notices, some cut to their beginning.
SENTENCES = {
    1: "Licensed under the Apache License, Version 2.0.",
    2: "Released under the MIT License.",
    3: "This work is licensed under the GNU General Public License, version 3.",
    4: "Licensed under CC BY-NC 4.0.",
    5: "All rights reserved.",
    6: "You may not use this file except in compliance with the License.",
    7: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    8: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    9: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    10: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    11: "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    12: "Redistribution and use in source and binary forms, with or without modification, are permitted",
    13: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
    14: "This is free and unencumbered software released into the public domain.",
    15: "Licensed under CC BY 4.0.",
    16: "Licensed under CC BY-SA 4.0.",
    17: "This work is dedicated to the public domain under CC0 1.0.",
    18: "SPDX-License-Identifier: Apache-2.0",
    19: "SPDX-License-Identifier: MIT",
}
# The identifiers of other one-line notices in SPDX form.
SPDX = ("BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "BSL-1.0", "Zlib")
SENTENCES |= {60 + i: f"SPDX-License-Identifier: {x}" for i, x in enumerate(SPDX)}
# The ordered rules (licence, sentence identifiers in their order).
RULES = [
    ("Apache-2.0", (1, 6, 7)),
    ("MIT", (8, 9)),
    ("BSD-3-Clause", (12, 13)),
    ("Apache-2.0", (1,)),
    ("Apache-2.0", (18,)),
    ("MIT", (2,)),
    ("MIT", (8,)),
    ("MIT", (19,)),
    ("GPL-3.0", (3,)),
    ("GPL-3.0-or-later", (10,)),
    ("CC-BY-NC-4.0", (4,)),
    ("CC-BY-4.0", (11,)),
    ("CC-BY-4.0", (15,)),
    ("CC-BY-SA-4.0", (16,)),
    ("BSD-2-Clause", (12,)),
    ("Unlicense", (14,)),
    ("CC0-1.0", (17,)),
    ("all-rights-reserved", (5,)),
]
RULES += [(x, (60 + i,)) for i, x in enumerate(SPDX)]
# The licences' whole sentences, wherever they are wrapped and whatever stands around them. Where a name is
# to be filled in, the sentence begins behind it.
WHOLE = {
    20: 'Licensed under the Apache License, Version 2.0 (the "License");',
    21: 'licenses this file to you under the Apache License, Version 2.0 (the "License");',
    22: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    23: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    24: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    25: "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    26: 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    27: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    28: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    29: "is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    30: "is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
}
WHOLE |= {
    31: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    32: "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    33: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    34: "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    35: "dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    36: "waived all copyright and related or neighboring rights to",
    37: "Distributed under the Boost Software License, Version 1.0.",
    38: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    39: "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    40: "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
}
# Notices that differ in a name and a version only: (licence, name, version) of the GNU ones, where the program's name
# stands in front, and (suffix, name) of the Creative Commons ones.
GNU = [("LGPL-2.0-or-later", "Library ", "2"), ("LGPL-2.1-or-later", "Lesser ", "2.1"), ("LGPL-3.0-or-later", "Lesser ", "3"), ("AGPL-3.0-or-later", "Affero ", "3")]
COMMONS = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
FAMILIES = [(licence, f"is free software: you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.") for licence, name, version in GNU]
FAMILIES += [(f"CC-{s}-{v}", text) for s, name in COMMONS for v, port in (("4.0", "International"), ("3.0", "Unported")) for text in (f"is licensed under a Creative Commons {name} {v} {port} License.", f"is licensed under CC {s} {v}")]
FAMILY_IDS = {100 + i: x for i, x in enumerate(FAMILIES)}
WHOLE |= {i: text for i, (_, text) in FAMILY_IDS.items()}
WHOLE |= {i: SENTENCES[i] for i in (6, 7, 9, 14)}
# Beginnings of sentences; they count only where a piece is just that.
CUT = {8, 10, 12, 13}
WHOLE_RULES = [
    ("Apache-2.0", (20, 6, 7)),
    ("Apache-2.0", (21, 6, 7)),
    ("BSD-4-Clause", (22, 23, 24, 40, 25)),
    ("BSD-with-advertising", (22, 23, 24, 40)),
    ("BSD-3-Clause", (22, 23, 24, 25)),
    ("BSD-2-Clause", (22, 23, 24)),
    ("MIT", (26, 9)),
    ("Apache-2.0", (20,)),
    ("Apache-2.0", (21,)),
    ("BSD-2-Clause", (22,)),
    ("MIT", (26,)),
    ("GPL-3.0-or-later", (27,)),
    ("GPL-2.0-or-later", (28,)),
    ("GPL-3.0-or-later", (29,)),
    ("GPL-2.0-or-later", (30,)),
    ("ISC", (31,)),
    ("ISC", (32,)),
    ("MPL-2.0", (33,)),
    ("CC0-1.0", (34,)),
    ("CC0-1.0", (35,)),
    ("CC0-1.0", (36,)),
    ("BSL-1.0", (37,)),
    ("Zlib", (38,)),
    ("GPL-2.0-only", (39,)),
]
WHOLE_RULES += [(licence, (i,)) for i, (licence, _) in FAMILY_IDS.items()]
SPLIT = r"\n|[.!?;][ \t]+"
DROPPED = r"[^a-z0-9]+"


def normalise(sentence: str) -> str:
    """The table's side of the normalisation that key() does in Spark."""
    return re.sub(DROPPED, " ", sentence.lower()).strip(" ")


def _key(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), DROPPED, " "))


def _known() -> Column:
    pairs = [F.lit(x) for i, s in (SENTENCES | WHOLE).items() for x in (normalise(s), str(i))]
    return F.create_map(*pairs)


def _pattern() -> str:
    """Finds the known sentences among pieces that stand between line ends: whole ones between any words, the others as
    one piece or, if they aren't cut, several. Longer ones come first."""

    def any_of(table: dict[int, str]) -> str:
        # By first word, so that few alternatives are tried at a place.
        found: dict[str, list[str]] = {}
        for s, i in sorted(((normalise(s), i) for i, s in table.items()), key=lambda x: (-len(x[0]), x[1])):
            first, _, rest = s.partition(" ")
            found.setdefault(first, []).append(f" {rest}" if i in CUT else "[ \\n]" + rest.replace(" ", "[ \\n]"))
        return "(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(found.items())) + ")"

    return rf"(?<=[ \n]){any_of(WHOLE)}(?=[ \n])|(?<=\n){any_of({i: s for i, s in SENTENCES.items() if i not in WHOLE})}(?=\n)"


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with sentence_ids (of the known sentences, in order), n_sentences and licenses (sorted names)."""
    p, r, h = unused(docs, "parts"), unused(docs, "rest"), unused(docs, "hit")
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), SPLIT), _key), lambda s: s != "")
    known = _known()
    lines = F.concat(F.lit("\n"), F.array_join(p, "\n"), F.lit("\n"))
    ids = F.transform(F.regexp_extract_all(lines, F.lit(_pattern()), F.lit(0)), lambda s: known[F.replace(s, F.lit("\n"), F.lit(" "))])
    rest: Column = F.concat(F.lit(","), F.array_join(F.transform(F.col("sentence_ids"), lambda i: F.concat(i, F.lit(","))), ","), F.lit(","))
    out = docs.drop("sentence_ids", "n_sentences", "licenses").withColumn(p, parts)
    out = out.withColumn("n_sentences", F.size(p)).withColumn("sentence_ids", ids).drop(p)
    # Each identifier stands between its own commas: ",1,,6,". A claimed run becomes "#".
    out, hits, flags = out.withColumn(r, rest), [], []
    for name, rule in sorted(RULES + WHOLE_RULES, key=lambda x: -len(x[1])):
        run = ",,".join(map(str, rule))
        found = F.col(r).contains(f",{run},")
        if len(rule) > 1:
            flags.append(f"{h}{len(flags)}_")
            out = out.withColumn(flags[-1], found).withColumn(r, F.replace(F.col(r), F.lit(f",{run},"), F.lit("#")))
            found = F.col(flags[-1])
        hits.append(F.when(found, F.lit(name)))
    out = out.withColumn("licenses", F.array_sort(F.array_distinct(F.array_compact(F.array(*hits)))))
    return out.drop(r, *flags)


def _sql() -> str:
    values = ", ".join(f"('{normalise(s)}', '{i}')" for i, s in SENTENCES.items())
    rest, cases = "r0", []
    steps, n = "", 0
    for k, (name, rule) in enumerate(sorted(RULES, key=lambda r: -len(r[1]))):
        run = "," + ",,".join(map(str, rule)) + ","
        cases.append(f"CASE WHEN contains({rest}, '{run}') THEN '{name}' END")
        if len(rule) > 1:
            n += 1
            steps += f", replace({rest}, '{run}', '#') AS r{n}"
            rest = f"r{n}"
    return f"""
WITH known AS (SELECT map(list(k), list(v)) AS m FROM (VALUES {values}) t(k, v)),
cut AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '{SPLIT}'),
          lambda s: trim(regexp_replace(lower(s), '{DROPPED}', ' ', 'g'), ' ')), lambda s: s <> '') AS parts FROM documents),
ids AS (SELECT doc_id, len(parts) AS n_sentences,
          list_filter(list_transform(parts, lambda s: m[s]), lambda i: i IS NOT NULL) AS sentence_ids FROM cut, known),
seq AS (SELECT *, ',' || array_to_string(list_transform(sentence_ids, lambda i: i || ','), ',') || ',' AS r0 FROM ids),
claimed AS (SELECT *{steps} FROM seq)
SELECT doc_id, n_sentences::int AS n_sentences, array_to_string(sentence_ids, ',') AS sentence_ids,
  coalesce(array_to_string(list_sort(list_distinct(list_filter([{", ".join(cases)}], lambda x: x IS NOT NULL))), ','), '') AS licenses
FROM claimed"""


SCAN_SQL = _sql()
