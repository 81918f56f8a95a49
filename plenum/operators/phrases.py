"""Many phrases found in one pass over a text: an Aho-Corasick automaton that each Python worker builds once.

The time for a text grows with its length, not with the number of phrases, and phrases that overlap or lie in one
another are all found. What a list's count means is the same as for ``functions.text.hits``: its distinct phrases that
the text holds.

Null text: holds nothing. An empty list, and an empty phrase, are never found. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: The automata of a worker, by their lists.
_automata: dict[tuple, object] = {}


def _automaton(lists: tuple[tuple[str, ...], ...]):
    """Finds phrases; the value of each is its number and the lists that it is in. None without phrases."""
    if lists not in _automata:
        import ahocorasick

        found = ahocorasick.Automaton()
        phrases = dict.fromkeys(p for own in lists for p in own if p)
        for number, phrase in enumerate(phrases):
            found.add_word(phrase, (number, tuple(i for i, own in enumerate(lists) if phrase in own)))
        found.make_automaton()
        _automata[lists] = found if phrases else None
    return _automata[lists]


def counts(text: str | None, lists: tuple[tuple[str, ...], ...]) -> list[int]:
    """How many distinct phrases of each list a text holds."""
    out, automaton = [0] * len(lists), _automaton(lists)
    if text and automaton is not None:
        for _, own in {value for _, value in automaton.iter(text)}:
            for i in own:
                out[i] += 1
    return out


def counted(rows: DataFrame, lists: dict[str, tuple[str, ...]], text: Column) -> DataFrame:
    """``rows`` with an integer column for each list: how many of its phrases ``text`` holds. Only the text and the
    columns of ``rows`` pass through Python, once, whatever the number of lists."""
    names, of = list(lists), tuple(map(tuple, lists.values()))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([counts(t, of) for t in batch.column(batch.num_columns - 1).to_pylist()], np.int32).reshape(len(batch), len(of))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(np.ascontiguousarray(c)) for c in found.T)], [*batch.schema.names[:-1], *names])

    taken = [c for c in rows.columns if c not in names]
    kinds = StructType([*rows.select(*taken).schema.fields, *(StructField(n, IntegerType()) for n in names)])
    return rows.select(*taken, text.alias("_text_to_search")).mapInArrow(find, kinds)
