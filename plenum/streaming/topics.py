"""Online topics over a stream: each key's topics are state that lives from batch to batch and over restarts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plenum.functions import constants as C
from plenum.operators.indexing import TopicFold

#: The state store that keyed state of this kind needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Topics(StatefulProcessor):
    """A key's topics, one entry of a map for each; a batch reads them once and writes those that it has changed."""

    def __init__(self, key: str, order: list[str], embedding: str, threshold: float, id_column: str):
        self._key, self._order, self._embedding, self._threshold, self._id = key, order, embedding, threshold, id_column

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._topics = handle.getMapState("topics", "topic int", "members long, centroid array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fold, changed = TopicFold(self._threshold), {}
        for (topic,), (members, centroid) in self._topics.iterator():
            fold.put(topic, members, np.array(centroid, float))
        # The rows of one key in one batch, which the source's limit for a batch bounds.
        batch = pd.concat(list(rows)).sort_values(self._order, kind="stable")
        out = []
        for row_id, vector in zip(batch[self._id], batch[self._embedding]):
            at = fold.add(vector)
            changed[at] = None
            out.append((key[0], row_id, at, int(fold.members[at]), fold.room[at].copy()))
        for at in changed:
            self._topics.updateValue((at,), (int(fold.members[at]), fold.room[at].tolist()))
        yield pd.DataFrame(out, columns=[self._key, self._id, "topic", "members", "centroid"])

    def close(self) -> None:
        pass


def assigned(stream: DataFrame, key: str, order: list[str], embedding: str = "embedding_he", threshold: float = C.TOPIC_SIMILARITY, id_column: str = "id") -> DataFrame:
    """(key, id_column, topic, members, centroid) for each row of the stream, as ``indexing.topics`` with states gives
    them for a table: in order within a batch, and batches one after another. ``indexing.topic_table`` of what has been
    written is the table of topics. The session's state store must be ``PROVIDER``."""
    kind = dict(stream.dtypes)
    kept = stream.where(F.col(embedding).isNotNull()).select(*dict.fromkeys([key, id_column, *order]), F.col(embedding).cast("array<double>").alias(embedding))
    kinds = f"{key} {kind[key]}, {id_column} {kind[id_column]}, topic int, members long, centroid array<double>"
    return kept.groupBy(key).transformWithStateInPandas(_Topics(key, order, embedding, threshold, id_column), kinds, "append", "none")
