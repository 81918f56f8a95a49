"""From diarized transcripts to turns, sentences, segments and topics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenum.functions import constants as C
from plenum.functions import text as T
from plenum.operators.noise import islands


def turns(rows: DataFrame, key: str = "media_id", order: str = "position") -> DataFrame:
    """Speaker turns (key, turn, speaker, start, end, text, speaker_confidence) of rows (key, order, start, end, text,
    speaker, speaker_confidence). Blank rows are skipped before speakers are compared."""
    filled = rows.withColumns({"text": F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", ""), "speaker": F.coalesce("speaker", F.lit("UNKNOWN")), "speaker_confidence": F.coalesce("speaker_confidence", F.lit(0.0))}).where("text <> ''")
    marked = islands(filled, key, [order], "speaker")
    out = marked.groupBy(key, "island", "speaker").agg(
        F.min_by("start", order).alias("start"),
        F.max_by("end", order).alias("end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ").alias("text"),
        F.min("speaker_confidence").alias("speaker_confidence"),
    )
    return out.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy("island")) - 1).drop("island")


def sentences(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each row (keys, start, end, text) cut into sentences with times by share of characters (keys, part, start, end,
    text and the other columns). A row of one sentence keeps its times as they are; junk is dropped."""
    clean = T.clean_asr(F.col("text"))
    parts = F.filter(F.split(F.col("_clean"), r"(?U)(?<=[.?!।])\s+"), lambda p: ~T.is_junk(p))
    cut = rows.withColumn("_clean", clean).where(~T.is_junk(F.col("_clean"))).withColumn("_parts", parts)
    total = F.aggregate(F.col("_parts"), F.lit(0), lambda s, p: s + F.length(p))
    # Only rows of more than one part get new times; the others keep the cleaned text whole.
    many = F.size("_parts") > 1
    listed = F.when(many, F.col("_parts")).otherwise(F.array("_clean"))
    state = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("ends"))
    ends = F.aggregate(F.col("_list"), state, lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.concat(s["ends"], F.array(s["at"] + F.length(p))).alias("ends")), lambda s: s["ends"])
    cut = cut.withColumns({"_many": many, "_total": total, "_list": listed}).withColumn("_ends", ends)
    rest = [c for c in rows.columns if c not in (*keys, "start", "end", "text")]
    out = cut.select(*keys, *rest, "start", "end", "_many", "_total", F.posexplode(F.arrays_zip(F.col("_list").alias("p"), F.col("_ends").alias("e"))).alias("part", "x"))
    span = F.col("end") - F.col("start")
    begin = F.round(F.col("start") + span * (F.col("x.e") - F.length("x.p")) / F.col("_total"), 2)
    close = F.round(F.col("start") + span * F.col("x.e") / F.col("_total"), 2)
    return out.select(*keys, *rest, "part", F.when(F.col("_many"), begin).otherwise(F.col("start")).alias("start"), F.when(F.col("_many"), close).otherwise(F.col("end")).alias("end"), F.col("x.p").alias("text"))


def segments(rows: DataFrame, key: str = "media_id", order: str = "sentence_index", embedding: str = "embedding_he", similarity: float = C.SEGMENT_SIMILARITY, seconds: float = C.SEGMENT_SECONDS, least: int = C.SEGMENT_LEAST, window: int = C.SEGMENT_WINDOW) -> DataFrame:
    """(key, order, segment_index): a new segment begins before a sentence that is unlike the mean of the last
    ``window`` members, if the segment has ``least`` members, or that would make it ``seconds`` long.

    Where a segment begins depends on where the last one did, so this is a fold for each recording. It streams the
    sorted partition: memory is a few sentences, however long a recording is."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        media, index, members, begun = object(), 0, [], 0.0
        for frame in frames:
            out = []
            for name, start, end, vector in zip(frame[key], frame["start"], frame["end"], frame[embedding]):
                vector = np.asarray(vector, float)
                if name != media:
                    media, index, members, begun, count = name, 0, [], start, 0
                elif members:
                    mean = np.mean(members, axis=0)
                    scale = np.linalg.norm(mean) * np.linalg.norm(vector)
                    near = float(mean @ vector / scale) if scale else 0.0
                    if (near < similarity and count >= least) or end - begun >= seconds:
                        index, members, begun, count = index + 1, [], start, 0
                members = [*members, vector][-window:]
                count += 1
                out.append(index)
            yield pd.DataFrame({key: frame[key], order: frame[order], "segment_index": out})

    kind = dict(rows.dtypes)
    kept = rows.where(F.col(embedding).isNotNull()).select(key, order, "start", "end", embedding)
    return kept.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, f"{key} {kind[key]}, {order} {kind[order]}, segment_index int")


def segment_rows(sentences_with_segment: DataFrame, key: str = "media_id", order: str = "sentence_index") -> DataFrame:
    """The segments' own rows: times, text, speakers in order of first speech, sentence count."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "text", F.coalesce("speaker", F.lit("UNKNOWN")).alias("speaker"))))
    out = sentences_with_segment.groupBy(key, "segment_index").agg(F.round(F.min_by("start", order), 2).alias("start_time"), F.round(F.max_by("end", order), 2).alias("end_time"), ordered.alias("_s"), F.count("*").cast("int").alias("sentence_count"))
    return out.withColumns({"text": F.array_join(F.transform("_s", lambda x: x["text"]), " "), "speakers": F.array_distinct(F.transform("_s", lambda x: x["speaker"]))}).drop("_s")


class TopicFold:
    """The topics of one key as its vectors come by: a vector joins the nearest topic that reaches the threshold, whose
    centroid becomes the running mean, or opens a new one."""

    def __init__(self, threshold: float):
        self.threshold, self.n = threshold, 0
        self.room, self.members = np.zeros((16, 0)), np.zeros(16, np.int64)

    def put(self, topic: int, members: int, centroid: np.ndarray) -> None:
        """Topic ``topic`` as it was left."""
        if self.room.shape[1] != len(centroid) and self.n == 0:
            self.room = np.zeros((len(self.room), len(centroid)))
        while topic >= len(self.room):
            self.room, self.members = np.concatenate([self.room, np.zeros_like(self.room)]), np.concatenate([self.members, np.zeros_like(self.members)])
        self.room[topic], self.members[topic], self.n = centroid, members, max(self.n, topic + 1)

    def add(self, vector: np.ndarray) -> int:
        v = np.asarray(vector, float)
        centres = self.room[: self.n]
        at = -1
        if self.n:
            scale = np.linalg.norm(centres, axis=1) * np.linalg.norm(v)
            near = centres @ v / np.where(scale == 0, 1, scale)
            at = int(near.argmax())
        if at >= 0 and near[at] >= self.threshold:
            self.room[at] = (self.room[at] * self.members[at] + v) / (self.members[at] + 1)
            self.members[at] += 1
            return at
        self.put(self.n, 1, v)
        return self.n - 1


def topics(rows: DataFrame, key: str, order: list[str], embedding: str = "embedding_he", threshold: float = C.TOPIC_SIMILARITY, id_column: str = "id", known: DataFrame | None = None, states: bool = False) -> DataFrame:
    """(key, id_column, topic): online clustering in order within each key, such as a station's month. A row joins the
    nearest topic that reaches the threshold, whose centroid becomes the running mean; else it opens one. Rows without
    a vector get none.

    ``states``: with members and centroid, the topic as the row left it. ``known``: (key, topic, members, centroid) as
    an earlier run left them (``topic_table``); this run goes on from there, as if the rows of both had come at once.

    Each step needs the topics as the rows before left them. One order over everything would be one task's work, so
    the order is a key's; a task holds the topics of one key while its rows stream by."""
    kind = dict(rows.dtypes)
    names = [key, id_column, "topic", *(["members", "centroid"] if states else [])]
    kinds = f"{key} {kind[key]}, {id_column} {kind[id_column]}, topic int" + (", members long, centroid array<double>" if states else "")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, fold = object(), None
        for frame in frames:
            out = []
            for name, known_topic, members, vector, row_id in zip(frame[key], frame["_topic"], frame["_members"], frame[embedding], frame[id_column]):
                if name != now and not (name != name and now != now):
                    now, fold = name, TopicFold(threshold)
                if known_topic >= 0:
                    fold.put(int(known_topic), int(members), vector)
                    continue
                at = fold.add(vector)
                out.append((name, row_id, at, *((int(fold.members[at]), fold.room[at].copy()) if states else ())))
            yield pd.DataFrame(out, columns=names)

    kept = rows.where(F.col(embedding).isNotNull()).select(*dict.fromkeys([key, id_column, *order]), F.col(embedding).cast("array<double>").alias(embedding)).withColumns({"_topic": F.lit(-1), "_members": F.lit(0).cast("long")})
    if known is not None:
        old = known.select(key, F.col("centroid").cast("array<double>").alias(embedding), F.col("topic").alias("_topic"), F.col("members").cast("long").alias("_members"))
        kept = kept.unionByName(old, allowMissingColumns=True)
    # Topics that are known come before a key's rows.
    return kept.repartition(key).sortWithinPartitions(key, F.col("_topic") < 0, *order).mapInPandas(run, kinds)


def topic_table(assigned: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """(key, topic, members, centroid) as rows of ``topics`` with their states have left them: a topic's members only
    grow, so its last state is the one of most members."""
    rows = assigned.select(key, "topic", "members", "centroid")
    if known is not None:
        rows = rows.unionByName(known.select(key, "topic", F.col("members").cast("long").alias("members"), F.col("centroid").cast("array<double>").alias("centroid")))
    return rows.groupBy(key, "topic").agg(F.max("members").alias("members"), F.max_by("centroid", "members").alias("centroid"))
