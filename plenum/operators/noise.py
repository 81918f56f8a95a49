"""Noise flags of sentences and segments: advertisement breaks, jingles, audio spans; priority and propagation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType
from pyspark.sql.window import Window

from plenum.functions import constants as C
from plenum.functions import text as T
from plenum.operators import phrases

#: Sentences after which an open break is given up.
LONGEST_BREAK = 60


def with_breaks(rows: DataFrame, key: str, order: str, opens: Column, closes: Column) -> DataFrame:
    """``rows`` with in_break, by each key's rows (a recording's sentences) in order.

    A break runs from an opening cue to the next closing one behind it, both flagged; after ``LONGEST_BREAK``
    sentences without one it is given up, flagged up to the sentence before; one that is open at the end is not
    flagged. The fold streams the sorted partition and holds back only the rows of an open break, at most
    ``LONGEST_BREAK`` + 1, however many rows a key has. Rows are shuffled once and carried through."""
    cues = rows.drop("in_break").withColumns({"_opens": F.coalesce(opens, F.lit(False)), "_closes": F.coalesce(closes, F.lit(False))})
    names = cues.columns[:-2]
    at = names.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(batch: pa.RecordBatch, flags: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(flags, pa.bool_())], [*names, "in_break"])

        held = None
        for batch in batches:
            # A fold that begins anew at the row that opened the break comes to the same.
            batch = batch if held is None else pa.concat_batches([held, batch])
            flags, begun, now = np.zeros(len(batch), bool), -1, object()
            opening, closing = (batch.column(i).to_numpy(zero_copy_only=False) for i in (len(names), len(names) + 1))
            for i, name in enumerate(batch.column(at).to_pylist()):
                if name != now and not (name != name and now != now):
                    now, begun = name, -1
                if begun < 0:
                    begun = i if opening[i] else -1
                elif closing[i]:
                    flags[begun : i + 1], begun = True, -1
                elif i - begun > LONGEST_BREAK:
                    flags[begun:i], begun = True, -1
            sure = len(batch) if begun < 0 else begun
            held = batch.slice(sure) if begun >= 0 else None
            yield out(batch.slice(0, sure), flags[:sure])
        if held is not None:
            yield out(held, np.zeros(len(held), bool))

    kinds = StructType([*cues.schema.fields[:-2], StructField("in_break", BooleanType())])
    return cues.repartition(key).sortWithinPartitions(key, order, "_opens", "_closes").mapInArrow(run, kinds)


def in_break(rows: DataFrame, key: str, order: str, opens: Column, closes: Column) -> DataFrame:
    """(key, order, in_break) of ``with_breaks``; only the cues are shuffled."""
    cues = rows.select(key, order, opens.alias("_o"), closes.alias("_c"))
    return with_breaks(cues, key, order, F.col("_o"), F.col("_c")).select(key, order, "in_break")


def index_ads(sentences: DataFrame, key: str = "media_id", order: str = "sentence_index") -> DataFrame:
    """``sentences`` with is_ad, as at index time: breaks, inline advertisements, station jingles."""
    low = F.lower("text")
    out = with_breaks(sentences, key, order, T.any_of(low, C.INDEX_AD_STARTS), T.any_of(low, C.INDEX_AD_ENDS))
    return out.withColumn("is_ad", F.col("in_break") | T.is_ad_index(F.col("text")) | T.is_jingle(F.col("text"))).drop("in_break")


@dataclass(frozen=True)
class Phrases:
    """What the later filter looks for, in lower case: cues of breaks, phrases of which two make an advertisement, and
    those of jingles."""

    opens: tuple[str, ...] = C.FILTER_AD_STARTS
    closes: tuple[str, ...] = C.FILTER_AD_ENDS
    ads: tuple[str, ...] = C.FILTER_AD_PHRASES
    jingles: tuple[str, ...] = C.FILTER_JINGLES


#: Advertisement phrases that make a sentence commercial; a jingle is shorter than so many seconds and words.
LEAST_ADS, JINGLE_SECONDS, JINGLE_WORDS = 2, 15, 20


def detections(sentences: DataFrame, audio: DataFrame | None = None, key: str = "media_id", order: str = "sentence_index", wanted: Phrases = Phrases()) -> DataFrame:
    """(key, order, noise_type) of the later filter: commercial before jingle before the audio label. ``sentences``:
    key, order, text, start_time, end_time; ``audio``: (key, order, noise_type), as ``intervals.noisy_sentences`` finds
    them. All phrases are found in one pass over each text, which is not shuffled: what goes on is counts."""
    low = F.lower("text")
    lists = {"_o": wanted.opens, "_c": wanted.closes, "_a": wanted.ads, "_j": wanted.jingles}
    short = (F.col("end_time") - F.col("start_time") < JINGLE_SECONDS) & (F.size(T.words(low)) < JINGLE_WORDS)
    found = phrases.counted(sentences.select(key, order, F.coalesce(short, F.lit(False)).alias("_short"), low.alias("_low")), lists, F.col("_low")).drop("_low")
    marked = with_breaks(found, key, order, F.col("_o") > 0, F.col("_c") > 0)
    kind = F.when(F.col("in_break") | (F.col("_a") >= LEAST_ADS), F.struct(F.lit(1).alias("p"), F.lit("commercial").alias("t"))).when(F.col("_short") & (F.col("_j") > 0), F.struct(F.lit(2).alias("p"), F.lit("jingle").alias("t")))
    own = marked.select(key, order, kind.alias("k")).where("k IS NOT NULL")
    if audio is not None:
        own = own.unionByName(audio.select(key, order, F.struct(F.lit(3).alias("p"), F.col("noise_type").alias("t")).alias("k")))
    return own.groupBy(key, order).agg(F.min("k").alias("k")).select(key, order, F.col("k.t").alias("noise_type"))


def flagged(sentences: DataFrame, found: DataFrame, key: str = "media_id") -> DataFrame:
    """``sentences`` with is_noise and noise_type set anew for every recording that has a detection; recordings
    without one keep their flags."""
    touched = found.select(key).distinct().withColumn("_touched", F.lit(True))
    new = found.select(key, "sentence_index", F.col("noise_type").alias("_type"))
    out = sentences.join(touched, key, "left").join(new, [key, "sentence_index"], "left")
    again = F.col("_touched").eqNullSafe(True)
    return out.withColumns({"is_noise": F.when(again, F.col("_type").isNotNull()).otherwise(F.col("is_noise")), "noise_type": F.when(again, F.col("_type")).otherwise(F.col("noise_type"))}).drop("_touched", "_type")


def propagated(sentences: DataFrame, segment: str = "segment_id") -> DataFrame:
    """(segment, is_noise, noise_type): a segment is noise if all its sentences are; its type is the most frequent
    one, the least by name on a tie."""
    counts = sentences.where(F.col(segment).isNotNull()).groupBy(segment, "noise_type").agg(F.count("*").alias("n"), F.bool_and(F.coalesce("is_noise", F.lit(False))).alias("all"))
    by = F.when(F.col("noise_type").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("noise_type").alias("t")))
    out = counts.groupBy(segment).agg(F.bool_and("all").alias("is_noise"), F.min(by).alias("m"))
    return out.select(segment, "is_noise", F.when(F.col("is_noise"), F.col("m.t")).alias("noise_type"))


def reset(rows: DataFrame, media: DataFrame, key: str = "media_id") -> DataFrame:
    """``rows`` with the flags of the given recordings cleared."""
    hit = media.select(key).distinct().withColumn("_hit", F.lit(True))
    out = rows.join(hit, key, "left")
    again = F.col("_hit").eqNullSafe(True)
    return out.withColumns({"is_noise": F.when(again, F.lit(False)).otherwise(F.col("is_noise")), "noise_type": F.when(again, F.lit(None).cast("string")).otherwise(F.col("noise_type"))}).drop("_hit")


def islands(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``rows`` with ``island``: the number of the run of equal ``value`` that each row is in, in order."""
    by = Window.partitionBy(key).orderBy(*order)
    new = F.coalesce(~F.lag(value).over(by).eqNullSafe(F.col(value)), F.lit(True))
    first = F.row_number().over(by) == 1
    return rows.withColumn("_new", (new | first).cast("int")).withColumn("island", F.sum("_new").over(by)).drop("_new")
