"""Intervals in seconds: overlap joins and label spans.

Overlap joins carry the media key and a time bucket. Buckets come in levels, each ``LEVEL`` times as wide as the one
before, and a span belongs to the level whose buckets are as long as it is or longer, so that it touches two of them at
most there and at every higher level. Two spans meet at the higher of their levels. A span so makes two rows for each
level that occurs, whatever its length, and one hot media item spreads over many buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenum.functions import constants as C


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


#: Width of the narrowest buckets in seconds, how many times wider the next ones are, and how many levels there are.
NARROWEST, LEVEL, LEVELS = 8.0, 8.0, 12


def _level(start: Column, end: Column) -> Column:
    length = F.greatest(end - start, F.lit(NARROWEST))
    return F.least(F.ceil(F.log(length / NARROWEST) / F.log(F.lit(LEVEL)) - 1e-9), F.lit(LEVELS)).cast("int")


def _levels(rows: DataFrame, start: str, end: str) -> set[int]:
    """The levels that occur, of which there are at most LEVELS + 1."""
    return {r[0] for r in rows.select(_level(F.col(start), F.col(end)).alias("level")).distinct().collect() if r[0] is not None}


def _bucketed(rows: DataFrame, start: str, end: str, levels: list[int], names: tuple[str, str, str]) -> DataFrame:
    """``rows`` once for each bucket that they touch at their own level and at those of ``levels`` above it."""
    own, level, bucket = names
    width = F.lit(NARROWEST) * F.pow(F.lit(LEVEL), F.col(level))
    at = F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x >= F.col(own))
    rows = rows.withColumn(own, _level(F.col(start), F.col(end))).withColumn(level, F.explode(at))
    return rows.withColumn(bucket, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(start, end) / width))))


def overlapping(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs of a left row (start, end) and a right row (s, e) of one key that overlap, once each: at the higher of
    their levels, in the bucket where the overlap begins. Spans longer than the widest buckets (some 17,000 years) touch
    more of them."""
    levels = sorted(_levels(left, "start", "end") | _levels(right, "s", "e"))
    lb = _bucketed(left, "start", "end", levels, ("_l", "_level", "_bucket"))
    rb = _bucketed(right, "s", "e", levels, ("_r", "_level", "_bucket"))
    pairs = lb.join(rb, [key, "_level", "_bucket"]).where(F.col("_level") == F.greatest("_l", "_r"))
    pairs = pairs.where((F.col("start") < F.col("e")) & (F.col("s") < F.col("end")))
    width = F.lit(NARROWEST) * F.pow(F.lit(LEVEL), F.col("_level"))
    return pairs.where(F.col("_bucket") == F.floor(F.greatest("start", "s") / width)).drop("_l", "_r", "_level", "_bucket")


def assign_speakers(segments: DataFrame, turns: DataFrame, key: str = "media_id") -> DataFrame:
    """Each segment (key, segment_index, start, end) with the speaker of the largest total overlap among the turns
    (key, s, e, speaker), and that share of its length; UNKNOWN and 0.0 without overlap. On a tie the speaker whose
    overlapping turn comes first."""
    pairs = overlapping(segments.select(key, "segment_index", "start", "end"), turns.select(key, "s", "e", "speaker"), key)
    sums = pairs.groupBy(key, "segment_index", "speaker").agg(F.sum(overlap(F.col("start"), F.col("end"), F.col("s"), F.col("e"))).alias("o"), F.min("s").alias("f"))
    order = F.struct("o", (-F.col("f")).alias("f"), "speaker")
    best = sums.groupBy(key, "segment_index").agg(F.max(order).alias("b"))
    out = segments.join(best, [key, "segment_index"], "left")
    length = F.col("end") - F.col("start")
    confidence = F.when((length > 0) & F.col("b.o").isNotNull(), F.round(F.col("b.o") / length, 3)).otherwise(F.lit(0.0))
    return out.withColumns({"speaker": F.coalesce("b.speaker", F.lit("UNKNOWN")), "speaker_confidence": confidence}).drop("b")


def noisy_sentences(sentences: DataFrame, spans: DataFrame, key: str = "media_id") -> DataFrame:
    """(key, sentence_index, noise_type) of the sentences that noise spans (key, s, e, label, span_index) cover by more
    than half in total. The label is that of the last span that covers more than three tenths, else noise."""
    pairs = overlapping(sentences.select(key, "sentence_index", "start", "end"), spans.select(key, "s", "e", "label", "span_index"), key)
    length = F.col("end") - F.col("start")
    part = overlap(F.col("start"), F.col("end"), F.col("s"), F.col("e"))
    pairs = pairs.where(length > 0).withColumns({"o": part, "len": length})
    found = pairs.groupBy(key, "sentence_index").agg(F.sum("o").alias("total"), F.max("len").alias("len"), F.max(F.when(F.col("o") > 0.3 * F.col("len"), F.struct("span_index", "label"))).alias("last"))
    return found.where(F.col("total") > 0.5 * F.col("len")).select(key, "sentence_index", F.coalesce("last.label", F.lit("noise")).alias("noise_type"))


def merge_adjacent(spans: DataFrame, key: str, gap: float = C.MERGE_GAP) -> DataFrame:
    """(key, start, end, label): neighbours in time with one label and at most ``gap`` between them become one."""
    by = Window.partitionBy(key).orderBy("start", "end")
    new = ~((F.lag("label").over(by) == F.col("label")) & (F.col("start") - F.lag("end").over(by) <= gap))
    marked = spans.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("_g", F.sum("_new").over(by))
    return marked.groupBy(key, "_g").agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end"), F.first("label").alias("label")).drop("_g")


def runs(bins: DataFrame, key: str, resolution: float = C.BIN_SECONDS, least: float = C.LEAST_SPAN) -> DataFrame:
    """Spans of equal label from bins (key, bin, label), shorter ones than ``least`` dropped, neighbours merged."""
    by = Window.partitionBy(key).orderBy("bin")
    marked = bins.withColumn("_new", F.coalesce(F.lag("label").over(by) != F.col("label"), F.lit(True)).cast("int")).withColumn("_g", F.sum("_new").over(by))
    spans = marked.groupBy(key, "_g").agg(F.min("bin").alias("a"), (F.max("bin") + 1).alias("b"), F.first("label").alias("label"))
    spans = spans.where((F.col("b") - F.col("a")) * F.lit(resolution) >= least)
    spans = spans.select(key, F.round(F.col("a") * resolution, 3).alias("start"), F.round(F.col("b") * resolution, 3).alias("end"), "label")
    return merge_adjacent(spans, key)


def label_bins(speech: DataFrame, labels: DataFrame, media: DataFrame, key: str, music_wins: bool = False, resolution: float = C.BIN_SECONDS) -> DataFrame:
    """(key, bin, label) of each tenth of a second: speech where the detector heard it (unless the classifier says
    music and ``music_wins``), else the classifier's label (the last span that covers the bin), else silence. Spans are
    cut to the recording's length before they are laid out in bins. ``media``: key, duration; ``speech``: key, start, end; ``labels``: key, start, end, label, span_index."""
    # Cast to int truncates, as the bin numbers are meant.
    to_bin = lambda c: (F.col(c) / resolution).cast("int")
    bins = media.select(key, F.explode(F.sequence(F.lit(0), (F.col("duration") / resolution).cast("int"))).alias("bin"))
    last = media.groupBy(key).agg(F.max((F.col("duration") / resolution).cast("int")).alias("_last"))

    def cover(rows: DataFrame) -> DataFrame:
        low, high = F.greatest(to_bin("start"), F.lit(0)), F.least(to_bin("end"), F.col("_last"))
        inside = rows.join(last, key).where(low <= high)
        return inside.withColumn("bin", F.explode(F.sequence(low, high))).drop("_last")

    heard = cover(speech).select(key, "bin").distinct().withColumn("heard", F.lit(True))
    named = cover(labels).groupBy(key, "bin").agg(F.max_by("label", "span_index").alias("cls"))
    rows = bins.join(heard, [key, "bin"], "left").join(named, [key, "bin"], "left")
    spoken = F.col("heard").eqNullSafe(True)
    music = spoken & (F.col("cls") == "music") if music_wins else F.lit(False)
    label = F.when(music, "music").when(spoken, "speech").when(F.col("cls").isin("music", "noise"), F.col("cls")).otherwise("silence")
    return rows.select(key, "bin", label.alias("label"))


def class_label(name: Column) -> Column:
    """The classifier's names mapped to ours."""
    return F.when(name.isin("male", "female", "speech"), "speech").when(name == "music", "music").when(name == "noEnergy", "silence").otherwise("noise")


def loudness(samples: DataFrame, key: str, rate: int, seconds: float = C.WINDOW_SECONDS) -> DataFrame:
    """(key, start, end, db, label) of each window of samples (key, i, x): silence below the limit, else music. A last
    window of less than half a second is dropped. Sums are combined in the tasks that read the samples."""
    size = int(rate * seconds)
    w = F.floor(F.col("i") / size)
    sums = samples.groupBy(key, w.alias("w")).agg(F.sum(F.col("x") * F.col("x")).alias("s"), F.count("*").alias("n")).where(F.col("n") >= rate * 0.5)
    db = 20 * F.log10(F.sqrt(F.col("s") / F.col("n")) + 1e-10)
    return sums.select(key, F.round(F.col("w") * size / rate, 3).alias("start"), F.round((F.col("w") * size + F.col("n")) / rate, 3).alias("end"), F.round(db, 6).alias("db"), F.when(db < C.SILENCE_DB, "silence").otherwise("music").alias("label"))


def speech_spans(frames: DataFrame, key: str, rate: int = 16000, size: int = 512, threshold: float = 0.5, least_ms: int = 250, silence_ms: int = 100, lengths: DataFrame | None = None) -> DataFrame:
    """(key, start, end) in samples of speech from frame probabilities (key, i, p).

    Speech closes at a frame below the threshold that enough silence follows; where a shorter pause follows, it goes
    on. The number of silent frames behind each frame comes from run lengths, so a fold over each item's frames in
    order is all that is left; a span open at the end closes there: at the waveform's length (``lengths``: key, samples)
    or, where that isn't given, at the end of the last frame."""
    by = Window.partitionBy(key).orderBy("i")
    loud = F.col("p") >= threshold
    ahead = by.rowsBetween(1, Window.unboundedFollowing)
    rows = frames.withColumn("loud", loud).withColumn("next", F.min(F.when(loud, F.col("i"))).over(ahead))
    rows = rows.withColumn("last", F.max("i").over(Window.partitionBy(key)))
    quiet = (F.coalesce(F.col("next"), F.col("last") + 1) - F.col("i") - 1) * size
    need = int(silence_ms * rate / 1000)
    closing = ~F.col("loud") & ((quiet >= need) | (F.col("i") == F.col("last")))
    # Between two closing frames speech begins at the first loud one; a frame closes only what is open.
    rows = rows.withColumn("closing", closing).withColumn("g", F.coalesce(F.sum(closing.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    spans = rows.groupBy(key, "g").agg(F.min(F.when(F.col("loud"), F.col("i"))).alias("a"), F.max(F.when(F.col("closing"), F.col("i"))).alias("z"), F.max("last").alias("last"))
    spans = spans.where(F.col("a").isNotNull()).withColumn("z", F.coalesce("z", F.col("last") + 1))
    close = F.col("z") * size
    if lengths is not None:
        spans = spans.join(lengths.select(key, "samples"), key, "left")
        close = F.when(F.col("z") > F.col("last"), F.coalesce("samples", close)).otherwise(close)
    out = spans.select(key, (F.col("a") * size).alias("start"), close.alias("end"))
    return out.where(F.col("end") - F.col("start") >= int(least_ms * rate / 1000))
