"""Keys and times of recordings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the pattern of a recording's stamp.
STAMP = r"(\d{4}-\d{2}-\d{2})_(\d{2})-(\d{2})"
ZONE = "Asia/Jerusalem"


def _stamp(text: Column) -> Column:
    parts = F.concat(F.regexp_extract(text, STAMP, 1), F.lit(" "), F.regexp_extract(text, STAMP, 2), F.lit(":"), F.regexp_extract(text, STAMP, 3))
    return F.try_to_timestamp(F.nullif(parts, F.lit(" :")), F.lit("yyyy-MM-dd HH:mm"))


def segment_time(key: Column, zone: str = "UTC") -> Column:
    """The recording's start from its key, a local time of ``zone``."""
    return F.to_utc_timestamp(_stamp(key), zone)


def recording_time(key: Column, timestamp: Column, filename: Column, zone: str = ZONE) -> Column:
    """From the key, else the timestamp field, else the file name; local time of ``zone``."""
    field = F.coalesce(F.try_to_timestamp(timestamp, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(timestamp, F.lit("yyyy-MM-dd'T'HH:mm")))
    return F.to_utc_timestamp(F.coalesce(_stamp(key), field, _stamp(filename)), zone)


def absolute(base: Column, offset: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(base) + F.round(offset * 1_000_000).cast("long"))


def iso(time: Column, zone: str = ZONE) -> Column:
    """A time as the zone's clock shows it, with its offset: 2026-03-19T08:00:00+02:00."""
    local = F.from_utc_timestamp(time, zone)
    ahead = ((F.unix_micros(local) - F.unix_micros(time)) / 60_000_000).cast("int")
    offset = F.format_string("%s%02d:%02d", F.when(ahead < 0, "-").otherwise("+"), F.floor(F.abs(ahead) / 60), F.abs(ahead) % 60)
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.when(time.isNotNull(), offset))


def uri_parts(uri: Column, default_bucket: str) -> tuple[Column, Column]:
    """(bucket, key) of s3://bucket/key, else (default, the text as it is)."""
    full = uri.startswith("s3://")
    return (
        F.when(full, F.regexp_extract(uri, "^s3://([^/]*)", 1)).otherwise(F.lit(default_bucket)),
        F.when(full, F.regexp_extract(uri, "^s3://[^/]*/?(.*)$", 1)).otherwise(uri),
    )


def media_type(station: Column) -> Column:
    return F.when(station.startswith("tv/"), "tv").otherwise("radio")


def station(key: Column) -> Column:
    """The first part of the key, two parts below tv/."""
    parts = F.split(key, "/")
    return F.when((parts[0] == "tv") & (F.size(parts) > 2), F.concat_ws("/", parts[0], parts[1])).otherwise(parts[0])


def diarized_key(key: Column) -> Column:
    return F.replace(key, F.lit("_transcript"), F.lit("_diarized"))


def audio_key(key: Column) -> Column:
    return F.concat(F.regexp_replace(key, r"_(transcript|diarized)\.json$", ""), F.when(key.startswith("tv/"), ".mp4").otherwise(".mp3"))
