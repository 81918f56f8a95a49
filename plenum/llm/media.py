"""Media columns: a Spark data source over folders of archives.

Format ``plenum_archive``. Writing packs rows (name, media) into zip archives, a task's own, under their final names;
the commit on the driver writes one manifest with their names and sizes, which makes them visible all together. Reading
plans byte ranges of the archives on the driver from the manifests alone; a task opens the archive, reads its central directory (bounded by the archive size), takes the members whose
offset falls into its range, and streams them as Arrow batches of bounded size. Each member is read by itself from its
offset: opened, checked against its length and CRC, and tried again (after a pause that doubles) when that fails, so
that one broken read costs one member and not the task. After the last try the member comes back with ``error`` set and no media.

Files are reached through pyarrow's filesystems (file, hdfs, viewfs, s3, ...); the folder is a shared one.

``store`` puts texts in as 8-bit mono WAV: a text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are
the samples; a chunk "nbyt" holds the unpadded length. Null text: as empty (64 zeros). Null doc_id: kept. Equal texts
give equal media. Repeated rows stay repeated. Empty table: no archives, no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from plenum.llm.scratch import fresh_path
from plenum.llm.textbytes import buffers

FORMAT = "plenum_archive"
SCHEMA = "archive string, offset long, name string, media binary, error string"
ARROW_SCHEMA = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("name", pa.string()), ("media", pa.binary()), ("error", pa.string())])
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, TRIES = 64 << 20, 8 << 20, 4 << 20, 3
UNIT = 64
#: Seconds before the second try; beginning of a manifest's name.
PAUSE, MANIFEST = 0.2, "_manifest-"


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    archive: str
    start: int
    end: int

    def __post_init__(self) -> None:
        self.value = None


@dataclass
class Written(WriterCommitMessage):
    archives: list[tuple[str, int]]


def read_member(store, archive: str, info: zipfile.ZipInfo) -> bytes:
    """One member, found by its offset alone."""
    with store.open_input_file(archive) as f:
        f.seek(info.header_offset)
        head = f.read(30)
        if head[:4] != b"PK\x03\x04":
            raise OSError(f"no member at {info.header_offset}")
        name, extra = struct.unpack("<HH", head[26:30])
        f.seek(info.header_offset + 30 + name + extra)
        data = f.read(info.compress_size)
    if info.compress_type == zipfile.ZIP_DEFLATED:
        data = zlib.decompress(data, -15)
    if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
        raise OSError(f"member at {info.header_offset} is damaged")
    return data


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, tries: int):
        self.path, self.range_bytes, self.tries = path, range_bytes, tries

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, root = filesystem(self.path)
        archives = []
        for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.is_file and f.base_name.startswith(MANIFEST):
                with store.open_input_file(f.path) as manifest:
                    archives += [(f"{root}/{name}", n) for name, n in json.loads(manifest.read())]
        return [Range(a, x, min(n, x + self.range_bytes)) for a, n in sorted(archives) for x in range(0, n, self.range_bytes)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        store, _ = filesystem(self.path)
        with store.open_input_file(partition.archive) as f, zipfile.ZipFile(f) as z:
            members = [m for m in z.infolist() if partition.start <= m.header_offset < partition.end]
        rows, held = [], 0
        for info in members:
            media, error = None, None
            for attempt in range(self.tries):
                if attempt:
                    time.sleep(PAUSE * 2 ** (attempt - 1))
                try:
                    media, error = read_member(store, partition.archive, info), None
                    break
                except (OSError, zlib.error) as e:
                    error = str(e)
            rows.append({"archive": partition.archive, "offset": info.header_offset, "name": info.filename, "media": media, "error": error})
            held += info.file_size
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, ARROW_SCHEMA)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW_SCHEMA)


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, archive_bytes: int):
        self.path, self.archive_bytes = path, archive_bytes
        store, root = filesystem(path)
        store.create_dir(root, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = filesystem(self.path)
        written: list[tuple[str, int]] = []
        name = sink = archive = None
        held = 0

        def close() -> None:
            archive.close()
            written.append((name, sink.tell()))
            sink.close()

        for batch in iterator:
            media = batch.column(batch.schema.get_field_index("media"))
            for member, one in zip(batch.column(batch.schema.get_field_index("name")).to_pylist(), media):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    sink = store.open_output_stream(f"{root}/{name}")
                    archive, held = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED, compresslevel=1), 0
                data = memoryview(one.as_buffer() or b"")
                archive.writestr(zipfile.ZipInfo(member), data, zipfile.ZIP_DEFLATED, 1)
                held += len(data)
                if held >= self.archive_bytes:
                    close()
                    archive = None
        if archive is not None:
            close()
        return Written(written)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Archives of failed or repeated attempts are in no message, so no manifest names them and no reader sees
        them."""
        store, root = filesystem(self.path)
        own = f"{uuid.uuid4().hex}.json"
        with store.open_output_stream(f"{root}/_new-{own}") as f:
            f.write(json.dumps([a for m in messages if m for a in m.archives]).encode())
        store.move(f"{root}/_new-{own}", f"{root}/{MANIFEST}{own}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = filesystem(self.path)
        for name, _ in (a for m in messages if m for a in m.archives):
            store.delete_file(f"{root}/{name}")


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)), int(self.options.get("tries", TRIES)))

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], int(self.options.get("archiveBytes", ARCHIVE_BYTES)))


def to_wav(data: bytes, unit: int = UNIT) -> bytes:
    payload = data + bytes(-len(data) % unit or (0 if data else unit))
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"nbyt" + struct.pack("<IQ", 8, len(data)) + b"data" + struct.pack("<I", len(payload))
    return b"RIFF" + struct.pack("<I", len(body) + len(payload)) + body + payload


def from_wav(media: bytes) -> tuple[memoryview, int]:
    """Samples and unpadded length."""
    view, at, length, samples = memoryview(media), 12, 0, memoryview(b"")
    while at + 8 <= len(view):
        kind, (size,) = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)
        if kind == b"nbyt":
            (length,) = struct.unpack_from("<Q", view, at + 8)
        elif kind == b"data":
            samples = view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return samples, length


def sound_features(samples: memoryview) -> str:
    """Mean, root mean square and peak around the middle level 128, and crossings of it, for the whole recording."""
    total = square = crossings = peak = 0
    last = None
    for low in range(0, len(samples), 1 << 20):
        x = np.frombuffer(samples[low : low + (1 << 20)], np.uint8).astype(np.int16) - 128
        total += int(x.sum(dtype=np.int64))
        square += int(np.dot(x.astype(np.float64), x))
        peak = max(peak, int(np.abs(x).max()))
        above = x >= 0
        crossings += int(np.count_nonzero(above[1:] != above[:-1])) + (last is not None and bool(last != above[0]))
        last = above[-1]
    n = max(1, len(samples))
    return f"mean={total / n:.3f} rms={(square / n) ** 0.5:.3f} peak={peak} crossings={crossings}"


def store(docs: DataFrame, path: str) -> None:
    """Write the texts of ``docs`` (doc_id, text) as WAV members named by doc_id."""
    docs.sparkSession.dataSource.register(ArchiveSource)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                raw, at = buffers(part.column(1))
                data = raw.tobytes()
                media = [to_wav(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                names = ["" if d is None else str(d) for d in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "media": pa.array(media, pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows.mapInArrow(pack, "name string, media binary").write.format(FORMAT).mode("append").save(path)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def load(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The archives' members: archive, offset, name, media, error."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(FORMAT).options(**options).load(path)


def describe(members: DataFrame) -> DataFrame:
    """Features of WAV members from the bytes read back. A member that stayed unreadable raises: no row is dropped."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, value, error in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if error is not None:
                    raise OSError(f"{name}: {error}")
                media = value.as_buffer().to_pybytes()
                samples, length = from_wav(media)
                rows.append((int(name) if name else None, length, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), sound_features(samples)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = zip(*rows) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [f.split()[0] for f in FEATURES.split(", ")])

    return members.select("name", "media", "error").mapInArrow(of, FEATURES)


def round_trip(docs: DataFrame) -> DataFrame:
    """Store all texts in the shared folder, read them back through the source, and describe them."""
    path = fresh_path(docs.sparkSession, "media")
    store(docs, path)
    return describe(load(docs.sparkSession, path))
