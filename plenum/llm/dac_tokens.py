"""Token ids in directly addressable codes (Brisaboa, Ladra and Navarro 2009).

An id is cut into chunks of eight bits. Level 0 holds the lowest chunk of every id, level 1 the second one of those
ids that have one, and so on; a bitmap for each level says which ids go on, and a rank directory counts its ones up to
each block of 512 bits. Token i of a segment is found with one rank for each level and without decoding others.

The file format is a folder of Parquet files, so that Spark's committer makes them whole or not at all and any store
that Spark reaches will do. A row is a segment: part, first_token (in its part), n_tokens, and the packed ``blob``.
Parts are ranges of doc_id, in order.

Null text: as empty, so the document holds the end id alone. Null doc_id: kept, sorts first. Repeated doc_id: each row
is a document of its own, ordered by text. Empty table: no segments. Extra columns are ignored. A document of any
length stays in one segment.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm.chunk_encoder import ChunkEncoder
from plenum.llm.scratch import fresh_path
from plenum.llm.textbytes import buffers

MAGIC = b"DAC1"
SEGMENT_TOKENS = 1 << 18
BLOCK = 512
FILE_SCHEMA = "part int, segment int, first_token long, n_tokens long, n_docs int, blob binary"
_POPCOUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def pack(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray) -> bytes:
    """One segment: header, document directory, then for each level its chunks, bitmap and rank directory."""
    rest, levels = np.asarray(ids, np.uint32), []
    while len(rest) or not levels:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (BLOCK // 8)))
        ranks = np.concatenate([[0], np.cumsum(_POPCOUNT[bits].reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32))])
        levels.append((rest.astype(np.uint8), bits, ranks.astype(np.uint32)))
        rest = rest[more] >> np.uint32(8)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = np.array([0 if d is None else d for d in doc_ids], np.int64)
    out = [MAGIC, struct.pack("<IQI", len(docs), len(ids), len(levels)), docs.tobytes(), known.tobytes(), np.asarray(ends, np.uint32).tobytes()]
    for chunks, bits, ranks in levels:
        out += [struct.pack("<QQQ", len(chunks), len(bits), len(ranks)), chunks.tobytes(), bits.tobytes(), ranks.tobytes()]
    return b"".join(out)


class Segment:
    """Reads a blob in place."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        n_docs, self.n_tokens, n_levels = struct.unpack_from("<IQI", blob, 4)
        self._blob, self._at = blob, 4 + struct.calcsize("<IQI")
        docs, known = self._take(np.int64, n_docs), self._take(np.uint8, n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(docs, known)]
        self.ends = self._take(np.uint32, n_docs)
        self.levels = []
        for _ in range(n_levels):
            sizes = struct.unpack_from("<QQQ", blob, self._at)
            self._at += 24
            self.levels.append((self._take(np.uint8, sizes[0]), self._take(np.uint8, sizes[1]), self._take(np.uint32, sizes[2])))

    def _take(self, kind: type, n: int) -> np.ndarray:
        found = np.frombuffer(self._blob, kind, n, self._at)
        self._at += found.nbytes
        return found

    def __getitem__(self, i: int) -> int:
        """Token i, by one rank query for each level that it has."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // BLOCK
            inside = bits[block * (BLOCK // 8) : (i >> 3) + 1].copy()
            inside[-1] &= (1 << (i & 7)) - 1
            i, shift = int(ranks[block]) + int(_POPCOUNT[inside].sum()), shift + 8
        return value

    def all(self) -> np.ndarray:
        """All ids at once."""
        chunks, bits, _ = self.levels[-1]
        ids = chunks.astype(np.uint32)
        for chunks, bits, _ in reversed(self.levels[:-1]):
            upper, ids = ids, chunks.astype(np.uint32)
            ids[np.flatnonzero(np.unpackbits(bits, count=len(chunks), bitorder="little"))] |= upper << np.uint32(8)
        return ids


_encoders: dict[str, ChunkEncoder | WholeTexts] = {}


#: ASCII punctuation that never joins a letter in one token (the apostrophe does).
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def word_and_marks(chunk: str, apart: Callable[[str], bool] = str.isalpha) -> tuple[str, str]:
    """A word of letters and the marks behind it, as the model's pattern parts them; A-Z as the model lowers them.
    ``apart``: does the model part a mark from this letter before it?"""
    core = chunk.rstrip(_MARKS)
    if not core.isalpha():
        return chunk, ""
    if core.isascii():
        return core.lower(), chunk[len(core) :]
    return (core, chunk[len(core) :]) if apart(core[-1]) else (chunk, "")


def parts_of(model) -> Callable[[str], tuple[str, str]]:
    """``word_and_marks`` for a tokenizers model. The normal form of some letters ends in a combining mark, which the
    pattern joins with the marks behind it; the model itself is asked, once for each letter."""
    known: dict[str, bool] = {}

    def apart(letter: str) -> bool:
        if letter not in known:
            pieces = model.pre_tokenizer.pre_tokenize_str(model.normalizer.normalize_str(letter + "."))
            known[letter] = pieces[-1][0] == "."
        return known[letter]

    return lambda chunk: word_and_marks(chunk, apart)


def chunk_ids(model) -> Callable[[list[str]], list[list[int]]]:
    """Encodes chunks by the parts of a tokenizers model; a chunk that may hold a special token as a whole."""
    tokenize = model.model.tokenize

    def of(word: str) -> list[int]:
        if word.isascii() and word.isalpha():
            return [t.id for t in tokenize(word.lower())]
        if "<|" in word:
            return model.encode(word, add_special_tokens=False).ids
        pieces = model.pre_tokenizer.pre_tokenize_str(model.normalizer.normalize_str(word))
        return [t.id for piece, _ in pieces for t in tokenize(piece)]

    return lambda chunks: [of(c) for c in chunks]


# The normaliser and the pre-tokenizer that part a text at white space and at marks as assumed above.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def separable(form: dict) -> bool:
    """May texts be cut into words and marks for the tokenizers file with this content?"""
    parts = (form.get("pre_tokenizer") or {}).get("pretokenizers")
    special = [t["content"] for t in form.get("added_tokens") or []]
    return form.get("normalizer") == _NORMALIZER and parts == [_SPLIT, _BYTES] and (form.get("model") or {}).get("type") == "BPE" and all("<|" in t and not any(c.isspace() for c in t) for t in special)


class WholeTexts:
    """Encodes with any tokenizers file, text by text."""

    def __init__(self, model):
        self._model = model

    def encode(self, raw: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        data = raw.tobytes()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        ids = [[*e.ids, end_id] for e in self._model.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.uint32), np.cumsum([len(x) for x in ids], dtype=np.int64)


def encoder(path: str) -> ChunkEncoder | WholeTexts:
    """The worker's encoder for a tokenizers file."""
    if path not in _encoders:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            fits = separable(json.load(f))
        _encoders[path] = ChunkEncoder(chunk_ids(model), parts_of(model)) if fits else WholeTexts(model)
    return _encoders[path]


def write(docs: DataFrame, tokenizer_path: str, end_id: int, out: str, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode ``docs`` (doc_id, text) and write the segments, in ascending doc_id order, into folder ``out``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, coder = TaskContext.get().partitionId(), encoder(tokenizer_path)
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        ends: list[int] = []
        held, first, segment = 0, 0, 0

        def flush() -> pa.RecordBatch:
            blob = pack(np.concatenate(ids), names, np.array(ends))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "segment": pa.array([segment], pa.int32()), "first_token": pa.array([first], pa.int64()), "n_tokens": pa.array([held], pa.int64()), "n_docs": pa.array([len(names)], pa.int32()), "blob": pa.array([blob], pa.binary())})

        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for low in range(0, len(batch), 256):
                found, stops = coder.encode(*buffers(texts.slice(low, 256)), end_id)
                start = 0
                for doc, stop in zip(doc_ids.slice(low, 256).to_pylist(), stops.tolist()):
                    if held and held + stop - start > segment_tokens:
                        yield flush()
                        first, segment, held = first + held, segment + 1, 0
                        ids, names, ends = [], [], []
                    ids.append(found[start:stop])
                    held += stop - start
                    names.append(doc)
                    ends.append(held)
                    start = stop
        if names:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The beginning of the text parts rows that share a doc_id; the bounds' sample holds no whole texts.
    rows = rows.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(encode, FILE_SCHEMA).write.parquet(out)


def bases(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(part, ids of all parts before it): a row for each part of the files, that is, for each task that wrote."""
    segments, out, total = spark.read.schema(FILE_SCHEMA).parquet(path), [], 0
    for row in segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        out.append((row["part"], total))
        total += row["n"]
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document from the files: doc_id, start, n_tokens, ids_crc32."""
    segments = spark.read.schema(FILE_SCHEMA).parquet(path)
    base = spark.createDataFrame(bases(spark, path), "part int, base long")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, blob in zip(pc.add(batch.column("base"), batch.column("first_token")).to_pylist(), batch.column("blob")):
                segment = Segment(blob.as_buffer().to_pybytes())
                ids, ends = segment.all().astype("<u4"), segment.ends.astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                sums = [zlib.crc32(ids[a:b].data) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(segment.doc_ids, pa.int64()), "start": pa.array(starts + first, pa.int64()), "n_tokens": pa.array(ends - starts, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())})

    joined = segments.select("part", "first_token", "blob").join(F.broadcast(base), "part")
    return joined.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(spark: SparkSession, path: str, part: int, index: int) -> int:
    """Random access: token ``index`` of a part. One row is read, and of it nothing is decoded but that token."""
    row = spark.read.schema(FILE_SCHEMA).parquet(path).where((F.col("part") == part) & (F.col("first_token") <= index) & (F.col("first_token") + F.col("n_tokens") > index)).first()
    if row is None:
        raise IndexError(index)
    return Segment(row["blob"])[index - row["first_token"]]


def token(spark: SparkSession, path: str, index: int, parts: list[tuple[int, int]] | None = None) -> int:
    """Random access by a token's number in the corpus. ``parts``: what ``bases`` returns, for calls one after another."""
    before = [(part, base) for part, base in parts or bases(spark, path) if base <= index]
    if index < 0 or not before:
        raise IndexError(index)
    part, base = before[-1]
    return tokens_at(spark, path, part, index - base)


def encode_corpus(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` in this format into the shared folder and return what the files say of each document."""
    out = fresh_path(docs.sparkSession, "dac")
    write(docs, tokenizer_path, end_id, out)
    return read(docs.sparkSession, out)
