"""SentencePiece encoding and decoding with the tokenizers library as the back end.

The model protobuf is read field by field: pieces with scores and types, trainer and normaliser settings. From them a
tokenizers model is rebuilt: the precompiled character map, the whitespace rule, the metaspace marker, and either
unigram scores or byte-pair merges ranked by score, both with byte fallback. Batches are encoded by the library's own
threads (``threads`` for a task). ``parity`` compares with the sentencepiece library.

No piece of a usual model holds a marker behind another character or a line end, so that a text may be cut before
every run of blanks and around line ends; then each distinct chunk is encoded once for a Python worker. A model with
such pieces, or with user-defined ones, is applied to whole texts instead.

Null or empty text: no ids, decoded as empty. Null doc_id: kept. Repeated rows: the same result each. Texts of any
length are whole. ``decode`` of ids without text (control pieces) adds nothing; unknown ids give the model's surface
for unknown. Extra columns are kept by ``encode``, which replaces one called ids.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from plenum.llm.chunk_encoder import ChunkEncoder
from plenum.llm.textbytes import SLICE_BYTES, buffers, groups, keep, trimmed

MARK = "▁"
#: Chunks that a worker's cache holds.
KEPT_CHUNKS = 300_000
KEPT = "sentencepiece codecs"
# Fixed values of the protobuf: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class SentencePieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_surface: str = " ⁇ "
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> SentencePieceModel:
        model = cls()
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                model.pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                own = dict(_fields(value))
                model.kind, model.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
                if 44 in own:
                    model.unk_surface = own[44].decode()
            elif number == 3:
                own = dict(_fields(value))
                model.charsmap = own.get(2, b"")
                model.add_dummy_prefix, model.remove_extra_whitespaces, model.escape_whitespaces = (bool(own.get(i, 1)) for i in (3, 4, 5))
        if model.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair models are supported")
        return model

    @property
    def separable(self) -> bool:
        """May a text be cut before every run of markers and around line ends?"""
        return not self.charsmap and not self.remove_extra_whitespaces and not any(t == USER or t == NORMAL and (re.search(f"[^{MARK}]{MARK}", p) or "\n" in p) for p, _, t in self.pieces)


def library_model(model: SentencePieceModel):
    """The tokenizers model over marked text."""
    from tokenizers import models

    unk = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
    if model.kind == UNIGRAM:
        # Pieces that never match text get names that no text has, and no score below the others: the library derives
        # what an unknown character costs from the least one. Codec turns unknown stretches into their byte pieces.
        vocab = [(p, s) if t in (NORMAL, USER) else (f"\x00{p}", 0.0) for p, s, t in model.pieces]
        return models.Unigram(vocab, unk, False)
    ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    score = {p: s for p, s, t in model.pieces if t in (NORMAL, USER)}
    merges = [(-score[p], ids[p], p[:i], p[i:]) for p in score for i in range(1, len(p)) if p[:i] in score and p[i:] in score]
    merges.sort(key=lambda m: (m[0], m[1], len(m[2])))
    return models.BPE(ids, [(a, b) for *_, a, b in merges], unk_token=model.pieces[unk][0] if unk is not None else None, fuse_unk=True, byte_fallback=model.byte_fallback)


def library_tokenizer(model: SentencePieceModel):
    """The whole tokenizer: normaliser, model and decoder."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, normalizers

    tokenizer = Tokenizer(library_model(model))
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(" +"), " "), normalizers.Replace(Regex("^ +| +$"), "")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", 1 if model.add_dummy_prefix else 0, 0)])
    users = [AddedToken(p, normalized=False, special=False) for p, _, t in model.pieces if t == USER]
    if users:
        tokenizer.add_tokens(users)
    return tokenizer


class Codec:
    """Encodes and decodes rows of Arrow string columns."""

    def __init__(self, data: bytes, threads: int = 2):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        from tokenizers import Tokenizer

        self.model = SentencePieceModel.parse(data)
        bare = Tokenizer(library_model(self.model))
        blank = np.zeros(256, bool)
        blank[0x20] = True
        self._bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.model.pieces) if t == BYTE}
        self._unknown = next((i for i, p in enumerate(self.model.pieces) if p[2] == UNKNOWN), -1)
        self._chunks = ChunkEncoder(lambda texts: self._batch(bare, texts), end=re.compile(b" "), blank=blank, kept=KEPT_CHUNKS)
        surfaces = []
        for piece, _, kind in self.model.pieces:
            own = {BYTE: lambda p: bytes([int(p[3:5], 16)]), CONTROL: lambda p: b"", UNUSED: lambda p: b"", UNKNOWN: lambda p: self.model.unk_surface.encode()}
            surfaces.append(own.get(kind, lambda p: p.replace(MARK, " ").encode())(piece))
        self._surface = np.frombuffer(b"".join(surfaces), np.uint8)
        self._ends = np.concatenate([[0], np.cumsum([len(s) for s in surfaces])])

    @cached_property
    def tokenizer(self):
        """The whole tokenizer; texts that can be cut into chunks don't need it."""
        return library_tokenizer(self.model)

    def _batch(self, tokenizer, texts: list[str]) -> list[list[int]]:
        if self.model.kind == BPE or not self.model.byte_fallback:
            return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        out = []
        for e in tokenizer.encode_batch(texts, add_special_tokens=False):
            ids = e.ids
            if self._unknown in ids:  # an unknown stretch keeps its text
                ids = [i for own, piece in zip(ids, e.tokens) for i in ([self._bytes.get(b, own) for b in piece.encode()] if own == self._unknown else [own])]
            out.append(ids)
        return out

    def _marked(self, text: str) -> str:
        """The text with markers for blanks and one blank between chunks."""
        if not text:
            return ""
        text = f"{MARK if self.model.add_dummy_prefix else ''}{text}".replace(" ", MARK).replace(MARK, f" {MARK}")
        while f"{MARK} {MARK}" in text:
            text = text.replace(f"{MARK} {MARK}", MARK + MARK)
        return text.replace("\n", " \n ")

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the end of each row in them."""
        if self.model.separable:
            raw, at = buffers(column)
            ids, ends, total = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
            for low, high in groups(at, SLICE_BYTES):
                own, stops = self._chunks.encode(*buffers(pa.array([self._marked(t or "") for t in column.slice(low, high - low).to_pylist()], pa.large_string())))
                ids.append(own)
                ends.append(stops + total)
                total += len(own)
            return np.concatenate(ids), np.concatenate(ends)
        texts = [t or "" for t in column.to_pylist()]
        found = [ids if t else [] for t, ids in zip(texts, self._batch(self.tokenizer, texts))]
        return np.array([i for x in found for i in x], np.uint32), np.cumsum([len(x) for x in found], dtype=np.int64)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' UTF-8 bytes and the end of each row in them."""
        low, size = self._ends[ids], self._ends[ids.astype(np.int64) + 1] - self._ends[ids]
        stops = np.concatenate([[0], np.cumsum(size)])
        text = self._surface[np.repeat(low - stops[:-1], size) + np.arange(stops[-1])]
        edges = stops[np.concatenate([[0], ends])]
        if self.model.add_dummy_prefix:
            begins = edges[:-1][edges[1:] > edges[:-1]]
            gone = begins[text[begins] == 0x20]
            text = np.delete(text, gone)
            edges = edges - np.searchsorted(gone, edges)
        return text, edges[1:]


@lru_cache(4)
def codec(path: str, threads: int) -> Codec:
    """The worker's codec for a model file that every worker can open."""
    keep(KEPT, codec.cache_clear)
    with open(path, "rb") as f:
        return Codec(f.read(), threads)


def encode(docs: DataFrame, model_path: str, text: str = "text", threads: int = 2) -> DataFrame:
    """``docs`` with the array column ids."""
    docs = docs.drop("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model_path, threads)
        for whole in batches:
            for low in range(0, len(whole), 500):
                batch = whole.slice(low, 500)
                ids, ends = coder.encode(batch.column(batch.schema.get_field_index(text)))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "ids"])

    fields = [StructField(f.name, f.dataType, True) for f in docs.schema.fields]
    return docs.mapInArrow(trimmed(run, KEPT), StructType([*fields, StructField("ids", ArrayType(IntegerType(), False))]))


def decode(rows: DataFrame, model_path: str, ids: str = "ids", threads: int = 2) -> DataFrame:
    """``rows`` with the string column decoded, from their ids alone (null ids: as none)."""
    rows = rows.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model_path, threads)
        for whole in batches:
            for low in range(0, len(whole), 500):
                batch = whole.slice(low, 500)
                lists = batch.column(batch.schema.get_field_index(ids))
                sizes = np.array([0 if n is None else n for n in pc.list_value_length(lists).to_pylist()], np.int64)
                text, ends = coder.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint32), np.cumsum(sizes))
                data = text.tobytes()
                texts = [data[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    fields = [StructField(f.name, f.dataType, True) for f in rows.schema.fields]
    return rows.mapInArrow(trimmed(run, KEPT), StructType([*fields, StructField("decoded", StringType())]))


def digests(docs: DataFrame, model_path: str, threads: int = 2) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): n_tokens, the CRC-32 of the ids as little-endian 32-bit numbers, and
    whether decoding the ids gives the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model_path, threads)
        for whole in batches:
            for low in range(0, len(whole), 500):
                batch = whole.slice(low, 500)
                ids, ends = coder.encode(batch.column(1))
                back, stops = coder.decode(ids, ends)
                raw, at = buffers(batch.column(1))
                words, starts = ids.astype("<u4"), np.concatenate([[0], ends])
                sums = [zlib.crc32(words[a:b].data) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
                begins = np.concatenate([[0], stops[:-1]])
                same = [b - a == d - c and bool(np.array_equal(back[a:b], raw[c:d])) for a, b, c, d in zip(begins.tolist(), stops.tolist(), at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(starts), pa.int64()), pa.array(sums, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(run, KEPT), "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")


def parity(model_path: str, texts: list[str]) -> list[str]:
    """Those of ``texts`` that the sentencepiece library encodes or decodes otherwise."""
    import sentencepiece

    own, other = codec(model_path, 1), sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids, ends = own.encode(pa.array(texts, pa.string()))
    back, stops = own.decode(ids, ends)
    data, bad = back.tobytes(), []
    for i, text in enumerate(texts):
        mine = ids[ends[i - 1] if i else 0 : ends[i]].tolist()
        theirs = other.encode(text)
        if mine != theirs or data[stops[i - 1] if i else 0 : stops[i]].decode("utf-8", "replace") != other.decode(theirs):
            bad.append(text)
    return bad
