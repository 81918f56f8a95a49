"""An approximate index of vectors by cosine: cells of a coarse quantiser, product-quantised codes, exact re-ranking.

Vectors are brought to length one. The coarse quantiser's cells and the codebooks of the residuals are trained by
Lloyd's steps on the cluster: each task sums the sample's vectors by their nearest centre, and the sums are added up
as DataFrame rows. Training reads a sample of ``SAMPLE`` vectors for each centre at most; every row is indexed.

The rows are stored in a folder for each cell, dealt to several files where a cell is large, with a code of one byte
for each ``WIDTH`` dimensions. A search names the cells nearest to its vector, so the scan is pruned to their folders;
it reads ids and codes there, keeps the rows of the best approximate scores, and ranks only these by their vectors.
``exact`` reads every cell and ranks by the vectors alone. Many queries at once meet the rows of their cells in blocks
of bounded size and are ranked by the vectors.

Rows without a vector are not indexed and match nothing, as in an exact search; a zero vector is like nothing
(similarity 0). Filter columns are looked at before rows are ranked. Empty table: an index without rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from plenum.functions import constants as C
from plenum.functions import vector as V
from plenum.operators import search
from plenum.sources import store

#: Dimensions of a code's byte, centres of a codebook, sample vectors for each centre, Lloyd's steps.
WIDTH, CODES, SAMPLE, STEPS = 8, 256, 64, 8
#: The share of cells that a search reads unless told otherwise: enough for vectors without any clusters. Where vectors
#: lie in clusters, a few cells will do.
PROBED = (2, 3)
#: Most cells, files of a cell, floats of a block of vectors.
MOST_CELLS, SPREAD, BLOCK_FLOATS = 4096, 8, 1 << 20


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long number arrays as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size == 0, 1, size)


def nearest(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centre."""
    return np.argmax(m @ centres.T - (centres * centres).sum(1) / 2, axis=1)


def _pieces(m: np.ndarray, spaces: int) -> np.ndarray:
    """(spaces, rows, width): the rows cut into sub-vectors, the last one filled up with zeros."""
    width = -(-m.shape[1] // spaces)
    m = np.pad(m, ((0, 0), (0, width * spaces - m.shape[1])))
    return m.reshape(len(m), spaces, width).transpose(1, 0, 2)


def lloyd(rows: DataFrame, start: np.ndarray, steps: int, prepare: Callable[[np.ndarray], np.ndarray], embedding: str) -> np.ndarray:
    """``steps`` of Lloyd's algorithm in each of the spaces of ``start`` (spaces, centres, width). A task sends one sum
    for each space and centre, and a step's result has the size of ``start``. A centre without members stays."""
    spaces, k, width = start.shape
    centres = start.astype(np.float32)
    only = rows.select(embedding)
    for _ in range(steps):

        def sums(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((spaces * k, width)), np.zeros(spaces * k, np.int64)
            for batch in batches:
                if len(batch):
                    for s, piece in enumerate(_pieces(prepare(matrix(batch.column(0))), spaces)):
                        at = nearest(piece, centres[s]) + s * k
                        np.add.at(total, at, piece)
                        n += np.bincount(at, minlength=spaces * k)
            met = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"centre": pa.array(met, pa.int32()), "s": pa.array(list(total[met]), pa.list_(pa.float64())), "n": pa.array(n[met], pa.int64())})

        parts = only.mapInArrow(sums, "centre int, s array<double>, n long")
        each = parts.select("centre", "n", F.posexplode("s").alias("i", "x")).groupBy("centre", "i").agg((F.sum("x") / F.sum("n")).alias("x"))
        new = centres.reshape(spaces * k, width).copy()
        for row in each.groupBy("centre").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("x")).collect():
            new[row["centre"]] = [x["x"] for x in row["x"]]
        centres = new.reshape(start.shape)
    return centres


@dataclass(frozen=True)
class VectorIndex:
    rows: DataFrame
    cells: np.ndarray = field(repr=False)
    books: np.ndarray = field(repr=False)
    counts: tuple[int, ...] = ()
    id_column: str = "id"
    embedding: str = "embedding_he"

    def nearest_cells(self, vector: list[float], probes: int) -> list[int]:
        q = unit(np.array([vector], np.float32))[0]
        order = np.lexsort((np.arange(len(self.cells)), -(self.cells @ q - (self.cells**2).sum(1) / 2))) if len(self.cells) else []
        return [int(c) for c in order[:probes]]


def _default_cells(n: int) -> int:
    return max(1, min(MOST_CELLS, round(math.sqrt(n))))


def _default_probes(index: VectorIndex) -> int:
    return -(-len(index.cells) * PROBED[0] // PROBED[1])


def write(rows: DataFrame, path: str, id_column: str = "id", embedding: str = "embedding_he", cells: int | None = None, steps: int = STEPS) -> None:
    """Train and write the index of ``rows`` into folder ``path``."""
    spark = rows.sparkSession
    kept = rows.where(F.col(embedding).isNotNull())
    n = kept.count()
    k = min(cells or _default_cells(n), max(n, 1))
    # The sample: rows of the least hashes, so that it is the same in every run; written once for all steps.
    want = max(k, CODES) * SAMPLE
    share = F.pmod(F.xxhash64(id_column), F.lit(max(n, 1))) < want
    kept.where(share if n > want else F.lit(True)).select(id_column, embedding).write.parquet(f"{path}/sample")
    sample = spark.read.parquet(f"{path}/sample")
    first = sample.orderBy(F.xxhash64(F.lit(1), id_column), id_column).limit(max(k, CODES)).select(embedding).collect()
    seeds = unit(np.array([r[0] for r in first], np.float32)) if first else np.zeros((0, 1), np.float32)
    k = min(k, len(seeds))
    centres = lloyd(sample, seeds[None, :k], steps, unit, embedding)[0] if k else seeds
    spaces = max(1, -(-seeds.shape[1] // WIDTH))

    def residual(m: np.ndarray) -> np.ndarray:
        m = unit(m)
        return m - centres[nearest(m, centres)]

    books = lloyd(sample, _pieces(residual(seeds), spaces), steps, residual, embedding) if k else np.zeros((1, 0, 1), np.float32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                m = unit(matrix(batch.column(batch.schema.get_field_index(embedding))))
                cell = nearest(m, centres)
                codes = np.stack([nearest(p, books[s]) for s, p in enumerate(_pieces(m - centres[cell], spaces))], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], [*batch.schema.names, "cell", "code"])

    kinds = StructType([*kept.schema.fields, StructField("cell", IntegerType()), StructField("code", BinaryType())])
    placed = kept.mapInArrow(encode, kinds) if k else spark.createDataFrame([], kinds)
    placed = placed.repartition("cell", F.pmod(F.xxhash64(id_column), F.lit(SPREAD))).sortWithinPartitions("cell", id_column)
    placed.write.partitionBy("cell").parquet(f"{path}/rows")
    counts = {r["cell"]: r["count"] for r in spark.read.schema(kinds).parquet(f"{path}/rows").groupBy("cell").count().collect()}
    model = [("cell", 0, i, c.tolist(), counts.get(i, 0)) for i, c in enumerate(centres)] + [("book", s, i, c.tolist(), 0) for s, b in enumerate(books) for i, c in enumerate(b)]
    spark.createDataFrame(model, "kind string, space int, number int, centre array<float>, n long").coalesce(1).write.parquet(f"{path}/model")
    kept.limit(0).write.parquet(f"{path}/schema")
    store.remove(spark, f"{path}/sample")


def read(spark: SparkSession, path: str, id_column: str = "id", embedding: str = "embedding_he") -> VectorIndex:
    """The index that ``write`` has left in ``path``. Its model, of a size that parameters bound, comes to the driver."""
    model = spark.read.parquet(f"{path}/model").orderBy("kind", "space", "number").collect()
    cells = np.array([r["centre"] for r in model if r["kind"] == "cell"], np.float32)
    books = [r for r in model if r["kind"] == "book"]
    spaces = max((r["space"] for r in books), default=-1) + 1
    shaped = np.array([r["centre"] for r in books], np.float32).reshape(spaces, -1, len(books[0]["centre"])) if books else np.zeros((0, 0, 0), np.float32)
    kinds = StructType([*spark.read.parquet(f"{path}/schema").schema.fields, StructField("code", BinaryType()), StructField("cell", IntegerType())])
    rows = spark.read.schema(kinds).parquet(f"{path}/rows")
    return VectorIndex(rows, cells, shaped, tuple(r["n"] for r in model if r["kind"] == "cell"), id_column, embedding)


def find(index: VectorIndex, vector: list[float], n: int = 20, threshold: float = C.SEMANTIC_THRESHOLD, probes: int | None = None, ranked: int | None = None, exact: bool = False, station: str | None = None, media_type: str | None = None) -> DataFrame:
    """The rows nearest to ``vector`` with a similarity over the threshold, best first, as ``search.semantic`` gives
    them. ``probes``: cells that are read (``PROBED`` of them unless given); ``ranked``: rows that are ranked by their
    vectors (twenty for each result unless given)."""
    rows = index.rows.drop("code")
    where = {"station": station, "media_type": media_type}
    if exact or not len(index.cells):
        return search.semantic(rows.drop("cell"), vector, n, threshold, index.id_column, index.embedding, **where)
    near = index.nearest_cells(vector, probes or _default_probes(index))
    q, cells, id_column = unit(np.array([vector], np.float32))[0], index.cells, index.id_column
    # The score of a code is that of its cell and one entry of a table for each of its bytes.
    table = np.einsum("skw,sw->sk", index.books, _pieces(q[None], len(index.books))[:, 0])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_cell = cells @ q
        for batch in batches:
            if len(batch):
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(batch), -1)
                scores = of_cell[batch.column(1).to_numpy()] + table[np.arange(codes.shape[1]), codes].sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores.astype(np.float64))], [id_column, "cell", "_score"])

    probed = search.only(search.not_noise(index.rows.where(F.col("cell").isin(near))), **where)
    kind = dict(index.rows.dtypes)[index.id_column]
    scored = probed.select(index.id_column, "cell", "code").mapInArrow(score, f"{index.id_column} {kind}, cell int, _score double")
    # At most ``ranked`` rows, so they may be broadcast.
    best = scored.orderBy(F.col("_score").desc(), index.id_column).limit(ranked or 20 * n).select(index.id_column, "cell")
    chosen = rows.where(F.col("cell").isin(near)).join(F.broadcast(best), [index.id_column, "cell"], "left_semi").drop("cell")
    found = chosen.withColumn("similarity", V.cosine_to(F.col(index.embedding), vector)).where(F.col("similarity") > threshold)
    return search.top(found, "similarity", n, index.id_column)


def find_all(index: VectorIndex, queries: DataFrame, n: int = 20, probes: int | None = None, query_column: str = "query_id", vector_column: str = "vector") -> DataFrame:
    """(query, id, similarity, place): the n nearest rows of each query's cells (all cells: exact), best first.

    Queries and rows meet by cell in blocks, each of bounded size, however many a cell holds; a pair of blocks gives
    the n best rows of each query in it, and these are merged by query."""
    probes, cells, dims = min(probes or _default_probes(index), len(index.cells)), index.cells, max(index.cells.shape[-1], 1)
    block = max(64, BLOCK_FLOATS // dims)
    id_kind, q_kind = dict(index.rows.dtypes)[index.id_column], dict(queries.dtypes)[query_column]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                m = unit(matrix(batch.column(1)))
                near = np.argsort(-(m @ cells.T - (cells * cells).sum(1) / 2), axis=1, kind="stable")[:, :probes]
                at = pa.array(np.repeat(np.arange(len(batch)), probes))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(near.ravel(), pa.int32())], ["q", "v", "cell"])

    asked = queries.where(F.col(vector_column).isNotNull()).select(query_column, F.col(vector_column).cast("array<float>")).mapInArrow(probe, f"q {q_kind}, v array<float>, cell int")
    # Blocks of a cell: by its size, which the model knows; the queries' ones by their number.
    blocks = F.element_at(F.lit([max(1, -(-c // block)) for c in index.counts] or [1]), F.col("cell") + 1)
    asked_blocks = max(1, -(-queries.count() // block))
    mine = asked.groupBy("cell", F.pmod(F.xxhash64("q"), F.lit(asked_blocks)).alias("qb")).agg(F.collect_list(F.struct("q", "v")).alias("asked"))
    own = F.struct(F.col(index.id_column).alias("id"), F.col(index.embedding).cast("array<float>").alias("v"))
    held = index.rows.groupBy("cell", F.pmod(F.xxhash64(index.id_column), blocks).alias("rb")).agg(F.array_sort(F.collect_list(own)).alias("held"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                a, h = batch.column(0)[i].values, batch.column(1)[i].values
                left, right = (unit(matrix(x.field("v")).astype(np.float64)) for x in (a, h))
                for low in range(0, len(left), 256):
                    at, of, sims = _best(left[low : low + 256] @ right.T, n)
                    yield pa.RecordBatch.from_arrays([a.field("q").take(pa.array(at + low)), h.field("id").take(pa.array(of)), pa.array(sims)], ["q", "id", "similarity"])

    met = mine.join(held, "cell").select("asked", "held").mapInArrow(best, f"q {q_kind}, id {id_kind}, similarity double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("similarity").desc(), "id"))
    return met.withColumn("place", place).where(F.col("place") <= n).withColumnRenamed("q", query_column)


def _best(sims: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the n largest values of each row; of equal ones the first columns."""
    least = -np.partition(-sims, n - 1, axis=1)[:, n - 1 : n] if sims.shape[1] > n else -np.inf
    at, of = np.nonzero(sims >= least)
    order = np.lexsort((of, -sims[at, of], at))
    at, of = at[order], of[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    return at[place < n], of[place < n], sims[at, of][place < n]
