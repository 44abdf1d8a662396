"""Whitening of embeddings by products of distributed block matrices.

Rows become whole numbers, are centred on the exact mean and cut into blocks of rows, each
a block of an MLlib ``BlockMatrix``. One product of transposed and plain blocks gives the
scatter matrix, whose eigenvectors are found on the driver (it has as many rows as a vector
has entries), and a second product with the whitening matrix projects every row.

How the blocks lie matters. In the plain product of a tall matrix's transpose with itself
every block goes to the single block of the result, hence to one task. So the blocks are
numbered densely and laid out on a square grid: row block b belongs to grid cell (b div g,
b mod g). For the scatter, the left matrix holds the transposed block at (b div g, b) and
the right one the plain block at (b, b mod g), so cell by cell each product meets once and
in a task of its own; the sum over cells is a tree reduction of small squares. For the
projection the blocks lie in their cells and the right matrix repeats the whitening matrix
on its diagonal. MLlib spreads a square grid evenly over its tasks, which it does
not do with a tall one, and a task holds some ``BLOCKS_PER_TASK`` blocks.

The blocks are written once as a table in the shared checkpoint folder, as small integers,
so that no later step depends on the order in which files are read. The driver keeps one
number for each task of that scan and the coordinates of at most about ``MOST_BLOCKS``
blocks; blocks grow with the table beyond that.

Nulls: a null vector, or one with an entry that is null, not finite or past exact whole
numbers as a double (2**53 after scaling), is left out; a null ``vec_id`` stays. Vectors
without entries are left out, and of vectors of several lengths those of the most frequent
length stay (the longer one of a tie). Repeated rows and keys are rows like others. Very
long vectors make blocks of fewer rows. A component without spread gives 0.0 and counts as
1 in the identity error. An empty table gives no rows. ``deviation`` is null where it does
not fit a long. Further columns are left out, so their names cannot clash. Equal
eigenvalues leave their components free, as they do in any such method.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.functions.lineage import cut_lineage

#: Scale and shift of entries, and components at most.
SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8

#: Numbers in a block (1 MB of doubles), blocks of a task, blocks before they grow.
BLOCK_ENTRIES = 1 << 17
BLOCKS_PER_TASK = 16
MOST_BLOCKS = 200_000

LONGEST = 2 ** 63 - 1


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """Key and whole-number vector of the rows that have one."""
    # Spark may work out an entry before it drops the vector: no error then.
    shifted = F.transform(F.col("embedding").cast("array<double>"),
                          lambda c: F.try_add(F.floor(c * SCALE).cast("long"), F.lit(SHIFT)))
    whole = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c)
                     & (F.abs(c.cast("double")) < float(2 ** 53) / SCALE))
    return embeddings.filter(whole & (F.size("embedding") > 0)).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        shifted.alias("x"))


@dataclass(frozen=True)
class FitList:
    """Number of vectors and exact sums of their entries."""

    n: int
    sums: list[int]

    @property
    def length(self) -> int:
        return len(self.sums)


def fit_list(vectors: DataFrame) -> FitList:
    """Size and sums of the vectors of the most frequent length, in one pass."""
    sums = vectors.select(F.size("x").alias("length"), F.posexplode("x").alias("at", "entry")).groupBy(
        "length", "at").agg(F.sum("entry").alias("total"), F.count("*").alias("n"))
    row = sums.groupBy("length").agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "total"))).alias("sums"),
    ).orderBy(F.desc("n"), F.desc("length")).first()
    return FitList(0, []) if row is None else FitList(row["n"], [s["total"] for s in row["sums"]])


def _narrow(values: np.ndarray) -> tuple[int, int, bytes]:
    """Whole numbers as differences from the least, in 2, 4 or 8 bytes each."""
    least = int(values.min())
    size = next(s for s in (2, 4, 8) if int(values.max()) - least < 1 << (8 * s - 1))
    return least, size, (values - least).astype(f"<i{size}").tobytes()


def _wide(least: int, data: bytes, rows: int) -> np.ndarray:
    size = int(data[0])
    return np.frombuffer(data, f"<i{size}", offset=1).astype(np.int64).reshape(rows, -1) + least


def _deviations(x: np.ndarray, fit: FitList) -> list[int | None]:
    """Sum of (n x - S)**2 per row, exact; None past a long."""
    rough = fit.n * x.astype(float) - np.array(fit.sums, float)
    if max(np.abs(rough).max(), fit.n * float(np.abs(x).max())) < 2 ** 62 \
            and (rough * rough).sum(axis=1).max() < 2 ** 62:
        apart = fit.n * x - np.array(fit.sums, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    exact = [sum((fit.n * int(v) - s) ** 2 for v, s in zip(row, fit.sums)) for row in x]
    return [v if v <= LONGEST else None for v in exact]


BLOCK_SCHEMA = ("task long, place long, rows int, vec_ids array<long>, deviations array<long>, "
                "least long, data binary")


def _cut(fit: FitList, height: int) -> Callable:
    """Consecutive rows of a task as blocks, with what the result needs of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, place = TaskContext.get().partitionId(), 0
        keys, held = [], []

        def block(count: int) -> pa.RecordBatch:
            nonlocal keys, held, place
            ids, rows = np.concatenate(keys), np.concatenate(held)
            x = rows[:count]
            least, size, data = _narrow(x)
            out = pa.RecordBatch.from_arrays([
                pa.array([task]), pa.array([place]), pa.array([len(x)], pa.int32()),
                pa.array([ids[:count].tolist()], pa.list_(pa.int64())),
                pa.array([_deviations(x, fit)], pa.list_(pa.int64())),
                pa.array([least]), pa.array([bytes([size]) + data], pa.binary()),
            ], ["task", "place", "rows", "vec_ids", "deviations", "least", "data"])
            keys, held, place = [ids[count:]], [rows[count:]], place + 1
            return out

        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys.append(np.array(batch.column("vec_id").to_pylist(), object))
            held.append(batch.column("x").flatten().to_numpy().reshape(-1, fit.length))
            count += batch.num_rows
            while count >= height:
                yield block(height)
                count -= height
        if count:
            yield block(count)
    return run


@dataclass(frozen=True)
class Blocks:
    """Numbered blocks of rows, and the grid they are laid out on."""

    table: DataFrame
    count: int
    height: int
    fit: FitList

    @property
    def side(self) -> int:
        return math.isqrt(self.count - 1) + 1


def numbered_blocks(vectors: DataFrame, fit: FitList) -> Blocks:
    """The vectors of the fit list in blocks of rows, numbered from 0 without gaps."""
    spark = vectors.sparkSession
    height = max(1, BLOCK_ENTRIES // fit.length, -(-fit.n // MOST_BLOCKS))
    cut = cut_lineage(vectors.filter(F.size("x") == fit.length).mapInArrow(
        _cut(fit, height), BLOCK_SCHEMA))
    # One row for each task of the scan.
    sizes = sorted(cut.groupBy("task").agg(F.count("*")).collect())
    before, offsets = 0, []
    for task, count in sizes:
        offsets.append((task, before))
        before += count
    numbered = cut.join(F.broadcast(spark.createDataFrame(offsets, "task long, before long")), "task")
    return Blocks(numbered.withColumn("block", F.col("before") + F.col("place")).drop(
        "task", "place", "before"), before, height, fit)


def _centred(row, n: int, sums: list[int]) -> np.ndarray:
    x = _wide(row["least"], row["data"], row["rows"])
    if n * float(np.abs(x).max()) < 2 ** 62:
        return (n * x - np.array(sums, np.int64)) / n
    return x - np.array([s / n for s in sums])


def _dense(a: np.ndarray, flipped: bool = False) -> DenseMatrix:
    """A block, or its transpose, with the entries of one dimension side by side."""
    rows, columns = a.shape
    values = a.ravel(order="F")
    return DenseMatrix(columns, rows, values, True) if flipped else DenseMatrix(rows, columns, values)


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + b


def centred_rows(blocks: Blocks):
    """RDD of block number and centred rows; its one shuffle serves every later product."""
    n, sums = blocks.fit.n, blocks.fit.sums
    tasks = -(-blocks.count // BLOCKS_PER_TASK)
    rows = blocks.table.select("block", "rows", "least", "data").repartition(tasks, "block").rdd
    return rows.map(lambda row: (row["block"], _centred(row, n, sums)))


def scatter(blocks: Blocks, rows) -> np.ndarray:
    """Sum over all rows of the outer product of the centred row with itself."""
    g, d = blocks.side, blocks.fit.length
    inner = blocks.count * blocks.height
    left = BlockMatrix(rows.map(lambda b: ((b[0] // g, b[0]), _dense(b[1], True))),
                       d, blocks.height, g * d, inner)
    right = BlockMatrix(rows.map(lambda b: ((b[0], b[0] % g), _dense(b[1]))),
                        blocks.height, d, inner, g * d)
    cells = left.multiply(right).blocks.map(lambda cell: cell[1].toArray())
    return cells.treeReduce(_added)


@dataclass(frozen=True)
class Whitening:
    """Eigenvalues by fall, unit eigenvectors as columns, and their scaled form."""

    eigenvalues: np.ndarray
    vectors: np.ndarray
    matrix: np.ndarray
    explained: np.ndarray


def whitening_of(covariance: np.ndarray, components: int = COMPONENTS) -> Whitening:
    """Leading components; each vector's entry of largest size is positive."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[largest, range(len(largest))] < 0, -1.0, 1.0)
    total = float(np.trace(covariance))
    spread = values > max(total, 0.0) * len(covariance) * np.finfo(float).eps
    scale = np.where(spread, 1 / np.sqrt(np.where(spread, values, 1.0)), 0.0)
    share = np.where(spread, values, 0.0) / total if total > 0 else np.zeros(len(values))
    return Whitening(values, vectors, vectors * scale, share)


def project(blocks: Blocks, rows, whitening: Whitening) -> DataFrame:
    """Blocks of projected rows: ``block`` and its numbers row by row, as a table."""
    g, d, c = blocks.side, blocks.fit.length, whitening.matrix.shape[1]
    matrix = whitening.matrix
    spark = blocks.table.sparkSession
    left = BlockMatrix(rows.map(lambda b: ((b[0] // g, b[0] % g), _dense(b[1]))),
                       blocks.height, d, g * blocks.height, g * d)
    right = BlockMatrix(spark.sparkContext.range(g).map(lambda j: ((j, j), _dense(matrix))),
                        d, c, g * d, g * c)
    numbers = left.multiply(right).blocks.map(
        lambda cell: (cell[0][0] * g + cell[0][1], cell[1].toArray().tobytes()))
    return cut_lineage(spark.createDataFrame(numbers, "block long, projected binary"))


def _moments(c: int, mean: np.ndarray | None) -> Callable:
    """Sums of the projected rows, or of the products of their centred entries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column(0).to_pylist():
                w = np.frombuffer(data).reshape(-1, c)
                part = w.sum(axis=0) if mean is None else ((w - mean).T @ (w - mean)).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(total)], ["at", "total"])
    return run


def identity_error(projected: DataFrame, n: int, c: int) -> float:
    """Largest absolute entry of the projected rows' covariance minus the identity."""
    def sums(mean: np.ndarray | None) -> np.ndarray:
        rows = projected.select("projected").mapInArrow(
            _moments(c, mean), "at int, total double").groupBy("at").agg(F.sum("total")).collect()
        return np.array([total for _, total in sorted(rows)])

    covariance = sums(sums(None) / n).reshape(c, c) / n
    return float(np.abs(covariance - np.eye(c)).max())


RESULT = ("vec_id long, component int, n long, deviation long, whitened double, "
          "explained double, identity_error double")


def _unfold(n: int, explained: list[float], error: float) -> Callable:
    c = len(explained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, deviations, data in zip(*(column.to_pylist() for column in batch.columns)):
                rows = len(ids)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.array(ids, object), c), pa.int64(), from_pandas=True),
                    pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * c, n)),
                    pa.array(np.repeat(np.array(deviations, object), c), pa.int64(), from_pandas=True),
                    pa.array(np.frombuffer(data)), pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * c, error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained",
                    "identity_error"])
    return run


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Every usable row projected on the leading components, one row for each of them."""
    spark: SparkSession = embeddings.sparkSession
    vectors = whole_vectors(embeddings)
    fit = fit_list(vectors)
    if not fit.n:
        return spark.createDataFrame([], RESULT)
    blocks = numbered_blocks(vectors, fit)
    rows = centred_rows(blocks)
    whitening = whitening_of(scatter(blocks, rows) / fit.n, components)
    projected = project(blocks, rows, whitening)
    explained = whitening.explained.tolist()
    error = identity_error(projected, fit.n, len(explained))
    return (
        blocks.table.select("block", "vec_ids", "deviations").join(projected, "block")
        .select("vec_ids", "deviations", "projected")
        .mapInArrow(_unfold(fit.n, explained, error), RESULT))
