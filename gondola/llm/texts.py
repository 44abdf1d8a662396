"""What several text operators share: taking the two columns, slicing Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text a task holds as Python objects at one time, single texts aside.
SLICE_BYTES = 1 << 20


def id_and_text(docs: DataFrame, *more: str, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """Key and text as ``doc_id`` and ``text``; a missing text counts as empty.

    Whatever else the table carries is left out, so its names cannot clash with ours.
    """
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
        *more)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts take about ``most`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


class Shared:
    """A broadcast value whose classes travel with it.

    Plain broadcasts name classes by their module, which workers would have to import. This
    one sends the classes of this package themselves; a task unpacks it once.
    """

    def __init__(self, spark: SparkSession, value):
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._held = [value]

    def __getstate__(self):
        return {"_sent": self._sent, "_held": []}

    @property
    def value(self):
        if not self._held:
            self._held.append(cloudpickle.loads(self._sent.value))
        return self._held[0]


def is_held_out(id_column: str, modulus: int, remainder: int):
    """Whether crc32 of the key as text leaves this remainder; a null key counts as ''."""
    key = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % modulus == remainder


def replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with one column exchanged, keeping that column's type."""
    at = batch.schema.get_field_index(name)
    return batch.set_column(at, batch.schema.field(at), values.cast(batch.schema.field(at).type))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all texts of a column without nulls, end to end, and where each begins;
    the last of these numbers is the end of all."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def packed(kind: pa.DataType, data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A string or binary column of these bytes; ``ends`` starts with 0."""
    return pa.Array.from_buffers(kind, len(ends) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(ends, np.int32)),
        pa.py_buffer(np.ascontiguousarray(data))])


def gathered(pieces: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Pieces ``pieces[start:start + size]`` end to end."""
    total = int(sizes.sum())
    shift = starts - (np.cumsum(sizes) - sizes)
    return pieces[np.arange(total) + np.repeat(shift, sizes)]


class SpanHash:
    """64-bit hashes of many byte spans at once, from running sums.

    The sum of byte * r**place over a span, divided by r**start (r is odd, so it has an
    inverse modulo 2**64), depends on the span's bytes only.
    """

    ROOTS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

    def __init__(self):
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _powers(self, which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of a root and of its inverse, at least so many."""
        held = self.tables.get(which)
        if held is None or len(held[0]) <= size:
            root = self.ROOTS[which]
            held = []
            for factor in (root, pow(root, -1, 1 << 64)):
                row = np.full(size + size // 8 + 1, factor, np.uint64)
                row[0] = 1
                held.append(np.multiply.accumulate(row, out=row))
            self.tables[which] = tuple(held)
        return self.tables[which]

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                 which: int = 0) -> np.ndarray:
        power, inverse = self._powers(which, len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.add(data, np.uint64(1), out=sums[1:], dtype=np.uint64, casting="unsafe")
        sums[1:] *= power[:len(data)]
        np.cumsum(sums[1:], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * inverse[starts])


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    values = values.astype(np.uint64)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def alike(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of equal entries: one place for each class, and the class of each entry.

    ``second`` is another hash of the same things; a clash of the first raises.
    """
    _, place, group = np.unique(first, return_index=True, return_inverse=True)
    if (second[place][group] != second).any():
        raise ArithmeticError("two different spans share a hash")
    return place, group
