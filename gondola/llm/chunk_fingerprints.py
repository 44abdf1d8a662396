"""Fingerprints of texts from content-defined chunks.

A gear hash runs over the UTF-8 bytes, and a chunk ends where bits of it are zero: many
bits (a hard test) before the normal size, few after it, so that sizes gather about the
normal one (normalised chunking). A boundary depends on the 16 bytes before it only;
after an edit the boundaries fall into step again. The fingerprint is the set of chunk
digests, each with the chunk's length, and likeness is the length of the chunks shared.

A null or empty text has the empty fingerprint; it is like another empty text (1) and
unlike any other (0). Equal texts have equal fingerprints. Rows with one key are taken in
order of their texts; null keys come first. Repeated rows give one row each. An empty
table gives an empty result, and a table of one row has itself as the next. Extra columns
are ignored. Whole texts are cut, of any length.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.llm.texts import SpanHash, bytes_of, id_and_text, slices

LEAST, NORMAL, MOST = 16, 48, 240
HARD_BITS, EASY_BITS = 7, 4
DIGEST_DIGITS, SIZE_DIGITS = 12, 2
ROWS_PER_BUCKET = 2_000
MOST_BUCKETS = 10_000
#: A random 32-bit number for each byte, from its SHA-256.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "big")
                 for b in range(256)], np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """For each place the gear hash of the 16 bytes that end there.

    The hash of 2n bytes is that of the last n plus that of the n before, shifted.
    """
    value = GEAR[data]
    for step in (1, 2, 4, 8):
        older = np.zeros_like(value)
        older[step:] = value[:-step] << np.uint32(step)
        value = value + older
    return value


def _cuts(size: int, hard: list[int], easy: list[int]) -> list[int]:
    """Chunk ends of a text of ``size`` bytes; hard and easy: places where a test passes."""
    ends, start, h, e = [], 0, 0, 0
    while size - start > LEAST:
        h = bisect_left(hard, start + LEAST, h)
        if h < len(hard) and hard[h] < start + NORMAL:
            end = hard[h]
        else:
            e = bisect_left(easy, start + NORMAL, e)
            end = easy[e] if e < len(easy) and easy[e] < start + MOST else start + MOST
            if end >= size:
                break
        ends.append(end)
        start = end
    if size > start:
        ends.append(size)
    return ends


class Chunker:
    def __init__(self):
        self.hash = SpanHash()

    def fingerprints(self, texts: pa.Array) -> list[dict[int, int]]:
        """For each text the digests of its chunks with their lengths."""
        data, at = bytes_of(texts)
        gear = gear_hashes(data) >> np.uint32(4)  # low bits see too few bytes
        hard = np.flatnonzero(gear & np.uint32(((1 << HARD_BITS) - 1) << 5) == 0) + 1
        easy = np.flatnonzero(gear & np.uint32(((1 << EASY_BITS) - 1) << 5) == 0) + 1
        hard_at, easy_at = np.searchsorted(hard, at), np.searchsorted(easy, at)
        starts, ends, counts = [], [], []
        for k in range(len(texts)):
            low, high = int(at[k]), int(at[k + 1])
            cuts = _cuts(high - low, (hard[hard_at[k]:hard_at[k + 1]] - low).tolist(),
                         (easy[easy_at[k]:easy_at[k + 1]] - low).tolist())
            ends += [c + low for c in cuts]
            starts += [c + low for c in [0, *cuts[:-1]]] if cuts else []
            counts.append(len(cuts))
        first, last = np.array(starts, np.int64), np.array(ends, np.int64)
        digests = (self.hash(data, first, last) >> np.uint64(64 - 4 * DIGEST_DIGITS)).tolist()
        sizes = (last - first).tolist()
        out, upto = [], 0
        for count in counts:
            out.append(dict(zip(digests[upto:upto + count], sizes[upto:upto + count])))
            upto += count
        return out


def written(chunks: dict[int, int]) -> str:
    """Sorted digests, each followed by its chunk's length, in hex digits."""
    return "".join([f"{d:0{DIGEST_DIGITS}x}{n:0{SIZE_DIGITS}x}" for d, n in sorted(chunks.items())])


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Length of the chunks shared, as a share of the smaller text: containment."""
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    if len(b) < len(a):
        a, b = b, a
    shared = sum(n for d, n in a.items() if d in b)
    return shared / min(sum(a.values()), sum(b.values()))


def fingerprint_texts(docs: DataFrame, **columns: str) -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``chunks`` (digest in hex and length of each)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker = Chunker()
        for batch in slices(batches):
            found = chunker.fingerprints(batch.column("text"))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([written(x) for x in found], pa.string()),
                pa.array([[{"digest": f"{d:0{DIGEST_DIGITS}x}", "length": n}
                           for d, n in sorted(x.items())] for x in found],
                         pa.list_(pa.struct([("digest", pa.string()), ("length", pa.int32())])))],
                names=["doc_id", "fingerprint", "chunks"])

    return id_and_text(docs, **columns).mapInArrow(run, (
        "doc_id long, fingerprint string, chunks array<struct<digest:string,length:int>>"))


def with_next(docs: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Rows in order of ``doc_id`` in buckets; each bucket also holds, marked ``beyond``,
    the first rows of the next one, and the last bucket those of the first.

    The bounds of the buckets are quantiles of the keys, one number for each bucket, so at
    most ``MOST_BUCKETS``; a bucket is sorted by Spark and read as a stream, and may be of
    any size. The texts are shuffled once.
    """
    n = docs.count()
    buckets = min(MOST_BUCKETS, max(1, -(-n // rows_per_bucket)))
    bounds = docs.approxQuantile("doc_id", [k / buckets for k in range(1, buckets)],
                                 0.2 / buckets) if n and buckets > 1 else []
    keyed = docs.withColumn("place", F.coalesce(F.col("doc_id").cast("double"), F.lit(-math.inf)))
    rows = Bucketizer(splits=[-math.inf, *sorted({*bounds} - {-math.inf} or {0.0}), math.inf],
                      inputCol="place", outputCol="cut").transform(keyed).select(
        "doc_id", "text", F.col("cut").cast("int").alias("bucket"))
    firsts = sorted(rows.groupBy("bucket").agg(
        F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("no_key")).collect())
    # One row a bucket: its first key, and the bucket that takes a copy of that key's rows.
    leads = docs.sparkSession.createDataFrame(
        [(f.bucket, None if f.no_key else f.least, firsts[k - 1].bucket)
         for k, f in enumerate(firsts)], "bucket int, least long, before int")
    with_leads = rows.join(F.broadcast(leads), "bucket")

    def to(bucket: str, beyond: bool) -> Column:
        return F.struct(F.col(bucket).alias("bucket"), F.lit(beyond).alias("beyond"))

    copies = F.when(F.col("doc_id").eqNullSafe(F.col("least")), F.array(
        to("bucket", False), to("before", True))).otherwise(F.array(to("bucket", False)))
    return with_leads.select("doc_id", "text", F.explode(copies).alias("to")).select(
        "doc_id", "text", "to.bucket", "to.beyond").repartition("bucket").sortWithinPartitions(
        "bucket", "beyond", F.col("doc_id").asc_nulls_first(), "text")


def edited_fingerprints(docs: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET,
                        **columns: str) -> DataFrame:
    """Each text beside an edited copy and beside the next text in order of keys.

    In the copy the last quarter of the code points is replaced by as many (or all) of the
    next text's first. Gives ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next``.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
             "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker = Chunker()

        def rows(keys: list, texts: list[str]) -> pa.RecordBatch:
            """A row for each text but the last, which is the next one of the last row."""
            edited = []
            for text, after in zip(texts, texts[1:]):
                cut = len(text) // 4
                edited.append((text[:len(text) - cut] + after[:cut]) if cut else text)
            plain = chunker.fingerprints(pa.array(texts, pa.string()))
            other = chunker.fingerprints(pa.array(edited, pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip([
                keys, [len(t) for t in texts[:-1]],
                [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                [written(x) for x in plain[:-1]], [written(x) for x in other],
                [likeness(a, b) for a, b in zip(plain, other)],
                [likeness(a, b) for a, b in zip(plain, plain[1:])]], kinds)], names=names)

        held: tuple[int, int | None, str] | None = None  # the row that waits for its next
        for batch in slices(batches):
            keys, texts = [], []
            for bucket, beyond, key, text in zip(*[batch.column(c).to_pylist() for c in (
                    "bucket", "beyond", "doc_id", "text")]):
                if held is not None and held[0] == bucket:
                    keys.append(held[1])
                    texts.append(held[2])
                    if beyond:  # ends the bucket; more rows of that key do not matter
                        yield rows(keys, [*texts, text])
                        keys, texts, held = [], [], None
                        continue
                held = None if beyond else (bucket, key, text)
            if keys:
                yield rows(keys, [*texts, held[2]])

    return with_next(id_and_text(docs, **columns), rows_per_bucket).mapInArrow(run, (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"))
