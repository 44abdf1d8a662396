"""Passages of a benchmark in documents, by pigeonhole pieces and bit-parallel distance.

Texts and items are compared in lower case with runs of white space as one blank. An
item of m characters may differ in k = max(0, m // PIECE - 1) edits. It is cut into k + 1
pieces; a passage within the budget holds at least one piece unchanged, and an
Aho-Corasick automaton finds all of these. A hit is verified from small to large: the
piece with its sibling within one edit, four pieces within three, and at last the whole
item, each with Myers' bit-parallel distance. (If a node of n pieces differs in at most
n - 1 edits, one of its halves does in at most its own number less one, so no passage is
lost on the way.)

The items are a query set against all documents. They are taken in blocks of about
``BLOCK_BYTES`` of text, so that what is broadcast is bounded however many items there are.

Null or empty items match nothing; a null or empty text has no match. Repeated items and
repeated documents give a row each; keys may be null. Empty tables give empty results.
Extra columns are ignored by ``find_passages`` and kept by ``without_passages``. Texts of
any length are searched whole; places are code points of the text as given.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.texts import id_and_text, slices

PIECE = 10
BLOCK_BYTES = 1 << 20


def lowered(text: str) -> str:
    """Lower case, one character for each."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low


def normal(text: str) -> str:
    return " ".join(lowered(text).split())


class Pattern:
    """A string to be found within some edits."""

    def __init__(self, text: str):
        self.size = len(text)
        self.places: dict[str, int] = {}
        for k, c in enumerate(text):
            self.places[c] = self.places.get(c, 0) | 1 << k

    def search(self, text: str) -> tuple[int, int]:
        """The least distance to any stretch of ``text`` and the first place where such a
        stretch ends (Myers' algorithm)."""
        full, high = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, score = full, 0, self.size
        best, end = score, 0
        places = self.places
        for k, c in enumerate(text):
            equal = places.get(c, 0)
            vertical = equal | minus
            across = (((equal & plus) + plus) ^ plus) | equal
            up = minus | ~(across | plus)
            down = plus & across
            if up & high:
                score += 1
            elif down & high:
                score -= 1
                if score < best:
                    best, end = score, k + 1
            up, down = up << 1, down << 1
            plus = (down | ~(vertical | up)) & full
            minus = up & vertical & full
        return best, end


class Item:
    """A benchmark item, its pieces, and the nodes of the tree over its pieces."""

    def __init__(self, key: int | None, text: str):
        self.key, self.text = key, text
        self.budget = max(0, len(text) // PIECE - 1)
        n = self.budget + 1
        self.bounds = [len(text) * k // n for k in range(n + 1)]
        self.nodes: dict[tuple[int, int], Pattern] = {}

    def pieces(self) -> list[str]:
        return [self.text[a:b] for a, b in zip(self.bounds, self.bounds[1:])]

    def _near(self, text: str, at: int, low: int, high: int) -> tuple[int, int] | None:
        """Distance and end if pieces low..high lie about ``at`` (where the item would
        begin) within their budget."""
        node = self.nodes.get((low, high))
        if node is None:
            node = self.nodes[low, high] = Pattern(self.text[self.bounds[low]:self.bounds[high]])
        slack = self.budget if high - low > self.budget else 2 * (high - low)
        start = max(0, at + self.bounds[low] - slack)
        best, end = node.search(text[start:at + self.bounds[high] + slack])
        return (best, start + end) if best <= high - low - 1 else None

    def verify(self, text: str, piece: int, at: int) -> tuple[int, int, int] | None:
        """Distance, start and end of the item in ``text`` if a hit of a piece belongs to it."""
        pieces, width = len(self.bounds) - 1, 2
        while width < pieces and width <= 4:
            low = piece // width * width
            if not self._near(text, at, low, min(low + width, pieces)):
                return None
            width *= 2
        found = self._near(text, at, 0, pieces)
        if not found:
            return None
        best, end = found
        start = max(0, end - len(self.text) - best)
        back, length = Pattern(self.text[::-1]).search(text[start:end][::-1])
        return best, end - length, end


class Searcher:
    def __init__(self, rows: list[tuple[int | None, str]]):
        self.items = [Item(key, normal(text)) for key, text in rows if text and text.strip()]
        self.items = [i for i in self.items if i.text]
        owners: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            for k, piece in enumerate(item.pieces()):
                owners.setdefault(piece, []).append((n, k))
        self.automaton = ahocorasick.Automaton()
        for piece, places in owners.items():
            self.automaton.add_word(piece, places)
        if owners:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """For each item in the normalised text its best stretch: item, start, end, distance."""
        best: dict[int, tuple[int, int, int]] = {}
        if not self.items or not text:
            return []
        tried: set[tuple[int, int, int]] = set()
        for end, places in self.automaton.iter(text):
            for n, piece in places:
                item = self.items[n]
                at = end + 1 - item.bounds[piece + 1]
                held = best.get(n)
                if held and (held[0] == 0 or abs(held[1] - at) <= item.budget) or (
                        n, piece, at) in tried:
                    continue
                tried.add((n, piece, at))
                found = item.verify(text, piece, at)
                if found and (held is None or found < held):
                    best[n] = found
        return [(n, start, end, distance) for n, (distance, start, end) in sorted(best.items())]


def _blocks(benchmark: DataFrame, item_column: str, text_column: str):
    """The items as bounded lists, one after another."""
    items = benchmark.select(F.col(item_column).cast("long").alias("item_id"),
                             F.col(text_column).cast("string").alias("text")).where(
        F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        yield sorted(((r.item_id, r.text) for r in rows), key=lambda x: (x[0] is None, *x))


def find_passages(docs: DataFrame, benchmark: DataFrame, item_column: str = "item_id",
                  item_text: str = "text", **columns: str) -> DataFrame:
    """One row per document and item found in it, with the nearest stretch (the first of
    equally near ones): ``doc_id``, ``item_id``, ``start``, ``end``, ``distance``."""
    schema = "doc_id long, item_id long, start int, end int, distance int"
    found = None
    for rows in _blocks(benchmark, item_column, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(shared.value)
            for batch in slices(batches):
                out = []
                for key, text in zip(batch.column("doc_id").to_pylist(),
                                     batch.column("text").to_pylist()):
                    low = lowered(text)
                    matches = searcher.matches(" ".join(low.split()))
                    if matches:
                        origin = np.array([k for word in re.finditer(r"\S+", low) for k in
                                           [*range(*word.span()), word.end()]])
                        out += [(key, searcher.items[n].key, int(origin[s]), int(origin[e - 1]) + 1, d)
                                for n, s, e, d in matches]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("doc_id", "item_id", "start", "end", "distance"), r)) for r in out],
                    schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()),
                                      ("start", pa.int32()), ("end", pa.int32()),
                                      ("distance", pa.int32())]))

        part = id_and_text(docs, **columns).mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return found


def without_passages(docs: DataFrame, benchmark: DataFrame, item_column: str = "item_id",
                     item_text: str = "text", text_column: str = "text") -> DataFrame:
    """The rows whose text holds no item; all columns stay."""
    for rows in _blocks(benchmark, item_column, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(shared.value)
            for batch in slices(batches, text_column):
                keep = [not (t and searcher.matches(normal(t)))
                        for t in batch.column(text_column).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
