"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols are the leaves of a segment tree that holds the rank of each symbol
with its right neighbour. The root names the leftmost pair of lowest rank; merging it
changes three leaves, and each change climbs the tree in logarithmic time. The trees of
many words of like length are rows of one numpy array and take their steps together;
long words have a tree of their own.

A vocabulary (a public tokenizer's file, never trained here) has a fixed size, so its
tables are broadcast.

Null texts count as empty: no token, and the empty text when decoded. Repeated rows and
repeated or null keys give one row each. An empty table gives an empty result. Extra
columns are ignored. A text of any length is encoded whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm.texts import (
    Shared,
    SpanHash,
    alike,
    bytes_of,
    gathered,
    id_and_text,
    packed,
    slices,
)

#: Fixed value: how byte-level BPE cuts a text before merging.
WORDS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
         r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: The same cut, but with all that is not white space taken as one kind.
RUNS = r" ?\P{White_Space}+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: White space of one byte, and all other white space with those controls
#: that only some definitions count.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LETTERS = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
MARKS = np.array([32 < b < 127 and not chr(b).isalnum() for b in range(256)])
ODD_SPACE = "\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

WIDTHS = (4, 8, 16, 32, 64)
WORDS_AT_ONCE = 8_192
KEPT_WORDS = 600_000
NO_PAIR = np.int64(1) << 40
SLOT_BITS = 18


def _byte_letters() -> dict[str, int]:
    """The printable letter that vocabularies of this kind write for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {chr(b): b for b in shown}
    letters.update({chr(256 + k): b for k, b in
                    enumerate(b for b in range(256) if b not in set(shown))})
    return letters


class BytePairs:
    """The tables of one vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        letters = _byte_letters()
        vocabulary = told["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, number in vocabulary.items():
            self.token_bytes[number] = bytes(letters[x] for x in token)
        for token, number in self.special.items():
            self.token_bytes[number] = token.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.byte_ids[byte] = vocabulary[letter]
        merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        self.token_sizes = np.fromiter(map(len, self.token_bytes), np.int64, size)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.token_pool = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        self.ranks = {(vocabulary[a], vocabulary[b]): r for r, (a, b) in enumerate(merges)}
        self._slots()

    def _slots(self) -> None:
        """An open-addressed table of pair ranks that numpy can probe for many pairs."""
        self.slot_key = np.full(1 << SLOT_BITS, -1, np.int64)
        self.slot_rank = np.full(1 << SLOT_BITS, NO_PAIR >> 8, np.int64)
        for (a, b), rank in self.ranks.items():
            at = self._slot(np.int64(a << 20 | b))
            while self.slot_key[at] >= 0:
                at = (at + 1) & ((1 << SLOT_BITS) - 1)
            self.slot_key[at], self.slot_rank[at] = a << 20 | b, rank

    @staticmethod
    def _slot(key):
        return (key ^ (key >> 11) ^ (key >> 20) * 40503) & ((1 << SLOT_BITS) - 1)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or a number above all ranks."""
        key = left << 20 | right
        at = self._slot(key)
        found = self.slot_key[at]
        rank = np.where(found == key, self.slot_rank[at], NO_PAIR >> 8)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while open_.size:
            at[open_] = (at[open_] + 1) & ((1 << SLOT_BITS) - 1)
            found = self.slot_key[at[open_]]
            hit = found == key[open_]
            rank[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return rank

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for width in WIDTHS:
            some = np.flatnonzero((sizes > low) & (sizes <= width))
            for start in range(0, some.size, WORDS_AT_ONCE):
                part = some[start:start + WORDS_AT_ONCE]
                for k, ids in zip(part, self._together([words[k] for k in part], width)):
                    out[k] = ids
            low = width
        for k in np.flatnonzero(sizes > low):
            out[k] = self._alone(words[k])
        return out

    def _together(self, words: list[bytes], width: int) -> list[bytes]:
        """Many words of at most ``width`` bytes, one step of all trees at a time."""
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8)
        symbol = np.zeros((n, width + 1), np.int64)
        symbol[:, :width] = self.byte_ids[text.reshape(n, width)]
        place = np.arange(width + 1)
        after = np.minimum(np.broadcast_to(place + 1, (n, width + 1)), sizes[:, None]).copy()
        before = np.broadcast_to(place - 1, (n, width + 1)).copy()
        tree = np.full((n, 2 * width), NO_PAIR, np.int64)
        rank = self.rank_of(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()).reshape(n, width)
        tree[:, width:] = np.where(place[1:] < sizes[:, None], rank << 8 | place[:-1], NO_PAIR)
        level = width >> 1
        while level:
            tree[:, level:2 * level] = tree[:, 2 * level:4 * level].reshape(n, level, 2).min(2)
            level >>= 1
        row = np.flatnonzero(tree[:, 1] < NO_PAIR)
        while row.size:
            root = tree[row, 1]
            at, made = root & 255, self.made[root >> 8]
            gone = after[row, at]
            right = after[row, gone]
            left = before[row, at]
            size = sizes[row]
            symbol[row, at] = made
            after[row, at] = right
            before[row, right] = np.where(right < size, at, before[row, right])
            self._climb(tree, row, gone, np.full(row.size, NO_PAIR))
            rank = self.rank_of(made, symbol[row, right])
            self._climb(tree, row, at, np.where((right < size) & (rank < NO_PAIR >> 8),
                                                rank << 8 | at, NO_PAIR))
            some = np.flatnonzero(left >= 0)
            rank = self.rank_of(symbol[row[some], left[some]], made[some])
            self._climb(tree, row[some], left[some],
                        np.where(rank < NO_PAIR >> 8, rank << 8 | left[some], NO_PAIR))
            row = row[tree[row, 1] < NO_PAIR]
        live = np.zeros((n, width + 1), bool)
        at = np.zeros(n, np.int64)
        row = np.arange(n)
        while row.size:
            live[row, at] = True
            at = after[row, at]
            more = at < sizes[row]
            row, at = row[more], at[more]
        counts = live.sum(1)
        ids = symbol[live].astype("<u4").tobytes()
        ends = np.cumsum(counts) * 4
        return [ids[e - 4 * c:e] for e, c in zip(ends.tolist(), counts.tolist())]

    @staticmethod
    def _climb(tree: np.ndarray, row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + tree.shape[1] // 2
        flat, base = tree.reshape(-1), row * tree.shape[1]
        flat[base + node] = value
        level = tree.shape[1] // 2
        while level > 1:
            node, level = node >> 1, level >> 1
            twin = base + 2 * node
            flat[base + node] = np.minimum(flat[twin], flat[twin + 1])

    def _alone(self, word: bytes) -> bytes:
        """One word of any length."""
        symbols = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(symbols)
        leaves = 1 << max(1, (n - 1).bit_length())
        never = (1 << 60, 0)
        tree = [never] * (2 * leaves)
        for k in range(n - 1):
            rank = self.ranks.get((symbols[k], symbols[k + 1]))
            if rank is not None:
                tree[leaves + k] = (rank, k)
        for k in range(leaves - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(leaf: int, value: tuple[int, int]) -> None:
            node = leaf + leaves
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        def pair(k: int) -> tuple[int, int]:
            if k < 0 or after[k] >= n:
                return never
            rank = self.ranks.get((symbols[k], symbols[after[k]]))
            return never if rank is None else (rank, k)

        while tree[1] < never:
            rank, k = tree[1]
            gone = after[k]
            symbols[k], after[k] = int(self.made[rank]), after[gone]
            if after[gone] < n:
                before[after[gone]] = k
            put(gone, never)
            put(k, pair(k))
            if before[k] >= 0:
                put(before[k], pair(before[k]))
        ids, k = [], 0
        while k < n:
            ids.append(symbols[k])
            k = after[k]
        return np.array(ids, "<u4").tobytes()

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of ids that lie end to end; bytes that are no UTF-8 become
        replacement characters."""
        sizes = self.token_sizes[ids]
        data = gathered(self.token_pool, self.token_starts[ids], sizes)
        upto = np.concatenate([[0], np.cumsum(sizes)])[ends]
        texts = packed(pa.string(), data, upto)
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            raw = packed(pa.binary(), data, upto)
            texts = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())
        return texts


class Encoder:
    """Encodes texts and remembers the runs it has met, a bounded number of them."""

    def __init__(self, pairs: BytePairs, special: bool = True):
        """Without ``special`` the special tokens' strings are ordinary text."""
        self.pairs = pairs
        self.words = regex.compile(WORDS)
        self.runs = regex.compile(RUNS)
        strings = sorted(pairs.special, key=len, reverse=True) if special else []
        either = "|".join(map(re.escape, strings)) or "(?!)"
        self.special = re.compile(f"({either})")
        self.odd = re.compile(f"[{ODD_SPACE}]|{either}")
        self.hash = SpanHash()
        self.by_run: dict[int, bytes] = {}
        self.by_word: dict[str, bytes] = {}

    def _words_of(self, run: str) -> list[str]:
        """A run of non-space, or of space, cut as the vocabulary's rule cuts it."""
        bare = run[1:] if run[:1] == " " else run
        if bare.isalpha() or len(run) < 2:
            return [run]
        if bare[:-1].isalpha() and bare[-1] in ".,;:?!":
            return [run[:-1], run[-1]]
        return self.words.findall(run)

    def encode_runs(self, runs: list[str]) -> list[bytes]:
        if len(self.by_word) > KEPT_WORDS:
            self.by_word.clear()
        cut = [self._words_of(run) for run in runs]
        known = self.by_word
        unknown = list({w for words in cut for w in words}.difference(known))
        known.update(zip(unknown, self.pairs.encode_words([w.encode() for w in unknown])))
        return [known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words])
                for words in cut]

    def _odd_text(self, text: str) -> bytes:
        """A text with special tokens or unusual white space."""
        out = []
        for k, piece in enumerate(self.special.split(text)):
            if k % 2:
                out.append(np.array([self.pairs.special[piece]], "<u4").tobytes())
            elif piece:
                out += self.encode_runs(self.runs.findall(piece))
        return b"".join(out)

    @staticmethod
    def _run_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where runs begin: a run takes the one blank before it; of other white space
        before a word the last character stands alone; marks part from a letter or digit."""
        space = SPACE[data]
        before = np.zeros(len(data), bool)
        before[1:] = space[:-1]
        follows = np.zeros(len(data), bool)
        follows[:-1] = ~space[1:]
        inner = at[(at > 0) & (at < len(data))]
        before[inner], follows[inner - 1] = False, False
        blank = np.zeros(len(data), bool)
        blank[1:] = data[:-1] == 32
        ended = np.zeros(len(data), bool)
        ended[1:] = LETTERS[data[:-1]]
        start = np.where(space, ~before | follows, before & ~blank | ended & MARKS[data])
        start[at[:-1][at[:-1] < len(data)]] = True
        return np.flatnonzero(start)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids begin (and the last end)."""
        odd = {k: self._odd_text(t) for k, t in enumerate(column.to_pylist())
               if self.odd.search(t)}
        if odd:
            keep = pa.array(["" if k in odd else t for k, t in enumerate(column.to_pylist())],
                            pa.string())
            ids, ends = self._plain(keep)
            parts = [np.frombuffer(odd[k], "<u4") if k in odd else ids[ends[k]:ends[k + 1]]
                     for k in range(len(column))]
            return np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return self._plain(column)

    def _plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at = bytes_of(column)
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(column) + 1, np.int64)
        starts = self._run_starts(data, at)
        ends = np.append(starts[1:], len(data))
        first = self.hash(data, starts, ends)
        place, group = alike(first, self.hash(data, starts, ends, 1))
        keys = first[place].tolist()
        if len(self.by_run) + len(keys) > KEPT_WORDS:
            self.by_run.clear()
        known = self.by_run
        new = [k for k, key in enumerate(keys) if key not in known]
        whole = data.tobytes()
        runs = [whole[s:e].decode() for s, e in zip(starts[place[new]].tolist(),
                                                    ends[place[new]].tolist())]
        known.update(zip([keys[k] for k in new], self.encode_runs(runs)))
        found = [known[k] for k in keys]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool = np.frombuffer(b"".join(found), "<u4")
        ids = gathered(pool, (np.cumsum(sizes) - sizes)[group], sizes[group])
        upto = np.concatenate([[0], np.cumsum(sizes[group])])
        return ids, upto[np.searchsorted(starts, at)]


def load(spark: SparkSession, path: str):
    """The vocabulary's tables, read on the driver and broadcast (its size is fixed)."""
    return Shared(spark, BytePairs(path))


def round_trip(docs: DataFrame, path: str, **columns: str) -> DataFrame:
    """Each text's ids and the text decoded from them: ``doc_id``, ``ids`` (binary,
    little-endian unsigned 32-bit integers), ``decoded``."""
    pairs = load(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pairs.value)
        for batch in slices(batches):
            ids, ends = encoder.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), packed(pa.binary(), ids.view(np.uint8), 4 * ends),
                 encoder.pairs.decode(ids, ends)], names=["doc_id", "ids", "decoded"])

    return id_and_text(docs, **columns).mapInArrow(
        run, "doc_id long, ids binary, decoded string")


def encode(docs: DataFrame, path: str, **columns: str) -> DataFrame:
    """Each text's token ids as an array: ``doc_id``, ``ids``."""
    pairs = load(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pairs.value)
        for batch in slices(batches):
            ids, ends = encoder.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"),
                 pa.ListArray.from_arrays(ends.astype(np.int32), ids.astype(np.int32))],
                names=["doc_id", "ids"])

    return id_and_text(docs, **columns).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """Texts of ``doc_id``, ``ids`` (array): ``doc_id``, ``text``. Null ids count as none."""
    pairs = load(tokens.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [x or [] for x in batch.column("ids").to_pylist()]
            ids = np.array([k for x in lists for k in x], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"),
                 pairs.value.decode(ids, np.cumsum([0, *map(len, lists)]))],
                names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(
        run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str, **columns: str) -> DataFrame:
    """Per document: ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``."""
    return round_trip(docs, path, **columns).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
