"""Repair of conversations: the cheapest edits that make roles alternate.

A conversation is a word over role initials. Every row is kept, given another role or
deleted, and empty rows may be put in anywhere, so that the initials read
``(s?(ua)+)?``. The least cost from each of the four places in that pattern to the end of
the conversation is a short vector; shifted so that its least entry is 0, only a few dozen
such vectors exist. So the work is done by the Four-Russians method: a table built once
from the rules gives, for every block of ``BLOCK`` rows' symbols and every vector behind
the block, the vector before it and what was added to all entries. A conversation is read
from its end by look-ups, a block at a time, and only the vectors between blocks are kept.
Then it is walked from its start: each block is opened again from the vector behind it,
and at each row the first letter in ASCII order that still leads to the least cost is
taken, which gives the least of all cheapest edit strings.

Rows of a conversation are ordered by turn, nulls first; rows of one turn by role, then by
the SHA-256 of their text. Equal rows are counted before they are shuffled. A first pass
moves digests in place of texts and ends in one edit string a conversation; a second one
streams the texts past that string. A conversation is hashed in order, which is the work
of one task, but that task holds a byte or two a row (the edit string itself), never the
texts: they arrive sorted, through Spark's sort, which spills.

Nulls in any column: role and text count as one space, a null ``conv_id`` is a
conversation of its own and a null ``turn`` sorts first; both are one space in the damage
key. Empty and very long texts are rows like others; ties and repeated rows are ordered as
above, and a repeated row is a duplicate; an empty table gives no rows; further columns are
left out, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Costs of the edits, and of a row that stays cut off.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3

#: Rows in a block of the table.
BLOCK = 4

# Places in the pattern: at the start, after s, after u, after a. From each one role may be
# written next (``EXPECTED``); s may be kept at the start only. The ends are 0 and 3.
EXPECTED = (2, 2, 3, 2)
WRITTEN = ("user", "user", "assistant", "user")
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})

# Symbols: 0 must be deleted; otherwise 1 + 2 * initial + cut off.
INITIALS = "sua"
SYMBOLS = 1 + 2 * (len(INITIALS) + 1)


def symbol(initial: str, cut_off: bool) -> int:
    at = INITIALS.find(initial) if initial else -1
    return 1 + 2 * (at if at >= 0 else len(INITIALS)) + bool(cut_off)


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    """Least costs when empty rows may be written first; two at most are of use."""
    for _ in range(2):
        costs = [min(costs[p], INSERT + costs[EXPECTED[p]]) for p in range(4)]
    return tuple(costs)


#: Costs behind the last row, before the inserts.
END = _with_inserts([0, 10 ** 6, 10 ** 6, 0])


def moves(code: int, place: int) -> list[tuple[str, int, int]]:
    """What may be done with a row at a place: letter, cost, next place, in letter order."""
    found = [("D", DELETE, place)]
    if code:
        initial, cut_off = (INITIALS + " ")[(code - 1) // 2], (code - 1) % 2 * CUT_OFF
        if initial in KEPT[place]:
            found.append(("K", cut_off, KEPT[place][initial]))
        found.append(("R", REROLE + cut_off, EXPECTED[place]))
    return found


def before(code: int, behind: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs before a row from those behind it."""
    return _with_inserts([
        min(cost + behind[to] for _, cost, to in moves(code, place)) for place in range(4)])


class Tables:
    """Every normalised vector, and what each symbol and each block makes of it."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        number = {tuple(c - min(END) for c in END): 0}
        self.vectors = list(number)
        rows = []
        for vector in self.vectors:  # grows while it is read
            row = []
            for code in range(SYMBOLS):
                costs = before(code, vector)
                least = min(costs)
                shifted = tuple(c - least for c in costs)
                if shifted not in number:
                    number[shifted] = len(self.vectors)
                    self.vectors.append(shifted)
                row.append((number[shifted], least))
            rows.append(row)
        self.one = rows
        step = np.array(rows, np.int64).transpose(2, 1, 0)  # (vector or cost, symbol, from)
        to, cost = step[0], step[1]
        # Put one more symbol before every block; the first symbol is the leading digit.
        block_to, block_cost = to, cost
        for _ in range(block - 1):
            block_cost = (block_cost[None, :, :]
                          + cost[:, block_to].reshape(SYMBOLS, *block_to.shape))
            block_to = to[:, block_to].reshape(SYMBOLS, *block_to.shape)
            block_to = block_to.reshape(-1, len(self.vectors))
            block_cost = block_cost.reshape(-1, len(self.vectors))
        self.to, self.cost = block_to, block_cost
        self.start = (0, min(END))

    def cheapest(self, codes: bytes | bytearray) -> tuple[int, bytearray]:
        """Least cost of a conversation's symbols, and the least of its cheapest edits."""
        n, size = len(codes), self.block
        head = n % size
        blocks = np.frombuffer(codes, np.uint8)[head:].reshape(-1, size).astype(np.int64)
        numbers = (blocks @ (SYMBOLS ** np.arange(size - 1, -1, -1))).tolist()
        vector, total = self.start
        behind = [vector]  # behind the last block, then before each block from the last on
        to, cost = self.to, self.cost
        for number in reversed(numbers):
            total += int(cost[number, vector])
            vector = int(to[number, vector])
            behind.append(vector)
        behind = bytes(behind) if len(self.vectors) < 256 else behind
        at_head = vector
        for code in reversed(codes[:head]):
            vector, more = self.one[vector][code]
            total += more
        edits, place = bytearray(), 0
        total += self.vectors[vector][0]
        if head:
            place = self._walk(codes[:head], at_head, place, edits)
        last = len(behind) - 2
        for i in range(len(numbers)):
            start = head + i * size
            place = self._walk(codes[start:start + size], behind[last - i], place, edits)
        while END[place]:
            edits += b"I"
            place = EXPECTED[place]
        return total, edits

    def _walk(self, codes, vector: int, place: int, edits: bytearray) -> int:
        """Open a block from the vector behind it and go through it from its start."""
        behind = [self.vectors[vector]]
        for code in reversed(codes):
            behind.append(before(code, behind[-1]))
        behind.reverse()
        for i, code in enumerate(codes):
            here, after = behind[i], behind[i + 1]
            while True:
                options = [(letter, to) for letter, cost, to in moves(code, place)
                           if here[place] == cost + after[to]]
                inserts = here[place] == INSERT + here[EXPECTED[place]]
                if inserts and not (options and options[0][0] == "D"):
                    edits += b"I"
                    place = EXPECTED[place]
                    continue
                letter, place = options[0]
                edits += letter.encode()
                break
        return place


def _key() -> list[Column]:
    return [F.col(name).cast("long").alias(name) for name in ("conv_id", "turn")]


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the contract's damage; ``copies`` is 0 for a dropped row, 2 for a
    repeated one, so that every conversation stays known."""
    fate = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    role, text = _text("role"), _text("text")
    return conversations.select(
        *_key(), F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text)
        .alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"))


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def symbols_of(rows: DataFrame) -> DataFrame:
    """One row for each turn, role and text of a conversation: number of equal rows, role
    initial, faults, and whether an earlier row had the same role and text."""
    tail = F.rtrim(F.col("text"), F.lit(" \t\n\v\f\r"))
    counted = rows.select(
        "conv_id", "turn", "role", "copies", _digest("text").alias("digest"),
        (tail == "").alias("blank"),
        (~F.substring(tail, -1, 1).isin(".", "!", "?")).alias("cut_off"),
    ).groupBy("conv_id", "turn", "role", "digest").agg(
        F.sum("copies").alias("copies"), F.first("blank").alias("blank"),
        F.first("cut_off").alias("cut_off"))
    same = Window.partitionBy("conv_id", "role", "digest").orderBy(
        (F.col("copies") == 0), F.col("turn").asc_nulls_first())
    return (
        counted.repartition("conv_id")
        .withColumn("seen", F.row_number().over(same) > 1)
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest")
        .select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "copies",
                "blank", "cut_off", "seen"))


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
AUDITS = "conv_id long, {}, audit string".format(", ".join(f"{name} long" for name in FIGURES))
REPAIRED = f"{AUDITS}, repaired_sha256 string"
LEGAL = ("su", "ua", "au")


class _Reading:
    """What is known of the conversation being read."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.codes = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None
        self.turns = 0
        self.initial = None

    def add(self, turn, initial: str, copies: int, blank: bool, cut_off: bool, seen: bool):
        if not copies:
            return
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        if self.initial is not None:
            self.illegal += self.initial + initial not in LEGAL
        self.illegal += copies - 1  # a role next to itself
        self.initial = initial
        if blank:
            self.blank += copies
            self.codes += bytes(copies)
            return
        again = copies if seen else copies - 1
        self.duplicate += again
        if not seen:
            self.truncated += cut_off
            self.codes.append(symbol(initial, cut_off))
        self.codes += bytes(again)

    def row(self, tables: Tables) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        cost, edits = tables.cheapest(self.codes)
        return (self.conv_id, min(gaps, 2 ** 63 - 1), self.blank, self.duplicate, self.truncated, self.illegal,
                cost, edits.decode())


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _audit_schema(more: tuple[str, ...] = ()) -> pa.Schema:
    return pa.schema([("conv_id", pa.int64()), *((name, pa.int64()) for name in FIGURES),
                      ("audit", pa.string()), *((name, pa.string()) for name in more)])


ROWS_OUT = 4096


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables, schema = Tables(), _audit_schema()
    reading, done = None, []
    for batch in batches:
        for conv_id, *row in zip(*(column.to_pylist() for column in batch.columns)):
            if reading is None or conv_id != reading.conv_id:
                if reading is not None:
                    done.append(reading.row(tables))
                reading = _Reading(conv_id)
            reading.add(*row)
            if len(done) >= ROWS_OUT:
                yield _batch(done, schema)
                done = []
    if reading is not None:
        done.append(reading.row(tables))
        yield _batch(done, schema)


def audits(rows: DataFrame) -> DataFrame:
    """Per conversation of ``damaged``-like rows: faults, least cost and the edit string."""
    return symbols_of(rows).mapInArrow(_audited, AUDITS)


class _Writer:
    """Writes the repaired rows of one conversation, in order."""

    def __init__(self, edits: str):
        self.letters, self.at, self.place, self.some = edits, 0, 0, False

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            yield WRITTEN[self.place], ""
            self.place = EXPECTED[self.place]
            self.at += 1

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            yield role, text
            self.place = KEPT[self.place][role[:1]]
        elif letter == "R":
            yield WRITTEN[self.place], text
            self.place = EXPECTED[self.place]


def _with_audit(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, in one partition.

    The edit string lies in ``text`` of the audit's row, so that rows carry no copy of it.
    """
    given = rows.filter("copies > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", _digest("text").alias("digest"), "text",
        F.lit(None).cast("array<long>").alias("figures"))
    heads = found.select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"),
        F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"),
        F.array(*FIGURES).alias("figures"))
    return heads.unionByName(given).repartition("conv_id").sortWithinPartitions(
        "conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "digest",
    ).select("conv_id", "kind", "role", "text", "figures")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _audit_schema(("repaired_sha256",))
    head = writer = digest = None
    done: list[tuple] = []

    def put(pieces):
        for role, text in pieces:
            digest.update((f"\n{role}:" if writer.some else f"{role}:").encode())
            digest.update(text.encode())
            writer.some = True

    def close():
        put(writer.inserts())
        done.append((*head, digest.hexdigest()))

    for batch in batches:
        for conv_id, kind, role, text, figures in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                if head is not None:
                    close()
                head, writer, digest = (conv_id, *figures, text), _Writer(text), hashlib.sha256()
            else:
                put(writer.row(role, text))
        if len(done) >= ROWS_OUT:
            yield _batch(done, schema)
            done.clear()
    if head is not None:
        close()
        yield _batch(done, schema)


def repair_digests(rows: DataFrame) -> DataFrame:
    """``audits`` with the SHA-256 of each repaired conversation."""
    return _with_audit(rows, audits(rows)).mapInArrow(_hashed, REPAIRED)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()),
                        ("text", pa.string())])
    head, writer, place, done, size = None, None, 0, [], 0

    def put(pieces):
        nonlocal place, size
        for role, text in pieces:
            done.append((head, place, role, text))
            place, size = place + 1, size + len(text)

    for batch in batches:
        for conv_id, kind, role, text, _ in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                if writer is not None:
                    put(writer.inserts())
                head, writer, place = conv_id, _Writer(text), 0
            else:
                put(writer.row(role, text))
            if len(done) >= ROWS_OUT or size > 1 << 22:
                yield _batch(done, schema)
                done, size = [], 0
    if writer is not None:
        put(writer.inserts())
    if done:
        yield _batch(done, schema)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: ``conv_id``, ``place`` from 0, role and text."""
    return _with_audit(rows, audits(rows)).mapInArrow(
        _repaired, "conv_id long, place long, role string, text string")


def undamaged(conversations: DataFrame) -> DataFrame:
    """Conversations as rows to repair as they are: one copy of each."""
    return conversations.select(
        *_key(), _text("role").alias("role"), _text("text").alias("text"),
        F.lit(1).alias("copies"))
