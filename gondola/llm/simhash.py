"""Near-duplicate documents by SimHash, joined over binary tries.

Each text's shingles are hashed with XXH64 and vote on the 64 bits of a fingerprint.
Distinct fingerprints are linked when at most two bits differ. Two such fingerprints
agree on at least two of four 16-bit blocks, so each fingerprint is sent to the six
tries whose leading 32 bits are two blocks; a subtree under one such prefix is joined
with itself by walking pairs of nodes down together, adding up differing bits, and
leaving a pair as soon as the error budget is exceeded. A subtree with very many
fingerprints is cut into its lower node pairs, each a group of its own, so no task takes
an unbounded group.

Equal texts have one fingerprint and meet before the join; what leaves a subtree is not
all pairs but enough links to join its components. Components are found with Spark jobs.

A null or empty text has the fingerprint zero and is linked like any other. Texts with
fewer words than a shingle are one shingle. Repeated rows and repeated keys give one row
each; a null key gives a row, and is the component's key only if no other is there. An
empty table gives an empty result. Extra columns are ignored by ``simhash_components``
and kept by ``keep_one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.functions.lineage import cut_lineage
from gondola.llm.links import components
from gondola.llm.texts import id_and_text, slices

WORDS_PER_SHINGLE = 3
SEED = 42
BUDGET = 2
#: Most fingerprints of a subtree that one group joins.
GROUP_FINGERPRINTS = 20_000
#: Lowest level at which a subtree is cut.
LOWEST = 24
SMALL_PAIR = 8
#: Fixed value: the two of four blocks that lead each trie.
LEADING = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))


def fingerprint(text: bytes, size: int = WORDS_PER_SHINGLE) -> int:
    """SimHash of one text, already in lower case."""
    words = text.split()
    if not words:
        return 0
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        spans = words
        for k in range(1, size):
            spans = [a + b" " + b for a, b in zip(spans, words[k:])]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(s, SEED) for s in spans]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes)).tobytes(), "big")


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def with_fingerprints(rows: DataFrame) -> DataFrame:
    """The table with ``bits``, the fingerprint as a signed 64-bit number, for ``text``."""
    kept = [c for c in rows.columns if c != "text"]
    schema = rows.select(*kept, F.lit(0).cast("long").alias("bits")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(t.encode().lower()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], _signed(found)], names=[*kept, "bits"])

    return rows.mapInArrow(run, schema)


def _permuted(bits: np.ndarray, lead: tuple[int, int]) -> np.ndarray:
    """The fingerprint with the two leading blocks first."""
    order = [*lead, *[k for k in range(4) if k not in lead]]
    out = np.zeros(len(bits), np.uint64)
    for place, block in enumerate(order):
        part = (bits >> np.uint64(48 - 16 * block)) & np.uint64(0xFFFF)
        out |= part << np.uint64(48 - 16 * place)
    return out


def trie_join(keys: np.ndarray, pairs: list[np.ndarray], budget: int = BUDGET,
              depth: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in ``keys`` that differ in at most ``budget`` bits.

    ``pairs`` are the node pairs to start from: low and high end of one node's range and
    of the other's, and the number of bits above the last ``depth`` in which they differ. A
    node is a range of keys, sorted and distinct, that are equal above these bits. All node
    pairs of one level go down together: like branches keep the pair's count of differing
    bits, unlike branches add one.
    """
    frontier = pairs
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for level in range(depth - 1, -1, -1):
        a_low, a_high, b_low, b_high, differ = frontier
        same = a_low == b_low
        size_a, size_b = a_high - a_low, b_high - b_low
        # Small pairs of nodes, and pairs of leaves, are compared bit by bit.
        small = (size_a * size_b <= SMALL_PAIR) | (level == 0)
        if small.any():
            la, lb = size_a[small], size_b[small]
            which = np.repeat(np.arange(la.size), la * lb)
            place = np.arange(which.size) - np.repeat(np.cumsum(la * lb) - la * lb, la * lb)
            i = a_low[small][which] + place // lb[which]
            j = b_low[small][which] + place % lb[which]
            near = ((i < j) | ~same[small][which]) & (i != j)
            i, j = i[near], j[near]
            close = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            found.append((i[close], j[close]))
        a_low, a_high, b_low, b_high, differ, same = (
            x[~small] for x in (a_low, a_high, b_low, b_high, differ, same))
        if not a_low.size:
            break
        ones = np.concatenate([[0], np.cumsum((keys >> np.uint64(level)) & np.uint64(1)).astype(np.int64)])
        a_mid = a_high - (ones[a_high] - ones[a_low])
        b_mid = b_high - (ones[b_high] - ones[b_low])
        parts = [(a_low, a_mid, b_low, b_mid, differ), (a_mid, a_high, b_mid, b_high, differ),
                 (a_low, a_mid, b_mid, b_high, differ + 1)]
        cross = ~same
        parts.append(tuple(x[cross] for x in (a_mid, a_high, b_low, b_mid, differ + 1)))
        joined = [np.concatenate(x) for x in zip(*parts)]
        keep = (joined[4] <= budget) & (joined[1] > joined[0]) & (joined[3] > joined[2])
        frontier = [x[keep] for x in joined]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def spanning(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least member of each node's component, for nodes 0..n-1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _tries(distinct: DataFrame) -> DataFrame:
    """Six rows for each fingerprint: trie, its leading 32 bits, its other 32 bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column("bits").to_numpy(zero_copy_only=False).view(np.uint64)
            for trie, lead in enumerate(LEADING):
                turned = _permuted(bits, lead)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(bits), trie, np.int32)),
                    pa.array((turned >> np.uint64(32)).astype(np.int64)),
                    pa.array((turned & np.uint64(0xFFFFFFFF)).astype(np.int64)),
                    batch.column("bits")], names=["trie", "prefix", "rest", "bits"])

    return distinct.mapInArrow(run, "trie int, prefix long, rest long, bits long")


def _with_node_pairs(rows: DataFrame) -> DataFrame:
    """A prefix with ``levels`` over 0 is cut so many levels lower: its keys go to every
    pair of lower nodes within the budget that they take part in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.column("rest").to_numpy()
            levels = batch.column("levels").to_numpy()
            for level in np.unique(levels).tolist():
                mine = np.flatnonzero(levels == level)
                some = batch.take(pa.array(mine)).select(["trie", "prefix", "rest", "bits", "levels"])
                node = rest[mine] >> (32 - level)
                one = [1 << k for k in range(level)]
                for flip in [0, *one, *[x | y for x in one for y in one if x < y]]:
                    low, high = np.minimum(node, node ^ flip), np.maximum(node, node ^ flip)
                    yield pa.RecordBatch.from_arrays(
                        [*some.columns, pa.array(low), pa.array(high)],
                        names=["trie", "prefix", "rest", "bits", "levels", "low", "high"])

    return rows.mapInArrow(
        run, "trie int, prefix long, rest long, bits long, levels int, low long, high long")


GROUP = ["trie", "prefix", "low", "high"]


def _join_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group and rest; joins all complete groups of a batch together."""
    def linked(table: pa.Table, firsts: np.ndarray) -> pa.RecordBatch:
        keys = table.column("rest").to_numpy().view(np.uint64)
        bits = table.column("bits").to_numpy()
        low, high = (table.column(c).to_numpy()[firsts] for c in ("low", "high"))
        ends = np.append(firsts[1:], len(keys))
        # Of a pair of unlike nodes the keys of the higher come second.
        split = firsts.copy()
        levels = table.column("levels").to_numpy()
        second = (keys.astype(np.int64) >> (32 - levels)) == np.repeat(high, ends - firsts)
        counts = np.add.reduceat(second, firsts, dtype=np.int64)
        unlike = low != high
        split[unlike] = (ends - counts)[unlike]
        # The walk goes down all 32 levels, so it adds up the nodes' own differing bits too.
        pairs = [firsts, np.where(unlike, split, ends), split, ends, np.zeros(len(firsts), np.int64)]
        left, right = trie_join(keys, pairs)
        root = spanning(len(keys), left, right)
        own = np.flatnonzero(root != np.arange(len(keys)))
        return pa.RecordBatch.from_arrays([pa.array(bits[own]), pa.array(bits[root[own]])],
                                          names=["u", "v"])

    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        group = np.stack([held.column(c).to_numpy() for c in GROUP])
        firsts = np.flatnonzero(np.append(True, (group[:, 1:] != group[:, :-1]).any(0)))
        if len(firsts) > 1:
            yield linked(held.slice(0, int(firsts[-1])), firsts[:-1])
            held = held.slice(int(firsts[-1]))
    if held is not None and held.num_rows:
        yield linked(held, np.zeros(1, np.int64))


def _cut_levels(rows: DataFrame, large: DataFrame, most: int) -> DataFrame:
    """For each of the ``large`` prefixes the least ``levels`` at which no node has more than
    ``most`` keys, as counted; at the lowest a node has 256 keys at most."""
    lowest = rows.join(large, ["trie", "prefix"], "left_semi").groupBy(
        "trie", "prefix", F.shiftright("rest", 32 - LOWEST).alias("node")).agg(F.count("*").alias("n"))
    level = F.explode(F.sequence(F.lit(1), F.lit(LOWEST))).alias("levels")
    nodes = lowest.select("*", level).groupBy(
        "trie", "prefix", "levels", F.expr(f"shiftright(node, {LOWEST} - levels)").alias("node")).agg(
        F.sum("n").alias("n"))
    largest = nodes.groupBy("trie", "prefix", "levels").agg(F.max("n").alias("n"))
    return largest.groupBy("trie", "prefix").agg(F.coalesce(
        F.min(F.when(F.col("n") <= most, F.col("levels"))), F.lit(LOWEST)).alias("levels"))


def fingerprint_links(distinct: DataFrame, most: int = GROUP_FINGERPRINTS) -> DataFrame:
    """Links ``u``, ``v`` that join all distinct ``bits`` within the budget, transitively."""
    rows = _tries(distinct)
    sizes = cut_lineage(rows.groupBy("trie", "prefix").agg(F.count("*").alias("n")).where("n > 1"))
    large = _cut_levels(rows, sizes.where(F.col("n") > most), most)
    levels = sizes.join(large, ["trie", "prefix"], "left").select(
        "trie", "prefix", F.coalesce("levels", F.lit(0)).alias("levels"))
    # Only prefixes with company go on.
    kept = rows.join(levels, ["trie", "prefix"])
    plain = kept.where("levels = 0").withColumns({"low": F.lit(0).cast("long"),
                                                  "high": F.lit(0).cast("long")})
    cut = _with_node_pairs(kept.where("levels > 0").select(
        "trie", "prefix", "rest", "bits", "levels"))
    wanted = ["trie", "prefix", "low", "high", "rest", "bits", "levels"]
    groups = plain.select(*wanted).union(cut.select(*wanted))
    return groups.repartition(*GROUP).sortWithinPartitions(*GROUP, "rest").mapInArrow(
        _join_groups, "u long, v long")


def fingerprint_components(prints: DataFrame) -> DataFrame:
    """Each distinct ``bits`` of the table with ``group``, one of its component's."""
    distinct = prints.select("bits").distinct()
    grouped = components(fingerprint_links(distinct))
    return distinct.join(grouped.select(F.col("u").alias("bits"), F.col("v").alias("group")),
                         "bits", "left").withColumn("group", F.coalesce("group", "bits"))


def simhash_components(docs: DataFrame, **columns: str) -> DataFrame:
    """Per document: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the
    least ``doc_id`` reachable over links, its own included."""
    prints = cut_lineage(with_fingerprints(id_and_text(docs, **columns)))
    least = prints.groupBy("bits").agg(F.min("doc_id").alias("least"))
    groups = least.join(fingerprint_components(least), "bits")
    named = groups.join(groups.groupBy("group").agg(F.min("least").alias("component_id")), "group")
    return prints.join(named.select("bits", "component_id"), "bits").select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_column: str = "doc_id",
                     text_column: str = "text") -> DataFrame:
    """The table with one row of each component: that of the least key (a null key last).

    Among rows of one key the first by place stays. All columns are kept. The table is
    written once with a number for each row, so that choosing a row is repeatable.
    """
    names = docs.columns
    numbered = cut_lineage(docs.select(F.struct(*[F.col(c) for c in names]).alias("row"),
                                       F.monotonically_increasing_id().alias("place")))
    row = F.col("row")
    first = cut_lineage(
        with_fingerprints(id_and_text(numbered.select(
            F.col("place").alias("doc_id"), row[text_column].alias("text"),
            row[id_column].alias("key")), "key"))
        .groupBy("bits").agg(F.min(F.struct(
            F.col("key").isNull().alias("no_key"), "key", F.col("doc_id").alias("place"))).alias("least")))
    groups = first.join(fingerprint_components(first), "bits")
    chosen = groups.groupBy("group").agg(F.min("least").alias("least")).select("least.place")
    return numbered.join(chosen, "place", "left_semi").select("row.*")
