"""Gradient-boosted trees from histograms, and trees that plain expressions can walk.

Three ways to fit share the arithmetic of splits. ``fit_classes`` fits one model on all rows:
rows lie in blocks over the cluster, a job per level adds up gradients and Hessians per
class, node, feature and bin; a class's sums (their size does not depend on the rows) meet in
one task, which picks its splits, and only these reach the driver. ``fit_regression`` does the same
for one regressor, whose sums meet by node. ``fit_many`` fits one small
model for each of many keys: rows of a key meet in one task, and a task grows the trees of
many keys together, level by level.

A fitted tree is a struct of arrays (``TREE``): feature (-1 in a leaf), threshold (greater
goes right), place of the left child (the right one follows), and value. Trees are saved as
tables. Trees of many models are scored by the expression ``walked``; one model for all rows
by ``with_chances``, where all trees of a label step together in numpy, with the same sums.

Draws of rows and columns are hashes of seed, round and key: the same for any partitioning.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from gondola.functions.lineage import cut_lineage

# Functions and classes that run inside tasks travel with the task: workers need not have
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREE = "struct<feature:array<int>,threshold:array<double>,left:array<int>,value:array<double>>"

ROWS_PER_BLOCK = 1 << 15
BLOCKS_IN_ONE_TASK = 4
BLOCKS_PER_TASK = 32
ROUNDS_PER_TABLE = 20
SKETCH_ACCURACY = 10_000


@dataclass(frozen=True)
class BoostSettings:
    """Settings of a boosted model; ``least_weight`` is the least Hessian sum of a child."""

    rounds: int = 300
    depth: int = 6
    rate: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    bins: int = 256
    ridge: float = 1.0
    least_weight: float = 1.0
    seed: int = 42


# --- arithmetic of splits --------------------------------------------------------------


def draws(seed: int, rounds: int, keys: np.ndarray) -> np.ndarray:
    """A uniform draw in [0, 1) for each key of this round."""
    z = keys.astype(np.uint64) + np.uint64((seed * 1_000_003 + rounds) * 0x9E3779B97F4A7C15 % 2 ** 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(2 ** 53)


def drawn_columns(settings: BoostSettings, rounds: int, tree: int, features: int) -> np.ndarray:
    """Which features a tree may split on."""
    draw = draws(settings.seed + 1, rounds, np.arange(features) + np.int64(tree) * features)
    mask = np.zeros(features, bool)
    mask[np.argsort(draw, kind="stable")[:max(1, int(features * settings.column_share))]] = True
    return mask


def best_splits(sums: np.ndarray, allowed: np.ndarray, settings: BoostSettings):
    """Per node: gain, feature, bin, and left sums of the best split.

    ``sums`` is node x feature x bin x (gradient, Hessian); rows of the last bin cannot be
    parted from it. The first of equal gains is taken.
    """
    left = sums.cumsum(axis=2)[:, :, :-1]
    total = sums[:, 0].sum(axis=1)
    right = total[:, None, None] - left
    ridge = settings.ridge

    def score(part):
        return part[..., 0] ** 2 / (part[..., 1] + ridge)

    gain = score(left) + score(right) - score(total)[:, None, None]
    good = ((left[..., 1] >= settings.least_weight) & (right[..., 1] >= settings.least_weight)
            & allowed[:, :, None])
    gain = np.where(good, gain, -np.inf).reshape(len(sums), -1)
    at = gain.argmax(axis=1)
    width = left.shape[2]
    nodes = np.arange(len(sums))
    return gain[nodes, at], at // width, at % width, left.reshape(len(sums), -1, 2)[nodes, at], total


# --- one model for all rows --------------------------------------------------------------


@dataclass
class GrowingTree:
    """A tree over bins while it grows."""

    feature: list[int]
    bin: list[int]
    left: list[int]
    value: list[float]

    @classmethod
    def root(cls) -> GrowingTree:
        return cls([-1], [0], [0], [0.0])

    def split(self, node: int, feature: int, bin_: int, values: tuple[float, float]) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.bin[node], self.left[node] = feature, bin_, at
        for value in values:
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(0)
            self.value.append(value)
        return at, at + 1


def _softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _drawn_rows(settings: BoostSettings, round_: int) -> Callable:
    """The rows of a block drawn for a round: bins by feature, label and the labels' chances."""
    def run(block):
        bins, label, key, margins = block
        used = draws(settings.seed, round_, key) < settings.row_share
        return np.ascontiguousarray(bins[used].T), label[used], _softmax(margins[used])
    return run


def _histogram(drawn, trees, active, classes, n_bins) -> dict[int, np.ndarray]:
    """Per class with active nodes the sums of a block's drawn rows: node x feature x bin x (gradient, Hessian)."""
    bins, label, chance = drawn
    if not len(label):
        return {}
    found = {}
    for c in range(classes):
        nodes = active[c]
        if not nodes:
            continue
        gradient = chance[:, c] - (label == c)
        weight = np.maximum(2 * chance[:, c] * (1 - chance[:, c]), 1e-16)
        columns = bins
        if len(trees[c].feature) > 1:
            number = np.full(len(trees[c].feature), -1)
            number[nodes] = range(len(nodes))
            node = number[_places(trees[c], bins)]
            mine = node >= 0
            if not mine.all():
                columns, node, gradient, weight = bins[:, mine], node[mine], gradient[mine], weight[mine]
        else:
            node = np.zeros(len(label), np.int64)
        place = node * n_bins
        sums = np.zeros((len(nodes), len(bins), n_bins, 2))
        for f, column in enumerate(columns):
            cell = place + column
            for k, part in enumerate((gradient, weight)):
                sums[:, f, :, k] = np.bincount(cell, part, len(nodes) * n_bins).reshape(-1, n_bins)
        found[c] = sums
    return found


def _class_sums(blocks, *settled) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """Per class the sums of a task's blocks, as flat places and their values."""
    total: dict[int, np.ndarray] = {}
    for block in blocks:
        for c, sums in _histogram(block, *settled).items():
            total[c] = total[c] + sums if c in total else sums
    for c, sums in total.items():
        flat = sums.reshape(-1, 2)
        at = np.flatnonzero(flat[:, 1])
        yield c, (at, flat[at])


def _class_splits(sums: np.ndarray, allowed: np.ndarray, settings: BoostSettings) -> tuple:
    """``best_splits`` of one class's nodes, from its sums."""
    return best_splits(sums, np.broadcast_to(allowed, sums.shape[:2]), settings)


def _summed(parts, shape: tuple) -> np.ndarray:
    """Sums of a class over all tasks, added in the order of the tasks."""
    sums = np.zeros((int(np.prod(shape[:-1])), 2))
    for _, (at, values) in sorted(parts, key=lambda part: part[0]):
        sums[at] += values
    return sums.reshape(shape)


def _block_tasks(blocks: int, cores: int) -> int:
    """Tasks of a round's jobs: every task is reported to the driver, in some thousand jobs, so once
    all cores are busy twice over a task takes more blocks, up to ``BLOCKS_PER_TASK``."""
    return max(1, min(blocks, 2 * cores), -(-blocks // BLOCKS_PER_TASK))


def _blocks(edges: list[np.ndarray], classes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            bins = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1)
            yield _packed([(bins.astype(np.uint8), batch.column("code").to_numpy().astype(np.uint8),
                            batch.column("key").to_numpy(), np.zeros((batch.num_rows, classes)))])
    return run


BLOCK = "bins binary, label binary, key binary, margins binary"


def _packed(blocks) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([b[k].tobytes() for b in blocks], pa.binary()) for k in range(4)],
        ["bins", "label", "key", "margins"])


def _unpacked(features: int, classes: int) -> Callable:
    def run(row):
        return (np.frombuffer(row[0], np.uint8).reshape(-1, features), np.frombuffer(row[1], np.uint8),
                np.frombuffer(row[2], np.int64), np.frombuffer(row[3]).reshape(-1, classes))
    return run


def bin_edges(rows: DataFrame, features: int, bins: int) -> list[np.ndarray]:
    """Upper edges of all bins but the last, per feature: ranks by a mergeable sketch.

    A feature with few distinct values has each of them as an edge.
    """
    ranks = [k / bins for k in range(1, bins)]
    row = rows.select(*[F.col("x")[j].alias(f"x{j}") for j in range(features)]).agg(*[
        F.percentile_approx(f"x{j}", ranks, SKETCH_ACCURACY).alias(f"x{j}") for j in range(features)]).first()
    return [np.unique(np.array(row[j] or [], float)) for j in range(features)]


@dataclass(frozen=True)
class ClassTrees:
    """A fitted classifier: labels in order, and per label its trees, in one row."""

    labels: list[str]
    trees: DataFrame  # forest: array of (array of TREE), one per label
    rounds: int
    depth: int


def fit_classes(rows: DataFrame, settings: BoostSettings = BoostSettings(),
                label: str = "label", key: str = "row_id") -> ClassTrees:
    """Softmax boosting, one tree a class and round, on ``label`` and the array ``x``.

    Ends early once a round finds no split in any class: all children would be lighter
    than ``least_weight``, since the rows are fitted. Up to ``BLOCKS_IN_ONE_TASK`` blocks all rounds
    run in one task; more rows lie in blocks, with a job per level. Both give the same trees.
    """
    spark = rows.sparkSession
    labels = sorted(r[0] for r in rows.select(label).distinct().collect())
    shape = rows.agg(F.max(F.size("x")), F.count("*")).first()
    features, n = shape[0] or 0, shape[1]
    classes = len(labels)
    edges = bin_edges(rows, features, min(settings.bins, 256))
    n_bins = max(map(len, edges), default=0) + 1
    code = F.array_position(F.array(*map(F.lit, labels)), F.col(label)) - 1
    table = rows.select("x", code.cast("int").alias("code"), F.xxhash64(key).alias("key")).repartition(
        max(1, -(-n // ROWS_PER_BLOCK)), "key").mapInArrow(_blocks(edges, classes), BLOCK)
    if n <= BLOCKS_IN_ONE_TASK * ROWS_PER_BLOCK:
        rounds = _fit_in_one_task(table, settings, classes, features, n_bins)
    else:
        rounds = _fit_by_jobs(table, settings, classes, features, n_bins, -(-n // ROWS_PER_BLOCK))
    forest = [[_thresholds(r[c], edges) for r in rounds] for c in range(classes)]
    frame = spark.createDataFrame([(forest,)], f"forest array<array<{TREE}>>")
    return ClassTrees(labels, frame, len(rounds), settings.depth)


def _fit_by_jobs(table: DataFrame, settings: BoostSettings, classes: int, features: int,
                 n_bins: int, blocks: int) -> list[list[GrowingTree]]:
    """A job per level; margins are kept with the rows and cut from their lineage at times."""
    spark, state, drawn, rounds = table.sparkSession, None, None, []
    tasks = _block_tasks(blocks, spark.sparkContext.defaultParallelism)
    for round_ in range(settings.rounds):
        old = state, drawn
        if round_ % ROUNDS_PER_TABLE == 0:
            if state is not None:
                table = spark.createDataFrame(state.map(_moved(rounds[-1], settings.depth)).map(_as_row), BLOCK)
            table = cut_lineage(table)
            state = table.rdd.coalesce(tasks).map(_unpacked(features, classes))
        else:
            state = state.map(_moved(rounds[-1], settings.depth))
        # Both are made by the first job of the round.
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
        drawn = state.map(_drawn_rows(settings, round_)).persist(StorageLevel.MEMORY_AND_DISK)

        def splits(held, allowed, drawn=drawn):
            """Sums of a class meet in one task, which picks the class's splits: the driver gets these."""
            def told(part, blocks):
                return ((c, (part, sums)) for c, sums in _class_sums(blocks, *held, classes, n_bins))

            def split(found):
                c, parts = found
                return c, _class_splits(_summed(parts, (len(held[1][c]), features, n_bins, 2)), allowed[c], settings)

            return drawn.mapPartitionsWithIndex(told).groupByKey(classes).map(split).collectAsMap()

        trees = _grow(splits, settings, round_, classes, features)
        for frame in old:
            if frame is not None:
                frame.unpersist()
        if not any(len(t.feature) > 1 for t in trees):
            break
        rounds.append(trees)
    for frame in (state, drawn):
        if frame is not None:
            frame.unpersist()
    return rounds


def _fit_in_one_task(table: DataFrame, settings: BoostSettings, classes: int, features: int,
                     n_bins: int) -> list[list[GrowingTree]]:
    """The same rounds inside one task, for rows that fit in one block: no job per level."""
    unpack = _unpacked(features, classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(row) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
        block = tuple(np.concatenate(c) for c in zip(*parts)) if parts else None
        for round_ in range(settings.rounds if parts else 0):
            def splits(held, allowed, drawn=_drawn_rows(settings, round_)(block)):
                return {c: _class_splits(sums, allowed[c], settings) for c, sums in
                        _histogram(drawn, *held, classes, n_bins).items()}

            trees = _grow(splits, settings, round_, classes, features)
            if not any(len(t.feature) > 1 for t in trees):
                break
            block = _moved(trees, settings.depth)(block)
            yield pa.RecordBatch.from_arrays(
                [pa.array([round_] * classes, pa.int32()), pa.array(range(classes), pa.int32()),
                 *[pa.array([getattr(t, name) for t in trees], pa.list_(kind)) for name, kind in (
                     ("feature", pa.int32()), ("bin", pa.int32()), ("left", pa.int32()),
                     ("value", pa.float64()))]],
                ["round", "class", "feature", "bin", "left", "value"])

    grown = table.coalesce(1).mapInArrow(
        run, "round int, class int, feature array<int>, bin array<int>, left array<int>, value array<double>").collect()
    rounds: list[list[GrowingTree]] = []
    for row in sorted(grown, key=lambda r: (r["round"], r["class"])):
        if row["class"] == 0:
            rounds.append([])
        rounds[-1].append(GrowingTree(*(list(row[k]) for k in ("feature", "bin", "left", "value"))))
    return rounds


def _as_row(block) -> tuple:
    return tuple(bytearray(np.ascontiguousarray(x).tobytes()) for x in block)


def _moved(trees: list[GrowingTree], depth: int) -> Callable:
    """Margins after a round."""
    def run(block):
        bins, label, key, margins = block
        columns = np.ascontiguousarray(bins.T)
        more = np.stack([np.array(t.value)[_places(t, columns)] for t in trees], axis=1)
        return bins, label, key, margins + more
    return run


def _grow(splits_of: Callable, settings: BoostSettings, round_: int, classes: int,
          features: int) -> list[GrowingTree]:
    trees = [GrowingTree.root() for _ in range(classes)]
    active: list[list[int]] = [[0] for _ in range(classes)]
    allowed = [drawn_columns(settings, round_, c, features) for c in range(classes)]
    for _ in range(settings.depth):
        if not any(active):
            break
        found = splits_of((trees, [list(a) for a in active]), allowed)
        for c in range(classes):
            nodes, active[c] = active[c], []
            if not nodes or c not in found:
                continue
            gain, feature, bin_, left, total = found[c]
            for i, node in enumerate(nodes):
                if gain[i] <= 1e-9:
                    if node == 0:
                        trees[c].value[0] = _leaf(total[i], settings)
                    continue
                active[c] += trees[c].split(node, int(feature[i]), int(bin_[i]), (
                    _leaf(left[i], settings), _leaf(total[i] - left[i], settings)))
    return trees


def _leaf(sums: np.ndarray, settings: BoostSettings) -> float:
    return float(-sums[0] / (sums[1] + settings.ridge) * settings.rate)


def _thresholds(tree: GrowingTree, edges: list[np.ndarray]) -> tuple:
    cuts = [float(edges[f][b]) if f >= 0 else 0.0 for f, b in zip(tree.feature, tree.bin)]
    return tree.feature, cuts, tree.left, tree.value


# --- one regressor for all rows ----------------------------------------------------------

ROWS_IN_ONE_TASK = 1 << 20
ROWS_PER_WIDE_BLOCK = 1 << 16
NODE_TASKS = 4


def _wide_rows(features: int) -> Callable:
    """A stored block as arrays: bins by feature, target, key for draws, and the sum of the trees so far."""
    def run(row):
        return (np.frombuffer(row[0], np.uint8).reshape(features, -1), np.frombuffer(row[1]),
                np.frombuffer(row[2], np.int64), np.frombuffer(row[3]))
    return run


def _guessed(tree: GrowingTree) -> Callable:
    """Sums of the trees after a round."""
    def run(block):
        bins, y, key, guess = block
        return bins, y, key, guess + np.array(tree.value)[_places(tree, bins)]
    return run


def _drawn(settings: BoostSettings, round_: int, absolute: bool) -> Callable:
    """Bins of the rows drawn for a round, and what its tree is fitted to: the target at first,
    then the residuals, or for absolute loss whether they are 0 and more."""
    def run(block):
        bins, y, key, guess = block
        used = draws(settings.seed, round_, key) < settings.row_share
        wanted = y if round_ == 0 else y >= guess if absolute else y - guess
        return bins[:, used], wanted[used]
    return run


def _places(tree: GrowingTree, bins: np.ndarray) -> np.ndarray:
    """The node that each row has come to, from bins by feature. Rows are masks of a byte each, which
    take a fraction of the time of looking up every row's node, feature and cut."""
    kind = np.uint8 if len(tree.feature) <= 256 else np.uint32
    node = np.zeros(bins.shape[1], kind)

    def walk(at: int, here: np.ndarray) -> None:
        if tree.feature[at] < 0:
            np.add(node, here * kind(at), out=node)
            return
        right = bins[tree.feature[at]] > tree.bin[at]
        walk(tree.left[at] + 1, here & right)
        walk(tree.left[at], here & ~right)

    walk(0, np.ones(len(node), bool))
    return node.astype(np.intp)


def _target_sums(blocks, tree: GrowingTree, active: list[int], n_bins: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per active node its sums over some blocks: feature x bin x (less target, rows)."""
    # Rows of all other nodes count as one more, unless they are so many that it pays to drop them.
    k, total = len(active) + 1, None
    number = np.full(len(tree.feature), k - 1)
    number[active] = range(k - 1)
    for bins, wanted in blocks:
        if len(tree.feature) > 1:
            at = number[_places(tree, bins)]
            kept = at < k - 1
            if 2 * np.count_nonzero(kept) < len(kept):
                bins, wanted, at = bins[:, kept], wanted[kept], at[kept]
        else:
            at = np.zeros(len(wanted), np.int64)
        if total is None:
            total = np.zeros((k, len(bins), n_bins, 2))
        if wanted.dtype == bool:  # +1 or -1: two counts tell their sum
            place = (at * 2 + wanted) * n_bins
            for f, column in enumerate(bins):
                down, up = np.bincount(place + column, minlength=k * 2 * n_bins).reshape(k, 2, n_bins).swapaxes(0, 1)
                total[:, f, :, 0] += down - up
                total[:, f, :, 1] += down + up
        else:
            place = at * n_bins
            for f, column in enumerate(bins):
                cell = place + column
                total[:, f, :, 0] -= np.bincount(cell, wanted, k * n_bins).reshape(k, n_bins)
                total[:, f, :, 1] += np.bincount(cell, minlength=k * n_bins).reshape(k, n_bins)
    if total is not None:
        yield from zip(active, total)


def _node_split(node: int, sums: np.ndarray, settings: BoostSettings, round_: int) -> tuple:
    """``best_splits`` of one node, over the columns drawn for it."""
    allowed = drawn_columns(settings, round_, node, len(sums))
    with np.errstate(divide="ignore", invalid="ignore"):
        return best_splits(sums[None], allowed[None], settings)


def _joined_splits(found: dict[int, tuple], nodes: list[int]) -> dict[int, tuple]:
    """Splits of single nodes in the order of the nodes, as of one class."""
    return {0: tuple(np.concatenate(part) for part in zip(*(found[node] for node in nodes)))} if found else {}


def _regression_tree(sums_of: Callable, settings: BoostSettings, round_: int, features: int) -> GrowingTree:
    """One round's tree; a node too light to be parted is left out of the sums."""
    settings = settings if round_ else replace(settings, rate=1.0)

    def splits(held, allowed):
        (tree,), (active,) = held
        return _joined_splits(sums_of(tree, active), active)

    return _grow(splits, settings, round_, 1, features)[0]


def fit_regression(rows: DataFrame, settings: BoostSettings, absolute: bool = True, tasks: int = 1) -> list[tuple]:
    """Boosted regression on the array ``x``, ``y`` and ``key``; returns the trees, as ``TREE``.

    The first tree is fitted to ``y`` and counts in full. The others are fitted to the residuals, or
    their signs for ``absolute`` loss, and count by the rate. A node's split is the one of least
    squares over columns drawn for the node; ``least_weight`` is the least number of drawn rows of
    a child. Up to ``ROWS_IN_ONE_TASK`` rows all rounds run in one task; more rows lie in blocks in
    ``tasks`` tasks, with a job per level, and only splits reach the driver.
    """
    shape = rows.agg(F.max(F.size("x")), F.count("*")).first()
    features, n = shape[0] or 0, shape[1]
    if not n:
        raise ValueError("there are no rows to fit a regression on")
    settings = replace(settings, ridge=0.0)
    edges = bin_edges(rows, features, min(settings.bins, 256))
    n_bins = max(map(len, edges), default=0) + 1
    alone = n <= ROWS_IN_ONE_TASK
    table = rows.select("x", F.col("y").cast("double"), F.col("key").cast("long")).repartition(
        1 if alone else tasks, "key").sortWithinPartitions("key").mapInArrow(
        _wide_blocks(edges, ROWS_PER_WIDE_BLOCK), BLOCK)
    fit = _regression_in_one_task if alone else _regression_by_jobs
    return [_thresholds(t, edges) for t in fit(table, settings, absolute, features, n_bins, tasks)]


def _wide_blocks(edges: list[np.ndarray], most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            whole = [np.concatenate(part, axis=-1) for part in zip(*held)]
            held.clear()
            return _packed([whole])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            bins = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)]).astype(np.uint8)
            held.append((bins, batch.column("y").to_numpy(), batch.column("key").to_numpy(),
                         np.zeros(batch.num_rows)))
            if sum(len(y) for _, y, *_ in held) >= most:
                yield block()
        if held:
            yield block()
    return run


def _regression_by_jobs(table: DataFrame, settings: BoostSettings, absolute: bool, features: int,
                        n_bins: int, tasks: int) -> list[GrowingTree]:
    """A job per level over the rows drawn for the round; the rows are cut from their lineage at times."""
    spark, grown, state, drawn = table.sparkSession, [], None, None
    for round_ in range(settings.rounds):
        old = state, drawn
        if round_ % ROUNDS_PER_TABLE == 0:
            if state is not None:
                table = spark.createDataFrame(state.map(_guessed(grown[-1])).map(_as_row), BLOCK)
            table = cut_lineage(table)
            state = table.rdd.coalesce(tasks).map(_wide_rows(features))
        else:
            state = state.map(_guessed(grown[-1]))
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
        drawn = state.map(_drawn(settings, round_, absolute)).persist(StorageLevel.MEMORY_AND_DISK)

        def sums_of(tree, active, round_=round_, drawn=drawn):
            """Sums of a node meet in one task, in the order of their tasks, which picks its split."""
            def told(part, blocks):
                return ((node, (part, sums)) for node, sums in _target_sums(blocks, tree, active, n_bins))

            def split(found):
                sums = sum(s for _, s in sorted(found[1], key=lambda ps: ps[0]))
                return found[0], _node_split(found[0], sums, settings, round_)

            return drawn.mapPartitionsWithIndex(told).groupByKey(
                min(len(active), NODE_TASKS)).map(split).collectAsMap()

        grown.append(_regression_tree(sums_of, settings, round_, features))
        for frame in old:
            if frame is not None:
                frame.unpersist()
    for frame in (state, drawn):
        if frame is not None:
            frame.unpersist()
    return grown


def _regression_in_one_task(table: DataFrame, settings: BoostSettings, absolute: bool, features: int,
                            n_bins: int, tasks: int) -> list[GrowingTree]:
    """The same rounds inside one task, for a bounded number of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [_wide_rows(features)(row) for batch in batches
                  for row in zip(*(c.to_pylist() for c in batch.columns))]
        for round_ in range(settings.rounds if blocks else 0):
            drawn = [*map(_drawn(settings, round_, absolute), blocks)]

            def sums_of(tree, active, round_=round_, drawn=drawn):
                return {node: _node_split(node, sums, settings, round_)
                        for node, sums in _target_sums(drawn, tree, active, n_bins)}

            tree = _regression_tree(sums_of, settings, round_, features)
            blocks = [*map(_guessed(tree), blocks)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([round_], pa.int32()), *[pa.array([getattr(tree, name)], pa.list_(kind)) for name, kind in (
                    ("feature", pa.int32()), ("bin", pa.int32()), ("left", pa.int32()), ("value", pa.float64()))]],
                ["round", "feature", "bin", "left", "value"])

    found = table.mapInArrow(
        run, "round int, feature array<int>, bin array<int>, left array<int>, value array<double>").collect()
    return [GrowingTree(*(list(row[k]) for k in ("feature", "bin", "left", "value")))
            for row in sorted(found, key=lambda r: r["round"])]


def with_sum(rows: DataFrame, trees: list[tuple], depth: int, x: str = "x", name: str = "predicted") -> DataFrame:
    """Rows with the sum of the trees' values, as ``walked`` gives it."""
    forest = [[dict(zip(("feature", "threshold", "left", "value"), t)) for t in trees]]
    scored = F.arrow_udf(_margins(forest, depth), "array<double>")
    return rows.withColumn(name, F.get(scored(F.col(x).cast("array<double>")), F.lit(0)))


# --- scoring by expressions --------------------------------------------------------------


def walked(trees: Column, x: Column, depth: int) -> Column:
    """Sum of the values that a row's features lead to, over an array of ``TREE``."""
    def value(tree: Column) -> Column:
        def step(node: Column, _: Column) -> Column:
            feature = F.get(tree["feature"], node)
            right = F.get(x, feature) > F.get(tree["threshold"], node)
            return F.when(feature < 0, node).otherwise(F.get(tree["left"], node) + right.cast("int"))
        return F.get(tree["value"], F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step))
    return F.aggregate(trees, F.lit(0.0), lambda total, tree: total + value(tree))


ROWS_AT_ONCE = 256


def _margins(forest: list, depth: int) -> Callable:
    """Sums of the values that rows lead to, per label, as ``walked`` gives them: all trees of a
    label step together, for some rows at a time."""
    tables = []
    for trees in forest:
        sizes = [len(t["feature"]) for t in trees]
        start = np.cumsum([0, *sizes[:-1]]).astype(np.int64) if trees else np.zeros(0, np.int64)
        feature, threshold, left, value = (
            np.concatenate([np.asarray(t[name], kind) for t in trees]) if trees else np.zeros(0, kind)
            for name, kind in (("feature", np.int64), ("threshold", float), ("left", np.int64), ("value", float)))
        tables.append((start, feature, threshold, left + np.repeat(start, sizes), value))
    width = max((int(f.max(initial=-1)) for _, f, *_ in tables), default=-1) + 1

    def run(x: pa.Array) -> pa.Array:
        n, k = len(x), len(tables)
        sizes = np.asarray(pc.fill_null(pc.list_value_length(x), 0), np.int64)
        flat = x.flatten()
        row = np.repeat(np.arange(n), sizes)
        column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        grid, absent = np.zeros((n, max(1, width))), np.ones((n, max(1, width)), bool)
        kept = column < width
        grid[row[kept], column[kept]] = np.asarray(flat.fill_null(0.0), float)[kept]
        absent[row[kept], column[kept]] = np.asarray(flat.is_null())[kept]
        odd = np.isnan(grid)
        out, unknown = np.zeros((n, k)), np.zeros((n, k), bool)
        for c, (start, feature, threshold, left, value) in enumerate(tables):
            for low in range(0, n if len(start) else 0, ROWS_AT_ONCE):
                part = slice(low, low + ROWS_AT_ONCE)
                some, gone, nan = grid[part], absent[part], odd[part]
                at = np.arange(len(some))[:, None]
                node, lost = np.tile(start, (len(some), 1)), np.zeros(len(some), bool)
                for _ in range(depth):
                    f = feature[node]
                    inner, f = f >= 0, np.maximum(f, 0)
                    cut = threshold[node]
                    right = some[at, f] > cut
                    if nan.any():  # as in Spark, greater than any number
                        right |= nan[at, f] & ~np.isnan(cut)
                    if gone.any():
                        lost |= (inner & gone[at, f]).any(axis=1)
                    node = np.where(inner, left[node] + right, node)
                # In the order of the trees, as a fold over them adds.
                out[part, c] = value[node].cumsum(axis=1)[:, -1]
                unknown[part, c] = lost
        values = pa.array(out.ravel(), mask=unknown.ravel())
        return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, max(1, k), dtype=np.int32)[:n + 1]
                                                 if k else np.zeros(n + 1, np.int32)), values)
    return run


def with_chances(rows: DataFrame, model: ClassTrees, x: str = "x", name: str = "chances") -> DataFrame:
    """Rows with the probabilities of all labels, in the order of the labels.

    The forest (its size is bounded by rounds, labels and depth) travels with the tasks.
    """
    margins, e = F.col("_margins"), F.col("_e")
    forest = [[t.asDict() for t in trees] for trees in model.trees.select("forest").first()["forest"]]
    scored = F.arrow_udf(_margins(forest, model.depth), "array<double>")
    return (
        rows.withColumn("_margins", scored(F.col(x).cast("array<double>")))
        .withColumn("_e", F.transform(margins, lambda m: F.exp(m - F.array_max(margins))))
        .withColumn(name, F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))
        .drop("_margins", "_e"))


def saved_classes(model: ClassTrees) -> DataFrame:
    """The model as a table of one row."""
    return model.trees.withColumns({
        "labels": F.array(*map(F.lit, model.labels)), "rounds": F.lit(model.rounds),
        "depth": F.lit(model.depth)})


def loaded_classes(table: DataFrame) -> ClassTrees:
    row = table.select("labels", "rounds", "depth").first()
    return ClassTrees(list(row["labels"]), table.select("forest"), row["rounds"], row["depth"])



# --- many small models --------------------------------------------------------------------

ROWS_PER_GROUP = 1 << 13
ROWS_PER_MANY_TASK = 1 << 13
KEYS_PER_BATCH = 64


@dataclass
class _Nodes:
    """Nodes of one round's trees of many keys; the roots come first, in key order."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    owner: np.ndarray

    @classmethod
    def roots(cls, values: np.ndarray) -> _Nodes:
        n = len(values)
        return cls(np.full(n, -1, np.int32), np.zeros(n), np.zeros(n, np.int32), values, np.arange(n))

    def split(self, at: np.ndarray, feature: np.ndarray, threshold: np.ndarray, values: np.ndarray) -> None:
        """Part the nodes; ``values`` has a pair for each, the left one first."""
        self.feature[at], self.threshold[at] = feature, threshold
        self.left[at] = len(self.feature) + 2 * np.arange(len(at))
        new = 2 * len(at)
        self.feature = np.concatenate([self.feature, np.full(new, -1, np.int32)])
        self.threshold = np.concatenate([self.threshold, np.zeros(new)])
        self.left = np.concatenate([self.left, np.zeros(new, np.int32)])
        self.value = np.concatenate([self.value, values.ravel()])
        self.owner = np.concatenate([self.owner, np.repeat(self.owner[at], 2)])

    def of(self, first: int, end: int) -> _Nodes:
        """The nodes of some keys, with places of their own."""
        mine = (self.owner >= first) & (self.owner < end)
        place = np.cumsum(mine, dtype=np.int32) - 1
        left = np.where(self.feature[mine] >= 0, place[self.left[mine]], 0)
        return _Nodes(self.feature[mine], self.threshold[mine], left, self.value[mine], self.owner[mine] - first)

    def step(self, node: np.ndarray, x: np.ndarray) -> np.ndarray:
        f = self.feature[node]
        right = x[np.arange(len(x)), f] > self.threshold[node]
        return np.where(f < 0, node, self.left[node] + right)


def _many_columns(settings: BoostSettings, round_: int, keys: np.ndarray, features: int) -> np.ndarray:
    draw = draws(settings.seed + 1, round_, keys[:, None] * np.int64(features) + np.arange(features))
    rank = draw.argsort(axis=1, kind="stable").argsort(axis=1)
    return rank < max(1, int(features * settings.column_share))


def _best_of_nodes(node, columns, gradient, order, allowed, settings):
    """Per node the best split over all features: gain, feature, threshold, left sums.

    ``columns`` has a line of values a feature, and ``order`` lists in the same line the rows by node
    and then by value. All features are looked at in one step.
    """
    in_order = node[order[0]]
    first = np.flatnonzero(np.diff(in_order, prepend=-1))
    nodes = in_order[first]
    sizes = np.diff(np.append(first, len(in_order)))
    of = np.repeat(np.arange(len(nodes)), sizes)
    count = np.arange(1, len(in_order) + 1) - first[of]
    rest = sizes[of] - count
    g = gradient[order]
    total = np.add.reduceat(g[0], first)
    value = np.take_along_axis(columns, order, 1)
    sums = np.cumsum(g, axis=1)
    sums -= (sums[:, first] - g[:, first])[:, of]
    gain = sums ** 2 / (count + settings.ridge)
    gain += (total[of] - sums) ** 2 / (rest + settings.ridge)
    gain -= (total ** 2 / (sizes + settings.ridge))[of]
    good = allowed[nodes].T[:, of]
    good &= (rest > 0) & (count >= settings.least_weight) & (rest >= settings.least_weight)
    good[:, :-1] &= value[:, :-1] < value[:, 1:]
    gain[~good] = -np.inf
    best = np.full(len(nodes), 1e-9)
    feature = np.full(len(nodes), -1, np.int32)
    most_of = np.maximum.reduceat(gain, first, axis=1)
    for f, most in enumerate(most_of):
        better = most > best + 1e-12
        best[better], feature[better] = most[better], f
    threshold, left_sum, left_count = (np.zeros(len(nodes)) for _ in range(3))
    parted = np.flatnonzero(feature >= 0)
    if len(parted):
        f = feature[of]
        # The first of equal gains; a node that is not parted has no gain like its best.
        hit = np.flatnonzero(gain[f, np.arange(len(of))] == best[of])
        at = hit[np.searchsorted(hit, first[parted])]
        f = feature[parted]
        threshold[parted], left_sum[parted], left_count[parted] = value[f, at], sums[f, at], count[at]
    return nodes, sizes, total, feature, threshold, left_sum, left_count


def _many_round(x, columns, gradient, owner, used, order, allowed, base, settings) -> _Nodes:
    """One round's trees of all keys, from the rows drawn for it."""
    counts = np.bincount(owner[used], minlength=base)
    sums = np.bincount(owner[used], gradient[used], base)
    nodes = _Nodes.roots(-sums / (counts + settings.ridge) * settings.rate)
    node = owner.copy()
    live = used
    for _ in range(settings.depth):
        order = order[live[order]].reshape(len(order), -1)
        if not order.size:
            break
        # Few nodes fit in 16 bits, whose stable sort counts instead of comparing.
        by_node = node.astype(np.int16) if len(nodes.feature) < 1 << 15 else node
        order = np.take_along_axis(order, by_node[order].argsort(axis=1, kind="stable"), 1)
        at, sizes, total, feature, threshold, left, count = _best_of_nodes(
            node, columns, gradient, order, allowed[nodes.owner], settings)
        split = feature >= 0
        if not split.any():
            break
        low, low_n, all_, all_n = left[split], count[split], total[split], sizes[split]
        nodes.split(at[split], feature[split], threshold[split], np.stack([
            -low / (low_n + settings.ridge), -(all_ - low) / (all_n - low_n + settings.ridge)], axis=1) * settings.rate)
        is_split = np.zeros(len(nodes.feature), bool)
        is_split[at[split]] = True
        live = live & is_split[node]
        node = np.where(live, nodes.step(node, x), node)
    return nodes


def grown_together(keys: np.ndarray, owner: np.ndarray, place: np.ndarray, x: np.ndarray, y: np.ndarray,
                   settings: BoostSettings) -> tuple[np.ndarray, list[_Nodes]]:
    """Base values (means) of the keys, and the nodes of every round."""
    base = np.bincount(owner, y, len(keys)) / np.bincount(owner, minlength=len(keys))
    guess = base[owner]
    columns = np.ascontiguousarray(x.T)
    order = np.stack([np.lexsort((column, owner)) for column in columns])
    ids = keys[owner] * np.int64(1 << 20) + place
    rounds = []
    for round_ in range(settings.rounds):
        used = draws(settings.seed, round_, ids) < settings.row_share
        nodes = _many_round(x, columns, guess - y, owner, used, order,
                            _many_columns(settings, round_, keys, x.shape[1]), len(keys), settings)
        node = owner
        for _ in range(settings.depth):
            node = nodes.step(node, x)
        guess = guess + nodes.value[node]
        rounds.append(nodes)
    return base, rounds


def _tree_lists(rounds: list[_Nodes], keys: int) -> pa.Array:
    """Per key an array of its trees, one a round, each with places of its own."""
    owner = np.concatenate([r.owner for r in rounds])
    turn = np.repeat(np.arange(len(rounds)), [len(r.owner) for r in rounds])
    order = np.lexsort((turn, owner))  # stable: nodes of a tree keep their order
    tree = owner[order] * len(rounds) + turn[order]
    ends = np.searchsorted(tree, np.arange(keys * len(rounds) + 1)).astype(np.int32)
    start_of = np.cumsum([0] + [len(r.owner) for r in rounds])[:-1]
    local = np.empty(len(order), np.int64)
    local[order] = np.arange(len(order)) - np.repeat(ends[:-1], np.diff(ends))
    flat = {name: np.concatenate([getattr(r, name) for r in rounds]) for name in (
        "feature", "threshold", "left", "value")}
    shifted = flat["left"] + np.repeat(start_of, [len(r.owner) for r in rounds])
    flat["left"] = np.where(flat["feature"] >= 0, local[shifted], 0).astype(np.int32)
    arrays = [pa.ListArray.from_arrays(ends, pa.array(flat[name][order]))
              for name in ("feature", "threshold", "left", "value")]
    trees = pa.StructArray.from_arrays(arrays, ["feature", "threshold", "left", "value"])
    return pa.ListArray.from_arrays(np.arange(0, keys * len(rounds) + 1, len(rounds), dtype=np.int32), trees)


def _by_groups(answered: Callable) -> Callable:
    """Runs ``answered`` on the rows of many whole keys at a time; rows come sorted by key. Rows without a
    place are not fitted and do not count, so that keys are grown in the same company with them and without."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            # Whole keys are taken, the last one waits for the rest.
            while batch.num_rows:
                take = min(batch.num_rows, max(1, ROWS_PER_GROUP - rows))
                held.append(batch.slice(0, take))
                batch, rows = batch.slice(take), rows + take - held[-1].column("place").null_count
                if rows < ROWS_PER_GROUP:
                    continue
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                key = whole.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield from answered(whole.slice(0, cut))
                held = [whole.slice(cut)]
                rows = len(key) - cut - held[0].column("place").null_count
                if not cut:  # one key fills the group: it goes on growing
                    rows = 0
        if held and sum(b.num_rows for b in held):
            yield from answered(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
    return run


def _grown(batch: pa.RecordBatch, settings: BoostSettings) -> tuple[np.ndarray, np.ndarray, list[_Nodes]]:
    """The keys of a batch, their base values, and the nodes of every round."""
    key = batch.column("key").to_numpy()
    keys, owner = np.unique(key, return_inverse=True)
    x = batch.column("x").flatten().to_numpy().reshape(len(key), -1)
    return keys, *grown_together(
        keys, owner, batch.column("place").to_numpy(), x, batch.column("y").to_numpy(), settings)


def _fit_groups(settings: BoostSettings) -> Callable:
    def fitted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, base, rounds = _grown(batch, settings)
        # A model is tens of kilobytes: a few are laid out and handed on at a time.
        for first in range(0, len(keys), KEYS_PER_BATCH):
            end = min(first + KEYS_PER_BATCH, len(keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[first:end]), pa.array(base[first:end]),
                 _tree_lists([r.of(first, end) for r in rounds], end - first)], ["key", "base", "trees"])

    return _by_groups(fitted)


def _rows_to_fit(rows: DataFrame, key: str, y: str, order: str) -> DataFrame:
    return rows.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("place"),
                       "x", F.col(y).cast("double").alias("y"))


def fit_many(rows: DataFrame, settings: BoostSettings = BoostSettings(), key: str = "key",
             y: str = "y", order: str = "place") -> DataFrame:
    """One squared-loss model a key, on the array ``x`` and ``y``: ``key``, ``base``, ``trees``.

    A key's rows are held by one task, so keys must be small (a product has a row a month).
    The draws of rows are hashes of key, place in ``order`` and round.
    """
    return _rows_to_fit(rows, key, y, order).repartition("key").sortWithinPartitions("key", "place").mapInArrow(
        _fit_groups(settings), f"key long, base double, trees array<{TREE}>").withColumnRenamed("key", key)


class ManyModels:
    """The models of some keys, while the task that grew them holds them."""

    def __init__(self, keys: np.ndarray, base: np.ndarray, rounds: list[_Nodes], depth: int):
        self.keys, self.base, self.rounds, self.depth = keys, base, rounds, depth

    def guess(self, key: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Base and sum of the trees, as ``walked`` adds it; NaN for a key without a model, and where
        a tree asks for a feature that is absent, which NaN stands for."""
        out = np.full(len(key), np.nan)
        if not len(self.keys):
            return out
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        mine = np.flatnonzero(self.keys[at] == key)
        root, x, total = at[mine], x[mine], np.zeros(len(mine))
        lost, some = np.zeros(len(mine), bool), bool(np.isnan(x).any())
        rows = np.arange(len(mine))
        for nodes in self.rounds:
            node = root
            for _ in range(self.depth):
                if some:
                    f = nodes.feature[node]
                    lost |= (f >= 0) & np.isnan(x[rows, f])
                node = nodes.step(node, x)
            total += nodes.value[node]
        out[mine] = np.where(lost, np.nan, self.base[root] + total)
        return out


def _answer_groups(answer: Callable, settings: BoostSettings) -> Callable:
    def answered(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        asked = batch.column("place").is_null()
        given = batch.filter(asked).column("given")
        if not len(given):
            return
        known = batch.filter(pc.invert(asked))
        keys, base, rounds = _grown(known, settings) if known.num_rows else (np.zeros(0, np.int64), None, [])
        yield answer(ManyModels(keys, base, rounds, settings.depth), pa.RecordBatch.from_struct_array(given))

    return _by_groups(answered)


def answered_by_many(rows: DataFrame, asked: DataFrame, answer: Callable, schema: str | T.StructType,
                     settings: BoostSettings = BoostSettings(), key: str = "key", y: str = "y",
                     order: str = "place") -> DataFrame:
    """What ``answer`` makes of the rows of ``asked``, by the models of ``fit_many``.

    A key's rows meet in the task that grows its model, which is dropped once they are answered:
    models take far more room than the rows they are fitted to. ``answer`` gets the ``ManyModels`` of
    some keys and the asked rows of these keys.
    """
    known = _rows_to_fit(rows, key, y, order).where("place is not null")
    tasks = max(1, -(-known.count() // ROWS_PER_MANY_TASK))
    given = asked.select(
        F.col(key).cast("long").alias("key"), F.lit(None).cast("long").alias("place"),
        F.lit(None).cast("array<double>").alias("x"), F.lit(None).cast("double").alias("y"),
        F.struct("*").alias("given"))
    both = known.withColumn("given", F.lit(None).cast(given.schema["given"].dataType)).unionByName(given)
    return both.repartition(tasks, "key").sortWithinPartitions("key", "place").mapInArrow(
        _answer_groups(answer, settings), schema)
