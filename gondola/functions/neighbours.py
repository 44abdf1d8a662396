"""Exact nearest neighbours within a class, without comparing all pairs.

Cells come from repeated median cuts of a bounded sample, each along the direction in which
its points spread most, and every cell has the bounding box of its points in the full
space. A point looks in its own cell first and then in others by the distance of their
boxes, in waves of growing width; after each wave it keeps its k nearest so far, and a
cell whose box is farther than the k-th of them is never visited. Cells, and the points
that visit one, are cut into chunks of bounded size, and a task hands on at most k rows for
a visiting point, only those that improve on what it had.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gondola.functions.columns import hash_key, hash_uniform
from gondola.functions.lineage import cut_lineage

CELL_POINTS = 500
CHUNK_POINTS = 4_000
MOST_CELLS = 4_096
SAMPLE_POINTS = 20_000
ROWS_AT_ONCE = 64
FIRST_WAVE, WAVE_GROWTH = 1, 4
CELL = ["label", "cell"]


def _median_cuts(sample: np.ndarray, leaves: int) -> dict[str, np.ndarray]:
    """A binary tree over the space: direction and place of each cut, children, leaf number."""
    nodes: list[list[float]] = []
    n_leaves = 0

    def grow(rows: np.ndarray, wanted: int) -> int:
        nonlocal n_leaves
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, -1])
        if wanted > 1 and len(rows) > 1:
            axis = int(np.argmax(rows.std(axis=0)))
            place = float(np.quantile(rows[:, axis], (wanted // 2) / wanted))
            left = rows[:, axis] < place
            if left.any() and not left.all():
                nodes[at][:2] = [axis, place]
                nodes[at][2] = grow(rows[left], wanted // 2)
                nodes[at][3] = grow(rows[~left], wanted - wanted // 2)
                return at
        nodes[at][4] = n_leaves
        n_leaves += 1
        return at

    grow(sample, leaves)
    table = np.array(nodes)
    return {"axis": table[:, 0].astype(int), "place": table[:, 1],
            "left": table[:, 2].astype(int), "right": table[:, 3].astype(int),
            "leaf": table[:, 4].astype(int)}


def _cuts_by_label(points: DataFrame, cell_points: int) -> dict[str, dict[str, np.ndarray]]:
    """Trees from about ``SAMPLE_POINTS`` points of each label, drawn by hash."""
    # One count per class.
    sizes = {r["label"]: r["n"] for r in points.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(v) for label, n in sizes.items() for v in (
        label, min(1.0, SAMPLE_POINTS / n))])
    drawn = points.where(hash_uniform(5, "point_id") <= share[F.col("label")]).select("label", "x").toPandas()
    out = {}
    for label, n in sizes.items():
        rows = drawn.loc[drawn["label"] == label, "x"]
        sample = np.stack(rows.to_numpy()) if len(rows) else np.zeros((0, 1))
        out[label] = _median_cuts(sample, min(MOST_CELLS, max(1, -(-n // cell_points))))
    return out


def _task_functions(k: int, trees: dict, boxes: dict | None = None):
    """Functions that run inside tasks. They are closures, so Spark ships them whole and
    workers need not have this package."""
    def place(frames):
        for frame in frames:
            cells = np.zeros(len(frame), np.int64)
            for label, rows in frame.groupby("label").indices.items():
                tree, x = trees[label], np.stack(frame["x"].to_numpy()[rows])
                node = np.zeros(len(rows), int)
                while True:
                    axis = tree["axis"][node]
                    open_ = np.flatnonzero(axis >= 0)
                    if not open_.size:
                        break
                    at = node[open_]
                    left = x[open_, axis[open_]] < tree["place"][at]
                    node[open_] = np.where(left, tree["left"][at], tree["right"][at])
                cells[rows] = tree["leaf"][node]
            frame["cell"] = cells
            yield frame

    def visits(first: int, end: int):
        """Cells number first..end in each point's order, own first and then by distance."""
        def run(frames):
            for frame in frames:
                for start in range(0, len(frame), ROWS_AT_ONCE):
                    some = frame.iloc[start:start + ROWS_AT_ONCE]
                    for label, part in some.groupby("label"):
                        cells, low, high = boxes[label]
                        x = np.stack(part["x"].to_numpy())[:, None, :]
                        gap = np.maximum(np.maximum(low - x, x - high), 0.0)
                        away = np.sqrt((gap * gap).sum(axis=2))
                        away[part["cell"].to_numpy()[:, None] == cells] = -1.0
                        order = np.argsort(away, axis=1, kind="stable")[:, first:end]
                        away = np.take_along_axis(away, order, axis=1)
                        # A little slack for rounding; a tie may still have the lesser key.
                        near = away <= (part["radius"].to_numpy() * (1 + 1e-9) + 1e-9)[:, None]
                        row, column = np.nonzero(near)
                        if len(row):
                            yield pd.DataFrame({
                                "label": label, "cell": cells[order[row, column]],
                                "point_id": part["point_id"].to_numpy()[row],
                                "x": part["x"].to_numpy()[row], "radius": part["radius"].to_numpy()[row]})
        return run

    def nearest(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        """The k nearest other points of each query within its radius, ties by id."""
        columns = ["point_id", "neighbour_id", "distance"]
        if queries.empty or points.empty:
            return pd.DataFrame(columns=columns)
        points = points.sort_values("other_id")
        ids, grid = points["other_id"].to_numpy(), np.stack(points["y"].to_numpy())
        found = []
        for start in range(0, len(queries), ROWS_AT_ONCE):
            some = queries.iloc[start:start + ROWS_AT_ONCE]
            own = some["point_id"].to_numpy()
            gap = np.stack(some["x"].to_numpy())[:, None, :] - grid[None, :, :]
            distance = np.sqrt((gap * gap).sum(axis=2))
            distance[own[:, None] == ids[None, :]] = np.inf
            order = np.argsort(distance, axis=1, kind="stable")[:, :k]
            reached = np.take_along_axis(distance, order, axis=1)
            use = np.isfinite(reached) & (reached <= some["radius"].to_numpy()[:, None])
            row, column = np.nonzero(use)
            found.append(pd.DataFrame({
                "point_id": own[row], "neighbour_id": ids[order[row, column]],
                "distance": reached[row, column]}))
        return pd.concat(found)

    return place, visits, nearest


def _boxes(placed: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cells of each label with their boxes: at most ``MOST_CELLS`` rows a label."""
    first = placed.select(F.size("x").alias("d")).first()
    sides = range(first["d"] if first else 0)
    rows = placed.groupBy(*CELL).agg(
        F.array(*[F.min(F.col("x")[i]) for i in sides]).alias("low"),
        F.array(*[F.max(F.col("x")[i]) for i in sides]).alias("high")).orderBy(*CELL).collect()
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r["label"], []).append((r["cell"], r["low"], r["high"]))
    return {label: (np.array([c for c, _, _ in found]), np.array([low for _, low, _ in found]),
                    np.array([high for _, _, high in found])) for label, found in out.items()}


def nearest_in_class(
    points: DataFrame, wanted: DataFrame, k: int,
    cell_points: int = CELL_POINTS, chunk_points: int = CHUNK_POINTS,
    compared: list[int] | None = None,
) -> DataFrame:
    """The ``k`` nearest other points of the same label, for the ``wanted`` points.

    ``points`` has distinct rows of ``label``, ``point_id`` and ``x``; ``wanted`` has
    ``point_id``. Returns ``point_id``, ``neighbour_id`` and ``distance``; fewer than
    ``k`` rows where a label has no more points. The number of pairs compared in each wave
    is appended to ``compared``, if given.
    """
    rows = points.select("label", "point_id", "x")
    place, _, nearest = _task_functions(k, _cuts_by_label(rows, cell_points))
    placed = cut_lineage(rows.mapInPandas(
        place, "label string, point_id bigint, x array<double>, cell bigint"))
    boxes = _boxes(placed)
    _, visits, _ = _task_functions(k, {}, boxes)
    most = max((len(cells) for cells, _, _ in boxes.values()), default=0)

    sizes = placed.groupBy(*CELL).agg(
        F.count("*").alias("n"), F.ceil(F.count("*") / chunk_points).cast("int").alias("chunks"))
    chunked = placed.join(sizes, CELL).select(
        *CELL, F.pmod(hash_key(2, "point_id"), F.col("chunks")).cast("int").alias("chunk"),
        F.col("point_id").alias("other_id"), F.col("x").alias("y"))
    asked = placed.join(wanted.select("point_id").distinct(), "point_id", "left_semi")
    found = points.sparkSession.createDataFrame(
        [], "point_id bigint, neighbour_id bigint, distance double")
    best = Window.partitionBy("point_id").orderBy("distance", "neighbour_id")
    lane = F.pmod(hash_key(3, "point_id"), F.col("lanes")).cast("int")
    work = [*CELL, "chunk", "lane"]
    first, width = 0, FIRST_WAVE
    while first < most:
        radius = found.groupBy("point_id").agg(
            F.when(F.count("*") >= k, F.max("distance")).alias("radius"))
        state = asked.join(radius, "point_id", "left").withColumn(
            "radius", F.coalesce("radius", F.lit(float("inf"))))
        going = cut_lineage(state.select("label", "cell", "point_id", "x", "radius").mapInPandas(
            visits(first, first + width),
            "label string, cell bigint, point_id bigint, x array<double>, radius double"))
        if compared is not None:
            compared.append(going.join(sizes, CELL).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        if going.isEmpty():  # cells come by distance, so nothing lies near enough any more
            break
        lanes = going.groupBy(*CELL).agg(
            F.ceil(F.count("*") / chunk_points).cast("int").alias("lanes"))
        busy = sizes.join(lanes, CELL)
        queries = going.join(busy, CELL).withColumn("lane", lane).withColumn(
            "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
            *work, "point_id", "x", "radius")
        others = chunked.join(lanes, CELL).withColumn(
            "lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))).select(
            *work, "other_id", "y").toDF(*[f"c_{name}" for name in work], "other_id", "y")
        pairs = queries.groupBy(*work).cogroup(
            others.groupBy(*[f"c_{name}" for name in work])
        ).applyInPandas(nearest, "point_id bigint, neighbour_id bigint, distance double")
        found = cut_lineage(found.union(pairs).withColumn("_r", F.row_number().over(best)).filter(
            F.col("_r") <= k).drop("_r"))
        first, width = first + width, width * WAVE_GROWTH
    return found
