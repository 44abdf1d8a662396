"""Boosted trees: splits against plain search, both ways to fit, scores from saved tables in SQL."""

import math
import random
from dataclasses import replace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gondola.functions import boosting
from gondola.functions.boosting import BoostSettings

EXACT = BoostSettings(rounds=6, depth=3, rate=0.3, row_share=1.0, column_share=1.0, least_weight=0.0)


def rows_of(n, seed=5):
    draw = random.Random(seed)
    out = []
    for k in range(n):
        x = [draw.random(), float(draw.randrange(4)), draw.gauss(0, 3)]
        label = "high" if x[2] > 2 else "low" if x[0] + x[1] / 4 < 0.6 else "mid"
        out.append((k, label if draw.random() < 0.95 else "mid", x))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "row_id long, label string, x array<double>")


def plain_tree(x, g, h, rate, ridge, depth):
    """The same greedy tree by trying every value of every feature."""
    total = g.sum(), h.sum()
    if depth:
        best = (1e-9, None)
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= cut
                parts = [(g[m].sum(), h[m].sum()) for m in (left, ~left)]
                gain = sum(a * a / (b + ridge) for a, b in parts) - total[0] ** 2 / (total[1] + ridge)
                if gain > best[0] + 1e-12:
                    best = (gain, (f, cut, left))
        if best[1]:
            f, cut, left = best[1]
            low, high = (plain_tree(x[m], g[m], h[m], rate, ridge, depth - 1) for m in (left, ~left))
            return lambda r: low(r) if r[f] <= cut else high(r)
    return lambda r: -total[0] / (total[1] + ridge) * rate


def plain_chances(rows, settings):
    x, labels = np.array([r[2] for r in rows]), sorted({r[1] for r in rows})
    y = np.array([labels.index(r[1]) for r in rows])
    margins = np.zeros((len(rows), len(labels)))
    for _ in range(settings.rounds):
        p = np.exp(margins - margins.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for c in range(len(labels)):
            g, h = p[:, c] - (y == c), 2 * p[:, c] * (1 - p[:, c])
            tree = plain_tree(x, g, h, settings.rate, settings.ridge, settings.depth)
            margins[:, c] += [tree(r) for r in x]
    p = np.exp(margins - margins.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def chances(model, rows):
    got = {r.row_id: r.chances for r in boosting.with_chances(rows, model).collect()}
    return np.array([got[k] for k in sorted(got)])


def test_trees_are_those_of_plain_search(spark):
    rows = rows_of(120)
    model = boosting.fit_classes(frame(spark, rows), EXACT)
    assert model.labels == ["high", "low", "mid"] and model.rounds == 6
    assert np.allclose(chances(model, frame(spark, rows)), plain_chances(rows, EXACT))


@pytest.mark.parametrize("settings", [EXACT, BoostSettings(rounds=23, depth=4, rate=0.2)])
def test_jobs_give_the_trees_of_one_task(spark, monkeypatch, settings):
    table = frame(spark, rows_of(900)).repartition(3)
    alone = chances(boosting.fit_classes(table, settings), table)
    monkeypatch.setattr(boosting, "ROWS_PER_BLOCK", 200)
    blocks = boosting.fit_classes(table.repartition(5), settings)
    assert np.allclose(chances(blocks, table), alone)


SCORED_IN_SQL = """
WITH RECURSIVE trees AS (
  SELECT label, tree, t.* FROM (
    SELECT label, unnest(range(len(ts))) AS tree, unnest(ts) AS t
    FROM (SELECT unnest(range(len(forest))) AS label, unnest(forest) AS ts FROM model))),
walk AS (
  SELECT row_id, x, trees.label, tree, 0 AS node FROM scored, trees
  UNION ALL
  SELECT w.row_id, w.x, w.label, w.tree,
         t."left"[w.node + 1] + (w.x[t.feature[w.node + 1] + 1] > t.threshold[w.node + 1])::INT
  FROM walk w JOIN trees t USING (label, tree) WHERE t.feature[w.node + 1] >= 0),
ends AS (
  SELECT w.row_id, w.label, sum(t.value[w.node + 1]) AS margin
  FROM walk w JOIN trees t USING (label, tree) WHERE t.feature[w.node + 1] < 0 GROUP BY ALL)
SELECT row_id, list(exp(margin) ORDER BY label) AS e FROM ends GROUP BY row_id ORDER BY row_id
"""


def test_saved_trees_scored_in_sql(spark, tmp_path):
    table = frame(spark, rows_of(300))
    model = boosting.fit_classes(table, BoostSettings(rounds=15, depth=6, rate=0.3))
    boosting.saved_classes(model).coalesce(1).write.parquet(str(tmp_path / "model"))
    table.coalesce(1).write.parquet(str(tmp_path / "rows"))
    again = boosting.loaded_classes(spark.read.parquet(str(tmp_path / "model")))
    assert (again.labels, again.rounds, again.depth) == (model.labels, model.rounds, 6)
    want = chances(model, table)
    assert (chances(again, table) == want).all()
    con = duckdb.connect()
    for name, folder in (("model", "model"), ("scored", "rows")):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{folder}/*.parquet')")
    e = np.array([r[1] for r in con.execute(SCORED_IN_SQL).fetchall()])
    assert np.allclose(e / e.sum(axis=1, keepdims=True), want)


def plain_many(x, y, key, place, settings):
    """One key's boosted guesses by trying every value of every feature."""
    guess = np.full(len(y), y.mean())

    def tree(rows, g, depth, allowed):
        total, n, best = g[rows].sum(), len(rows), (1e-9, None)
        for f in np.flatnonzero(allowed) if depth else []:
            for cut in np.unique(x[rows, f])[:-1]:
                parts = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                gain = sum(g[p].sum() ** 2 / (len(p) + settings.ridge) for p in parts) - total ** 2 / (n + settings.ridge)
                if min(map(len, parts)) >= settings.least_weight and gain > best[0] + 1e-12:
                    best = gain, (f, cut, *parts)
        if best[1]:
            f, cut, low, high = best[1]
            low, high = (tree(p, g, depth - 1, allowed) for p in (low, high))
            return lambda r: low(r) if r[f] <= cut else high(r)
        return lambda r: -total / (n + settings.ridge) * settings.rate

    for round_ in range(settings.rounds):
        ids = np.int64(key) * np.int64(1 << 20) + place
        used = np.flatnonzero(boosting.draws(settings.seed, round_, ids) < settings.row_share)
        allowed = boosting._many_columns(settings, round_, np.array([key]), x.shape[1])[0]
        one = tree(used, guess - y, settings.depth, allowed)
        guess = guess + [one(r) for r in x]
    return guess


@pytest.mark.parametrize("group", [1 << 13, 20, 3])
def test_many_models_are_those_of_plain_search(spark, monkeypatch, group):
    monkeypatch.setattr(boosting, "ROWS_PER_GROUP", group)
    rng = np.random.default_rng(7)
    settings = BoostSettings(rounds=7, depth=3, rate=0.3)
    sizes = {3: 12, 7: 1, 8: 30, 20: 5, 21: 2, 50: 17, 51: 9}
    series = {k: (np.round(rng.normal(size=(n, 4)), 1), rng.normal(size=n) * 10) for k, n in sizes.items()}
    rows = [(k, p, x[p].tolist(), float(y[p])) for k, (x, y) in series.items() for p in range(len(y))]
    table = spark.createDataFrame(rows, "key long, place long, x array<double>, y double").repartition(4)
    models = boosting.fit_many(table, settings)
    got = table.join(models, "key").withColumn(
        "guess", F.col("base") + boosting.walked(F.col("trees"), F.col("x"), settings.depth)).collect()
    assert models.count() == len(sizes)
    found = {(r.key, r.place): r.guess for r in got}
    for k, (x, y) in series.items():
        want = plain_many(x, y, k, np.arange(len(y)), settings)
        assert np.allclose([found[k, p] for p in range(len(y))], want)


def test_one_label_and_ties(spark):
    same = frame(spark, [(k, "only", [1.0, 2.0]) for k in range(20)])
    model = boosting.fit_classes(same, EXACT)
    assert model.rounds == 0 and (chances(model, same) == 1.0).all()
    tied = frame(spark, [(k, "ab"[k % 2], [1.0, 2.0]) for k in range(20)])
    assert np.allclose(chances(boosting.fit_classes(tied, EXACT), tied), 0.5)


def test_learning_reaches_held_out_rows(spark):
    train, rest = frame(spark, rows_of(1500)), rows_of(500, seed=6)
    model = boosting.fit_classes(train, BoostSettings(rounds=60, rate=0.1))
    got = chances(model, frame(spark, rest))
    hit = np.mean([model.labels[p.argmax()] == r[1] for p, r in zip(got, rest)])
    assert hit > 0.93  # a twentieth of the labels is noise
    loss = -np.mean([math.log(p[model.labels.index(r[1])]) for p, r in zip(got, rest)])
    assert loss < 0.4


def test_scores_of_one_model_are_those_of_the_walk(spark):
    """Nulls, NaN, short and absent arrays included; all trees of a label step together in tasks."""
    model = boosting.fit_classes(frame(spark, rows_of(300)), BoostSettings(rounds=15, depth=4, rate=0.3))
    odd = frame(spark, [
        *rows_of(40, seed=8), (100, "", [0.5, None, 1.0]), (101, "", [math.nan, 2.0, math.nan]),
        (102, "", [0.2]), (103, "", []), (104, "", None), (105, "", [0.1, 1.0, 0.3, 7.0]),
        (106, "", [math.inf, -math.inf, 0.0])])
    scored = boosting.with_chances(odd, model)
    margins = F.transform("_forest", lambda trees: boosting.walked(trees, F.col("x"), model.depth))
    walked = {r.row_id: r.m for r in odd.withColumn(
        "_forest", model.trees.select("forest").scalar()).select("row_id", margins.alias("m")).collect()}
    forest = [[t.asDict() for t in trees] for trees in model.trees.first()["forest"]]
    told = boosting._margins(forest, model.depth)
    got = {r.row_id: told(pa.array([r.x], pa.list_(pa.float64()))).to_pylist()[0] for r in odd.collect()}
    assert got == walked
    assert "ArrowEvalPython" in scored._jdf.queryExecution().executedPlan().toString()
    sums = {r.row_id: r.chances for r in scored.collect()}
    assert all(None in c or abs(sum(c) - 1) < 1e-12 for c in sums.values()) and len(sums) == len(walked)


def test_the_driver_gets_splits_and_no_sums(spark, monkeypatch):
    """Sums of all blocks meet in tasks, however many blocks there are."""
    got = []
    grow = boosting._grow

    def told(splits_of, *rest):
        def run(*held):
            got.append(splits_of(*held))
            return got[-1]
        return grow(run, *rest)

    monkeypatch.setattr(boosting, "ROWS_PER_BLOCK", 50)
    monkeypatch.setattr(boosting, "_grow", told)
    boosting.fit_classes(frame(spark, rows_of(600)), BoostSettings(rounds=2, depth=4, bins=64))
    assert got and all(np.size(part) <= 2 * 2 ** 4 for found in got for splits in found.values() for part in splits)


def test_models_of_many_keys_are_handed_on_a_few_at_a_time(monkeypatch):
    draw = np.random.default_rng(3)
    keys = np.repeat(np.arange(200), 9)
    batch = pa.RecordBatch.from_arrays([
        pa.array(keys), pa.array(np.tile(np.arange(9), 200)),
        pa.array(draw.random((len(keys), 2)).tolist(), pa.list_(pa.float64())), pa.array(draw.random(len(keys)))],
        ["key", "place", "x", "y"])
    settings = BoostSettings(rounds=5, depth=3)
    given = list(boosting._fit_groups(settings)(iter([batch])))
    assert [b.num_rows for b in given] == [64, 64, 64, 8]
    monkeypatch.setattr(boosting, "KEYS_PER_BATCH", 1000)
    whole = list(boosting._fit_groups(settings)(iter([batch])))
    assert len(whole) == 1 and pa.Table.from_batches(given).to_pylist() == whole[0].to_pylist()


def targets(spark, n, step=None):
    draw = np.random.default_rng(11)
    x = np.round(draw.random((n, 3)) * 40)
    y = np.where(x[:, 0] > 17, 5.0, 1.0) + x[:, 1] / 40 if step is None else np.where(x[:, 0] > step, 5.0, 1.0)
    return spark.createDataFrame([(k, v.tolist(), float(t)) for k, (v, t) in enumerate(zip(x, y))],
                                 "key long, x array<double>, y double")


@pytest.mark.parametrize("absolute", [True, False])
def test_a_regression_by_jobs_and_in_one_task_is_the_same(spark, monkeypatch, absolute):
    table, settings = targets(spark, 500), BoostSettings(rounds=6, depth=3, rate=0.3, bins=32, least_weight=5)
    alone = boosting.fit_regression(table, settings, absolute)
    monkeypatch.setattr(boosting, "ROWS_IN_ONE_TASK", 50)
    monkeypatch.setattr(boosting, "ROWS_PER_WIDE_BLOCK", 60)
    monkeypatch.setattr(boosting, "ROUNDS_PER_TABLE", 4)
    for parts, tasks in ((1, 1), (7, 3)):
        apart = boosting.fit_regression(table.repartition(parts), settings, absolute, tasks)
        assert [t[:3] for t in apart] == [t[:3] for t in alone]
        assert all(np.allclose(a[3], b[3], rtol=0, atol=1e-12) for a, b in zip(apart, alone))


def test_a_regression_splits_where_the_squares_are_least(spark):
    table = targets(spark, 300, step=17)
    settings = BoostSettings(rounds=1, depth=1, row_share=1.0, column_share=1.0, least_weight=1, bins=64)
    (tree,) = boosting.fit_regression(table, settings)
    assert tree[0][0] == 0 and tree[1][0] == 17.0 and np.allclose(tree[3][1:], [1.0, 5.0])
    heavy = boosting.fit_regression(table, replace(settings, least_weight=140))[0]
    assert 140 <= table.filter(F.col("x")[heavy[0][0]] > heavy[1][0]).count() <= 160
    with pytest.raises(ValueError):
        boosting.fit_regression(table.limit(0), settings)


def test_the_driver_gets_splits_of_a_regression_and_no_sums(spark, monkeypatch):
    got, grow = [], boosting._grow

    def told(splits_of, *rest):
        def run(*held):
            got.append(splits_of(*held))
            return got[-1]
        return grow(run, *rest)

    monkeypatch.setattr(boosting, "ROWS_IN_ONE_TASK", 50)
    monkeypatch.setattr(boosting, "_grow", told)
    boosting.fit_regression(targets(spark, 400), BoostSettings(rounds=2, depth=3, bins=64), tasks=4)
    assert got and all(np.size(part) <= 2 * 2 ** 3 for found in got for splits in found.values() for part in splits)


def test_tasks_of_a_round_do_not_grow_with_the_blocks(spark, monkeypatch):
    assert [boosting._block_tasks(n, 12) for n in (0, 1, 20, 160, 2000)] == [1, 1, 20, 24, 63]
    monkeypatch.setattr(boosting, "ROWS_PER_BLOCK", 10)
    given = []
    settings = BoostSettings(rounds=1, depth=2, rate=0.3, bins=64)
    table = frame(spark, rows_of(600))
    monkeypatch.setattr(boosting, "_block_tasks", lambda blocks, cores: given.append(blocks) or 3)
    model = boosting.fit_classes(table, settings)
    tracker = spark.sparkContext.statusTracker()
    last = tracker.getJobInfo(max(tracker.getJobIdsForGroup(None)))
    assert given == [60] and {tracker.getStageInfo(k).numTasks for k in last.stageIds} == {3}
    monkeypatch.undo()
    assert np.allclose(chances(model, table), chances(boosting.fit_classes(table, settings), table))


def test_a_few_blocks_need_no_jobs_by_level(spark, monkeypatch):
    """Rows of a few blocks are fitted in one task; by jobs a round has one a level and no other."""
    table = frame(spark, rows_of(180))
    settings = BoostSettings(rounds=3, depth=2, rate=0.3, bins=64)
    whole = chances(boosting.fit_classes(table, settings), table)
    monkeypatch.setattr(boosting, "ROWS_PER_BLOCK", 50)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup
    before = set(jobs(None))
    few = boosting.fit_classes(table, settings)
    in_one = set(jobs(None)) - before
    monkeypatch.setattr(boosting, "ROWS_PER_BLOCK", 40)
    by_jobs = boosting.fit_classes(table, settings)
    assert len(set(jobs(None)) - before - in_one) <= len(in_one) + 3 * settings.depth
    assert np.allclose(chances(few, table), whole) and np.allclose(chances(by_jobs, table), whole)


def test_places_are_those_of_a_walk_and_half_a_million_rows_need_no_job_by_level(spark):
    draw = np.random.default_rng(4)
    bins = draw.integers(0, 30, (3, 500)).astype(np.uint8)
    tree = boosting.GrowingTree.root()
    open_ = [0]
    for _ in range(200):  # over 256 nodes, which need more than a byte
        node = open_.pop(int(draw.integers(len(open_))))
        open_ += tree.split(node, int(draw.integers(3)), int(draw.integers(29)), (0.0, 0.0))

    def walk(row):
        node = 0
        while tree.feature[node] >= 0:
            node = tree.left[node] + bool(bins[tree.feature[node], row] > tree.bin[node])
        return node

    assert boosting._places(tree, bins).tolist() == [walk(k) for k in range(500)]
    rows = spark.range(500_000).select(
        F.col("id").alias("key"), F.array((F.col("id") % 7).cast("double")).alias("x"),
        (F.col("id") % 7 + F.col("id") % 2).cast("double").alias("y"))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup
    before = len(jobs(None))
    trees = boosting.fit_regression(rows, BoostSettings(rounds=4, depth=3), tasks=8)
    assert len(trees) == 4 and len(jobs(None)) - before < 4 * 3
