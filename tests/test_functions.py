import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gondola.functions import ordering
from gondola.functions.columns import (
    hash_beta,
    hash_normal,
    hash_uniform,
    month_diff,
    pct_change,
    round_half_even,
    round_half_up,
    settled,
)
from gondola.functions.neighbours import nearest_in_class


def test_month_diff_counts_boundaries(spark):
    row = spark.sql("SELECT date'2020-01-31' a, date'2020-03-01' b").select(
        month_diff(F.col("a"), F.col("b")).alias("m")).first()
    assert row.m == 2


def test_rounding_and_change(spark):
    rows = spark.createDataFrame([(2.5, 2.0), (-2.5, 0.0)], "a double, b double").select(
        round_half_up(F.col("a"), 0).alias("r"), pct_change(F.col("a"), F.col("b")).alias("p"))
    assert [tuple(r) for r in rows.collect()] == [(3.0, 25.0), (-3.0, None)]


def test_ties_go_to_the_even_neighbour(spark):
    rows = spark.createDataFrame([(0.125,), (100.125,), (-0.375,), (1e300,), (None,)], "a double")
    got = [r[0] for r in rows.select(round_half_even(F.col("a"), 2)).collect()]
    assert got == [round(x, 2) if x is not None else None for x in (0.125, 100.125, -0.375, 1e300, None)]
    exact = spark.createDataFrame([(98765.4321 + 0.000000001,)], "a double")
    assert exact.select(settled(F.col("a"), 2)).first()[0] == 98765.43


@pytest.mark.parametrize("alpha", [0.2, 0.5, 0.6, 1, 2, 5])
def test_beta_draws_for_every_alpha(spark, alpha):
    rows = spark.range(20_000).select(hash_beta(alpha, 1, "id").alias("b")).toPandas()
    assert rows.b.between(0, 1).all() and (rows.b == 0.5).mean() < 0.001
    assert abs(rows.b.mean() - 0.5) < 0.01
    assert abs(rows.b.std() - (1 / (4 * (2 * alpha + 1))) ** 0.5) < 0.006


def test_rounding_large_values_and_noise(spark):
    rows = spark.createDataFrame([(9e17 + 256, 0.1 * 3 + 0.0), (-1e300, 2.675)],
                                 "a double, b double").select(
        round_half_up(F.col("a"), 6).alias("r"),
        settled((F.col("b") + 1e-15), 3).alias("s")).collect()
    assert [r.r for r in rows] == [9e17 + 256, -1e300]
    assert [r.s for r in rows] == [0.3, 2.675]
    noisy = spark.createDataFrame([(0.6890625,), (0.6890625 - 1e-16,)], "x double")
    assert noisy.select(settled(F.col("x"), 6)).distinct().count() == 1


def test_draws_follow_their_distributions(spark):
    rows = spark.range(20_000).select(
        hash_uniform(1, "id").alias("u"), hash_normal(1, "id").alias("n"),
        hash_beta(0.2, 1, "id").alias("b")).toPandas()
    assert rows.u.between(0, 1, inclusive="neither").all()
    assert abs(rows.u.mean() - 0.5) < 0.01 and abs(rows.u.var() - 1 / 12) < 0.005
    assert abs(rows.n.mean()) < 0.03 and abs(rows.n.std() - 1) < 0.02
    assert rows.b.between(0, 1).all() and abs(rows.b.mean() - 0.5) < 0.01
    # Variance of Beta(a, a) is 1 / (4 (2a + 1)).
    assert abs(rows.b.var() - 1 / (4 * 1.4)) < 0.01


def test_draws_do_not_depend_on_partitions(spark):
    frame = spark.range(1000)
    draws = [
        sorted(map(tuple, frame.repartition(n).select("id", hash_normal(3, "id")).collect()))
        for n in (1, 7)
    ]
    assert draws[0] == draws[1]


@pytest.mark.parametrize("small_group", [10, 100_000])
def test_quantiles_are_exact(spark, monkeypatch, small_group):
    # With a low accuracy groups count as large, so the bracketing is exercised.
    monkeypatch.setattr(ordering, "RANK_ACCURACY", small_group * 10)
    rng = random.Random(5)
    values = {"a": [rng.random() * 100 for _ in range(4_001)],
              "hot": [7.0] * 3_000 + [float(i) for i in range(100)],
              "two": [1.0, 2.0]}
    frame = spark.createDataFrame(
        [(k, x) for k, xs in values.items() for x in xs], "k string, x double")
    wanted = {"p33": 0.33, "half": 0.5, "low": 0.0, "high": 1.0}
    got = {r.k: r for r in ordering.quantiles(frame, "x", wanted, ["k"]).collect()}
    for k, xs in values.items():
        for name, p in wanted.items():
            assert got[k][name] == pytest.approx(np.quantile(xs, p), rel=1e-12)
    alone = ordering.quantiles(frame, "x", {"p33": 0.33}).first()
    assert alone.p33 == pytest.approx(np.quantile(sum(values.values(), []), 0.33), rel=1e-12)


def test_numbering_follows_the_hash(spark):
    frame = spark.range(5000).select(
        "id", (F.col("id") % 3).alias("k"), F.xxhash64("id").alias("h"))
    for n in (1, 5):
        rows = ordering.numbered_by_hash(frame.repartition(n), "h", ["k"]).collect()
        for k in range(3):
            mine = sorted((r.row_index, r.h % 2**64) for r in rows if r.k == k)
            assert [i for i, _ in mine] == list(range(len(mine)))
            assert [h for _, h in mine] == sorted(h for _, h in mine)
            assert {r.group_size for r in rows if r.k == k} == {len(mine)}


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(260, 4)), rng.normal(size=(12, 4)) * 9 + 30,
                        np.zeros((1, 4)), np.repeat([[50.0, 0, 0, 0]], 1, axis=0)])
    labels = ["a" if i % 4 else "b" for i in range(len(x))]
    points = spark.createDataFrame(
        [(labels[i], i, x[i].tolist()) for i in range(len(x))],
        "label string, point_id bigint, x array<double>")
    wanted = points.select("point_id").filter("point_id % 2 = 0")
    got: dict[int, list] = {}
    for r in nearest_in_class(points, wanted, 3, cell_points=40, chunk_points=20).collect():
        got.setdefault(r.point_id, []).append((r.distance, r.neighbour_id))
    assert set(got) == set(range(0, len(x), 2))
    for i, found in got.items():
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        best = sorted((d[j], j) for j in range(len(x)) if j != i and labels[j] == labels[i])[:3]
        assert [j for _, j in sorted(found)] == [j for _, j in best]
