import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gondola.operators import demand, seasonal
from hand_made import history_rows, months

START = dt.date(2015, 1, 1)
NAMES = "sk_produto bigint, SaleMonth date, TotalQty double"


def by_numpy(y, t, month, settings=seasonal.CurveSettings()):
    """The same fit with matrices: trend and season in turn."""
    scale = max(y) if max(y) > 0 else 1.0
    y, u = np.array(y) / scale, np.array(t) / max(max(t), 1)
    trend_terms = np.stack([np.ones_like(u), u] + [np.maximum(u - c, 0) for c in settings.changes], 1)
    angles = [2 * math.pi * k / 12 * np.array(month) for k in range(1, settings.harmonics + 1)]
    season_terms = np.stack([f(a) for a in angles for f in (np.cos, np.sin)], 1)
    season = np.zeros(season_terms.shape[1])
    for _ in range(settings.passes):
        x = trend_terms * (1 + season_terms @ season)[:, None]
        trend = np.linalg.solve(x.T @ x + np.diag(settings.trend_ridge), x.T @ y)
        g = trend_terms @ trend
        x = season_terms * g[:, None]
        season = np.linalg.solve(x.T @ x + settings.season_ridge * np.eye(x.shape[1]), x.T @ (y - g))
    return trend, season, scale * (trend_terms @ trend) * (1 + season_terms @ season)


def swinging(n, seed=0, noise=0.0):
    """A trend that bends half way, times a yearly swing."""
    draw = np.random.default_rng(seed)
    line = [100 + 2.0 * i - 3.0 * max(0, i - n // 2) for i in range(n)]
    return [max(0.0, g * (1 + 0.4 * math.sin(2 * math.pi * (i % 12 + 1) / 12)) * (1 + noise * draw.normal()))
            for i, g in enumerate(line)]


def test_fit_equals_matrices_with_gaps(spark):
    days = months(START, 40)
    values = swinging(40, 1, 0.1)
    kept = [i for i in range(40) if i not in (3, 4, 17, 30)]
    frame = history_rows(spark, {7: {days[i]: values[i] for i in kept}})
    row = seasonal.train_curve(frame).first()
    trend, season, fitted = by_numpy([values[i] for i in kept], kept, [days[i].month for i in kept])
    assert row.trend == pytest.approx(list(trend), abs=1e-8)
    assert row.season == pytest.approx(list(season), abs=1e-8)
    misses = np.array([values[i] for i in kept]) - fitted
    assert row.sigma == pytest.approx(misses.std(ddof=1)) and row.mae == pytest.approx(np.abs(misses[-3:]).mean())
    got = seasonal.curve_coefficients(seasonal.train_curve(frame))
    assert got.count() == 13 and got.filter("part = 'season'").count() == 6


def test_settings_change_the_size_of_the_model(spark):
    settings = seasonal.CurveSettings(change_points=0, harmonics=1, passes=4)
    values = swinging(24)
    frame = history_rows(spark, {1: dict(zip(months(START, 24), values))})
    row = seasonal.train_curve(frame, settings).first()
    trend, season, _ = by_numpy(values, range(24), [d.month for d in months(START, 24)], settings)
    assert row.trend == pytest.approx(list(trend), abs=1e-8) and len(row.trend) == 2
    assert row.season == pytest.approx(list(season), abs=1e-8) and len(row.season) == 2


def planted(n, seed, noise):
    """A random trend that bends at a random place, times two random waves of the year."""
    draw = np.random.default_rng(seed)
    bend, first, then = draw.uniform(0.15, 0.7), *draw.normal(0, 0.5, 2)
    u, month = np.arange(n) / (n - 1), np.arange(n) % 12 + 1
    line = 100 * np.maximum(1 + first * u + (then - first) * np.maximum(u - bend, 0), 0.2)
    swing = 1 + draw.uniform(0.1, 0.5) * np.sin(2 * np.pi * month / 12 + draw.uniform(0, 6.28)) + draw.uniform(
        0, 0.2) * np.cos(4 * np.pi * month / 12)
    return [float(v) for v in np.maximum(line * swing * (1 + noise * draw.normal(size=n)), 0)]


@pytest.mark.parametrize("noise,share", [(0.05, 0.5), (0.15, 0.8)])
def test_planted_series_beat_month_means_and_factors(spark, noise, share):
    n, products = 63, 40
    days = months(START, n)
    series = {p: dict(zip(days, planted(n, p, noise))) for p in range(products)}
    rows = seasonal.curve_backtest(history_rows(spark, series)).collect()
    assert len(rows) == products

    def mean_miss(values):
        means = {m: np.mean([v for d, v in values.items() if d.month == m and d < days[-3]]) for m in range(1, 13)}
        return np.mean([abs(values[d] - means[d.month]) for d in days[-3:]])

    curve = np.mean([r.curve_mae for r in rows])
    assert curve < share * np.mean([mean_miss(v) for v in series.values()])
    assert curve < np.mean([r.factors_mae for r in rows])
    assert all((r.chosen == "curve") == (r.curve_mae < r.factors_mae) for r in rows)


def test_chosen_forecast_is_that_of_the_chosen_model(spark):
    days = months(START, 40)
    frame = history_rows(spark, {
        1: dict(zip(days, swinging(40, 3))), 2: dict(zip(days, range(10, 50))),
        3: dict(zip(days, range(1, 14))), 4: dict(zip(days, range(11)))})
    chosen = {r.sk_produto: r.chosen for r in seasonal.curve_backtest(frame).collect()}
    assert set(chosen) == {1, 2}  # 13 months keep ten for the test, 11 have no model at all
    got = seasonal.forecast_chosen(frame, 4)
    kinds = {r.sk_produto: (r.model, r["n"]) for r in got.groupBy("sk_produto", "model").agg(
        F.count("*").alias("n")).collect()}
    assert kinds == {1: (chosen[1], 4), 2: (chosen[2], 4), 3: ("factors", 4)}
    curves = seasonal.forecast_curve(seasonal.train_curve(frame), 4)
    factors = demand.forecast_seasonal(demand.train_seasonal(frame), 4)
    source = curves if chosen[1] == "curve" else factors
    assert got.filter("sk_produto = 1").drop("model").exceptAll(source).count() == 0


def test_zeros_repeated_values_short_and_empty(spark):
    days = months(START, 14)
    frame = history_rows(spark, {
        1: dict.fromkeys(days, 0.0), 2: dict.fromkeys(days, 8.0), 3: dict.fromkeys(days[:11], 5.0)})
    model = seasonal.train_curve(frame)
    rows = {(r.sk_produto, r.step): r for r in seasonal.forecast_curve(model, 14).collect()}
    assert set(rows) == {(p, s) for p in (1, 2) for s in range(1, 15)}
    assert all(rows[1, s][3:] == (0, 0, 0) and rows[2, s].forecast == 8 for s in range(1, 15))
    empty = spark.createDataFrame([], NAMES)
    assert seasonal.train_curve(empty).count() == 0 and seasonal.curve_backtest(empty).count() == 0
    with pytest.raises(ValueError):
        seasonal.forecast_curve(model, 0)


def test_one_shuffle_and_no_join(spark):
    frame = history_rows(spark, {1: dict(zip(months(START, 24), swinging(24)))})
    plan = seasonal.forecast_curve(seasonal.train_curve(frame))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Python" not in plan
