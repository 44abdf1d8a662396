"""Trend with change points times a yearly season, one small regression per product.

A product's months become one row (an array of at most one entry a month), so that fit,
spread and error need one shuffle and no join. With u the time from 0 (first month) to 1
(last), the trend is g = a + b u + sum of d_j max(0, u - c_j) over evenly spaced change
points, the season s a Fourier series over the calendar months, and the quantity
g (1 + s). Trend and season are fitted in turn, each as a ridge regression on its Gram
matrix. The ridge keeps bends and swings small where few months speak for them, and every
matrix can be inverted, whatever the series.

Months may be missing between others. Products of fewer than twelve months have no model.
A series of zeros gives zeros.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.functions.columns import month_diff, month_text, settled
from gondola.operators.demand import (
    SEASONAL_MONTHS,
    Z_80,
    _check_steps,
    _count_of,
    forecast_seasonal,
    train_seasonal,
)

HELD_OUT_MONTHS = 3


@dataclass(frozen=True)
class CurveSettings:
    """Change points within the first ``change_range`` of the time, harmonics of the year, the
    ridge on each kind of coefficient (quantities count as shares of the largest), passes."""

    change_points: int = 5
    change_range: float = 0.8
    harmonics: int = 3
    line_ridge: float = 1e-6
    change_ridge: float = 0.3
    season_ridge: float = 0.3
    passes: int = 3

    @property
    def changes(self) -> list[float]:
        n = self.change_points
        return [self.change_range * j / (n + 1) for j in range(1, n + 1)]

    @property
    def trend_ridge(self) -> list[float]:
        return [self.line_ridge] * 2 + [self.change_ridge] * self.change_points


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _trend_terms(u: Column, settings: CurveSettings) -> Column:
    return F.array(F.lit(1.0), u, *[F.greatest(u - c, F.lit(0.0)) for c in settings.changes])


def _season_terms(day: Column, settings: CurveSettings) -> Column:
    angles = [F.month(day) * (2.0 * math.pi * k / 12.0) for k in range(1, settings.harmonics + 1)]
    return F.array(*[wave(a) for a in angles for wave in (F.cos, F.sin)])


def ridge_solution(rows: Column, ridge: list[float]) -> Column:
    """Coefficients of a ridge regression. Each row is an array, regressors first, target last.

    The Gram matrix with the right-hand side beside it is reduced row by row. It is positive
    definite when every ridge is over 0, so the pivots are, and no rows are swapped.
    """
    size = len(ridge)
    places = F.sequence(F.lit(0), F.lit(size - 1))
    penalty = F.array(*[F.lit(float(r)) for r in ridge])

    def gram(z: Column) -> Column:
        def cell(i: Column, j: Column) -> Column:
            start = F.when(i == j, F.get(penalty, i)).otherwise(F.lit(0.0))
            return F.aggregate(z, start, lambda s, r: s + F.get(r, i) * F.get(r, j))
        return F.transform(places, lambda i: F.transform(
            F.sequence(F.lit(0), F.lit(size)), lambda j: cell(i, j)))

    def reduced(m: Column, k: Column) -> Column:
        def against(pivot: Column) -> Column:
            return F.transform(m, lambda row, i: F.when(i == k, pivot).otherwise(
                F.zip_with(row, pivot, lambda v, p: v - F.get(row, k) * p)))
        return _let(F.transform(F.get(m, k), lambda v: v / F.get(F.get(m, k), k)), against)

    solved = F.aggregate(places, _let(rows, gram), reduced)
    return F.transform(solved, lambda row: F.get(row, F.lit(size)))


def _fit(series: Column, settings: CurveSettings) -> Column:
    """Coefficients ``trend`` and ``season`` of a series of (y, trend terms, season terms)."""
    season_ridge = [settings.season_ridge] * (2 * settings.harmonics)

    def trend_given(season: Column) -> Column:
        def row(r: Column) -> Column:
            return _let(1.0 + _dot(season, r["season_terms"]), lambda w: F.concat(
                F.transform(r["trend_terms"], lambda v: v * w), F.array(r["y"])))
        return ridge_solution(F.transform(series, row), settings.trend_ridge)

    def season_given(trend: Column) -> Column:
        def row(r: Column) -> Column:
            return _let(_dot(trend, r["trend_terms"]), lambda g: F.concat(
                F.transform(r["season_terms"], lambda v: v * g), F.array(r["y"] - g)))
        return ridge_solution(F.transform(series, row), season_ridge)

    def once_more(model: Column, _: Column) -> Column:
        return _let(trend_given(model["season"]), lambda trend: F.struct(
            trend.alias("trend"), season_given(trend).alias("season")))

    start = F.struct(
        F.array(*[F.lit(0.0)] * len(settings.trend_ridge)).alias("trend"),
        F.array(*[F.lit(0.0)] * len(season_ridge)).alias("season"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(settings.passes)), start, once_more)


def _spread(misses: Column, n: Column) -> Column:
    """Sample deviation of an array of ``n`` numbers, at least two."""
    total = F.aggregate(misses, F.lit(0.0), lambda s, v: s + v)
    return _let(total / n, lambda mean: F.sqrt(F.aggregate(
        misses, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / (n - 1)))


def train_curve(history: DataFrame, settings: CurveSettings = CurveSettings()) -> DataFrame:
    """A row per product with a year of months: ``first_month``, ``last_month``, ``span`` (months
    from first to last), ``scale`` (the largest quantity), ``trend`` and ``season``, the spread
    ``sigma`` of the misses, and ``mae``, the mean absolute miss of the last three months."""
    qty = F.col("TotalQty").cast("double")
    products = history.groupBy("sk_produto").agg(
        F.count("*").alias("n_months"), F.min("SaleMonth").alias("first_month"),
        F.max("SaleMonth").alias("last_month"), F.max(qty).alias("top"),
        F.sort_array(F.collect_list(F.struct("SaleMonth", qty.alias("qty")))).alias("months"),
    ).filter(F.col("n_months") >= SEASONAL_MONTHS)
    sized = products.withColumn("scale", F.when(F.col("top") > 0, F.col("top")).otherwise(1.0)).withColumn(
        "span", F.greatest(month_diff(F.col("first_month"), F.col("last_month")), F.lit(1)).cast("double"))

    def entry(r: Column) -> Column:
        u = month_diff(F.col("first_month"), r["SaleMonth"]) / F.col("span")
        return F.struct(
            (r["qty"] / F.col("scale")).alias("y"), _trend_terms(u, settings).alias("trend_terms"),
            _season_terms(r["SaleMonth"], settings).alias("season_terms"))

    def measured(series: Column) -> Column:
        def with_misses(model: Column) -> Column:
            misses = F.transform(series, lambda r: F.col("scale") * (r["y"] - _dot(
                model["trend"], r["trend_terms"]) * (1.0 + _dot(model["season"], r["season_terms"]))))
            return _let(misses, lambda m: F.struct(
                model["trend"].alias("trend"), model["season"].alias("season"),
                _spread(m, F.col("n_months")).alias("sigma"),
                (F.aggregate(F.slice(m, -3, 3), F.lit(0.0), lambda s, v: s + F.abs(v)) / 3).alias("mae")))
        return _let(_fit(series, settings), with_misses)

    fitted = sized.withColumn("model", _let(F.transform("months", entry), measured))
    return fitted.select("sk_produto", "n_months", "first_month", "last_month", "span", "scale", "model.*")


def curve_value(month: Column, settings: CurveSettings = CurveSettings()) -> Column:
    """What a row of ``train_curve`` gives for a month, before or after its last."""
    u = month_diff(F.col("first_month"), month) / F.col("span")
    return F.col("scale") * _dot(F.col("trend"), _trend_terms(u, settings)) * (
        1.0 + _dot(F.col("season"), _season_terms(month, settings)))


def curve_coefficients(model: DataFrame) -> DataFrame:
    """The coefficients in long form, a row per product, part and place, for display and SQL."""
    def named(part: str) -> Column:
        return F.transform(F.col(part), lambda v, i: F.struct(
            F.lit(part).alias("part"), i.cast("long").alias("place"), v.alias("value")))

    return model.select(
        "sk_produto", "n_months", "scale", settled(F.col("sigma"), 6).alias("sigma"),
        F.explode(F.concat(named("trend"), named("season"))).alias("c")).select(
        "sk_produto", "n_months", "scale", "sigma", "c.part", "c.place",
        settled(F.col("c.value"), 6).alias("value"))


def curve_mae(model: DataFrame) -> DataFrame:
    """Mean absolute miss of the last three months, which the fit has seen."""
    return model.select("sk_produto", F.lit("curve").alias("model"), settled(F.col("mae"), 2).alias("mae"))


def forecast_curve(model: DataFrame, steps: int = 3,
                   settings: CurveSettings = CurveSettings()) -> DataFrame:
    """Forecast for the months after each product's last, with an 80 % band, never negative."""
    _check_steps(steps)
    value, band = F.col("value"), F.col("sigma") * Z_80
    return (
        model.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
        .withColumn("SaleMonth", F.add_months("last_month", F.col("step")))
        .withColumn("value", curve_value(F.col("SaleMonth"), settings))
        .select(
            "sk_produto", F.col("step").cast("long").alias("step"), month_text(F.col("SaleMonth")).alias("month"),
            _count_of(value).alias("forecast"), _count_of(value - band).alias("lower"),
            _count_of(value + band).alias("upper"))
    )


def curve_backtest(history: DataFrame, held_out: int = HELD_OUT_MONTHS,
                   settings: CurveSettings = CurveSettings()) -> DataFrame:
    """Held-out error of each product's last months under the curve and under line and factors.

    Both models are fitted on the months before. ``chosen`` is the model with the smaller
    error, line and factors when they are equal. Products that keep fewer than a year of
    months have no row.
    """
    place = F.row_number().over(Window.partitionBy("sk_produto").orderBy(F.desc("SaleMonth")))
    placed = history.select("sk_produto", "SaleMonth", F.col("TotalQty").cast("double").alias("TotalQty"),
                            place.alias("place"))
    before = placed.filter(F.col("place") > held_out).drop("place")
    held = placed.filter(F.col("place") <= held_out).drop("place")
    line = F.col("intercept") + F.col("slope") * month_diff(F.col("first_month"), F.col("SaleMonth"))
    by_factors = held.join(
        train_seasonal(before).select("sk_produto", "first_month", "slope", "intercept", "season"), "sk_produto",
    ).select("sk_produto", "SaleMonth", "TotalQty", (line * F.coalesce(
        F.try_element_at("season", F.month("SaleMonth")), F.lit(1.0))).alias("by_factors"))
    curves = train_curve(before, settings).select(
        "sk_produto", "first_month", "span", "scale", "trend", "season")
    errors = by_factors.join(curves, "sk_produto").groupBy("sk_produto").agg(
        settled(F.avg(F.abs(F.col("TotalQty") - curve_value(F.col("SaleMonth"), settings))), 4).alias("curve_mae"),
        settled(F.avg(F.abs(F.col("TotalQty") - F.col("by_factors"))), 4).alias("factors_mae"))
    return errors.withColumn(
        "chosen", F.when(F.col("curve_mae") < F.col("factors_mae"), "curve").otherwise("factors"))


def forecast_chosen(history: DataFrame, steps: int = 3, held_out: int = HELD_OUT_MONTHS,
                    settings: CurveSettings = CurveSettings()) -> DataFrame:
    """Each seasonal product's forecast by the model that ``curve_backtest`` chose for it; products
    too short for the test have line and factors. ``model`` names it."""
    chosen = curve_backtest(history, held_out, settings).select("sk_produto", "chosen")
    forecasts = forecast_curve(train_curve(history, settings), steps, settings).withColumn(
        "model", F.lit("curve")).union(
        forecast_seasonal(train_seasonal(history), steps).withColumn("model", F.lit("factors")))
    return forecasts.join(chosen, "sk_produto", "left").filter(
        F.col("model") == F.coalesce("chosen", F.lit("factors"))).drop("chosen")
