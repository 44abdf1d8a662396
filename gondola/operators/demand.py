"""Demand forecasting from monthly sales history.

Products with at least a year of months get a relational trend-and-season model; the
others a boosted-tree regressor, shared or of their own, whose forecast is fed back step by step. Every
window is partitioned by product and a product has one row per month, so no task ever
holds more than a few dozen rows of one key.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle, keyword_only
from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.storagelevel import StorageLevel

from gondola.functions.boosting import (
    BoostSettings,
    ManyModels,
    answered_by_many,
    fit_many,
    fit_regression,
    with_sum,
)
from gondola.functions.columns import month_diff, month_text, round_half_even, settled
from gondola.functions.lineage import cut_lineage

# ``answer`` functions run inside tasks: workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Months needed for any model and for the seasonal one, share of a
# product's rows used to fit, widening of the tree forecast's band, months at most in a
# request for one product, and the names of the features.
MIN_MONTHS = 6
SEASONAL_MONTHS = 12
TRAIN_SHARE = 0.8
BAND_LOW, BAND_HIGH = 0.82, 1.18
MAX_STEPS = 12
FEATURES = ["month", "quarter", "year", "lag_1", "lag_2", "lag_3", "roll_3", "roll_6", "trend"]

# Two-sided 80 % interval of the normal distribution.
Z_80 = 1.2815515655446004

# Features that are quantities; the trees see them as shares of the product's level.
QUANTITIES = ["lag_1", "lag_2", "lag_3", "roll_3", "roll_6"]
ROWS_PER_TASK = 50_000
MOST_ROWS_PER_TASK = 500_000
STEPS_PER_CHECKPOINT = 4


def _whole():
    return Window.partitionBy("sk_produto")


def _by_month():
    return _whole().orderBy("SaleMonth")


def with_month_count(history: DataFrame) -> DataFrame:
    """History rows of products with enough months, with the number of months."""
    counted = history.withColumn("n_months", F.count("*").over(_whole()))
    return counted.filter(F.col("n_months") >= MIN_MONTHS)


def densify(history: DataFrame) -> DataFrame:
    """Add a zero row for each month without sales between a product's first and last."""
    month = F.col("SaleMonth")
    spans = history.groupBy("sk_produto").agg(
        F.min(month).alias("first"), F.max(month).alias("last"))
    months = spans.select(
        "sk_produto",
        F.explode(F.sequence("first", "last", F.expr("interval 1 month"))).alias("SaleMonth"))
    measures = ["TotalQty", "TotalRevenue", "TotalProfit", "OrderCount"]
    texts = ["ProductID", "ProductName", "Category", "Subcategory"]
    filled = months.join(history, ["sk_produto", "SaleMonth"], "left")
    return filled.select(*[
        F.coalesce(c, F.lit(0)).alias(c) if c in measures
        else F.coalesce(c, F.max(c).over(_whole())).alias(c) if c in texts
        else F.col(c)
        for c in history.columns
    ])


def _rolling_mean(n: int, ending: int) -> Column:
    """Mean of the ``n`` rows up to ``ending``, null until there are that many."""
    span = _by_month().rowsBetween(ending - n + 1, ending)
    full = F.count("*").over(span) == n
    return F.when(full, F.sum("TotalQty").over(span) / n)


def add_features(history: DataFrame, leak_free: bool = False) -> DataFrame:
    """Calendar parts, lags, rolling means and a row counter; incomplete rows are kept.

    The rolling means include the row itself unless ``leak_free``, which ends them at
    the row before.
    """
    month, qty = F.col("SaleMonth"), F.col("TotalQty")
    ending = -1 if leak_free else 0
    return (
        history.withColumn("month", F.month(month).cast("long"))
        .withColumn("quarter", F.quarter(month).cast("long"))
        .withColumn("year", F.year(month).cast("long"))
        .withColumns({f"lag_{k}": F.lag(qty, k).over(_by_month()) for k in (1, 2, 3)})
        .withColumn("roll_3", _rolling_mean(3, ending))
        .withColumn("roll_6", _rolling_mean(6, ending))
        .withColumn("trend", (F.row_number().over(_by_month()) - 1).cast("long"))
    )


def demand_features(history: DataFrame, leak_free: bool = False) -> DataFrame:
    """Complete feature rows of the products with enough months."""
    enough = with_month_count(history).drop("n_months")
    return add_features(enough, leak_free).dropna()


def demand_split(features: DataFrame, share: float = TRAIN_SHARE) -> DataFrame:
    """Mark the first ``share`` of each product's rows, at least one, as training rows."""
    size = F.count("*").over(_whole())
    cut = F.greatest(F.lit(1), F.floor(size * share))
    return features.withColumn("is_train", F.row_number().over(_by_month()) <= cut)


# --- trend and season ------------------------------------------------------------


def _fit_rows(history: DataFrame) -> DataFrame:
    """History of the seasonal products with trend, seasonal factor and fitted value."""
    month, y = F.col("SaleMonth"), F.col("TotalQty")
    w = _whole()
    rows = (
        with_month_count(history.select("sk_produto", "SaleMonth", "TotalQty"))
        .filter(F.col("n_months") >= SEASONAL_MONTHS)
        .withColumn("first_month", F.min(month).over(w))
        .withColumn("t", month_diff(F.col("first_month"), month).cast("double"))
    )
    n, t = F.col("n_months"), F.col("t")
    sums = rows.withColumns({
        "st": F.sum(t).over(w), "stt": F.sum(t * t).over(w),
        "sy": F.sum(y).over(w), "sty": F.sum(t * y).over(w),
        "last_month": F.max(month).over(w),
    })
    st, stt, sy, sty = (F.col(c) for c in ("st", "stt", "sy", "sty"))
    trend = sums.withColumn("slope", (n * sty - st * sy) / (n * stt - st * st)).withColumn(
        "intercept", (sy - F.col("slope") * st) / n
    ).withColumn("trend", F.col("intercept") + F.col("slope") * t)
    ratio = F.when(F.col("trend") > 0, y / F.col("trend"))
    same_month = Window.partitionBy("sk_produto", F.month(month))
    return trend.withColumn(
        "factor", F.coalesce(F.avg(ratio).over(same_month), F.lit(1.0))
    ).withColumn("fitted", F.col("trend") * F.col("factor"))


def train_seasonal(history: DataFrame) -> DataFrame:
    """Coefficients per product: trend line, residual spread, factor per calendar month.

    ``season`` maps the calendar months seen (at most 12) to their factors.
    """
    month = F.month("SaleMonth")
    return _fit_rows(history).groupBy(
        "sk_produto", "n_months", "first_month", "last_month", "slope", "intercept"
    ).agg(
        F.coalesce(F.stddev_samp(F.col("TotalQty") - F.col("fitted")), F.lit(0.0)).alias("sigma"),
        F.map_from_entries(F.collect_set(F.struct(month, F.col("factor")))).alias("season"),
    )


def seasonal_factors(model: DataFrame) -> DataFrame:
    """The coefficients in long form, one row per product and calendar month."""
    return model.select(
        "sk_produto", "n_months", "first_month", "last_month",
        settled(F.col("slope"), 6).alias("slope"),
        settled(F.col("intercept"), 6).alias("intercept"),
        settled(F.col("sigma"), 6).alias("sigma"),
        F.explode("season").alias("calendar_month", "factor"),
    ).withColumn("factor", settled(F.col("factor"), 6)).withColumn(
        "calendar_month", F.col("calendar_month").cast("long"))


def seasonal_mae(history: DataFrame) -> DataFrame:
    """Mean absolute error of the last three months, month against month."""
    recent = F.row_number().over(
        Window.partitionBy("sk_produto").orderBy(F.desc("SaleMonth"))) <= 3
    miss = F.abs(F.col("TotalQty") - F.col("fitted"))
    return (
        _fit_rows(history).withColumn("recent", recent).filter("recent")
        .groupBy("sk_produto")
        .agg(settled(F.avg(miss), 2).alias("mae"))
        .select("sk_produto", F.lit("seasonal").alias("model"), "mae")
    )


def _check_steps(steps: int) -> None:
    if steps < 1:
        raise ValueError(f"steps must be 1 or more, not {steps}")


def _count_of(value: Column) -> Column:
    """Whole units, half to even, never negative.

    Six decimals are settled first, so that a value of one half up to the noise of
    floating-point sums goes the same way on every run.
    """
    return F.greatest(F.bround(round_half_even(value, 6), 0), F.lit(0.0)).cast("long")


def forecast_seasonal(model: DataFrame, steps: int = 3) -> DataFrame:
    """Forecast of the seasonal products for the months after each one's last."""
    _check_steps(steps)
    month = F.add_months("last_month", F.col("step"))
    value, spread = F.col("value"), F.col("sigma") * Z_80
    return (
        model.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
        .withColumn("SaleMonth", month)
        .withColumn("line", F.col("intercept")
                    + F.col("slope") * month_diff(F.col("first_month"), F.col("SaleMonth")))
        .withColumn("value", F.col("line") * F.coalesce(
            F.try_element_at("season", F.month("SaleMonth")), F.lit(1.0)))
        .select(
            "sk_produto", F.col("step").cast("long").alias("step"),
            month_text(F.col("SaleMonth")).alias("month"),
            _count_of(value).alias("forecast"), _count_of(value - spread).alias("lower"),
            _count_of(value + spread).alias("upper"),
        )
    )


ENTRY = "struct<step:bigint,month:string,forecast:bigint,lower:bigint,upper:bigint>"


def _entry(step: Column, month: Column, guess: Column) -> Column:
    """One step of a recursive forecast."""
    return F.struct(
        step.cast("long").alias("step"), month_text(month).alias("month"), guess.alias("forecast"),
        _count_of(guess * BAND_LOW).alias("lower"), _count_of(guess * BAND_HIGH).alias("upper"))


# --- boosted trees ---------------------------------------------------------------


@dataclass(frozen=True)
class TreeSettings:
    """Settings of the shared regressor."""

    rounds: int = 300
    depth: int = 6
    rate: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    bins: int = 256
    leaf_share: float = 0.02
    loss: str = "absolute"
    seed: int = 42


def tree_rows(history: DataFrame, leak_free: bool = True) -> DataFrame:
    """Feature rows of all products with enough months, split, with a product level.

    ``level`` is the mean quantity of a product's first months, none of them held out;
    it lets one model serve products of any size.
    """
    early = F.row_number().over(_by_month()) <= F.greatest(
        F.lit(1), F.floor(F.count("*").over(_whole()) * TRAIN_SHARE))
    levelled = history.withColumn("early", early).withColumn(
        "level", F.avg(F.when(F.col("early"), F.col("TotalQty"))).over(_whole()))
    return demand_split(demand_features(levelled.drop("early"), leak_free))


def _round_tasks(n: int, cores: int) -> int:
    """Tasks of a round's jobs: a few thousand such jobs each report every task to the driver, so
    once all cores are busy twice over a task takes more rows, up to ``MOST_ROWS_PER_TASK``."""
    return max(1, min(-(-n // ROWS_PER_TASK), 2 * cores), -(-n // MOST_ROWS_PER_TASK))


class SharedTrees(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees as a stage of a pipeline; a tree is lists of feature, threshold, left child and value."""

    trees = Param(Params._dummy(), "trees", "the trees, in the order of the rounds")
    depth = Param(Params._dummy(), "depth", "depth of the trees", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, trees=None, depth=None, featuresCol="features", predictionCol="prediction"):
        super().__init__()
        self._set(**{name: value for name, value in self._input_kwargs.items() if value is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = dataset.withColumn("_x", vector_to_array(self.getFeaturesCol()))
        return with_sum(rows, self.getOrDefault(self.trees), self.getOrDefault(self.depth), "_x",
                        self.getPredictionCol()).drop("_x")


def train_demand(rows: DataFrame, settings: TreeSettings = TreeSettings()) -> PipelineModel:
    """One regressor for all products, fitted on the training rows of ``tree_rows``.

    Quantities, the target among them, are taken relative to the product's level, so that
    products of any size share the trees. The rows are dealt out by product and month, and so
    are the draws: a round is several small jobs, and few rows in many tasks would cost more
    than the work. A leaf holds at least ``leaf_share`` of the rows, so that noise is not
    learned by heart.
    """
    if settings.loss not in ("absolute", "squared"):
        raise ValueError(f"loss must be 'absolute' or 'squared', not {settings.loss!r}")
    shares = ", ".join(f"{name} / coalesce(nullif(level, 0), 1) AS {name}_share" for name in QUANTITIES)
    relative = SQLTransformer(statement=f"SELECT *, {shares} FROM __THIS__")
    inputs = [f"{f}_share" if f in QUANTITIES else f for f in FEATURES]
    assembler = VectorAssembler(inputCols=[*inputs, "level"], outputCol="features")
    back = SQLTransformer(statement=(
        "SELECT *, predicted_share * coalesce(nullif(level, 0), 1) AS predicted FROM __THIS__"))
    level = F.coalesce(F.nullif(F.col("level"), F.lit(0.0)), F.lit(1.0))
    wanted = rows.filter("is_train").select(
        *FEATURES, "level", (F.col("TotalQty") / level).cast("double").alias("y"),
        F.xxhash64("sk_produto", "trend").alias("key"))
    wanted = assembler.transform(relative.transform(wanted)).select(vector_to_array("features").alias("x"), "y", "key")
    wanted = wanted.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = wanted.count()
        trees = fit_regression(
            wanted, BoostSettings(
                settings.rounds, settings.depth, settings.rate, settings.row_share, settings.column_share,
                settings.bins, least_weight=max(1, int(n * settings.leaf_share)), seed=settings.seed),
            settings.loss == "absolute", _round_tasks(n, rows.sparkSession.sparkContext.defaultParallelism))
    finally:
        wanted.unpersist()
    return PipelineModel(stages=[relative, assembler, SharedTrees(
        trees=trees, depth=settings.depth, featuresCol="features", predictionCol="predicted_share"), back])


def _features_of(rows: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Columns as doubles, a row each; NaN where there is none."""
    return np.stack([pc.fill_null(rows.column(n).cast(pa.float64()), np.nan).to_numpy(
        zero_copy_only=False) for n in names], axis=1)


def _or_level(guess: np.ndarray, rows: pa.RecordBatch) -> pa.Array:
    return pc.coalesce(pa.array(guess, mask=np.isnan(guess)), rows.column("level").cast(pa.float64()))


@dataclass(frozen=True)
class ProductTrees:
    """One boosted model a product: ``rows`` are the training rows that each is grown from.

    ``table`` has the models, as ``sk_produto``, ``base``, ``trees``. They are hundreds of
    times as large as their rows, so they are not stored: predictions come from the tasks that grow
    the models. A product without a model (none of its rows is complete) gets its level.
    """

    rows: DataFrame
    settings: BoostSettings

    @property
    def table(self) -> DataFrame:
        return fit_many(self.rows, self.settings, key="sk_produto", y="TotalQty", order="trend")

    def _answered(self, asked: DataFrame, answer: Callable, schema: str | StructType) -> DataFrame:
        return answered_by_many(self.rows, asked, answer, schema, self.settings, "sk_produto", "TotalQty", "trend")

    def transform(self, rows: DataFrame) -> DataFrame:
        """Rows with ``predicted``."""
        names = list(FEATURES)

        def answer(models: ManyModels, given: pa.RecordBatch) -> pa.RecordBatch:
            guess = models.guess(given.column("sk_produto").to_numpy(), _features_of(given, names))
            return given.append_column("predicted", _or_level(guess, given))

        return self._answered(rows, answer, StructType([*rows.schema.fields, StructField("predicted", DoubleType())]))

    def recursion(self, state: DataFrame, steps: int) -> DataFrame:
        """``forecast_recursive`` from its starting state, all steps in the task that grows the models."""
        months = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda k: F.add_months("last_month", k))
        asked = state.withColumn("calendar", F.transform(months, lambda m: F.array(F.month(m), F.quarter(m), F.year(m))))

        def answer(models: ManyModels, given: pa.RecordBatch) -> pa.RecordBatch:
            lag_1, lag_2, lag_3, roll_3, roll_6, trend = _features_of(
                given, ["lag_1", "lag_2", "lag_3", "roll_3", "roll_6", "last_trend"]).T
            key = given.column("sk_produto").to_numpy()
            # Year, quarter and month of every step; a state without a last month has none.
            calendar = np.array([c or [[np.nan] * 3] * steps for c in given.column("calendar").to_pylist()], float)
            done = []
            for k in range(steps):
                x = np.stack([*calendar[:, k].T, lag_1, lag_2, lag_3, roll_3, roll_6, trend + k + 1], axis=1)
                raw = _or_level(models.guess(key, x), given)
                done.append(raw)
                # As ``_count_of`` and ``round_half_even`` do it.
                guess = pc.fill_null(raw, np.nan).to_numpy(zero_copy_only=False)
                guess = np.fmax(np.rint(_rounded(guess, 6)), 0.0)
                lag_1, lag_2, lag_3, roll_3 = guess, lag_1, lag_2, _rounded((roll_3 * 2 + guess) / 3, 1)
            return pa.RecordBatch.from_arrays(
                [given.column("sk_produto"), given.column("last_month"),
                 pa.array(zip(*(d.to_pylist() for d in done)), pa.list_(pa.float64()))],
                ["sk_produto", "last_month", "raw"])

        raw = self._answered(asked, answer, StructType([
            state.schema["sk_produto"], state.schema["last_month"], StructField("raw", ArrayType(DoubleType()))]))
        step = F.col("step") + 1
        return raw.select("sk_produto", "last_month", F.posexplode("raw").alias("step", "raw")).select(
            "sk_produto", _entry(step, F.add_months("last_month", step), _count_of(F.col("raw"))).alias("f")).select(
            "sk_produto", "f.*")


def _rounded(value: np.ndarray, digits: int) -> np.ndarray:
    """``round_half_even`` of an array."""
    scale = 10.0 ** digits
    return np.where(np.abs(value) * scale < 2.0 ** 52, np.rint(value * scale) / scale, value)


def train_product_trees(rows: DataFrame, settings: BoostSettings = BoostSettings()) -> ProductTrees:
    """A model of its own for every product, on the training rows of ``tree_rows``.

    Squared loss over the nine features as they are; products are spread over the tasks, and
    a task grows the trees of many products together.
    """
    wanted = rows.filter("is_train").select(
        "sk_produto", "trend", F.array(*[F.col(f).cast("double") for f in FEATURES]).alias("x"), "TotalQty")
    return ProductTrees(cut_lineage(wanted), settings)


DemandModel = PipelineModel | ProductTrees


def tree_mae(model: DemandModel, rows: DataFrame, products: DataFrame) -> DataFrame:
    """Mean absolute error per product on its held-out rows, null where it has none.

    ``products`` has the ``sk_produto`` of all that are forecast; a product whose few months
    leave no complete row is among them.
    """
    miss = F.when(~F.col("is_train"), F.abs(F.col("TotalQty") - F.col("predicted")))
    rows = rows.select("sk_produto", "is_train", "TotalQty", *FEATURES, "level")
    errors = model.transform(rows).groupBy("sk_produto").agg(settled(F.avg(miss), 2).alias("mae"))
    return products.select("sk_produto").distinct().join(errors, "sk_produto", "left").select(
        "sk_produto", F.lit("trees").alias("model"), "mae")


def short_history(history: DataFrame, route: str) -> DataFrame:
    """History of the products the trees forecast: under a year, or all of them."""
    counted = with_month_count(history)
    if route == "auto":
        counted = counted.filter(F.col("n_months") < SEASONAL_MONTHS)
    elif route != "trees":
        raise ValueError(f"route must be 'auto' or 'trees', not {route!r}")
    return counted.drop("n_months")


def demand_mae(
    history: DataFrame, model: DemandModel, rows: DataFrame, route: str = "auto"
) -> DataFrame:
    """Error per trained product, from whichever model forecasts it."""
    short = short_history(history, route).select("sk_produto").distinct()
    trees = tree_mae(model, rows.join(short, "sk_produto", "left_semi"), short)
    return trees if route == "trees" else trees.unionByName(seasonal_mae(history))


def forecast_state(history: DataFrame, compat: bool = False) -> DataFrame:
    """What the recursion starts from: one row per product, from its last months.

    With ``compat`` the second and third lag start one month older and the trend one
    step later.
    """
    rows = tree_rows(history, leak_free=False).withColumn("qty", F.col("TotalQty"))
    last = F.max_by(F.struct(
        "SaleMonth", "qty", "lag_1", "lag_2", "lag_3", "roll_3", "roll_6", "trend", "level",
    ), "SaleMonth")
    state = rows.groupBy("sk_produto").agg(last.alias("last")).select("sk_produto", "last.*")
    lag_2, lag_3 = ("lag_2", "lag_3") if compat else ("lag_1", "lag_2")
    return state.select(
        "sk_produto", F.col("SaleMonth").alias("last_month"),
        F.col("qty").alias("lag_1"), F.col(lag_2).alias("lag_2"), F.col(lag_3).alias("lag_3"),
        "roll_3", "roll_6", (F.col("trend") + (1 if compat else 0)).alias("last_trend"), "level",
    )


def forecast_recursive(
    history: DataFrame, model: DemandModel, steps: int = 3, route: str = "auto",
    compat: bool = False,
) -> DataFrame:
    """Step-by-step tree forecast: each prediction becomes the next step's first lag.

    All products advance together, one model pass per step and no shuffle between steps.
    The done steps travel along as an array, so the result is read off in one pass.
    """
    _check_steps(steps)
    carried = ["sk_produto", "last_month", "roll_6", "last_trend", "level"]
    state = forecast_state(short_history(history, route), compat)
    if isinstance(model, ProductTrees):
        return model.recursion(state, steps)
    state = state.withColumn(
        "done", F.array().cast(f"array<{ENTRY}>"))
    for step in range(1, steps + 1):
        month = F.add_months("last_month", step)
        scored = model.transform(
            state.withColumn("month", F.month(month)).withColumn("quarter", F.quarter(month))
            .withColumn("year", F.year(month)).withColumn("trend", F.col("last_trend") + step)
        ).withColumn("guess", _count_of(F.col("predicted")))
        guess = F.col("guess")
        entry = _entry(F.lit(step), month, guess)
        state = scored.select(
            *carried,
            guess.cast("double").alias("lag_1"), F.col("lag_1").alias("lag_2"),
            F.col("lag_2").alias("lag_3"),
            round_half_even((F.col("roll_3") * 2 + guess) / 3, 1).alias("roll_3"),
            F.array_append("done", entry).alias("done"),
        )
        if step % STEPS_PER_CHECKPOINT == 0 and step < steps:
            state = cut_lineage(state)
    return state.select("sk_produto", F.explode("done").alias("f")).select("sk_produto", "f.*")


# --- what callers ask for --------------------------------------------------------


def forecast_all(
    history: DataFrame, model: DemandModel, steps: int = 3, route: str = "auto"
) -> DataFrame:
    """Forecasts of every trained product, each by its own kind of model."""
    trees = forecast_recursive(history, model, steps, route)
    if route == "trees":
        return trees
    return forecast_seasonal(train_seasonal(history), steps).unionByName(trees)


def forecast_product(forecasts: DataFrame, sk_produto: int, months: int = 3) -> DataFrame:
    """The first months, 12 at most, of one product; empty if it has no model."""
    chosen = (F.col("sk_produto") == sk_produto) & (F.col("step") <= min(months, MAX_STEPS))
    return forecasts.filter(chosen)


def forecast_next_month(forecasts: DataFrame, limit: int | None = None) -> DataFrame:
    """The first step of every product, or of the first ``limit`` by key."""
    first = forecasts.filter(F.col("step") == 1)
    return first if limit is None else first.orderBy("sk_produto").limit(limit)


def forecastable_products(history: DataFrame, features: DataFrame) -> DataFrame:
    """Products with a model, with their name or a default one."""
    trained = with_month_count(history.select("sk_produto", "SaleMonth"))
    names = features.select("sk_produto", "ProductName")
    default = F.concat(F.lit("Produto sk_"), F.col("sk_produto").cast("string"))
    return (
        trained.select("sk_produto").distinct().join(names, "sk_produto", "left")
        .select("sk_produto", F.coalesce("ProductName", default).alias("ProductName"))
        .orderBy("sk_produto")
    )
