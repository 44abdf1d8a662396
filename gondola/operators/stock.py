"""Stock risk: rule labels, a classifier trained on them, alerts and summaries.

Every frame here has one row per product. The classifier is softmax-boosted trees over
scaled features; it learns from the rule labels, optionally balanced by ``augment``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.functions.boosting import BoostSettings, ClassTrees, fit_classes, with_chances
from gondola.functions.columns import hash_key, round_half_even, settled
from gondola.functions.lineage import cut_lineage
from gondola.functions.ordering import numbered_by_hash, quantiles
from gondola.operators.augment import augment_classifier

# Feature names and order, labels and their priority, thresholds of the
# label rule, and the English names of the label counts.
FEATURES = [
    "ListPrice", "StandardCost", "TotalQty12m", "TotalRevenue12m", "TotalProfit12m",
    "AvgMonthlyQty", "StdDevQty", "AvgMargin", "MonthsWithSales", "OrderCount",
    "TotalQty3m", "AvgMonthlyQty3m", "TrendPct", "CoverageMonths", "SalesConsistency",
]
PRIORITY = {"CRITICO": 0, "BAIXO": 1, "NORMAL": 2, "INATIVO": 3}
COUNT_NAMES = {"CRITICO": "critical", "BAIXO": "low", "NORMAL": "normal", "INATIVO": "inactive"}
STRONG_FALL, MODERATE_FALL = -40, -15
LOW_VOLUME_QUANTILE = 0.33
MAX_COVERAGE_MONTHS = 24
PREDICTION = [
    "sk_produto", "ProductID", "ProductName", "Category", "AvgMonthlyQty", "TrendPct",
    "SalesConsistency", "StockStatus", "Confidence",
]
TRAIN_SHARE = 0.8


def stock_features(features: DataFrame) -> DataFrame:
    """Product features with coverage and consistency, complete rows only."""
    yearly = F.col("AvgMonthlyQty") * 12
    cap = F.lit(float(MAX_COVERAGE_MONTHS))
    coverage = F.when(yearly > 0, F.least(F.col("TotalQty12m") / yearly, cap)).otherwise(cap)
    return (
        features.withColumn("CoverageMonths", coverage)
        .withColumn("SalesConsistency", F.col("MonthsWithSales") / F.lit(12.0))
        .dropna(subset=FEATURES)
    )


def stock_labels(features: DataFrame) -> DataFrame:
    """Stock features with the rule label.

    The low-volume limit is taken over products that sold at all, so a mass of dead
    products does not pull it down.
    """
    rows = stock_features(features)
    active = rows.filter(F.col("TotalQty12m") > 0)
    limit = quantiles(active, "TotalQty12m", {"p33": LOW_VOLUME_QUANTILE}).select(
        F.coalesce(F.max("p33"), F.lit(1.0))).scalar()
    total, trend = F.col("TotalQty12m"), F.col("TrendPct")
    return rows.withColumn(
        "StockStatus",
        F.when(total == 0, "INATIVO").when(trend < STRONG_FALL, "CRITICO")
        .when((total <= limit) | (trend < MODERATE_FALL), "BAIXO").otherwise("NORMAL"),
    )


def label_counts(labelled: DataFrame, label: str = "StockStatus") -> DataFrame:
    return labelled.groupBy(label).agg(F.count("*").alias("products"))


def by_priority() -> list[Column]:
    """Sort order of predictions: urgency, then trend, then key."""
    rank = F.coalesce(*[F.when(F.col("StockStatus") == s, r) for s, r in PRIORITY.items()])
    return [rank, F.col("TrendPct"), F.col("sk_produto")]


def rule_predictions(labelled: DataFrame) -> DataFrame:
    """Rule labels in the layout of predictions, for alerts before any model exists."""
    return labelled.withColumn("Confidence", F.lit(100.0)).select(*PREDICTION)


# --- classifier ------------------------------------------------------------------


def fit_scaler(rows: DataFrame) -> PipelineModel:
    return Pipeline(stages=[
        VectorAssembler(inputCols=FEATURES, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
    ]).fit(rows)


def labelled_vectors(scaler: PipelineModel, labelled: DataFrame) -> DataFrame:
    """``row_id``, ``label`` and the scaled features as an array ``x``."""
    return scaler.transform(labelled).select(
        F.col("sk_produto").alias("row_id"), F.col("StockStatus").alias("label"),
        vector_to_array("scaled").alias("x"),
    )


def stratified_split(rows: DataFrame, share: float = TRAIN_SHARE, seed: int = 42) -> DataFrame:
    """Mark a hash-shuffled ``share`` of each label's rows, rounded up, for training."""
    shuffled = rows.withColumn("_h", hash_key(seed, "row_id"))
    numbered = numbered_by_hash(shuffled, "_h", ["label"])
    cut = F.ceil(F.col("group_size") * share)
    return numbered.withColumn("is_train", F.col("row_index") < cut).drop(
        "_h", "row_index", "group_size")


@dataclass(frozen=True)
class StockModel:
    """Scaling of the features, and boosted trees over the scaled ones."""

    scaler: PipelineModel
    trees: ClassTrees


@dataclass(frozen=True)
class StockTraining:
    """A fitted classifier and its predictions on the held-out rows."""

    model: StockModel
    held_out: DataFrame


def with_prediction(rows: DataFrame, trees: ClassTrees) -> DataFrame:
    """Rows with ``x``, the likeliest label (the first of a tie) and its probability."""
    surest = F.array_max("chances")
    labels = F.array(*[F.lit(name) for name in trees.labels])
    return with_chances(rows, trees).withColumns({
        "predicted": F.get(labels, (F.array_position("chances", surest) - 1).cast("int")),
        "surest": surest}).drop("chances")


def train_stock(
    labelled: DataFrame, augment: bool = False, split_first: bool = True,
    mixup_samples: int = 300, settings: BoostSettings = BoostSettings(),
) -> StockTraining:
    """Fit boosted trees, one a label and round, on rule labels.

    With ``augment`` the training part alone is balanced, so that held-out rows are all
    real; ``split_first=False`` balances before the split.
    """
    scaler = fit_scaler(labelled)
    rows = labelled_vectors(scaler, labelled)
    if augment and not split_first:
        rows = augment_classifier(rows, mixup_samples=mixup_samples)
    split = cut_lineage(stratified_split(rows, seed=settings.seed))
    train = split.filter("is_train").drop("is_train")
    if augment and split_first:
        train = cut_lineage(augment_classifier(train, mixup_samples=mixup_samples))
    trees = fit_classes(train, settings)
    held_out = with_prediction(split.filter("NOT is_train").select("label", "x"), trees)
    return StockTraining(StockModel(scaler, trees), held_out.select("label", "predicted"))


def stock_scores(model: StockModel, features: DataFrame) -> DataFrame:
    """Predicted label and confidence per product, in no particular order."""
    rows = model.scaler.transform(stock_features(features)).withColumn("x", vector_to_array("scaled"))
    return (
        with_prediction(rows, model.trees)
        .withColumn("StockStatus", F.col("predicted"))
        .withColumn("Confidence", round_half_even(F.col("surest") * 100, 1))
        .select(*PREDICTION)
    )


def stock_predict(model: StockModel, features: DataFrame) -> DataFrame:
    """Predicted label and confidence per product, most urgent first."""
    return stock_scores(model, features).orderBy(*by_priority())


# --- alerts and summaries --------------------------------------------------------


def _with_status(predictions: DataFrame, status: str) -> DataFrame:
    wanted = status.upper()
    return predictions if wanted == "ALL" else predictions.filter(F.col("StockStatus") == wanted)


def stock_alerts(predictions: DataFrame, status: str = "ALL") -> DataFrame:
    """Predictions of one status, or all, rounded for display, most urgent first."""
    return (
        _with_status(predictions, status)
        .withColumn("AvgMonthlyQty", round_half_even(F.col("AvgMonthlyQty"), 1))
        .withColumn("TrendPct", round_half_even(F.col("TrendPct"), 2))
        .orderBy(*by_priority())
    )


def status_counts(predictions: DataFrame, status: str = "ALL") -> DataFrame:
    """One row: number of products in all and per status, after the filter."""
    return _with_status(predictions, status).agg(F.count("*").alias("total"), *[
        F.count(F.when(F.col("StockStatus") == s, 1)).alias(name)
        for s, name in COUNT_NAMES.items()
    ])


def top_products(predictions: DataFrame, status: str, n: int = 5) -> DataFrame:
    """The first ``n`` products of a status, steepest fall first."""
    return _with_status(predictions, status).orderBy(*by_priority()).limit(n)


def stock_summary(predictions: DataFrame, n: int = 5) -> DataFrame:
    """One row: counts per status and the first ``n`` critical products."""
    top = top_products(predictions, "CRITICO", n).select(
        "sk_produto", "ProductID", "ProductName",
        round_half_even(F.col("AvgMonthlyQty"), 2).alias("AvgMonthlyQty"),
        round_half_even(F.col("TrendPct"), 2).alias("TrendPct"))
    entry = F.struct("TrendPct", "sk_produto", "ProductID", "ProductName", "AvgMonthlyQty")
    listed = top.agg(F.sort_array(F.collect_list(entry)).alias("top")).select("top").scalar()
    return status_counts(predictions).drop("total").withColumn("top_critical", listed)


def feature_summary(features: DataFrame, column: str = "TotalQty12m") -> DataFrame:
    """One row: count, mean, spread, extremes, quartiles and number of zeros."""
    quarters = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    quartiles = quantiles(features, column, quarters)
    value = F.col(column)
    return features.agg(
        F.count(value).alias("count"),
        settled(F.avg(value), 6).alias("mean"),
        settled(F.stddev_samp(value), 6).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
        F.count(F.when(value == 0, 1)).alias("zeros"),
        quartiles.select(F.struct(*[F.max(q).alias(q) for q in quarters])).scalar().alias("quartiles"),
    ).select("count", "mean", "std", "min", "max", "zeros",
             *[F.col(f"quartiles.{q}").alias(q) for q in quarters])
