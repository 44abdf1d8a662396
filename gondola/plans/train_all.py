"""The training job: read the star once, store the marts, train what is asked for.

    spark-submit gondola/plans/train_all.py <star folder> <output folder>
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.functions.lineage import drop_tables
from gondola.operators import demand, metrics, patterns, reports, stock
from gondola.plans import models
from gondola.sources.schema import StarSchema
from gondola.sources.warehouse import read_star

PARTS = ("demand", "stock", "patterns")


@dataclass(frozen=True)
class TrainingPlan:
    """What to train and how. The defaults are the full batch job."""

    parts: tuple[str, ...] = PARTS
    months: int = 36
    augment: bool = True
    split_first: bool = True
    mixup_samples: int = 300
    clusters: int = 6
    route: str = "auto"
    steps: int = 3
    trees: demand.TreeSettings = field(default_factory=demand.TreeSettings)
    boosting: stock.BoostSettings = field(default_factory=stock.BoostSettings)

    def __post_init__(self):
        unknown = set(self.parts) - set(PARTS)
        if unknown:
            raise ValueError(f"unknown parts {sorted(unknown)}; choose from {PARTS}")


def _train_demand(star: StarSchema, path: str, plan: TrainingPlan) -> dict[str, float]:
    history = models.save_table(reports.monthly_sales(star, plan.months), path, "sales_history")
    rows = models.save_table(demand.tree_rows(history), path, "demand_rows")
    trees = demand.train_demand(rows, plan.trees)
    models.save_pipeline(trees, path, "demand_trees")
    models.save_table(demand.train_seasonal(history), path, "demand_seasonal")
    errors = models.save_table(
        demand.demand_mae(history, trees, rows, plan.route), path, "demand_mae")
    models.save_table(
        demand.forecast_all(history, trees, plan.steps, plan.route), path, "forecasts")
    row = errors.agg(F.count("*").alias("n"), F.avg("mae").alias("mae")).first()
    return {"products_trained": float(row["n"]), "mean_mae": row["mae"]}


def _train_stock(features: DataFrame, path: str, plan: TrainingPlan) -> dict[str, float]:
    labelled = models.save_table(stock.stock_labels(features), path, "stock_labels")
    trained = stock.train_stock(
        labelled, augment=plan.augment, split_first=plan.split_first,
        mixup_samples=plan.mixup_samples, settings=plan.boosting)
    models.save_stock(trained.model, path)
    report = models.save_table(metrics.class_report(trained.held_out), path, "stock_report")
    models.save_table(stock.stock_scores(trained.model, features), path, "stock_predictions")
    # One row per class, plus three.
    lines = {r["class"]: r for r in report.collect()}
    found = {"accuracy": lines["accuracy"]["f1_score"]}
    for name in stock.PRIORITY:
        if name in lines:
            found[f"{name} precision"] = lines[name]["precision"]
            found[f"{name} recall"] = lines[name]["recall"]
            found[f"{name} support"] = float(lines[name]["support"])
    return found


def _train_patterns(features: DataFrame, path: str, plan: TrainingPlan) -> dict[str, float]:
    model = patterns.train_patterns(features, k=plan.clusters)
    models.save_patterns(features.sparkSession, model, path)
    segments = models.save_table(patterns.pattern_predict(model, features), path, "segments")
    summary = models.save_table(patterns.pattern_summary(segments), path, "pattern_summary")
    # One row per pattern, at most eight.
    return {f"{r['pattern']} products": float(r["product_count"]) for r in summary.collect()}


def train_all(star: StarSchema, path: str, plan: TrainingPlan = TrainingPlan()) -> DataFrame:
    """Train the planned parts into ``path``; returns one row per figure.

    Leaving ``demand`` out of the parts keeps the forecasts stored by an earlier run.
    """
    spark = star.ft_vendas.sparkSession
    figures: list[tuple[str, str, float]] = []

    def step(part: str, work: Callable[[], dict[str, float]]) -> None:
        start = time.perf_counter()
        figures.extend((part, name, value) for name, value in work().items())
        figures.append((part, "seconds", round(time.perf_counter() - start, 1)))

    if "demand" in plan.parts:
        step("demand", lambda: _train_demand(star, path, plan))
    if {"stock", "patterns"} & set(plan.parts):
        features = models.save_table(reports.product_features(star), path, "product_features")
        if "stock" in plan.parts:
            step("stock", lambda: _train_stock(features, path, plan))
        if "patterns" in plan.parts:
            step("patterns", lambda: _train_patterns(features, path, plan))
    result = spark.createDataFrame(figures, "part string, figure string, value double")
    return models.save_table(result.coalesce(1), path, "training_report")


def train_classifier_only(star: StarSchema, path: str, augment: bool = True, **options) -> DataFrame:
    """Retrain stock and patterns, keeping stored forecasts."""
    return train_all(star, path, TrainingPlan(
        parts=("stock", "patterns"), augment=augment, **options))


if __name__ == "__main__":
    session = SparkSession.builder.appName("train_all").getOrCreate()
    train_all(read_star(session, sys.argv[1]), sys.argv[2]).show(100, truncate=False)
    drop_tables(session)
