"""Sales patterns: products clustered on eight features and named by sales volume."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from gondola.functions.columns import settled
from gondola.functions.ordering import quantiles

# Feature names and order, and pattern names from high to low volume.
FEATURES = [
    "TotalQty12m", "AvgMonthlyQty", "StdDevQty", "MonthsWithSales", "ListPrice", "TrendPct",
    "TotalRevenue12m", "AvgMargin",
]
PATTERN_NAMES = [
    "Alta Rotatividade", "Rotatividade Alta-Media", "Venda Sazonal", "Venda Estável",
    "Baixa Rotatividade", "Baixíssima Rotatividade", "Nicho A", "Nicho B",
]
SEGMENT = [
    "sk_produto", "ProductID", "ProductName", "Category", "Subcategory", "AvgMonthlyQty",
    "StdDevQty", "MonthsWithSales", "TrendPct", "AvgMargin", "Cluster", "Pattern",
]


@dataclass(frozen=True)
class PatternModel:
    """Scaler and clusters, and the name of each cluster."""

    pipeline: PipelineModel
    names: dict[int, str]


def pattern_labels(assigned: DataFrame) -> DataFrame:
    """Name each cluster by its median volume, high to low; at most eight clusters."""
    medians = quantiles(assigned, "AvgMonthlyQty", {"median_qty": 0.5}, ["Cluster"])
    # One row per cluster.
    rank = F.row_number().over(Window.orderBy(F.desc("median_qty"), "Cluster"))
    names = F.array(*[F.lit(n) for n in PATTERN_NAMES])
    return medians.select("Cluster", "median_qty", rank.alias("rank")).select(
        "Cluster", "median_qty", F.element_at(names, F.col("rank")).alias("Pattern"))


def assign(pipeline: PipelineModel, features: DataFrame) -> DataFrame:
    rows = pipeline.transform(features.dropna(subset=FEATURES))
    return rows.withColumn("Cluster", F.col("prediction").cast("long"))


def train_patterns(
    features: DataFrame, k: int = 4, restarts: int = 10, seed: int = 42, parallelism: int = 4,
    iterations: int = 300,
) -> PatternModel:
    """K-means on scaled features, the cheapest of several starts.

    The starts are independent jobs on one cached frame; ``parallelism`` of them run at
    a time.
    """
    if not 1 <= k <= len(PATTERN_NAMES):
        raise ValueError(f"k must lie between 1 and {len(PATTERN_NAMES)}, not {k}")
    rows = features.dropna(subset=FEATURES)
    scaler = Pipeline(stages=[
        VectorAssembler(inputCols=FEATURES, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
    ]).fit(rows)
    vectors = scaler.transform(rows).select("scaled").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        vectors.count()
        fit = inheritable_thread_target(features.sparkSession)(
            lambda start: KMeans(
                k=k, seed=seed + start, maxIter=iterations, featuresCol="scaled").fit(vectors))
        with ThreadPoolExecutor(parallelism) as pool:
            starts = list(pool.map(fit, range(restarts)))
    finally:
        vectors.unpersist()
    best = min(starts, key=lambda m: m.summary.trainingCost)
    pipeline = PipelineModel(stages=[*scaler.stages, best])
    named = pattern_labels(assign(pipeline, features))
    return PatternModel(pipeline, {r.Cluster: r.Pattern for r in named.collect()})


def named_segments(assigned: DataFrame, names: DataFrame) -> DataFrame:
    """Products with cluster and pattern, given the names as a small frame."""
    return assigned.join(F.broadcast(names.select("Cluster", "Pattern")), "Cluster").select(*SEGMENT)


def pattern_predict(model: PatternModel, features: DataFrame) -> DataFrame:
    """Assign products to the trained clusters."""
    pairs = [F.lit(v) for item in model.names.items() for v in item]
    named = assign(model.pipeline, features).withColumn(
        "Pattern", F.create_map(*pairs)[F.col("Cluster")])
    return named.select(*SEGMENT)


def pattern_summary(segments: DataFrame) -> DataFrame:
    """Size and mean figures per pattern, largest volume first."""
    return (
        segments.groupBy(F.col("Pattern").alias("pattern"))
        .agg(
            F.count("*").alias("product_count"),
            settled(F.avg("AvgMonthlyQty"), 1).alias("avg_monthly_qty"),
            settled(F.avg("StdDevQty"), 1).alias("avg_variation"),
            settled(F.avg("AvgMargin"), 2).alias("avg_margin"),
            settled(F.avg("TrendPct"), 2).alias("avg_trend_pct"),
        )
        .orderBy(F.desc("avg_monthly_qty"), "pattern")
    )


def pattern_products(segments: DataFrame, pattern: str | None = None) -> DataFrame:
    """Products of one pattern, or of all."""
    chosen = segments if pattern is None else segments.filter(F.col("Pattern") == pattern)
    return chosen.select(
        "sk_produto", "ProductID", "ProductName", "Category", "Subcategory", "AvgMonthlyQty",
        "TrendPct", "Pattern",
    )
