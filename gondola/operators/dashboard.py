"""The executive dashboard as one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.operators.patterns import pattern_summary
from gondola.operators.reports import dashboard_kpis, top_sellers
from gondola.operators.stock import stock_summary
from gondola.sources.schema import StarSchema


def _listed(rows: DataFrame, falling: list[str], rising: list[str], kept: list[str]) -> DataFrame:
    """One row: a few rows as an array, by falling figures and then rising keys."""
    order = [*[(-F.col(c)).alias(f"_{c}") for c in falling],
             *[F.col(c).alias(f"_{c}") for c in rising]]
    sorted_ = F.sort_array(F.collect_list(F.struct(*order, F.struct(*kept).alias("row"))))
    return rows.agg(F.transform(sorted_, lambda x: x["row"]).alias("rows"))


def dashboard(
    star: StarSchema, features: DataFrame, predictions: DataFrame, segments: DataFrame
) -> DataFrame:
    """KPIs, stock counts, pattern summary, top sellers and number of products.

    Each part is a result of a few rows and enters as a scalar subquery.
    """
    patterns = _listed(pattern_summary(segments), ["avg_monthly_qty"], ["pattern"], [
        "avg_monthly_qty", "pattern", "product_count", "avg_variation", "avg_margin",
        "avg_trend_pct"])
    sellers = _listed(top_sellers(star, with_id=True), ["revenue"], ["SellerID"], [
        "TotalRevenue", "SellerName", "Territory", "QuotaAttainmentPct"])
    return features.sparkSession.range(1).select(
        dashboard_kpis(star).select(F.struct("*")).scalar().alias("kpis"),
        stock_summary(predictions).select(F.struct("*")).scalar().alias("stock"),
        patterns.scalar().alias("patterns"),
        sellers.scalar().alias("top_sellers"),
        features.agg(F.count("*").alias("n")).scalar().alias("total_products"),
    )
