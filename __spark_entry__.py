"""Queries over the given tables, with the SQL each one is checked against."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gondola.functions.columns import settled
from gondola.functions.lineage import checkpoint_dir, cut_lineage, scratch_folder, size_tasks
from gondola.operators import (
    augment,
    dashboard,
    demand,
    metrics,
    patterns,
    quality,
    reports,
    seasonal,
    stock,
)
from gondola.operators.sales import with_stored_sales
from gondola.plans.train_all import TrainingPlan, train_all
from gondola.sources.mart import SalesMart, write_slices
from gondola.sources.orders_feed import line_count, star_from_orders
from gondola.sources.schema import StarSchema
from gondola.sources.warehouse import as_json_records
from oracle.demand import DEMAND_SQL
from oracle.quality import QUALITY
from oracle.reports import REPORTS
from oracle.seasonal import SEASONAL_SQL
from oracle.stock import STOCK

try:
    from corpus_pipeline import run as run_pipeline
    from gondola.llm import queries as llm
except ModuleNotFoundError as missing:  # the folders, the pipeline or their packages are absent
    if missing.name not in ("gondola.llm", "corpus_pipeline"):
        print(f"queries over texts are left out: no module {missing.name}", file=sys.stderr)
    llm = None

Query = Callable[[SparkSession, str], DataFrame]

# Marts and models are read several times by the queries built on them. Each is made once
# per Spark application and table folder; the tables of a folder do not change meanwhile.
_made: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def _feed(spark: SparkSession, sf_dir: str) -> StarSchema:
    # Later steps reuse the partitioning by order; this lets Spark split a giant order's
    # lines all the same, at the price of a shuffle that only skewed data pays.
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return star_from_orders(spark, sf_dir)


def _star(spark: SparkSession, sf_dir: str) -> StarSchema:
    size_tasks(spark, _once(spark, sf_dir, "lines", lambda: line_count(spark, sf_dir)))
    return _feed(spark, sf_dir)


def _sold(spark: SparkSession, sf_dir: str) -> StarSchema:
    """The star with its valid sales written once, for what reads them several times."""
    star = _star(spark, sf_dir)
    return _once(spark, sf_dir, "sold", lambda: with_stored_sales(star))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "history",
                 lambda: cut_lineage(reports.monthly_sales(_sold(spark, sf_dir))))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "features",
                 lambda: cut_lineage(reports.product_features(_sold(spark, sf_dir))))


def _trees(spark: SparkSession, sf_dir: str):
    return _once(spark, sf_dir, "trees", lambda: demand.train_demand(
        demand.tree_rows(_history(spark, sf_dir))))


def _own_trees(spark: SparkSession, sf_dir: str) -> demand.ProductTrees:
    """A model of its own for every product."""
    return _once(spark, sf_dir, "own trees", lambda: demand.train_product_trees(
        demand.tree_rows(_history(spark, sf_dir))))


def _own_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _history(spark, sf_dir)
    return demand.tree_mae(_own_trees(spark, sf_dir), demand.tree_rows(history),
                           demand.with_month_count(history))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "labelled",
                 lambda: cut_lineage(stock.stock_labels(_features(spark, sf_dir))))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled products as scaled vectors."""
    labelled = _labelled(spark, sf_dir)
    return _once(spark, sf_dir, "vectors", lambda: cut_lineage(
        stock.labelled_vectors(stock.fit_scaler(labelled), labelled)))


def _classifier(spark: SparkSession, sf_dir: str, augmented: bool = False):
    return _once(spark, sf_dir, f"classifier {augmented}", lambda: stock.train_stock(
        _labelled(spark, sf_dir), augment=augmented))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _classifier(spark, sf_dir).model
    return stock.stock_scores(model, _features(spark, sf_dir))


def _pattern_model(spark: SparkSession, sf_dir: str):
    return _once(spark, sf_dir, "patterns",
                 lambda: patterns.train_patterns(_features(spark, sf_dir)))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.pattern_predict(_pattern_model(spark, sf_dir), _features(spark, sf_dir))


def _given_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by key instead of by K-means, so that SQL can follow."""
    return _features(spark, sf_dir).withColumn("Cluster", F.col("sk_produto") % 4)


def _given_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = _given_clusters(spark, sf_dir)
    return patterns.named_segments(assigned, patterns.pattern_labels(assigned))


def _on(source: Callable[[SparkSession, str], DataFrame], build: Callable[..., DataFrame],
        **options) -> Query:
    return lambda spark, sf_dir: build(source(spark, sf_dir), **options)


def _on_star(build: Callable[..., DataFrame], **options) -> Query:
    return _on(_star, build, **options)


def _on_history(build: Callable[..., DataFrame], **options) -> Query:
    return _on(_history, build, **options)


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stock.rule_predictions(_labelled(spark, sf_dir))


def _trend_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule labels, and a guess at them from the trend alone."""
    trend = F.col("TrendPct")
    return _labelled(spark, sf_dir).select(
        F.col("StockStatus").alias("label"),
        F.when(F.col("AvgMonthlyQty3m") == 0, "INATIVO").when(trend < -40, "CRITICO")
        .when(trend < -5, "BAIXO").otherwise("NORMAL").alias("predicted"))


def _held_out_report(augmented: bool) -> Query:
    return lambda spark, sf_dir: metrics.class_report(
        _classifier(spark, sf_dir, augmented).held_out)


def _dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.dashboard(
        _sold(spark, sf_dir), _features(spark, sf_dir), _predictions(spark, sf_dir),
        _segments(spark, sf_dir))


def entry(spark: SparkSession) -> DataFrame:
    """The executive KPI row over the smallest tables."""
    return reports.dashboard_kpis(_star(spark, "/root/testdata/sf0.001"))


def _train_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _history(spark, sf_dir)
    return demand.tree_mae(_trees(spark, sf_dir), demand.tree_rows(history),
                           demand.with_month_count(history))


def _demand_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _history(spark, sf_dir)
    return demand.demand_mae(history, _trees(spark, sf_dir), demand.tree_rows(history))


def _forecast_all(spark: SparkSession, sf_dir: str, steps: int = 3) -> DataFrame:
    return demand.forecast_all(_history(spark, sf_dir), _trees(spark, sf_dir), steps)


def _seasonal(spark: SparkSession, sf_dir: str, steps: int = 3) -> DataFrame:
    return demand.forecast_seasonal(demand.train_seasonal(_history(spark, sf_dir)), steps)


def _forecast_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _seasonal(spark, sf_dir, 1).select(F.min("sk_produto")).scalar()
    return demand.forecast_product(_forecast_all(spark, sf_dir, 12), first, 12)


def _forecast_short_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forecast by its own trees of the product with the fewest months, which every table has."""
    history = _history(spark, sf_dir)
    counted = demand.with_month_count(history)
    shortest = counted.agg(F.min(F.struct("n_months", "sk_produto"))["sk_produto"]).scalar()
    trees = demand.forecast_recursive(history, _own_trees(spark, sf_dir), 12, route="trees")
    return demand.forecast_product(trees, shortest, 12)


def _mart_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history from a mart by months that first sees the years before the last, the first of
    them with wrong amounts, and is then brought up to date."""
    star, folder = _star(spark, sf_dir), scratch_folder(spark)
    sales, year = star.ft_vendas, F.floor(F.col("IDTempo") / 10_000)
    first, last = sales.agg(F.min(year), F.max(year)).first()
    mart = SalesMart(spark, f"{folder}/sales", f"{folder}/mart")
    wrong = {c: F.when(year == first, F.lit(0)).otherwise(F.col(c)).cast("decimal(18,4)") for c in ("Quant", "TotLiq")}
    write_slices(sales.filter(year < last).withColumns(wrong), mart.sales_path, width=100)
    mart.refresh()
    write_slices(sales.filter((year == first) | (year == last)), mart.sales_path, width=100)
    mart.refresh()
    return mart.history(star)


def _forecastable_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History and features are read once here, so they are not stored, and Spark makes only
    the columns of them that are asked for."""
    star = _sold(spark, sf_dir)
    return demand.forecastable_products(reports.monthly_sales(star), reports.product_features(star))


def _trained_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _demand_mae(spark, sf_dir).select(
        "sk_produto", "model", F.col("mae").isNotNull().alias("has_error"))


def _six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: settled(F.col(c), 6) for c in columns})


def _tree_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(demand.tree_rows(_history(spark, sf_dir)), "roll_3", "roll_6", "level")


def _state(compat: bool) -> Query:
    return lambda spark, sf_dir: _six(
        demand.forecast_state(_history(spark, sf_dir), compat), "roll_3", "roll_6", "level")


def _forecast_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is forecast, and whether each forecast lies in its band."""
    low, mid, high = F.col("lower"), F.col("forecast"), F.col("upper")
    return _forecast_all(spark, sf_dir).select(
        "sk_produto", "step", "month", ((0 <= low) & (low <= mid) & (mid <= high)).alias("band_holds"))


def _gaussian_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each product's series and its copies, and how many are the given ones."""
    history = _history(spark, sf_dir)
    noisy = augment.augment_gaussian(history, keep_copy=True)
    given = history.select("sk_produto", "SaleMonth", "TotalQty", "TotalRevenue", F.lit(0).alias("copy"),
                           F.lit(1).alias("kept"))
    return noisy.join(given, ["sk_produto", "SaleMonth", "TotalQty", "TotalRevenue", "copy"], "left").groupBy(
        "sk_produto").agg(F.count("*").alias("series_rows"), F.count("kept").alias("unchanged"))


def _balanced_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augment.smote(_vectors(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("products"))


def _mixed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after mixing, how many of them are the given ones, and labels not known before."""
    vectors = _vectors(spark, sf_dir)
    known = vectors.select("label").distinct().withColumn("known", F.lit(1))
    given = vectors.select("row_id", "label", "x").withColumn("given", F.lit(1))
    return augment.mixup(vectors).join(given, ["row_id", "label", "x"], "left").join(known, "label", "left").agg(
        F.count("*").alias("row_total"), F.count("given").alias("given"),
        F.count(F.when(F.col("known").isNull(), 1)).alias("new_labels"))


def _split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stock.stratified_split(_vectors(spark, sf_dir)).groupBy("label", "is_train").agg(
        F.count("*").alias("products"))


def _predicted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with a prediction, and whether label and confidence are possible ones."""
    known = F.col("StockStatus").isin(list(stock.PRIORITY)) & F.col("Confidence").between(25.0, 100.0)
    return _predictions(spark, sf_dir).select("sk_produto", known.alias("possible"))


def _pattern_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of all patterns, and in how many patterns each is."""
    return _segments(spark, sf_dir).groupBy("sk_produto").agg(
        F.count_distinct("Pattern").alias("patterns"), F.count("*").alias("rows_of_it"))


def _dashboard_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard on rule labels and given clusters, one figure of each part."""
    row = dashboard.dashboard(
        _sold(spark, sf_dir), _features(spark, sf_dir), _rules(spark, sf_dir),
        _given_segments(spark, sf_dir))
    first = {name: F.get(name, F.lit(0)) for name in ("stock.top_critical", "patterns",
                                                      "top_sellers")}
    return row.select(
        "kpis.total_revenue", "kpis.total_orders", "kpis.reference_month",
        "stock.critical", "stock.low", "stock.normal", "stock.inactive",
        first["stock.top_critical"]["sk_produto"].alias("first_critical"),
        first["patterns"]["pattern"].alias("first_pattern"),
        first["patterns"]["product_count"].alias("first_pattern_products"),
        first["top_sellers"]["SellerName"].alias("first_seller"),
        first["top_sellers"]["TotalRevenue"].alias("first_seller_revenue"),
        "total_products",
    )


def _train(**options) -> Query:
    """A training job into a folder of its own; the result is its report."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{checkpoint_dir(spark)}/models-{uuid.uuid4()}"
        return train_all(_sold(spark, sf_dir), path, TrainingPlan(
            **options))
    return run


def queries() -> dict[str, Query]:
    """One entry per query: called with a session and a table folder."""
    extra = {} if llm is None else {**llm.queries(), "pipeline": run_pipeline}
    return {
        **extra,
        "sales_history": _on_star(reports.sales_history),
        "mart_history": _mart_history,
        "product_features": _on_star(reports.product_features),
        "sales_by_territory": _on_star(reports.sales_by_territory),
        "seller_performance": _on_star(reports.seller_performance),
        "seller_performance_12_months": _on_star(reports.seller_performance, months=12),
        "dashboard_kpis": _on_star(reports.dashboard_kpis),
        "top_sellers": _on_star(reports.top_sellers),
        "table_row_counts": _on(_feed, reports.table_row_counts),
        "dq_checks": _on_star(quality.dq_checks),
        "dq_overall": _on_star(quality.dq_overall),
        "data_period": _on_star(quality.data_period),
        "revenue_profit_total": _on_star(quality.revenue_profit_total),
        "eligible_products": _on_star(quality.eligible_products),
        "eligible_products_natural": _on_star(quality.eligible_products, by="product"),
        "top_groups": _on_star(quality.top_groups),
        "returns_summary": _on_star(quality.returns_summary),
        "demand_features": _on_history(demand.demand_features),
        "demand_split": _on_history(lambda h: demand.demand_split(demand.demand_features(h))),
        "train_demand": _train_demand,
        "train_seasonal": _on_history(
            lambda h: demand.seasonal_factors(demand.train_seasonal(h))),
        "seasonal_mae": _on_history(demand.seasonal_mae),
        "demand_mae": _demand_mae,
        "forecast_recursive": lambda spark, sf_dir: demand.forecast_recursive(
            _history(spark, sf_dir), _trees(spark, sf_dir), route="trees"),
        "train_demand_by_product": _own_mae,
        "forecast_recursive_by_product": lambda spark, sf_dir: demand.forecast_recursive(
            _history(spark, sf_dir), _own_trees(spark, sf_dir), route="trees"),
        "forecast_seasonal": _seasonal,
        "forecast_seasonal_12": lambda spark, sf_dir: _seasonal(spark, sf_dir, 12),
        "curve_coefficients": _on_history(
            lambda h: seasonal.curve_coefficients(seasonal.train_curve(h))),
        "curve_mae": _on_history(lambda h: seasonal.curve_mae(seasonal.train_curve(h))),
        "forecast_curve": _on_history(lambda h: seasonal.forecast_curve(seasonal.train_curve(h))),
        "curve_backtest": _on_history(seasonal.curve_backtest),
        "forecast_chosen": _on_history(seasonal.forecast_chosen),
        "forecast_product": _forecast_product,
        "forecast_short_product": _forecast_short_product,
        "forecast_keys": _forecast_keys,
        "trained_products": _trained_products,
        "tree_rows": _tree_rows,
        "forecast_state": _state(False),
        "forecast_state_compat": _state(True),
        "augment_gaussian_counts": _gaussian_counts,
        "smote_counts": _balanced_counts,
        "mixup_counts": _mixed_counts,
        "split_sizes": _split_sizes,
        "predicted_keys": _predicted_keys,
        "pattern_members": _pattern_members,
        "forecast_all": _forecast_all,
        "forecast_next_month": lambda spark, sf_dir: demand.forecast_next_month(
            _forecast_all(spark, sf_dir, 1)),
        "forecastable_products": _forecastable_products,
        "augment_gaussian": _on_history(augment.augment_gaussian),
        "stock_features": _on(_features, stock.stock_features),
        "stock_labels": _on(_features, stock.stock_labels),
        "stock_label_counts": _on(_labelled, stock.label_counts),
        "label_counts_json": lambda spark, sf_dir: as_json_records(
            stock.label_counts(_labelled(spark, sf_dir))),
        "smote": _on(_vectors, augment.smote),
        "mixup": _on(_vectors, augment.mixup),
        "augment_classifier": _on(_vectors, augment.augment_classifier),
        "train_stock": _held_out_report(augmented=False),
        "train_stock_augmented": _held_out_report(augmented=True),
        "class_report": _on(_trend_only, metrics.class_report),
        "stock_predict": lambda spark, sf_dir: stock.stock_predict(
            _classifier(spark, sf_dir).model, _features(spark, sf_dir)),
        "stock_alerts": _on(_predictions, stock.stock_alerts),
        "stock_alerts_rules": _on(_rules, stock.stock_alerts),
        "stock_alerts_critical_rules": _on(_rules, stock.stock_alerts, status="critico"),
        "stock_status_counts_rules": _on(_rules, stock.status_counts),
        "stock_summary": _on(_predictions, stock.stock_summary),
        "stock_top_critical_rules": _on(_rules, stock.top_products, status="CRITICO"),
        "stock_top_normal_rules": _on(_rules, stock.top_products, status="NORMAL"),
        "feature_summary": _on(_features, stock.feature_summary),
        "train_patterns": _on(_segments, patterns.pattern_summary),
        "pattern_labels": _on(_given_clusters, patterns.pattern_labels),
        "pattern_predict": _segments,
        "pattern_summary": _on(_given_segments, patterns.pattern_summary),
        "pattern_products": _on(
            _given_segments, patterns.pattern_products, pattern="Venda Sazonal"),
        "dashboard": _dashboard,
        "dashboard_rules": _dashboard_rules,
        "train_all": _train(),
        "train_classifier_only": _train(parts=("stock", "patterns"), augment=False),
    }


def oracle_sql() -> dict[str, str]:
    """The same results as DuckDB SQL, where SQL can express them."""
    extra = {} if llm is None else llm.oracle_sql()
    return {**extra, **REPORTS, "mart_history": REPORTS["sales_history"], **QUALITY, **DEMAND_SQL, **SEASONAL_SQL, **STOCK}
