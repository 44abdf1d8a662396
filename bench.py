"""Time the headline queries; prints one JSON line.

The star schema is stored once (``store_star``); the reports then read the stored
tables, as they would from a warehouse, and the models read the stored marts.
"""

from __future__ import annotations

import contextlib
import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from gondola.operators import dashboard, demand, metrics, patterns, quality, reports, stock
from gondola.sources.orders_feed import star_from_orders
from gondola.sources.warehouse import read_star, write_star

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    work = tempfile.mkdtemp(prefix="run-bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.checkpoint.dir", f"{work}/checkpoint")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    @contextlib.contextmanager
    def timed(name: str):
        start = time.perf_counter()
        yield
        times[name] = round(time.perf_counter() - start, 3)

    def run(name: str, df_of) -> None:
        with timed(name):
            df_of().write.format("noop").mode("overwrite").save()

    def store(name: str, df_of) -> DataFrame:
        with timed(name):
            df_of().write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    feed = star_from_orders(spark, SF_DIR)
    feed.ft_vendas.limit(1).collect()  # start the engine before the clock
    with timed("store_star"):
        write_star(feed, f"{work}/star")
    star = read_star(spark, f"{work}/star")

    history = store("sales_history", lambda: reports.sales_history(star))
    features = store("product_features", lambda: reports.product_features(star))
    run("sales_by_territory", lambda: reports.sales_by_territory(star))
    run("seller_performance", lambda: reports.seller_performance(star))
    run("dashboard_kpis", lambda: reports.dashboard_kpis(star))
    run("dq_checks", lambda: quality.dq_checks(star))
    run("eligible_products", lambda: quality.eligible_products(star))
    run("top_groups", lambda: quality.top_groups(star))
    run("demand_features", lambda: demand.demand_features(history))
    run("forecast_seasonal", lambda: demand.forecast_seasonal(demand.train_seasonal(history), 3))

    rows = store("tree_rows", lambda: demand.tree_rows(history))
    with timed("train_demand"):
        trees = demand.train_demand(rows, demand.TreeSettings())
    run("forecast_recursive", lambda: demand.forecast_recursive(history, trees, 3, route="trees"))

    labelled = store("stock_labels", lambda: stock.stock_labels(features))
    with timed("train_stock"):
        trained = stock.train_stock(labelled, settings=stock.BoostSettings())
        metrics.class_report(trained.held_out).collect()
    with timed("train_stock_augmented"):
        metrics.class_report(
            stock.train_stock(labelled, augment=True, settings=stock.BoostSettings()).held_out).collect()
    with timed("train_patterns"):
        segments_model = patterns.train_patterns(features)
    run("dashboard", lambda: dashboard.dashboard(
        star, features, stock.stock_scores(trained.model, features),
        patterns.pattern_predict(segments_model, features)))

    spark.stop()
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")),
        "cpus": int(CPUS), "boosting_rounds": demand.TreeSettings().rounds,
        "stock_rounds": stock.BoostSettings().rounds,
    }))


if __name__ == "__main__":
    main()
