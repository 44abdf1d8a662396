import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gondola.operators import dashboard, demand, patterns, reports, stock
from gondola.plans import models
from gondola.plans.train_all import TrainingPlan, train_all, train_classifier_only
from gondola.sources.orders_feed import star_from_orders
from gondola.sources.warehouse import (
    as_json_records,
    read_star,
    write_json_records,
    write_star,
)

SF_DIR = "/root/testdata/sf0.001"
QUICK = dict(trees=demand.TreeSettings(rounds=3, depth=3),
             boosting=stock.BoostSettings(rounds=5, depth=4, rate=0.3))


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("star"))
    write_star(star_from_orders(spark, SF_DIR), path)
    return read_star(spark, path)


@pytest.fixture(scope="module")
def trained(spark, star, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("models"))
    report = train_all(star, path, TrainingPlan(clusters=4, **QUICK))
    return path, report.collect()


def test_stored_star_gives_the_same_reports(spark, star):
    feed = star_from_orders(spark, SF_DIR)
    for build in (reports.sales_history, reports.product_features, reports.dashboard_kpis,
                  reports.sales_by_territory, reports.seller_performance):
        assert rows(build(star)) == rows(build(feed))


def test_partition_counts_do_not_matter(spark, star):
    build = [reports.sales_history, reports.product_features, reports.dashboard_kpis]
    found = []
    for n in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append([rows(b(star)) for b in build])
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert found[0] == found[1] == found[2]


def test_no_broadcast_of_products_still_right(spark, star):
    want = rows(reports.sales_history(star))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert rows(reports.sales_history(star)) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sales_by_day_prunes_days(spark, star, tmp_path):
    days = star.dim_tempo.orderBy("IDSK").limit(40)
    few = star.ft_vendas.join(days.select("IDSK"), star.ft_vendas.IDTempo == days.IDSK).select(
        *star.ft_vendas.columns)
    tables = {**star.tables(), "ft_vendas": few}
    write_star(type(star)(**tables), str(tmp_path), sales_by_day=True)
    stored = read_star(spark, str(tmp_path))
    assert rows(reports.sales_history(stored, 0)) == rows(
        reports.sales_history(type(star)(**tables), 0))
    plan = reports.sales_history(stored, 0)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_training_report(trained):
    path, report = trained
    figures = {(r.part, r.figure): r.value for r in report}
    assert figures["demand", "products_trained"] == 73
    assert 0 < figures["stock", "accuracy"] <= 1
    assert {part for part, _ in figures} == {"demand", "stock", "patterns"}


def test_loaded_models_predict_the_same(spark, trained):
    path, _ = trained
    features = models.load_table(spark, path, "product_features")
    history = models.load_table(spark, path, "sales_history")
    again = stock.stock_scores(models.load_stock(spark, path), features)
    assert rows(again) == rows(models.load_table(spark, path, "stock_predictions"))
    segments = patterns.pattern_predict(models.load_patterns(spark, path), features)
    assert rows(segments) == rows(models.load_table(spark, path, "segments"))
    forecasts = demand.forecast_seasonal(
        models.load_table(spark, path, "demand_seasonal"), 3).unionByName(
        demand.forecast_recursive(history, models.load_pipeline(path, "demand_trees"), 3))
    assert rows(forecasts) == rows(models.load_table(spark, path, "forecasts"))


def test_classifier_only_keeps_forecasts(spark, star, trained):
    path, _ = trained
    before = rows(models.load_table(spark, path, "forecasts"))
    report = train_classifier_only(star, path, augment=False, clusters=4, **QUICK)
    assert {r.part for r in report.collect()} == {"stock", "patterns"}
    assert rows(models.load_table(spark, path, "forecasts")) == before


def test_unknown_part_is_refused():
    with pytest.raises(ValueError, match="unknown parts"):
        TrainingPlan(parts=("demand", "shelves"))


def test_dashboard(spark, star, trained):
    path, _ = trained
    features = models.load_table(spark, path, "product_features")
    row = dashboard.dashboard(
        star, features, models.load_table(spark, path, "stock_predictions"),
        models.load_table(spark, path, "segments")).first()
    assert row.kpis.asDict() == reports.dashboard_kpis(star).first().asDict()
    assert row.total_products == features.count() == sum(p.product_count for p in row.patterns)
    sellers = [r.SellerName for r in reports.top_sellers(star).collect()]
    assert [s.SellerName for s in row.top_sellers] == sellers
    assert row.stock.critical >= len(row.stock.top_critical)


def test_json_records(spark, star, tmp_path):
    kpis = reports.dashboard_kpis(star)
    record = json.loads(as_json_records(kpis).first().record)
    assert record["total_orders"] == kpis.first().total_orders
    sellers = as_json_records(reports.seller_performance(star)).first().record
    assert json.loads(sellers)["QuotaAttainmentPct"] is None
    write_json_records(kpis, str(tmp_path / "kpis"))
    assert spark.read.json(str(tmp_path / "kpis")).count() == 1


def test_join_of_a_hot_product_is_split(spark, star, tmp_path):
    """With a third of all sales on one product, Spark splits that key's join tasks."""
    hot = F.when(F.col("IDPed") % 3 == 0, F.lit(2)).otherwise(F.col("IDProduto")).cast("long")
    skewed = star.ft_vendas.withColumn("IDProduto", hot).repartition(8)
    skewed.write.parquet(str(tmp_path / "sales"))
    again = replace(star, ft_vendas=spark.read.parquet(str(tmp_path / "sales")))
    want = rows(reports.seller_totals(again))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        for build in (reports.seller_totals, reports.dashboard_kpis, reports.sales_by_territory):
            frame = build(again)
            got = rows(frame)
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin(skew=true)" in plan
            if build is reports.seller_totals:
                assert got == want
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_lines_of_a_giant_order_are_split(spark, tmp_path):
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    for name in names:
        table = spark.read.parquet(f"{SF_DIR}/{name}.parquet")
        if name == "lineitem":
            giant = F.when(F.col("l_linenumber") % 3 == 0, F.lit(1)).otherwise(F.col("l_orderkey"))
            table = table.withColumn("l_orderkey", giant.cast("long")).repartition(8)
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    feed = star_from_orders(spark, str(tmp_path))
    want = rows(reports.dashboard_kpis(feed))
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        frame = reports.dashboard_kpis(feed)
        assert rows(frame) == want
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan
    finally:
        for key in settings:
            spark.conf.unset(key)
