import datetime as dt
from dataclasses import replace
from decimal import Decimal

import pytest

import __spark_entry__ as entry

from gondola.functions.lineage import size_tasks
from gondola.operators import demand, quality, reports
from gondola.operators.sales import with_stored_sales
from gondola.sources.orders_feed import star_from_orders
from gondola.sources.schema import SCHEMAS, conform
from hand_made import make_star, months, product, sale

D = dt.date


def test_profit_at_version_sold_but_latest_margin_shown(spark):
    star = make_star(
        spark, [sale(D(2020, 1, 5), 1, value=100)],
        [product(1, 7, margin=10, price=50), product(2, 7, margin=20, price=80)])
    history = reports.sales_history(star).first()
    assert history.TotalProfit == 10.0 and history.ProductName == "name 1"
    row = reports.product_features(star).first()
    assert row.sk_produto == 7 and row.ProductName == "name 2"
    assert row.TotalProfit12m == 10.0
    assert row.AvgMargin == 20.0 and row.ListPrice == 80.0 and row.StandardCost == 64.0


def test_product_without_natural_key(spark):
    day = D(2020, 1, 5)
    star = make_star(
        spark, [sale(day, 1, value=30), sale(day, 2, value=70, order=2)],
        [product(1, None, margin=10), product(2, 5, margin=10)])
    assert reports.sales_history(star).count() == 1
    assert reports.product_features(star).count() == 1
    assert reports.sales_by_territory(star).first().TotalRevenue == 100.0
    assert reports.seller_performance(star).first().TotalRevenue == 100.0
    assert reports.dashboard_kpis(star).first().total_revenue == 100.0


def test_window_keeps_one_month_more(spark):
    star = make_star(
        spark, [sale(d, 1, order=i) for i, d in enumerate(months(D(2018, 1, 31 - 3), 40))],
        [product(1, 1)])
    assert reports.sales_history(star, 36).count() == 37
    assert reports.sales_by_territory(star, 12).count() == 13


def test_one_sale_has_no_spread(spark):
    star = make_star(spark, [sale(D(2020, 1, 5), 1, qty=4)], [product(1, 1), product(2, 2)])
    rows = {r.sk_produto: r for r in reports.product_features(star).collect()}
    assert rows[1].StdDevQty == 0.0 and rows[1].AvgMonthlyQty == 4.0
    assert rows[2].TotalQty12m == 0.0 and rows[2].MonthsWithSales == 0 and rows[2].TrendPct == 0.0


def test_no_recent_sale(spark):
    star = make_star(
        spark, [sale(D(2020, 1, 5), 1), sale(D(2020, 12, 5), 2, order=2)],
        [product(1, 1), product(2, 2)])
    rows = {r.sk_produto: r for r in reports.product_features(star).collect()}
    assert rows[1].TrendPct == -100.0 and rows[1].AvgMonthlyQty3m == 0.0
    assert rows[2].TrendPct == 0.0


def test_order_with_two_versions_counts_once(spark):
    day = D(2020, 1, 5)
    star = make_star(
        spark, [sale(day, 1), sale(day, 2), sale(day, 2, order=9)],
        [product(1, 7), product(2, 7)])
    assert reports.sales_history(star).first().OrderCount == 2
    assert reports.product_features(star).first().OrderCount == 2


def test_kpis_without_earlier_sales(spark):
    row = reports.dashboard_kpis(make_star(spark, [sale(D(2020, 3, 5), 1)], [product(1, 1)])).first()
    assert row.mom_change_pct is None and row.yoy_change_pct is None
    assert (row.reference_month, row.reference_year) == ("2020-03", 2020)


def test_kpi_changes(spark):
    star = make_star(spark, [
        sale(D(2020, 3, 5), 1, value=150), sale(D(2020, 2, 5), 1, value=100, order=2),
        sale(D(2019, 2, 5), 1, value=500, order=3), sale(D(2020, 3, 6), 1, qty=0, order=4),
    ], [product(1, 1)])
    row = reports.dashboard_kpis(star).first()
    assert (row.mom_change_pct, row.yoy_change_pct) == (50.0, -50.0)
    assert row.total_orders == 3 and row.ytd_revenue == 250.0


def test_seller_territory_falls_back_to_city(spark):
    day = D(2020, 1, 5)
    star = make_star(
        spark, [sale(day, 1, seller=1), sale(day, 1, seller=2, value=20)], [product(1, 1)])
    rows = reports.seller_performance(star).collect()
    assert [(r.SellerName, r.Territory) for r in rows] == [("Rui", "Recife"), ("Ana", "Norte")]
    assert rows[0].QuotaAttainmentPct is None and rows[0].AnnualQuota == 0
    assert reports.top_sellers(star, 1).first().QuotaAttainmentPct == 0.0


def test_seller_months_option(spark):
    star = make_star(
        spark, [sale(D(2020, 1, 5), 1), sale(D(2021, 6, 5), 1, order=2)], [product(1, 1)])
    assert reports.seller_performance(star).first().OrderCount == 2
    assert reports.seller_performance(star, months=12).first().OrderCount == 1


def test_territory_null_state(spark):
    star = make_star(spark, [sale(D(2020, 1, 5), 1, customer=2)], [product(1, 1)])
    assert reports.sales_by_territory(star).first().Territory == "N/I"


def test_promotion_impact_is_empty_with_columns(spark):
    frame = reports.promotion_impact(spark)
    assert frame.count() == 0 and len(frame.columns) == 11


def test_dq_rules(spark):
    star = make_star(spark, [
        sale(None, 1), sale(D(2020, 1, 5), 1, qty=0), sale(D(2020, 1, 5), 1),
    ], [product(1, 1), product(2, 2, price=5)])
    rows = {r.description: r for r in quality.dq_checks(star).collect()}
    assert len(rows) == 12
    for name in ("ft_vendas: null IDTempo", "ft_vendas: Quant not positive",
                 "dim_produto: Uprc null or zero"):
        assert (rows[name].value, rows[name].ok, rows[name].tag) == (1, False, "ATENCAO")
    assert (rows["ft_vendas: rows"].value, rows["ft_vendas: rows"].tag) == (3, "ERRO")
    assert rows["dim_produto: products"].tag == "OK"
    assert quality.dq_overall(star).first().all_ok is False


def test_profit_total_uses_latest_margin_and_invalid_sales(spark):
    star = make_star(
        spark, [sale(D(2020, 1, 5), 1, qty=0, value=100)],
        [product(1, 7, margin=10), product(2, 7, margin=30)])
    assert tuple(quality.revenue_profit_total(star).first()) == (100.0, 30.0)


def test_eligible_products(spark):
    sales = [sale(d, v, order=i) for v, n in ((1, 4), (2, 12)) for i, d in
             enumerate(months(D(2019, 1, 5), n))]
    star = make_star(spark, sales, [product(1, 7), product(2, 8), product(3, 7)])
    assert tuple(quality.eligible_products(star).first()) == (1, 1)
    more = [sale(d, 3, order=90) for d in months(D(2019, 5, 5), 2)]
    star = make_star(spark, sales + more, [product(1, 7), product(2, 8), product(3, 7)])
    assert tuple(quality.eligible_products(star).first()) == (1, 1)
    assert tuple(quality.eligible_products(star, by="product").first()) == (2, 1)
    with pytest.raises(ValueError):
        quality.eligible_products(star, by="shelf")


def test_period_and_returns(spark):
    star = make_star(
        spark, [sale(D(2020, 1, 31), 1, qty=0), sale(D(2020, 3, 1), 1)], [product(1, 1)],
        returns=[(1, 1, Decimal(5)), (2, 1, Decimal(7))])
    assert quality.data_period(star).first().months == 2
    assert tuple(quality.returns_summary(star).first()) == (2, 12.0)


def test_schema_is_checked(spark):
    good = spark.createDataFrame([], SCHEMAS["dim_cliente"])
    assert conform("dim_cliente", good.withColumn("more", good.Est)).columns == good.columns
    with pytest.raises(ValueError, match="missing columns"):
        conform("dim_cliente", good.drop("Est"))
    with pytest.raises(ValueError, match="expected bigint"):
        conform("dim_cliente", good.withColumn("IDSK", good.Est))


def test_a_table_that_cannot_be_read_is_a_row(spark, tmp_path):
    star = star_from_orders(spark, "/root/testdata/sf0.001")
    (tmp_path / "part-0.parquet").write_text("no table")
    lost = spark.read.schema(star.dim_tempo.schema).parquet(str(tmp_path))
    rows = {r.table_name: r for r in reports.table_row_counts(replace(star, dim_tempo=lost)).collect()}
    assert not rows["dim_tempo"].ok and rows["dim_tempo"].row_count is None and rows["dim_tempo"].error
    assert all(r.ok and r.row_count > 0 for name, r in rows.items() if name != "dim_tempo")


def test_features_add_up_a_version_without_months(spark):
    """Sums go from sale to version to product, so that no wide row is kept for each month."""
    star = make_star(
        spark, [sale(d, v, qty=2, value=50, order=v * 100 + i) for v in (1, 2) for i, d in enumerate(months(D(2019, 1, 5), 30))],
        [product(1, 7, margin=10), product(2, 7, margin=20), product(2, 7, margin=30)])
    frame = reports.product_features(star)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    sums = [line for line in plan.splitlines() if "Aggregate [" in line and "sum(" in line]
    assert sums and not [line for line in sums if "trunc(" in line or "_groupingexpression" in line or "month#" in line]
    row = frame.first()
    # A repeated version counts twice, each time with its own margin.
    assert (row.MonthsWithSales, row.OrderCount, row.TotalQty12m) == (30, 60, 180.0)
    assert row.TotalProfit12m == 900.0


def test_stored_sales_give_the_same_and_are_joined_once(spark):
    star = star_from_orders(spark, "/root/testdata/sf0.001")
    stored = with_stored_sales(star)
    for build in (reports.sales_history, reports.product_features, reports.dashboard_kpis, reports.top_sellers):
        assert sorted(map(str, build(stored).collect())) == sorted(map(str, build(star).collect()))
    assert "lineitem" in "".join(reports.product_features(star).inputFiles())
    assert "lineitem" not in "".join(reports.product_features(stored).inputFiles())


def test_shuffles_have_more_partitions_for_more_rows(spark):
    names = ["spark.sql.adaptive.coalescePartitions.initialPartitionNum",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"]
    before = [spark.conf.get(name, None) for name in names]
    try:
        size_tasks(spark, 1_000)
        assert spark.conf.get(names[0]) == spark.conf.get("spark.sql.shuffle.partitions")
        size_tasks(spark, 216_000_000)
        assert int(spark.conf.get(names[0])) == 540
        plan = spark.range(10).selectExpr("id % 3 AS k").groupBy("k").count()
        assert ", 540)" in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in zip(names, before):
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_forecastable_products_store_no_history_and_no_features(spark):
    """Both are read once, for keys and names, so no measures and order counts are made of them."""
    path = "/root/testdata/sf0.001/."
    frame = entry.queries()["forecastable_products"](spark, path)
    assert not {"history", "features"} & {name for _, folder, name in entry._made if folder == path}
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Quant" not in "".join(line for line in plan.splitlines() if "Relation" not in line and "Filter" not in line)
    star = star_from_orders(spark, path)
    given = demand.forecastable_products(reports.monthly_sales(star), reports.product_features(star))
    assert frame.count() > 0 and sorted(map(str, frame.collect())) == sorted(map(str, given.collect()))
