import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gondola.functions import boosting
from gondola.functions.boosting import BoostSettings, walked
from gondola.operators import augment, demand
from hand_made import history_rows, months

D = dt.date
FEW_ROUNDS = demand.TreeSettings(rounds=5, depth=3)


def series(start, values):
    return dict(zip(months(start, len(values)), values))


def test_lags_are_positional_and_windows_full(spark):
    seven = series(D(2020, 1, 1), [1, 2, 3, 4, 5, 6, 7, 8])
    del seven[D(2020, 4, 1)]
    rows = demand.demand_features(history_rows(spark, {1: seven})).orderBy("SaleMonth").collect()
    assert [r.SaleMonth for r in rows] == [D(2020, 7, 1), D(2020, 8, 1)]
    first = rows[0]
    assert (first.lag_1, first.lag_2, first.lag_3) == (6.0, 5.0, 3.0)
    assert first.roll_3 == 6.0 and first.roll_6 == 4.0 and first.trend == 5


def test_leak_free_means_end_one_row_earlier(spark):
    frame = history_rows(spark, {1: series(D(2020, 1, 1), range(1, 9))})
    row = demand.demand_features(frame, leak_free=True).orderBy("SaleMonth").first()
    assert (row.TotalQty, row.roll_3, row.roll_6) == (7.0, 5.0, 3.5)


def test_short_products_are_left_out(spark):
    frame = history_rows(spark, {1: series(D(2020, 1, 1), [1] * 5)})
    assert demand.demand_features(frame).count() == 0
    assert demand.with_month_count(frame).count() == 0


def test_split_takes_at_least_one(spark):
    frame = history_rows(spark, {
        1: series(D(2020, 1, 1), range(6)), 2: series(D(2020, 1, 1), range(15))})
    split = demand.demand_split(demand.demand_features(frame))
    counts = {(r.sk_produto, r.is_train): r["count"] for r in
              split.groupBy("sk_produto", "is_train").count().collect()}
    assert counts == {(1, True): 1, (2, True): 8, (2, False): 2}


def test_densify_fills_gaps_with_zero(spark):
    gap = series(D(2020, 1, 1), [5, 6, 7])
    del gap[D(2020, 2, 1)]
    rows = demand.densify(history_rows(spark, {1: gap})).orderBy("SaleMonth").collect()
    assert [(r.SaleMonth.month, r.TotalQty, r.ProductName) for r in rows] == [
        (1, 5.0, "name 1"), (2, 0.0, "name 1"), (3, 7.0, "name 1")]
    assert rows[1].AvgUnitPrice is None


def test_seasonal_model_recovers_a_line(spark):
    frame = history_rows(spark, {3: series(D(2019, 1, 1), [10 + 2 * i for i in range(24)])})
    model = demand.train_seasonal(frame)
    row = model.first()
    assert row.slope == pytest.approx(2) and row.intercept == pytest.approx(10)
    got = demand.forecast_seasonal(model, 2).orderBy("step").collect()
    assert [(r.month, r.forecast, r.lower, r.upper) for r in got] == [
        ("2021-01", 58, 58, 58), ("2021-02", 60, 60, 60)]
    assert demand.seasonal_mae(frame).first().mae == 0.0


def test_forecast_is_never_negative(spark):
    frame = history_rows(spark, {3: series(D(2019, 1, 1), [24 - 2 * i for i in range(13)])})
    rows = demand.forecast_seasonal(demand.train_seasonal(frame), 12).collect()
    assert len(rows) == 12 and all(0 <= r.lower <= r.forecast <= r.upper for r in rows)
    model = demand.train_seasonal(frame)
    assert demand.forecast_seasonal(model, 14).count() == 14
    assert demand.forecast_product(demand.forecast_seasonal(model, 14), 3, 20).count() == 12
    with pytest.raises(ValueError):
        demand.forecast_seasonal(model, 0)


@pytest.fixture(scope="module")
def mixed(spark):
    return history_rows(spark, {
        1: series(D(2020, 1, 1), [10, 12, 11, 13, 12, 14, 13, 12]),
        2: series(D(2019, 1, 1), [50 + i % 5 for i in range(30)]),
        4: series(D(2020, 1, 1), [3, 4, 3, 4, 3, 4]),
        5: series(D(2020, 1, 1), [3, 4]),
    }).cache()


def test_recursion(spark, mixed):
    model = demand.train_demand(demand.tree_rows(mixed), FEW_ROUNDS)
    rows = demand.forecast_recursive(mixed, model, steps=5, route="trees").collect()
    by_product = {}
    for r in rows:
        by_product.setdefault(r.sk_produto, []).append(r)
    assert set(by_product) == {1, 2, 4}
    for found in by_product.values():
        found.sort(key=lambda r: r.step)
        assert [r.step for r in found] == [1, 2, 3, 4, 5]
        assert [r.month for r in found] == sorted({r.month for r in found})
        for r in found:
            assert 0 <= r.lower <= r.forecast <= r.upper
            assert abs(r.lower - 0.82 * r.forecast) <= 0.5
    assert by_product[1][0].month == "2020-09" and by_product[2][0].month == "2021-07"
    auto = demand.forecast_all(mixed, model, 3)
    assert {r.sk_produto for r in auto.select("sk_produto").distinct().collect()} == {1, 2, 4}
    assert demand.forecast_product(auto, 2, 2).count() == 2
    assert demand.forecast_product(auto, 99).count() == 0
    assert demand.forecast_next_month(auto).count() == 3
    assert [r.sk_produto for r in demand.forecast_next_month(auto, 2).collect()] == [1, 2]


def test_recursion_is_one_step_at_a_time(spark, mixed):
    """The first steps do not depend on how many follow, nor on a lineage cut between."""
    model = demand.train_demand(demand.tree_rows(mixed), FEW_ROUNDS)
    short = demand.forecast_recursive(mixed, model, 2, route="trees")
    long = demand.forecast_recursive(mixed, model, 9, route="trees").filter("step <= 2")
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, long.collect()))


def test_state_shift(spark, mixed):
    corrected = demand.forecast_state(mixed).filter("sk_produto = 1").first()
    as_before = demand.forecast_state(mixed, compat=True).filter("sk_produto = 1").first()
    assert (corrected.lag_1, corrected.lag_2, corrected.lag_3) == (12.0, 13.0, 14.0)
    assert (as_before.lag_1, as_before.lag_2, as_before.lag_3) == (12.0, 14.0, 12.0)
    assert as_before.last_trend == corrected.last_trend + 1 == 8


def test_errors_per_product(spark, mixed):
    rows = demand.tree_rows(mixed)
    model = demand.train_demand(rows, FEW_ROUNDS)
    got = {r.sk_produto: r for r in demand.demand_mae(mixed, model, rows).collect()}
    assert got[2].model == "seasonal" and got[1].model == "trees"
    assert set(got) == {1, 2, 4} and got[4].mae is None


def test_trees_follow_a_signal(spark):
    """Alternating series: the trees beat each product's own level by far."""
    frame = history_rows(spark, {
        k: series(D(2018, 1, 1), [(20 if i % 2 else 5) * (1 + k % 7) for i in range(30)]) for k in range(40)})
    rows = demand.tree_rows(frame).cache()
    model = demand.train_demand(rows, demand.TreeSettings(rounds=60, rate=0.1))
    miss = demand.tree_mae(model, rows, frame).agg(F.avg("mae")).first()[0]
    level = rows.filter("NOT is_train").agg(F.avg(F.abs(F.col("TotalQty") - F.col("level")))).first()[0]
    assert miss < 0.3 * level


def test_product_list(spark, mixed):
    names = spark.createDataFrame([(1, "first")], "sk_produto bigint, ProductName string")
    rows = demand.forecastable_products(mixed, names).collect()
    assert [tuple(r) for r in rows] == [
        (1, "first"), (2, "Produto sk_2"), (4, "Produto sk_4")]


def test_gaussian_copies(spark):
    frame = history_rows(spark, {
        1: series(D(2000, 1, 1), [1000.0] * 200), 2: series(D(2020, 1, 1), [0.0] * 4)})
    noisy = augment.augment_gaussian(frame, copies=2, keep_copy=True).cache()
    assert noisy.count() == 3 * 204
    back = noisy.filter("copy = 0").drop("copy")
    assert back.exceptAll(frame).count() == 0
    dead = noisy.filter("sk_produto = 2").select("TotalQty", "TotalRevenue").distinct().collect()
    assert [tuple(r) for r in dead] == [(0.0, 0.0)]
    moved = noisy.filter("sk_produto = 1 AND copy > 0").agg(
        F.stddev_samp("TotalQty").alias("q"), F.stddev_samp("TotalRevenue").alias("r"),
        F.min("TotalQty").alias("least"), F.count_distinct("TotalQty").alias("n")).first()
    assert 42 < moved.q < 58 and 420 < moved.r < 580 and moved.least >= 0 and moved.n > 50
    again = augment.augment_gaussian(frame.repartition(5), copies=2, keep_copy=True)
    assert again.exceptAll(noisy).count() == 0


def test_gaussian_hides_copy_number(spark):
    frame = history_rows(spark, {1: series(D(2020, 1, 1), [5.0] * 3)})
    assert augment.augment_gaussian(frame).columns == frame.columns


def test_one_model_a_product(spark, mixed):
    """Own trees follow their product; the recursion equals one done step by step."""
    rows = demand.tree_rows(mixed)
    model = demand.train_product_trees(rows, BoostSettings(rounds=40, depth=3, rate=0.2))
    fitted = {r.sk_produto for r in rows.filter("is_train").select("sk_produto").distinct().collect()}
    assert {r.sk_produto for r in model.table.select("sk_produto").collect()} == fitted
    short = demand.forecast_recursive(mixed, model, 2, route="trees")
    long = demand.forecast_recursive(mixed, model, 9, route="trees")
    assert sorted(short.collect()) == sorted(long.filter("step <= 2").collect())
    assert all(0 <= r.lower <= r.forecast <= r.upper for r in long.collect())

    state = demand.forecast_state(mixed)
    got = {(r.sk_produto, r.step): r.forecast for r in long.collect()}
    for step in range(1, 4):
        month = F.add_months("last_month", step)
        scored = model.transform(state.withColumns({
            "month": F.month(month), "quarter": F.quarter(month), "year": F.year(month),
            "trend": F.col("last_trend") + step})).collect()
        for r in scored:
            assert got[r.sk_produto, step] == max(0, round(round(r.predicted, 6)))
        state = spark.createDataFrame([(
            r.sk_produto, r.last_month, float(got[r.sk_produto, step]), r.lag_1, r.lag_2,
            float(np.rint((2 * r.roll_3 + got[r.sk_produto, step]) / 3 * 10) / 10), r.roll_6, r.last_trend,
            r.level) for r in scored],
            "sk_produto long, last_month date, lag_1 double, lag_2 double, lag_3 double, roll_3 double, "
            "roll_6 double, last_trend long, level double")


def test_models_of_products_are_not_stored(spark, mixed):
    """Predictions come from the tasks that grow the models, and are those of the models as a table."""
    rows = demand.tree_rows(mixed)
    model = demand.train_product_trees(rows, BoostSettings(rounds=30, depth=3, rate=0.2))
    assert "trees" not in model.rows.columns
    assert set(model.rows.inputFiles()) and all("tables-" in f for f in model.rows.inputFiles())
    odd = rows.unionByName(rows.limit(1).withColumns({"sk_produto": F.lit(-5).cast("long"), "level": F.lit(7.5)}))
    odd = odd.unionByName(rows.limit(1).withColumn("lag_1", F.lit(None).cast(rows.schema["lag_1"].dataType)))
    got = model.transform(odd)
    assert got.columns == [*odd.columns, "predicted"]
    x = F.array(*[F.col(f).cast("double") for f in demand.FEATURES])
    want = odd.join(model.table, "sk_produto", "left").withColumn("predicted", F.coalesce(
        F.col("base") + walked(F.col("trees"), x, 3), F.col("level"))).select(got.columns)
    key = lambda r: str(tuple(r)[:-1])
    told, plain = (sorted(d.collect(), key=key) for d in (got, want))
    assert [r[:-1] for r in told] == [r[:-1] for r in plain]
    assert np.allclose([r.predicted for r in told], [r.predicted for r in plain], rtol=0, atol=1e-9)


def test_tasks_of_a_round_do_not_grow_with_every_row():
    assert [demand._round_tasks(n, 12) for n in (0, 1, 50_001, 600_000)] == [1, 1, 2, 12]
    # By 50,000 rows a task these would be 400 and 80 tasks, in each of a few thousand jobs.
    assert demand._round_tasks(20_000_000, 12) == 40
    assert demand._round_tasks(4_000_000, 12) == 24


def test_shared_trees_do_not_depend_on_tasks(spark, monkeypatch):
    """However many tasks the rows are dealt out to, the draws and so the trees are the same."""
    rows = demand.tree_rows(history_rows(spark, {
        k: series(D(2018, 1, 1), [(k * 7 + i * 5) % 23 + 1 for i in range(30)]) for k in range(30)})).cache()
    found = []
    for each, alone in ((50_000, 1 << 17), (50_000, 10), (100, 10)):
        monkeypatch.setattr(demand, "ROWS_PER_TASK", each)
        monkeypatch.setattr(boosting, "ROWS_IN_ONE_TASK", alone)
        model = demand.train_demand(rows.repartition(each % 7 + 1), FEW_ROUNDS)
        found.append([r.predicted for r in model.transform(rows).orderBy("sk_produto", "trend").collect()])
    assert found[1] == pytest.approx(found[0], abs=1e-9) and found[2] == pytest.approx(found[0], abs=1e-9)
    assert len(set(found[0])) > 10
