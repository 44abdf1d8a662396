import numpy as np
import pytest
from pyspark.sql import functions as F

from gondola.operators import augment, metrics, patterns, stock

FEW = stock.BoostSettings(rounds=10, depth=4, rate=0.3)


def feature_rows(spark, rows):
    """Product features from (key, total, mean, trend) and plain values elsewhere."""
    return spark.createDataFrame([
        (k, f"P{k}", f"name {k}", "G", "S", 10.0, 8.0, "", "", float(total), total * 10.0,
         total * 1.0, float(mean), mean / 4.0, 20.0, min(k % 15, 14), 5, total / 3.0, mean * 0.9,
         float(trend))
        for k, total, mean, trend in rows
    ], "sk_produto bigint, ProductID string, ProductName string, Category string, "
       "Subcategory string, ListPrice double, StandardCost double, ProductClass string, "
       "ProductLine string, TotalQty12m double, TotalRevenue12m double, TotalProfit12m double, "
       "AvgMonthlyQty double, StdDevQty double, AvgMargin double, MonthsWithSales bigint, "
       "OrderCount bigint, TotalQty3m double, AvgMonthlyQty3m double, TrendPct double")


def test_label_edges(spark):
    # Volumes 100..400, so the limit is the value at rank 0.33 * 9 = 2.97.
    rows = [(i, 100 + 100 * (i // 3), 10, 0) for i in range(10)]
    rows += [(20, 0, 0, -90)]
    frame = feature_rows(spark, rows)
    limit = np.quantile([r[1] for r in rows if r[1] > 0], 0.33)
    quiet = [(100 + i, 10, 1, 0) for i in range(40)]  # keep the volume limit at 10
    edge = feature_rows(spark, quiet + [
        (1, 999, 1, -40), (2, 999, 1, -40.01), (3, 999, 1, -15), (4, 999, 1, -15.01),
        (6, 0, 0, -50), (7, 10, 1, -41), (8, 1, 1, 0), (9, 999, 1, 0)])
    got = {r.sk_produto: r.StockStatus for r in stock.stock_labels(edge).collect()}
    assert {k: v for k, v in got.items() if k < 100} == {
        1: "BAIXO", 2: "CRITICO", 3: "NORMAL", 4: "BAIXO", 6: "INATIVO", 7: "CRITICO", 8: "BAIXO",
        9: "NORMAL"}
    at = {r.sk_produto: r for r in stock.stock_labels(frame).collect()}
    for key, total, _, _ in rows:
        want = "INATIVO" if total == 0 else "BAIXO" if total <= limit else "NORMAL"
        assert at[key].StockStatus == want


def test_total_exactly_at_the_limit_is_low(spark):
    # Ranks 0..100 hold 1..101, so the 0.33 quantile is exactly 34.
    frame = feature_rows(spark, [(i, i, 1, 0) for i in range(1, 102)])
    got = {r.sk_produto: r.StockStatus for r in stock.stock_labels(frame).collect()}
    assert got[34] == "BAIXO" and got[35] == "NORMAL"


def test_coverage_and_consistency(spark):
    rows = {r.sk_produto: r for r in stock.stock_features(
        feature_rows(spark, [(1, 120, 5, 0), (2, 99999, 1, 0), (3, 5, 0, 0)])).collect()}
    assert rows[1].CoverageMonths == 2.0
    assert rows[2].CoverageMonths == 24.0 and rows[3].CoverageMonths == 24.0
    assert rows[2].SalesConsistency == pytest.approx(2 / 12)


def test_incomplete_rows_are_dropped(spark):
    frame = feature_rows(spark, [(1, 120, 5, 0), (2, 10, 1, 0)])
    holed = frame.withColumn("ListPrice", F.when(F.col("sk_produto") == 1, F.col("ListPrice")))
    assert stock.stock_features(holed).count() == 1


def labelled_rows(spark, sizes, spread=1.0, dims=3):
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for at, (label, n) in enumerate(sizes.items()):
        for _ in range(n):
            rows.append((i, label, (rng.normal(size=dims) * spread + 10 * at).tolist()))
            i += 1
    return spark.createDataFrame(rows, "row_id bigint, label string, x array<double>")


def on_segment(point, a, b):
    a, b, p = np.array(a), np.array(b), np.array(point)
    along = b - a
    if not along.any():
        return np.allclose(p, a)
    t = (p - a) @ along / (along @ along)
    return -1e-9 <= t <= 1 + 1e-9 and np.allclose(a + t * along, p)


def test_smote_balances_between_neighbours(spark):
    frame = labelled_rows(spark, {"a": 30, "b": 12, "c": 8})
    out = augment.smote(frame, k_neighbors=3).cache()
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {"a": 30, "b": 30, "c": 30}
    originals = {r.row_id: r for r in frame.collect()}
    new = [r for r in out.collect() if r.row_id not in originals]
    assert len(new) == 40 and len({r.row_id for r in new}) == 40
    for label in ("b", "c"):
        xs = [r.x for r in originals.values() if r.label == label]
        pairs = []
        for i, a in enumerate(xs):
            gaps = [(np.linalg.norm(np.array(a) - np.array(b)), j) for j, b in enumerate(xs) if j != i]
            pairs += [(a, xs[j]) for _, j in sorted(gaps)[:3]]
        for r in (r for r in new if r.label == label):
            assert any(on_segment(r.x, a, b) for a, b in pairs)
    again = augment.smote(frame.repartition(7), k_neighbors=3)
    assert sorted((r.row_id, r.label) for r in again.collect()) == sorted(
        (r.row_id, r.label) for r in out.collect())


def test_smote_with_tiny_classes(spark):
    out = augment.smote(labelled_rows(spark, {"a": 10, "b": 4, "c": 2}), k_neighbors=3)
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {"a": 10, "b": 10, "c": 10}


def test_smote_with_copies_and_a_single_row(spark):
    rows = [(i, "big", [float(i), 0.0]) for i in range(20)]
    rows += [(100 + i, "copies", [5.0, 5.0]) for i in range(9)] + [(120, "copies", [6.0, 5.0])]
    rows += [(200, "one", [9.0, 9.0])]
    frame = spark.createDataFrame(rows, "row_id bigint, label string, x array<double>")
    out = augment.smote(frame).cache()
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {"big": 20, "copies": 20, "one": 20}
    assert {tuple(r.x) for r in out.filter("label = 'one'").collect()} == {(9.0, 9.0)}
    for r in out.filter("label = 'copies'").collect():
        assert r.x[1] == 5.0 and 5.0 <= r.x[0] <= 6.0


def test_mixup(spark):
    frame = labelled_rows(spark, {"a": 12, "b": 8})
    out = augment.mixup(frame, n_samples=50).cache()
    assert out.count() == 70
    originals = {r.row_id for r in frame.collect()}
    centre = {"a": 0.0, "b": 10.0}
    for r in out.collect():
        if r.row_id not in originals:
            nearer = min(centre, key=lambda c: abs(np.mean(r.x) - centre[c]))
            assert r.label == nearer or 3.5 < np.mean(r.x) < 6.5
    again = augment.mixup(frame.repartition(6), n_samples=50)
    rounded = lambda df: sorted((r.row_id, r.label) for r in df.collect())
    assert rounded(again) == rounded(out)


def test_augment_switches(spark):
    frame = labelled_rows(spark, {"a": 12, "b": 8})
    assert augment.augment_classifier(frame, use_mixup=False).count() == 24
    assert augment.augment_classifier(frame, use_smote=False, mixup_samples=5).count() == 25
    assert augment.augment_classifier(frame, mixup_samples=5).count() == 29


def test_stratified_split(spark):
    frame = labelled_rows(spark, {"a": 50, "b": 11, "c": 1})
    for n in (1, 8):
        split = stock.stratified_split(frame.repartition(n))
        counts = {(r.label, r.is_train): r["count"] for r in
                  split.groupBy("label", "is_train").count().collect()}
        assert counts == {("a", True): 40, ("a", False): 10, ("b", True): 9, ("b", False): 2,
                          ("c", True): 1}


def test_class_report_with_class_never_predicted(spark):
    pairs = [("a", "a")] * 4 + [("a", "b")] + [("b", "b")] * 3 + [("c", "a")] * 2
    frame = spark.createDataFrame(pairs, "label string, predicted string")
    rows = {r["class"]: r for r in metrics.class_report(frame).collect()}
    assert rows["c"].precision == 0.0 and rows["c"].recall == 0.0 and rows["c"].support == 2
    assert rows["a"].precision == pytest.approx(4 / 6, abs=1e-6) and rows["a"].recall == 0.8
    assert rows["accuracy"].f1_score == 0.7 and rows["accuracy"].support == 10
    assert rows["macro avg"].recall == 0.6
    assert rows["weighted avg"].precision == pytest.approx(0.5 * 4 / 6 + 0.3 * 0.75, abs=1e-6)


@pytest.fixture(scope="module")
def products(spark):
    rows = []
    for i in range(240):
        kind = i % 4
        total = [0, 5000 + i, 4000 + i, 50 + i % 40][kind]
        rows.append((i, total, total / 100, [0, -60 - i % 7, 5 + i % 9, -20 + i % 3][kind]))
    return feature_rows(spark, rows).cache()


@pytest.mark.parametrize("augmented,split_first", [(False, True), (True, True), (True, False)])
def test_classifier_beats_the_largest_class(spark, products, augmented, split_first):
    labelled = stock.stock_labels(products).cache()
    trained = stock.train_stock(
        labelled, augment=augmented, split_first=split_first, mixup_samples=20, settings=FEW)
    report = {r["class"]: r for r in metrics.class_report(trained.held_out).collect()}
    assert report["accuracy"].f1_score > 0.9
    rows = stock.stock_predict(trained.model, products).collect()
    assert len(rows) == 240 and rows[0].asDict().keys() == set(stock.PREDICTION)
    keys = [(stock.PRIORITY[r.StockStatus], r.TrendPct) for r in rows]
    assert keys == sorted(keys)
    assert all(25 <= r.Confidence <= 100 for r in rows)
    truth = {r.sk_produto: r.StockStatus for r in labelled.collect()}
    assert sum(truth[r.sk_produto] == r.StockStatus for r in rows) > 0.9 * len(rows)


def test_alerts_and_summary(spark, products):
    found = stock.rule_predictions(stock.stock_labels(products)).cache()
    everything = stock.status_counts(found).first()
    assert everything.total == 240 == sum(
        everything[c] for c in ("critical", "low", "normal", "inactive"))
    only = stock.status_counts(found, "critico").first()
    assert only.total == only.critical == everything.critical and only.normal == 0
    assert stock.stock_alerts(found, "Critico").count() == everything.critical
    top = stock.top_products(found, "CRITICO", 5).collect()
    assert [r.TrendPct for r in top] == sorted(
        r.TrendPct for r in found.filter("StockStatus = 'CRITICO'").collect())[:5]
    summary = stock.stock_summary(found).first()
    assert summary.critical == everything.critical
    assert [r.sk_produto for r in summary.top_critical] == [r.sk_produto for r in top]


def test_feature_summary(spark, products):
    row = stock.feature_summary(products).first()
    values = [r.TotalQty12m for r in products.collect()]
    assert row["count"] == 240 and row.zeros == 60
    assert (row.q25, row.q50, row.q75) == tuple(np.quantile(values, [0.25, 0.5, 0.75]))


def test_patterns(spark, products):
    model = patterns.train_patterns(products, k=3, restarts=3)
    segments = patterns.pattern_predict(model, products).cache()
    assert segments.count() == 240 and set(segments.columns) == set(patterns.SEGMENT)
    names = patterns.PATTERN_NAMES[:3]
    assert set(model.names.values()) == set(names)
    medians = {r.Pattern: r.m for r in segments.groupBy("Pattern").agg(
        F.median("AvgMonthlyQty").alias("m")).collect()}
    assert [medians[n] for n in names] == sorted(medians.values(), reverse=True)
    summary = patterns.pattern_summary(segments).collect()
    assert sum(r.product_count for r in summary) == 240
    assert patterns.pattern_products(segments, names[0]).count() == [
        r.product_count for r in summary if r.pattern == names[0]][0]
    again = patterns.train_patterns(products, k=3, restarts=3)
    assert patterns.pattern_predict(again, products).select("sk_produto", "Pattern").exceptAll(
        segments.select("sk_produto", "Pattern")).count() == 0


@pytest.mark.parametrize("k", [0, 9])
def test_number_of_patterns_is_checked(spark, products, k):
    with pytest.raises(ValueError):
        patterns.train_patterns(products, k=k)
