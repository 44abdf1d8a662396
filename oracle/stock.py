"""SQL for stock labels, alerts on rule labels, class report, and patterns on given clusters."""

from oracle.reports import SELLERS
from oracle.star import FEATURES, STAR

LABELLED = """
engineered AS (
  SELECT *, CASE WHEN AvgMonthlyQty * 12 > 0
      THEN least(TotalQty12m / (AvgMonthlyQty * 12), 24.0) ELSE 24.0 END AS CoverageMonths,
    MonthsWithSales / CAST(12 AS DOUBLE) AS SalesConsistency
  FROM features
),
labelled AS (
  SELECT e.*, CASE WHEN TotalQty12m = 0 THEN 'INATIVO' WHEN TrendPct < -40 THEN 'CRITICO'
      WHEN TotalQty12m <= p.p33 OR TrendPct < -15 THEN 'BAIXO' ELSE 'NORMAL' END AS StockStatus
  FROM engineered e CROSS JOIN (
    SELECT coalesce(quantile_cont(TotalQty12m, 0.33), 1.0) AS p33
    FROM engineered WHERE TotalQty12m > 0) p
),
predicted AS (
  SELECT sk_produto, ProductID, ProductName, Category, AvgMonthlyQty, TrendPct, SalesConsistency,
    StockStatus, CAST(100 AS DOUBLE) AS Confidence,
    CASE StockStatus WHEN 'CRITICO' THEN 0 WHEN 'BAIXO' THEN 1 WHEN 'NORMAL' THEN 2 ELSE 3 END
      AS urgency
  FROM labelled
)
"""

CLUSTERED = """
clustered AS (
  SELECT *, sk_produto % 4 AS Cluster FROM features
),
medians AS (
  SELECT Cluster, median(AvgMonthlyQty) AS median_qty FROM clustered GROUP BY 1
),
named AS (
  SELECT Cluster, median_qty, CASE row_number() OVER (ORDER BY median_qty DESC, Cluster)
    WHEN 1 THEN 'Alta Rotatividade' WHEN 2 THEN 'Rotatividade Alta-Media'
    WHEN 3 THEN 'Venda Sazonal' ELSE 'Venda Estável' END AS Pattern
  FROM medians
)
"""

_HEAD = f"WITH {STAR}, {FEATURES}, {LABELLED}"
_COUNTS = """count(CASE WHEN StockStatus = 'CRITICO' THEN 1 END) AS critical,
  count(CASE WHEN StockStatus = 'BAIXO' THEN 1 END) AS low,
  count(CASE WHEN StockStatus = 'NORMAL' THEN 1 END) AS normal,
  count(CASE WHEN StockStatus = 'INATIVO' THEN 1 END) AS inactive"""
_COLUMNS = """sk_produto, ProductID, ProductName, Category, AvgMonthlyQty, TrendPct,
  SalesConsistency, StockStatus, Confidence"""


def _round(value: str, scale: str) -> str:
    """Half away from zero, for the class report."""
    return f"sign({value}) * floor(abs({value}) * {scale} + 0.5) / {scale}"


def _even(value: str, scale: str) -> str:
    return f"round_even(({value}) * {scale}, 0) / {scale}"


def _settled(value: str, scale: str) -> str:
    return _even(_even(value, f"({scale} * 1000)"), scale)


def _alerts(where: str) -> str:
    return f"""{_HEAD}
SELECT sk_produto, ProductID, ProductName, Category, {_even('AvgMonthlyQty', '10.0')}
  AS AvgMonthlyQty, {_even('TrendPct', '100.0')} AS TrendPct, SalesConsistency, StockStatus,
  Confidence FROM predicted {where}"""


def _top(status: str) -> str:
    return f"""{_HEAD} SELECT {_COLUMNS} FROM predicted WHERE StockStatus = '{status}'
ORDER BY TrendPct, sk_produto LIMIT 5"""


STOCK = {
    "smote_counts": _HEAD + """, sizes AS (SELECT StockStatus AS label, count(*) AS n FROM labelled GROUP BY 1)
SELECT label, (SELECT max(n) FROM sizes) AS products FROM sizes""",
    "mixup_counts": _HEAD + """
SELECT count(*) + 100 AS row_total, count(*) AS given, CAST(0 AS BIGINT) AS new_labels FROM labelled""",
    "split_sizes": _HEAD + """, sizes AS (SELECT StockStatus AS label, count(*) AS n FROM labelled GROUP BY 1)
SELECT label, t AS is_train, CAST(CASE WHEN t THEN ceil(n * 0.8) ELSE n - ceil(n * 0.8) END AS BIGINT)
  AS products
FROM sizes, (SELECT unnest([true, false]) AS t)
WHERE CASE WHEN t THEN ceil(n * 0.8) ELSE n - ceil(n * 0.8) END > 0""",
    "predicted_keys": _HEAD + " SELECT sk_produto, true AS possible FROM labelled",
    "pattern_members": f"""WITH {STAR}, {FEATURES}
SELECT sk_produto, CAST(1 AS BIGINT) AS patterns, CAST(1 AS BIGINT) AS rows_of_it FROM features""",
    "stock_features": _HEAD + " SELECT * FROM engineered",
    "stock_labels": _HEAD + " SELECT * FROM labelled",
    "stock_label_counts": _HEAD
    + " SELECT StockStatus, count(*) AS products FROM labelled GROUP BY 1",
    "label_counts_json": _HEAD + """
SELECT CAST(to_json({'StockStatus': StockStatus, 'products': products}) AS VARCHAR) AS record
FROM (SELECT StockStatus, count(*) AS products FROM labelled GROUP BY 1)""",
    "stock_alerts_rules": _alerts(""),
    "stock_alerts_critical_rules": _alerts("WHERE StockStatus = 'CRITICO'"),
    "stock_status_counts_rules": f"{_HEAD} SELECT count(*) AS total, {_COUNTS} FROM predicted",
    "stock_top_critical_rules": _top("CRITICO"),
    "stock_top_normal_rules": _top("NORMAL"),
    "feature_summary": f"""WITH {STAR}, {FEATURES}
SELECT count(TotalQty12m) AS count, {_settled('avg(TotalQty12m)', '1000000.0')} AS mean,
  {_settled('stddev_samp(TotalQty12m)', '1000000.0')} AS std, min(TotalQty12m) AS min,
  max(TotalQty12m) AS max, count(CASE WHEN TotalQty12m = 0 THEN 1 END) AS zeros,
  quantile_cont(TotalQty12m, 0.25) AS q25, quantile_cont(TotalQty12m, 0.5) AS q50,
  quantile_cont(TotalQty12m, 0.75) AS q75
FROM features""",
    "class_report": f"""{_HEAD},
scored AS (
  SELECT StockStatus AS label, CASE WHEN AvgMonthlyQty3m = 0 THEN 'INATIVO'
    WHEN TrendPct < -40 THEN 'CRITICO' WHEN TrendPct < -5 THEN 'BAIXO' ELSE 'NORMAL' END
    AS predicted
  FROM labelled
),
classes AS (
  SELECT class, sum(CASE WHEN label = class THEN 1 ELSE 0 END) AS support,
    sum(CASE WHEN predicted = class THEN 1 ELSE 0 END) AS claimed,
    sum(CASE WHEN label = class AND predicted = class THEN 1 ELSE 0 END) AS hit
  FROM scored CROSS JOIN (SELECT DISTINCT unnest([label, predicted]) AS class FROM scored)
  GROUP BY class
),
scores AS (
  SELECT class, CASE WHEN claimed > 0 THEN hit / claimed ELSE 0.0 END AS p,
    CASE WHEN support > 0 THEN hit / support ELSE 0.0 END AS r,
    2.0 * hit / (support + claimed) AS f, CAST(support AS BIGINT) AS support, hit FROM classes
)
SELECT class, {_round('p', '1000000.0')} AS precision, {_round('r', '1000000.0')} AS recall,
  {_round('f', '1000000.0')} AS f1_score, support FROM scores
UNION ALL SELECT 'accuracy', NULL, NULL, {_round('(sum(hit) / sum(support))', '1000000.0')},
  CAST(sum(support) AS BIGINT) FROM scores
UNION ALL SELECT 'macro avg', {_round('avg(p)', '1000000.0')}, {_round('avg(r)', '1000000.0')},
  {_round('avg(f)', '1000000.0')}, CAST(sum(support) AS BIGINT) FROM scores
UNION ALL SELECT 'weighted avg', {_round('(sum(p * support) / sum(support))', '1000000.0')},
  {_round('(sum(r * support) / sum(support))', '1000000.0')},
  {_round('(sum(f * support) / sum(support))', '1000000.0')}, CAST(sum(support) AS BIGINT)
  FROM scores""",
    "pattern_labels": f"WITH {STAR}, {FEATURES}, {CLUSTERED} SELECT * FROM named",
    "pattern_summary": f"""WITH {STAR}, {FEATURES}, {CLUSTERED}
SELECT n.Pattern AS pattern, count(*) AS product_count,
  {_settled('avg(AvgMonthlyQty)', '10.0')} AS avg_monthly_qty,
  {_settled('avg(StdDevQty)', '10.0')} AS avg_variation,
  {_settled('avg(AvgMargin)', '100.0')} AS avg_margin,
  {_settled('avg(TrendPct)', '100.0')} AS avg_trend_pct
FROM clustered c JOIN named n ON c.Cluster = n.Cluster GROUP BY n.Pattern""",
    "pattern_products": f"""WITH {STAR}, {FEATURES}, {CLUSTERED}
SELECT sk_produto, ProductID, ProductName, Category, Subcategory, AvgMonthlyQty, TrendPct, Pattern
FROM clustered c JOIN named n ON c.Cluster = n.Cluster WHERE Pattern = 'Venda Sazonal'""",
    "dashboard_rules": f"""{_HEAD}, {CLUSTERED}, {SELLERS},
kpis AS (
  SELECT {_even('CAST(round(sum(v.TotLiq), 4) AS DOUBLE)', '100.0')} AS total_revenue,
    count(DISTINCT v.IDPed) AS total_orders, strftime(max(b.last_day), '%Y-%m') AS reference_month
  FROM valid v JOIN dim_produto dp ON v.IDProduto = dp.IDSK CROSS JOIN bounds b
),
counts AS (SELECT {_COUNTS} FROM predicted),
top_critical AS (
  SELECT sk_produto FROM predicted WHERE StockStatus = 'CRITICO'
  ORDER BY TrendPct, sk_produto LIMIT 1
),
top_pattern AS (
  SELECT n.Pattern AS pattern, count(*) AS products FROM clustered c JOIN named n
    ON c.Cluster = n.Cluster
  GROUP BY 1 ORDER BY {_settled('avg(AvgMonthlyQty)', '10.0')} DESC, 1 LIMIT 1
),
top_seller AS (
  SELECT SellerName, {_even('TotalRevenue', '100.0')} AS revenue FROM sellers
  ORDER BY TotalRevenue DESC, SellerID LIMIT 1
)
SELECT k.*, c.*, (SELECT sk_produto FROM top_critical) AS first_critical,
  (SELECT pattern FROM top_pattern) AS first_pattern,
  (SELECT products FROM top_pattern) AS first_pattern_products,
  (SELECT SellerName FROM top_seller) AS first_seller,
  (SELECT revenue FROM top_seller) AS first_seller_revenue,
  (SELECT count(*) FROM features) AS total_products
FROM kpis k CROSS JOIN counts c""",
}
