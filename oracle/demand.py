"""SQL for demand features, the split, and the trend-and-season model."""

from oracle.star import FEATURES, HISTORY, STAR

DEMAND = """
counted AS (SELECT *, count(*) OVER (PARTITION BY sk_produto) AS n_months FROM history),
shifted AS (
  SELECT * EXCLUDE (n_months), month(SaleMonth) AS month, quarter(SaleMonth) AS quarter,
    year(SaleMonth) AS year,
    lag(TotalQty, 1) OVER w AS lag_1, lag(TotalQty, 2) OVER w AS lag_2,
    lag(TotalQty, 3) OVER w AS lag_3,
    CASE WHEN count(*) OVER w3 = 3 THEN sum(TotalQty) OVER w3 / 3 END AS roll_3,
    CASE WHEN count(*) OVER w6 = 6 THEN sum(TotalQty) OVER w6 / 6 END AS roll_6,
    row_number() OVER w - 1 AS trend
  FROM counted WHERE n_months >= 6
  WINDOW w AS (PARTITION BY sk_produto ORDER BY SaleMonth),
    w3 AS (PARTITION BY sk_produto ORDER BY SaleMonth ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
    w6 AS (PARTITION BY sk_produto ORDER BY SaleMonth ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)
),
demand AS (SELECT * FROM shifted WHERE roll_6 IS NOT NULL AND lag_3 IS NOT NULL
  AND Subcategory IS NOT NULL AND Category IS NOT NULL AND ProductName IS NOT NULL
  AND ProductID IS NOT NULL AND AvgUnitPrice IS NOT NULL)
"""

SEASON = """
counted AS (
  SELECT sk_produto, SaleMonth, TotalQty AS y,
    count(*) OVER (PARTITION BY sk_produto) AS n_months,
    min(SaleMonth) OVER (PARTITION BY sk_produto) AS first_month,
    max(SaleMonth) OVER (PARTITION BY sk_produto) AS last_month
  FROM history
),
indexed AS (
  SELECT *, CAST((year(SaleMonth) * 12 + month(SaleMonth))
    - (year(first_month) * 12 + month(first_month)) AS DOUBLE) AS t
  FROM counted WHERE n_months >= 12
),
trendline AS (
  SELECT sk_produto, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept
  FROM indexed GROUP BY 1
),
trended AS (
  SELECT i.*, l.slope, l.intercept, l.intercept + l.slope * i.t AS trend
  FROM indexed i JOIN trendline l USING (sk_produto)
),
fitted AS (
  SELECT *, trend * factor AS fit FROM (
    SELECT *, coalesce(avg(CASE WHEN trend > 0 THEN y / trend END)
      OVER (PARTITION BY sk_produto, month(SaleMonth)), 1.0) AS factor
    FROM trended)
),
spread AS (SELECT sk_produto, coalesce(stddev_samp(y - fit), 0.0) AS sigma FROM fitted GROUP BY 1),
factors AS (
  SELECT DISTINCT sk_produto, month(SaleMonth) AS calendar_month, factor FROM fitted
),
ahead AS (
  SELECT p.*, s.step, CAST(p.last_month + to_months(CAST(s.step AS INTEGER)) AS DATE) AS m
  FROM (SELECT DISTINCT f.sk_produto, first_month, last_month, slope, intercept, sigma
        FROM fitted f JOIN spread USING (sk_produto)) p
  CROSS JOIN (SELECT unnest(range(1, {steps} + 1)) AS step) s
),
valued AS (
  SELECT a.*, a.sigma * 1.2815515655446004 AS band, coalesce(f.factor, 1.0) * (a.intercept + a.slope
    * ((year(m) * 12 + month(m)) - (year(first_month) * 12 + month(first_month)))) AS v
  FROM ahead a LEFT JOIN factors f
    ON a.sk_produto = f.sk_produto AND month(a.m) = f.calendar_month
),
forecast AS (
  SELECT sk_produto, step, strftime(m, '%Y-%m') AS month,
    {whole:v} AS forecast,
    {whole:v - band} AS lower,
    {whole:v + band} AS upper
  FROM valued
)
"""

SIX = "sign({0}) * floor(abs({0}) * 1000000.0 + 0.5) / 1000000.0"


def _settled(value: str, scale: str) -> str:
    first = f"(round_even(({value}) * ({scale} * 1000), 0) / ({scale} * 1000))"
    return f"round_even({first} * {scale}, 0) / {scale}"


WHOLE = "CAST(greatest(round_even({0}, 0), 0) AS BIGINT)"


def _season(steps: int) -> str:
    sql = SEASON.replace("{steps}", str(steps))
    for value in ("v", "v - band", "v + band"):
        sql = sql.replace("{whole:%s}" % value, WHOLE.format(SIX.format(f"({value})")))
    return f"WITH {STAR}, {HISTORY}, {sql}"


TREE = """
counted AS (
  SELECT *, count(*) OVER p AS n_months, row_number() OVER w AS place FROM history
  WINDOW p AS (PARTITION BY sk_produto), w AS (PARTITION BY sk_produto ORDER BY SaleMonth)
),
levelled AS (
  SELECT *, avg(CASE WHEN place <= greatest(1, floor(n_months * 0.8)) THEN TotalQty END)
    OVER (PARTITION BY sk_produto) AS level
  FROM counted WHERE n_months >= 6
),
rolled AS (
  SELECT * EXCLUDE (n_months, place), month(SaleMonth) AS month, quarter(SaleMonth) AS quarter,
    year(SaleMonth) AS year, lag(TotalQty, 1) OVER w AS lag_1, lag(TotalQty, 2) OVER w AS lag_2,
    lag(TotalQty, 3) OVER w AS lag_3,
    CASE WHEN place > {before3} THEN sum(TotalQty) OVER w3 / 3 END AS roll_3,
    CASE WHEN place > {before6} THEN sum(TotalQty) OVER w6 / 6 END AS roll_6,
    row_number() OVER w - 1 AS trend
  FROM levelled
  WINDOW w AS (PARTITION BY sk_produto ORDER BY SaleMonth),
    w3 AS (PARTITION BY sk_produto ORDER BY SaleMonth ROWS BETWEEN {from3} PRECEDING AND {to} PRECEDING),
    w6 AS (PARTITION BY sk_produto ORDER BY SaleMonth ROWS BETWEEN {from6} PRECEDING AND {to} PRECEDING)
),
complete AS (SELECT * FROM rolled WHERE roll_6 IS NOT NULL AND lag_3 IS NOT NULL
  AND Subcategory IS NOT NULL AND Category IS NOT NULL AND ProductName IS NOT NULL
  AND ProductID IS NOT NULL AND AvgUnitPrice IS NOT NULL AND AvgMargin IS NOT NULL),
tree_rows AS (
  SELECT *, row_number() OVER (PARTITION BY sk_produto ORDER BY SaleMonth)
    <= greatest(1, floor(count(*) OVER (PARTITION BY sk_produto) * 0.8)) AS is_train
  FROM complete
)
"""
LEAK_FREE = TREE.format(before3=3, before6=6, from3=3, from6=6, to=1)
WITH_ROW = TREE.format(before3=2, before6=5, from3=2, from6=5, to=0)


def _state(compat: bool) -> str:
    second, third = ("lag_2", "lag_3") if compat else ("lag_1", "lag_2")
    return f"""WITH {STAR}, {HISTORY}, {WITH_ROW}
SELECT sk_produto, SaleMonth AS last_month, TotalQty AS lag_1, {second} AS lag_2, {third} AS lag_3,
  {_settled('roll_3', '1e6')} AS roll_3, {_settled('roll_6', '1e6')} AS roll_6,
  trend + {int(compat)} AS last_trend, {_settled('level', '1e6')} AS level
FROM tree_rows QUALIFY row_number() OVER (PARTITION BY sk_produto ORDER BY SaleMonth DESC) = 1"""


FORECAST_KEYS = f"""WITH {STAR}, {HISTORY}, {WITH_ROW},
long AS (SELECT sk_produto, max(SaleMonth) AS last_month FROM history GROUP BY 1 HAVING count(*) >= 12),
short AS (SELECT sk_produto, max(SaleMonth) AS last_month FROM tree_rows
  WHERE sk_produto NOT IN (SELECT sk_produto FROM long) GROUP BY 1)
SELECT sk_produto, step, strftime(CAST(last_month + to_months(CAST(step AS INTEGER)) AS DATE), '%Y-%m')
  AS month, true AS band_holds
FROM (SELECT * FROM long UNION ALL SELECT * FROM short), (SELECT unnest(range(1, 4)) AS step)"""

DEMAND_SQL = {
    "tree_rows": f"""WITH {STAR}, {HISTORY}, {LEAK_FREE}
SELECT * REPLACE ({_settled('roll_3', '1e6')} AS roll_3, {_settled('roll_6', '1e6')} AS roll_6,
  {_settled('level', '1e6')} AS level) FROM tree_rows""",
    "forecast_state": _state(False),
    "forecast_state_compat": _state(True),
    "trained_products": f"""WITH {STAR}, {HISTORY}, {LEAK_FREE},
held AS (SELECT sk_produto, count(CASE WHEN NOT is_train THEN 1 END) > 0 AS has_error
  FROM tree_rows GROUP BY 1)
SELECT h.sk_produto, CASE WHEN n >= 12 THEN 'seasonal' ELSE 'trees' END AS model,
  n >= 12 OR coalesce(has_error, false) AS has_error
FROM (SELECT sk_produto, count(*) AS n FROM history GROUP BY 1 HAVING count(*) >= 6) h
LEFT JOIN held USING (sk_produto)""",
    "forecast_keys": FORECAST_KEYS,
    "augment_gaussian_counts": f"""WITH {STAR}, {HISTORY}
SELECT sk_produto, count(*) * 3 AS series_rows, count(*) AS unchanged FROM history GROUP BY 1""",
    "demand_features": f"WITH {STAR}, {HISTORY}, {DEMAND} SELECT * FROM demand",
    "demand_split": f"""WITH {STAR}, {HISTORY}, {DEMAND}
SELECT *, row_number() OVER (PARTITION BY sk_produto ORDER BY SaleMonth)
  <= greatest(1, floor(count(*) OVER (PARTITION BY sk_produto) * 0.8)) AS is_train FROM demand""",
    "train_seasonal": _season(1) + f"""
SELECT DISTINCT f.sk_produto, n_months, first_month, last_month,
  {_settled('slope', '1e6')} AS slope, {_settled('intercept', '1e6')} AS intercept,
  {_settled('sigma', '1e6')} AS sigma, month(SaleMonth) AS calendar_month,
  {_settled('factor', '1e6')} AS factor
FROM fitted f JOIN spread s ON f.sk_produto = s.sk_produto""",
    "seasonal_mae": _season(1) + f"""
SELECT sk_produto, 'seasonal' AS model, {_settled('avg(miss)', '100.0')} AS mae
FROM (SELECT sk_produto, abs(y - fit) AS miss,
        row_number() OVER (PARTITION BY sk_produto ORDER BY SaleMonth DESC) AS r FROM fitted)
WHERE r <= 3 GROUP BY sk_produto""",
    "forecast_seasonal": _season(3) + " SELECT * FROM forecast",
    "forecast_seasonal_12": _season(12) + " SELECT * FROM forecast",
    "forecast_product": _season(12) + """
SELECT * FROM forecast WHERE sk_produto = (SELECT min(sk_produto) FROM forecast)""",
    "forecastable_products": f"""WITH {STAR}, {HISTORY}, {FEATURES}
SELECT h.sk_produto, coalesce(f.ProductName, 'Produto sk_' || h.sk_produto) AS ProductName
FROM (SELECT sk_produto FROM history GROUP BY 1 HAVING count(*) >= 6) h
LEFT JOIN features f ON h.sk_produto = f.sk_produto""",
}
