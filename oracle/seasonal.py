"""SQL for the seasonal curve: sums per product, and one reduction step of a matrix a CTE."""

from oracle.demand import SEASON, SIX, WHOLE, _settled
from oracle.star import HISTORY, STAR

CHANGES = [0.8 * j / 6 for j in range(1, 6)]
TREND_RIDGE = [1e-6] * 2 + [0.3] * 5
SEASON_RIDGE = [0.3] * 6
WAVES = [(k, wave) for k in (1, 2, 3) for wave in ("cos", "sin")]


def _u(time: str) -> list[str]:
    return ["1.0", time] + [f"greatest({time} - {c!r}, 0.0)" for c in CHANGES]


def _x(month: str) -> list[str]:
    return [f"{wave}({month} * (2.0 * pi() * {k} / 12.0))" for k, wave in WAVES]


def _solve(name: str, source: str, regressors: list[str], target: str, ridge: list[float]) -> list[str]:
    """CTEs that end in ``name`` with columns ``name_0``, ... per product."""
    n = len(ridge)
    entries = regressors + [target]
    cells = [f"sum(({entries[i]}) * ({entries[j]})) + {ridge[i] if i == j else 0.0!r} AS m_{i}_{j}"
             for i in range(n) for j in range(n + 1)]
    out = [f"{name}_step0 AS (SELECT sk_produto, {', '.join(cells)} FROM {source} GROUP BY 1)"]
    for k in range(n):
        cells = [f"m_{i}_{j} / m_{k}_{k} AS m_{i}_{j}" if i == k
                 else f"m_{i}_{j} - m_{i}_{k} * m_{k}_{j} / m_{k}_{k} AS m_{i}_{j}"
                 for i in range(n) for j in range(k + 1, n + 1)]
        out.append(f"{name}_step{k + 1} AS (SELECT sk_produto, {', '.join(cells)} FROM {name}_step{k})")
    final = ", ".join(f"m_{i}_{n} AS {name}_{i}" for i in range(n))
    return out + [f"{name} AS (SELECT sk_produto, {final} FROM {name}_step{n})"]


def _sum(name: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"{name}_{i} * ({t})" for i, t in enumerate(terms)) + ")"


def _curve() -> str:
    """CTEs from ``history`` to ``curve``: sizes and coefficients per product, and ``curve_fit``."""
    terms = ", ".join([f"{e} AS u{i}" for i, e in enumerate(_u("t / span"))]
                      + [f"{e} AS x{i}" for i, e in enumerate(_x("month(SaleMonth)"))])
    us, xs = [f"u{i}" for i in range(7)], [f"x{i}" for i in range(6)]
    parts = ["""
curve_counted AS (
  SELECT sk_produto, SaleMonth, CAST(TotalQty AS DOUBLE) AS y, count(*) OVER p AS n_months,
    min(SaleMonth) OVER p AS first_month, max(SaleMonth) OVER p AS last_month,
    CASE WHEN max(TotalQty) OVER p > 0 THEN CAST(max(TotalQty) OVER p AS DOUBLE) ELSE 1.0 END AS scale
  FROM history WINDOW p AS (PARTITION BY sk_produto)
)""", """
curve_sized AS (
  SELECT *, CAST((year(SaleMonth) * 12 + month(SaleMonth)) - (year(first_month) * 12
      + month(first_month)) AS DOUBLE) AS t,
    CAST(greatest((year(last_month) * 12 + month(last_month)) - (year(first_month) * 12
      + month(first_month)), 1) AS DOUBLE) AS span
  FROM curve_counted WHERE n_months >= 12
)""", f"curve_rows AS (SELECT *, y / scale AS ys, {terms} FROM curve_sized)"]
    source = "(SELECT *, 1.0 AS w FROM curve_rows)"
    for k in (1, 2, 3):
        parts += _solve(f"trend{k}", source, [f"{u} * w" for u in us], "ys", TREND_RIDGE)
        level = f"(SELECT *, {_sum(f'trend{k}', us)} AS g FROM curve_rows JOIN trend{k} USING (sk_produto))"
        parts += _solve(f"season{k}", level, [f"{x} * g" for x in xs], "ys - g", SEASON_RIDGE)
        source = f"(SELECT *, 1.0 + {_sum(f'season{k}', xs)} AS w FROM curve_rows JOIN season{k} USING (sk_produto))"
    parts.append(
        f"curve_fit AS (SELECT *, y - scale * {_sum('trend3', us)} * (1.0 + {_sum('season3', xs)}) AS miss, "
        "row_number() OVER (PARTITION BY sk_produto ORDER BY SaleMonth DESC) AS place "
        "FROM curve_rows JOIN trend3 USING (sk_produto) JOIN season3 USING (sk_produto))")
    parts.append("""
curve AS (
  SELECT s.*, t.* EXCLUDE (sk_produto), x.* EXCLUDE (sk_produto)
  FROM (SELECT sk_produto, n_months, first_month, last_month, scale, span, stddev_samp(miss) AS sigma,
          avg(CASE WHEN place <= 3 THEN abs(miss) END) AS mae
        FROM curve_fit GROUP BY ALL) s
  JOIN trend3 t USING (sk_produto) JOIN season3 x USING (sk_produto)
)""")
    return ", ".join(parts)


def _value(month: str) -> str:
    time = f"((year({month}) * 12 + month({month})) - (year(first_month) * 12 + month(first_month))) / span"
    return f"scale * {_sum('trend3', _u(f'({time})'))} * (1.0 + {_sum('season3', _x(f'month({month})'))})"


def _whole(value: str) -> str:
    return WHOLE.format(SIX.format(f"({value})"))


def _ahead(steps: int) -> str:
    return f"""curve_ahead AS (
  SELECT *, {_value('m')} AS v, sigma * 1.2815515655446004 AS band FROM (
    SELECT c.*, s.step, CAST(c.last_month + to_months(CAST(s.step AS INTEGER)) AS DATE) AS m
    FROM curve c CROSS JOIN (SELECT unnest(range(1, {steps} + 1)) AS step) s)
),
curve_forecast AS (
  SELECT sk_produto, step, strftime(m, '%Y-%m') AS month, {_whole('v')} AS forecast,
    {_whole('v - band')} AS lower, {_whole('v + band')} AS upper
  FROM curve_ahead
)"""


BACKTEST = f"""
placed AS (
  SELECT *, row_number() OVER (PARTITION BY sk_produto ORDER BY SaleMonth DESC) AS place FROM history
),
factor_guess AS (
  WITH history AS (SELECT * FROM placed WHERE place > 3), {SEASON.split('ahead AS')[0].rstrip().rstrip(',')}
  SELECT h.sk_produto, h.SaleMonth, h.TotalQty, coalesce(f.factor, 1.0) * (p.intercept + p.slope
    * ((year(h.SaleMonth) * 12 + month(h.SaleMonth)) - (year(p.first_month) * 12 + month(p.first_month)))) AS guess
  FROM placed h
  JOIN (SELECT DISTINCT sk_produto, first_month, slope, intercept FROM fitted) p USING (sk_produto)
  LEFT JOIN factors f ON f.sk_produto = h.sk_produto AND f.calendar_month = month(h.SaleMonth)
  WHERE h.place <= 3
),
curve_before AS (
  WITH history AS (SELECT * FROM placed WHERE place > 3), {_curve()} SELECT * FROM curve
),
backtest AS (
  SELECT *, CASE WHEN curve_mae < factors_mae THEN 'curve' ELSE 'factors' END AS chosen FROM (
    SELECT sk_produto,
      {_settled(f"avg(abs(TotalQty - {_value('SaleMonth')}))", "10000.0")} AS curve_mae,
      {_settled("avg(abs(TotalQty - guess))", "10000.0")} AS factors_mae
    FROM factor_guess JOIN curve_before USING (sk_produto) GROUP BY 1)
)"""


def _long(part: str, n: int) -> str:
    return " UNION ALL ".join(
        f"SELECT sk_produto, n_months, scale, {_settled('sigma', '1000000.0')} AS sigma, '{part}' AS part, "
        f"CAST({i} AS BIGINT) AS place, {_settled(f'{part}3_{i}', '1000000.0')} AS value FROM curve"
        for i in range(n))


def _factors(steps: int) -> str:
    sql = SEASON.replace("{steps}", str(steps))
    for value in ("v", "v - band", "v + band"):
        sql = sql.replace("{whole:%s}" % value, _whole(value))
    return sql


BASE = f"WITH {STAR}, {HISTORY}"
SEASONAL_SQL = {
    "curve_coefficients": f"{BASE}, {_curve()} {_long('trend', 7)} UNION ALL {_long('season', 6)}",
    "curve_mae": f"{BASE}, {_curve()} SELECT sk_produto, 'curve' AS model, "
                 f"{_settled('mae', '100.0')} AS mae FROM curve",
    "forecast_curve": f"{BASE}, {_curve()}, {_ahead(3)} SELECT * FROM curve_forecast",
    "curve_backtest": f"{BASE}, {BACKTEST} SELECT * FROM backtest",
    "forecast_chosen": f"""{BASE}, {BACKTEST}, {_curve()}, {_ahead(3)}, {_factors(3)}
SELECT f.* FROM (SELECT *, 'curve' AS model FROM curve_forecast
  UNION ALL SELECT *, 'factors' AS model FROM forecast) f
LEFT JOIN backtest b USING (sk_produto)
WHERE f.model = coalesce(b.chosen, 'factors')""",
}
