"""SQL for the marts, reports and data-quality checks."""

from oracle.star import FEATURES, HISTORY, STAR

CENTS = "round_even(({0}) * 100.0, 0) / 100.0"

SELLERS = """
sellers AS (
  SELECT dv.IDVendedor AS SellerID, dv.Nome AS SellerName,
    coalesce(dv.Equipe, dv.Mun) AS Territory, CAST(0 AS BIGINT) AS AnnualQuota,
    CAST(0 AS BIGINT) AS CommissionPct,
    CAST(round(sum(v.TotLiq), 4) AS DOUBLE) AS TotalRevenue,
    CAST(round(sum(v.TotLiq * coalesce(dp.Margem, 0)), 4) AS DOUBLE) / 100 AS TotalProfit,
    CAST(round(sum(v.Quant), 4) AS DOUBLE) AS TotalQty, count(DISTINCT v.IDPed) AS OrderCount,
    count(DISTINCT v.IDCliente) AS UniqueCustomers,
    CAST(round(sum(coalesce(dp.Margem, 0)), 4) AS DOUBLE) / count(*) AS AvgMargin,
    CAST(NULL AS DOUBLE) AS QuotaAttainmentPct
  FROM {sales} v
  JOIN dim_produto dp ON v.IDProduto = dp.IDSK
  JOIN (SELECT IDVendedor, max(IDSK) AS IDSK FROM dim_vendedor GROUP BY 1) m
    ON v.IDVendedor = m.IDVendedor
  JOIN dim_vendedor dv ON dv.IDSK = m.IDSK
  GROUP BY dv.IDVendedor, dv.Nome, dv.Equipe, dv.Mun
)
"""

ALL_SALES = "(SELECT * FROM ft_vendas WHERE Quant > 0 AND TotLiq > 0)"
YEAR_OF_SALES = """(SELECT valid.* FROM valid CROSS JOIN bounds
  WHERE SaleMonth >= CAST(last_month - INTERVAL 12 MONTH AS DATE))"""
SELLERS_12 = SELLERS.replace("{sales}", YEAR_OF_SALES)
SELLERS = SELLERS.replace("{sales}", ALL_SALES)

REPORTS = {
    "sales_history": f"WITH {STAR}, {HISTORY} SELECT * FROM history",
    "product_features": f"WITH {STAR}, {FEATURES} SELECT * FROM features",
    "sales_by_territory": f"""WITH {STAR}
SELECT coalesce(dc.Est, 'N/I') AS Territory, coalesce(dc.Est, 'N/I') AS Country,
  'Brasil' AS Region, year(v.Data) AS Year, month(v.Data) AS Month, quarter(v.Data) AS Quarter,
  v.NomeMes AS MonthName, CAST(round(sum(v.Quant), 4) AS DOUBLE) AS TotalQty,
  CAST(round(sum(v.TotLiq), 4) AS DOUBLE) AS TotalRevenue,
  CAST(round(sum(v.TotLiq * coalesce(dp.Margem, 0)), 4) AS DOUBLE) / 100 AS TotalProfit,
  count(DISTINCT v.IDPed) AS OrderCount, count(DISTINCT v.IDCliente) AS UniqueCustomers
FROM valid v JOIN dim_produto dp ON v.IDProduto = dp.IDSK
JOIN (SELECT IDCliente, max(IDSK) AS IDSK FROM dim_cliente GROUP BY 1) m
  ON v.IDCliente = m.IDCliente
JOIN dim_cliente dc ON dc.IDSK = m.IDSK CROSS JOIN bounds b
WHERE v.SaleMonth >= CAST(b.last_month - INTERVAL 12 MONTH AS DATE)
GROUP BY dc.Est, year(v.Data), month(v.Data), quarter(v.Data), v.NomeMes""",
    "seller_performance": f"WITH {STAR}, {SELLERS} SELECT * FROM sellers",
    "seller_performance_12_months": f"WITH {STAR}, {SELLERS_12} SELECT * FROM sellers",
    "top_sellers": f"""WITH {STAR}, {SELLERS}
SELECT SellerName, Territory, {CENTS.format('TotalRevenue')} AS TotalRevenue,
  CAST(0 AS DOUBLE) AS QuotaAttainmentPct
FROM (SELECT * FROM sellers ORDER BY TotalRevenue DESC, SellerID LIMIT 5)""",
    "dashboard_kpis": f"""WITH {STAR},
totals AS (
  SELECT CAST(round(sum(v.TotLiq), 4) AS DOUBLE) AS revenue,
    CAST(round(sum(v.TotLiq * coalesce(dp.Margem, 0)), 4) AS DOUBLE) / 100 AS profit,
    sum(v.Quant) AS qty, count(DISTINCT v.IDPed) AS orders,
    count(DISTINCT v.IDCliente) AS customers,
    CAST(round(sum(coalesce(dp.Margem, 0)), 4) AS DOUBLE) / count(*) AS margin,
    CAST(sum(CASE WHEN v.SaleMonth = b.last_month THEN v.TotLiq ELSE 0 END) AS DOUBLE) AS tm,
    CAST(sum(CASE WHEN v.SaleMonth = CAST(b.last_month - INTERVAL 1 MONTH AS DATE)
      THEN v.TotLiq ELSE 0 END) AS DOUBLE) AS lm,
    CAST(sum(CASE WHEN year(v.Data) = year(b.last_day) THEN v.TotLiq ELSE 0 END) AS DOUBLE) AS ty,
    CAST(sum(CASE WHEN year(v.Data) = year(b.last_day) - 1 THEN v.TotLiq ELSE 0 END)
      AS DOUBLE) AS ly,
    any_value(b.last_day) AS last_day
  FROM valid v JOIN dim_produto dp ON v.IDProduto = dp.IDSK CROSS JOIN bounds b
)
SELECT {CENTS.format('revenue')} AS total_revenue, {CENTS.format('profit')} AS total_profit,
  CAST(qty AS BIGINT) AS total_qty, orders AS total_orders, customers AS unique_customers,
  {CENTS.format('margin')} AS avg_margin_pct, {CENTS.format('tm')} AS current_month_revenue,
  {CENTS.format('lm')} AS prev_month_revenue,
  CASE WHEN lm > 0 THEN {CENTS.format('((tm - lm) / lm * 100)')} END AS mom_change_pct,
  {CENTS.format('ty')} AS ytd_revenue, {CENTS.format('ly')} AS prev_year_revenue,
  CASE WHEN ly > 0 THEN {CENTS.format('((ty - ly) / ly * 100)')} END AS yoy_change_pct,
  strftime(last_day, '%Y-%m') AS reference_month, year(last_day) AS reference_year
FROM totals""",
    "table_row_counts": "WITH " + STAR + " " + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count, true AS ok, "
        f"CAST(NULL AS VARCHAR) AS error FROM {t}"
        for t in ["ft_vendas", "dim_produto", "dim_cliente", "dim_vendedor", "dim_tempo",
                  "ft_trocas"]),
}
