"""The star schema over the given tables, as common table expressions."""

STAR = """
dim_tempo AS (
  SELECT CAST(year(d) * 10000 + month(d) * 100 + day(d) AS BIGINT) AS IDSK, d AS Data,
    CASE month(d) WHEN 1 THEN 'Jan' WHEN 2 THEN 'Feb' WHEN 3 THEN 'Mar' WHEN 4 THEN 'Apr'
      WHEN 5 THEN 'May' WHEN 6 THEN 'Jun' WHEN 7 THEN 'Jul' WHEN 8 THEN 'Aug'
      WHEN 9 THEN 'Sep' WHEN 10 THEN 'Oct' WHEN 11 THEN 'Nov' ELSE 'Dec' END AS NomeMes
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
),
parts AS (SELECT *, CAST(floor(p_partkey / 2) AS BIGINT) AS nk FROM part),
dim_produto AS (
  SELECT p_partkey AS IDSK, CASE WHEN nk % 10 = 7 THEN NULL ELSE nk END AS IDProduto,
    concat('P', CAST(nk AS VARCHAR)) AS Cod, p_name AS Descri, p_brand AS Grupo,
    p_type AS SubGrp,
    CASE WHEN p_size % 17 = 0 THEN NULL ELSE CAST(10 + p_size % 40 AS DECIMAL(9,4)) END AS Margem,
    CASE WHEN nk % 23 = 0 THEN NULL ELSE CAST(p_retailprice AS DECIMAL(18,4)) END AS Uprc
  FROM parts
),
dim_cliente AS (
  SELECT c_custkey AS IDSK, CAST(floor(c_custkey / 2) AS BIGINT) AS IDCliente,
    CASE WHEN n_nationkey % 8 = 5 THEN NULL ELSE n_name END AS Est
  FROM customer JOIN nation ON c_nationkey = n_nationkey
),
dim_vendedor AS (
  SELECT s_suppkey AS IDSK, CAST(floor(s_suppkey / 2) AS BIGINT) AS IDVendedor, s_name AS Nome,
    CASE WHEN s_suppkey % 5 = 1 THEN NULL ELSE r_name END AS Equipe, n_name AS Mun
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
),
lines AS (
  SELECT *, CAST(floor(l_partkey / 2) AS BIGINT) AS nk, CAST(o_orderdate AS DATE) AS d
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
ft_vendas AS (
  SELECT CAST(year(d) * 10000 + month(d) * 100 + day(d) AS BIGINT) AS IDTempo,
    l_partkey AS IDProduto, CAST(floor(o_custkey / 2) AS BIGINT) AS IDCliente,
    CAST(floor(l_suppkey / 2) AS BIGINT) AS IDVendedor, l_orderkey AS IDPed,
    CAST(CASE
      WHEN nk % 19 = 0 THEN 0
      WHEN nk % 13 = 4 AND d < DATE '2001-04-01' THEN 0
      WHEN nk % 13 = 6 AND d < DATE '2000-11-01' THEN 0
      WHEN nk % 11 = 3 AND d >= DATE '1998-04-01' THEN ceil(l_quantity * 0.2)
      WHEN nk % 11 = 5 AND d >= DATE '1998-04-01' THEN ceil(l_quantity * 0.65)
      ELSE l_quantity END AS DECIMAL(18,4)) AS Quant,
    CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(1 - l_discount AS DECIMAL(5,2))
      AS DECIMAL(18,4)) AS TotLiq,
    CAST(floor(l_extendedprice * 100 / l_quantity) / 100 AS DECIMAL(18,4)) AS PrVenda
  FROM lines
),
ft_trocas AS (
  SELECT l_orderkey AS IDPed, l_partkey AS IDProduto,
    CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(1 - l_discount AS DECIMAL(5,2))
      AS DECIMAL(18,4)) AS TotLiq
  FROM lineitem WHERE l_returnflag = 'R'
),
valid AS (
  SELECT fv.*, dt.Data, dt.NomeMes, CAST(date_trunc('month', dt.Data) AS DATE) AS SaleMonth
  FROM ft_vendas fv JOIN dim_tempo dt ON fv.IDTempo = dt.IDSK
  WHERE fv.Quant > 0 AND fv.TotLiq > 0
),
bounds AS (
  SELECT min(Data) AS first_day, max(Data) AS last_day,
    CAST(date_trunc('month', max(Data)) AS DATE) AS last_month,
    CAST(min(Data) + to_months(CAST(((year(max(Data)) * 12 + month(max(Data)))
      - (year(min(Data)) * 12 + month(min(Data)))) // 2 AS INTEGER)) AS DATE) AS mid
  FROM valid
)
"""

HISTORY = """
history AS (
  SELECT dp.IDProduto AS sk_produto, max(dp.Cod) AS ProductID, max(dp.Descri) AS ProductName,
    max(dp.Grupo) AS Category, max(dp.SubGrp) AS Subcategory, v.SaleMonth,
    CAST(round(sum(v.Quant), 4) AS DOUBLE) AS TotalQty,
    CAST(round(sum(v.TotLiq), 4) AS DOUBLE) AS TotalRevenue,
    CAST(round(sum(v.TotLiq * coalesce(dp.Margem, 0)), 4) AS DOUBLE) / 100 AS TotalProfit,
    CAST(round(sum(v.PrVenda), 4) AS DOUBLE) / count(v.PrVenda) AS AvgUnitPrice,
    CAST(round(sum(coalesce(dp.Margem, 0)), 4) AS DOUBLE) / count(*) AS AvgMargin,
    count(DISTINCT v.IDPed) AS OrderCount
  FROM valid v JOIN dim_produto dp ON v.IDProduto = dp.IDSK CROSS JOIN bounds b
  WHERE dp.IDProduto IS NOT NULL
    AND v.SaleMonth >= CAST(b.last_month - INTERVAL 36 MONTH AS DATE)
  GROUP BY dp.IDProduto, v.SaleMonth
)
"""

FEATURES = """
newest AS (
  SELECT p.* FROM dim_produto p JOIN (
    SELECT IDProduto, max(IDSK) AS IDSK FROM dim_produto WHERE IDProduto IS NOT NULL GROUP BY 1
  ) m ON p.IDSK = m.IDSK
),
lifetime AS (
  SELECT dp.IDProduto, CAST(round(sum(v.Quant), 4) AS DOUBLE) AS qty,
    CAST(CAST(CAST(count(*) AS DECIMAL(12,0)) * CAST(sum(v.Quant * v.Quant) AS DECIMAL(25,8))
      - CAST(sum(v.Quant) AS DECIMAL(18,4)) * CAST(sum(v.Quant) AS DECIMAL(18,4)) AS VARCHAR)
      AS DOUBLE) AS misses,
    CAST(round(sum(v.TotLiq), 4) AS DOUBLE) AS revenue,
    CAST(round(sum(v.TotLiq * coalesce(dp.Margem, 0)), 4) AS DOUBLE) / 100 AS profit,
    count(*) AS n, count(DISTINCT v.SaleMonth) AS months, count(DISTINCT v.IDPed) AS orders,
    CAST(round(sum(CASE WHEN v.Data >= b.mid THEN v.Quant END), 4) AS DOUBLE) AS rqty,
    count(CASE WHEN v.Data >= b.mid THEN 1 END) AS rn
  FROM valid v JOIN dim_produto dp ON v.IDProduto = dp.IDSK CROSS JOIN bounds b
  WHERE dp.IDProduto IS NOT NULL GROUP BY dp.IDProduto
),
means AS (
  SELECT p.*, l.* EXCLUDE (IDProduto), coalesce(l.qty / l.n, 0.0) AS mean_qty,
    coalesce(CASE WHEN l.rn > 0 THEN l.rqty / l.rn END, 0.0) AS recent_mean
  FROM newest p LEFT JOIN lifetime l ON p.IDProduto = l.IDProduto
),
features AS (
  SELECT IDProduto AS sk_produto, Cod AS ProductID, Descri AS ProductName, Grupo AS Category,
    SubGrp AS Subcategory, CAST(coalesce(Uprc, 0) AS DOUBLE) AS ListPrice,
    coalesce(CAST(round(Uprc * (100 - coalesce(Margem, 0)), 4) AS DOUBLE) / 100, 0.0)
      AS StandardCost,
    '' AS ProductClass, '' AS ProductLine, coalesce(qty, 0.0) AS TotalQty12m,
    coalesce(revenue, 0.0) AS TotalRevenue12m, coalesce(profit, 0.0) AS TotalProfit12m,
    mean_qty AS AvgMonthlyQty,
    CASE WHEN n > 1 THEN sqrt(greatest(misses / n / (n - 1), 0.0)) ELSE 0.0 END
      AS StdDevQty,
    CAST(coalesce(Margem, 0) AS DOUBLE) AS AvgMargin, coalesce(months, 0) AS MonthsWithSales,
    coalesce(orders, 0) AS OrderCount, coalesce(rqty, 0.0) AS TotalQty3m,
    recent_mean AS AvgMonthlyQty3m,
    CASE WHEN mean_qty > 0 THEN
      sign((recent_mean - mean_qty) / mean_qty * 100)
        * floor(abs((recent_mean - mean_qty) / mean_qty * 100) * 100.0 + 0.5) / 100.0
      ELSE 0.0 END AS TrendPct
  FROM means
)
"""
