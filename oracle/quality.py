"""SQL for the data-quality rules and profile figures."""

from oracle.star import STAR

_RULES = [
    ("ft_vendas: rows", "SELECT count(*) FROM ft_vendas", 1000),
    ("ft_vendas: null IDTempo", "SELECT count(*) FROM ft_vendas WHERE IDTempo IS NULL", -1),
    ("ft_vendas: null IDProduto", "SELECT count(*) FROM ft_vendas WHERE IDProduto IS NULL", -1),
    ("ft_vendas: null IDCliente", "SELECT count(*) FROM ft_vendas WHERE IDCliente IS NULL", -1),
    ("ft_vendas: null IDVendedor", "SELECT count(*) FROM ft_vendas WHERE IDVendedor IS NULL", -1),
    ("ft_vendas: Quant not positive", "SELECT count(*) FROM ft_vendas WHERE Quant <= 0", -1),
    ("ft_vendas: TotLiq not positive", "SELECT count(*) FROM ft_vendas WHERE TotLiq <= 0", -1),
    ("dim_produto: products", "SELECT count(DISTINCT IDProduto) FROM dim_produto", 1),
    ("dim_produto: Uprc null or zero",
     "SELECT count(*) FROM dim_produto WHERE Uprc IS NULL OR Uprc = 0", -1),
    ("dim_tempo: days", "SELECT count(*) FROM dim_tempo", 365),
    ("dim_cliente: customers", "SELECT count(DISTINCT IDCliente) FROM dim_cliente", 1),
    ("dim_vendedor: sellers", "SELECT count(DISTINCT IDVendedor) FROM dim_vendedor", 1),
]

CHECKS = "found AS (" + " UNION ALL ".join(
    f"SELECT '{text}' AS description, ({sql}) AS value, CAST({minimum} AS BIGINT) AS minimum"
    for text, sql, minimum in _RULES
) + """),
checks AS (
  SELECT *, CASE WHEN minimum = -1 THEN value = 0 ELSE value >= minimum END AS ok,
    CASE WHEN minimum = -1 THEN CASE WHEN value = 0 THEN 'OK' ELSE 'ATENCAO' END
         ELSE CASE WHEN value >= minimum THEN 'OK' ELSE 'ERRO' END END AS tag
  FROM found
)"""

PER_PRODUCT = """
latest AS (
  SELECT p.IDProduto, p.Grupo, coalesce(p.Margem, 0) AS Margem FROM dim_produto p JOIN (
    SELECT IDProduto, max(IDSK) AS IDSK FROM dim_produto GROUP BY 1
  ) m ON p.IDSK = m.IDSK
),
sold AS (
  SELECT l.Grupo, l.Margem, fv.Quant, fv.TotLiq FROM ft_vendas fv
  JOIN dim_produto v ON fv.IDProduto = v.IDSK JOIN latest l ON v.IDProduto = l.IDProduto
)"""


def _eligible(key: str, extra: str = "") -> str:
    return f"""WITH {STAR},
months AS (
  SELECT {key} AS k, count(DISTINCT year(dt.Data) * 100 + month(dt.Data)) AS n
  FROM ft_vendas fv JOIN dim_tempo dt ON fv.IDTempo = dt.IDSK {extra}
  GROUP BY 1
)
SELECT count(CASE WHEN n >= 6 THEN 1 END) AS products_6_months,
  count(CASE WHEN n >= 12 THEN 1 END) AS products_12_months FROM months"""


QUALITY = {
    "dq_checks": f"WITH {STAR}, {CHECKS} SELECT * FROM checks",
    "dq_overall": f"""WITH {STAR}, {CHECKS}
SELECT bool_and(ok) AS all_ok, count(CASE WHEN NOT ok THEN 1 END) AS failed FROM checks""",
    "data_period": f"""WITH {STAR}
SELECT min(dt.Data) AS first_day, max(dt.Data) AS last_day,
  (year(max(dt.Data)) * 12 + month(max(dt.Data)))
    - (year(min(dt.Data)) * 12 + month(min(dt.Data))) AS months
FROM ft_vendas fv JOIN dim_tempo dt ON fv.IDTempo = dt.IDSK""",
    "revenue_profit_total": f"""WITH {STAR}, {PER_PRODUCT}
SELECT CAST(round(sum(TotLiq), 4) AS DOUBLE) AS revenue,
  CAST(round(sum(TotLiq * Margem), 4) AS DOUBLE) / 100 AS approx_profit FROM sold""",
    "eligible_products": _eligible("fv.IDProduto"),
    "eligible_products_natural": _eligible(
        "v.IDProduto",
        "JOIN dim_produto v ON fv.IDProduto = v.IDSK WHERE v.IDProduto IS NOT NULL"),
    "top_groups": f"""WITH {STAR}, {PER_PRODUCT}
SELECT Grupo, CAST(round(sum(Quant), 4) AS DOUBLE) AS TotalQty,
  CAST(round(sum(TotLiq), 4) AS DOUBLE) AS TotalRevenue
FROM sold GROUP BY Grupo ORDER BY TotalRevenue DESC, Grupo LIMIT 5""",
    "returns_summary": f"""WITH {STAR}
SELECT count(*) AS returns, coalesce(CAST(round(sum(TotLiq), 4) AS DOUBLE), 0.0) AS net_value
FROM ft_trocas""",
}
