"""Small star schemas for hand-made cases."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from gondola.sources.schema import SCHEMAS, StarSchema


def day_key(day: dt.date) -> int:
    return day.year * 10000 + day.month * 100 + day.day


def sale(day, product, qty=1, value=10, customer=1, seller=1, order=1, price=10):
    key = None if day is None else day_key(day)
    return (key, product, customer, seller, order, Decimal(qty), Decimal(value), Decimal(price))


def product(version, key, margin=None, price=None, code=None, group="G"):
    as_decimal = lambda x: None if x is None else Decimal(str(x))
    return (version, key, code or f"P{key}", f"name {version}", group, "S",
            as_decimal(margin), as_decimal(price))


def make_star(spark, sales, products, days=None, customers=None, sellers=None, returns=()):
    used = {r[0] for r in sales if r[0] is not None}
    days = days or sorted(dt.date(k // 10000, k // 100 % 100, k % 100) for k in used)
    rows = {
        "ft_vendas": list(sales),
        "dim_produto": list(products),
        "dim_tempo": [(day_key(d), d, d.strftime("%b")) for d in days],
        "dim_cliente": customers or [(1, 1, "SP"), (2, 2, None)],
        "dim_vendedor": sellers or [(1, 1, "Ana", "Norte", "Belem"), (2, 2, "Rui", None, "Recife")],
        "ft_trocas": list(returns),
    }
    return StarSchema(**{
        name: spark.createDataFrame(rows[name], SCHEMAS[name]) for name in SCHEMAS})


def months(start: dt.date, n: int) -> list[dt.date]:
    first = start.year * 12 + start.month - 1
    return [dt.date((first + i) // 12, (first + i) % 12 + 1, start.day) for i in range(n)]


def history_rows(spark, series: dict[int, dict[dt.date, float]]):
    """Sales-history rows from quantities per product and month."""
    return spark.createDataFrame(
        [(sk, f"P{sk}", f"name {sk}", "G", "S", month, float(q), q * 10.0, q * 2.0, 10.0, 20.0, 1)
         for sk, values in series.items() for month, q in values.items()],
        "sk_produto bigint, ProductID string, ProductName string, Category string, "
        "Subcategory string, SaleMonth date, TotalQty double, TotalRevenue double, "
        "TotalProfit double, AvgUnitPrice double, AvgMargin double, OrderCount bigint")
