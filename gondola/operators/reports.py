"""Marts and reports: sales history, product features, territories, sellers, KPIs."""

from __future__ import annotations


from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.functions.columns import (
    money,
    month_start,
    month_text,
    pct_change,
    ratio,
    round_half_even,
    round_half_up,
)
from gondola.operators.sales import (
    latest_version,
    margin,
    named_products,
    order_totals,
    product_margins,
    recent_start,
    sale_dates,
    valid_sales,
    window_start,
)
from gondola.sources.schema import StarSchema

SALES_HISTORY = [
    "sk_produto", "ProductID", "ProductName", "Category", "Subcategory", "SaleMonth", "TotalQty",
    "TotalRevenue", "TotalProfit", "AvgUnitPrice", "AvgMargin", "OrderCount",
]


def monthly_sales(star: StarSchema, months: int = 36) -> DataFrame:
    """Sales history rows in no particular order, for use by other operators.

    Measures and order counts take separate routes: the measures collapse to one row
    per product version and month before product texts join them, so the only wide
    exchange, the one that counts distinct orders, carries three integers a row.
    """
    sold = (
        valid_sales(star)
        .join(star.calendar(since=window_start(star, months)), "IDTempo")
        .withColumn("SaleMonth", month_start(F.col("Data")))
    )
    measures = sold.groupBy("IDProduto", "SaleMonth").agg(
        F.sum("Quant").alias("qty"), F.sum("TotLiq").alias("revenue"),
        F.sum("PrVenda").alias("price"), F.count("PrVenda").alias("priced"),
        F.count("*").alias("lines"),
    )
    return history_of(measures, sold, named_products(star))


def history_of(measures: DataFrame, sold: DataFrame, products: DataFrame) -> DataFrame:
    """History rows from sums per product version and month, and from rows with the orders."""
    rows = F.col("lines").cast("decimal(18,0)")
    keys = ["sk_produto", "SaleMonth"]
    named = measures.join(products, "IDProduto").groupBy(*keys).agg(
        F.max("Cod").alias("ProductID"), F.max("Descri").alias("ProductName"),
        F.max("Grupo").alias("Category"), F.max("SubGrp").alias("Subcategory"),
        money(F.sum("qty")).alias("TotalQty"),
        money(F.sum("revenue")).alias("TotalRevenue"),
        (money(F.sum(F.col("revenue") * F.col("Margem"))) / 100).alias("TotalProfit"),
        ratio(money(F.sum("price")), F.sum("priced")).alias("AvgUnitPrice"),
        (money(F.sum(rows * F.col("Margem"))) / F.sum("lines")).alias("AvgMargin"),
    )
    orders = (
        sold.select("IDProduto", "SaleMonth", "IDPed")
        .join(products.select("IDProduto", "sk_produto"), "IDProduto")
        .groupBy(*keys)
        .agg(F.count_distinct("IDPed").alias("OrderCount"))
    )
    return named.join(orders, keys).select(*SALES_HISTORY)


def sales_history(star: StarSchema, months: int = 36) -> DataFrame:
    """Quantity, revenue, profit, prices and orders per product and month."""
    return monthly_sales(star, months).orderBy("SaleMonth", "sk_produto")


def _squared_misses():
    """Number of rows times the sum of squared distances from their mean.

    The two terms may be far larger than their difference, so it is taken in decimals; as
    doubles only where a term does not fit.
    """
    n, total, squares = F.sum("lines"), F.sum("qty"), F.sum("qty_squared")
    exact = (n.try_cast("decimal(12,0)") * squares.try_cast("decimal(25,8)")
             - total.try_cast("decimal(18,4)") * total.try_cast("decimal(18,4)"))
    return F.coalesce(exact.cast("double"), n * squares.cast("double") - F.pow(total.cast("double"), F.lit(2)))


def product_features(star: StarSchema) -> DataFrame:
    """One row per product, sold or not, with lifetime and recent-half figures.

    Column names with ``12m`` hold the whole history and those with ``3m`` the recent
    half; ``AvgMonthlyQty`` is the mean per sales row. The names are part of the API.
    """
    recent = F.col("Data") >= recent_start(star)
    quant = F.col("Quant")
    sold = valid_sales(star).join(star.calendar(), "IDTempo")
    versions = named_products(star).select("sk_produto", "IDProduto", "Margem")
    products = versions.select("sk_produto", "IDProduto")
    # The join leaves the rows of a version together, so its sums need no exchange of their own.
    totals = (
        sold.select("IDProduto", "Data", "Quant", "TotLiq").join(versions, "IDProduto")
        .groupBy("IDProduto", "sk_produto", "Margem")
        .agg(
            F.sum("Quant").alias("qty"), F.sum(quant * quant).alias("qty_squared"),
            F.sum("TotLiq").alias("revenue"), F.count("*").alias("lines"),
            F.sum(F.when(recent, quant)).alias("recent_qty"),
            F.count(F.when(recent, 1)).alias("recent_lines"),
        )
        .groupBy("sk_produto")
        .agg(
            money(F.sum("qty")).alias("qty"), _squared_misses().alias("squared_misses"),
            money(F.sum("revenue")).alias("revenue"),
            (money(F.sum(F.col("revenue") * F.col("Margem"))) / 100).alias("profit"),
            F.sum("lines").alias("lines"),
            money(F.sum("recent_qty")).alias("recent_qty"),
            F.sum("recent_lines").alias("recent_lines"),
        )
    )

    def distinct(value: Column, name: str) -> DataFrame:
        """Number of distinct values per product, from two or three narrow columns."""
        return sold.select("IDProduto", value.alias("_v")).join(products, "IDProduto").groupBy(
            "sk_produto").agg(F.count_distinct("_v").alias(name))

    months = distinct(month_start(F.col("Data")), "months")
    orders = distinct(F.col("IDPed"), "orders")
    n = F.col("lines")
    spread = F.col("squared_misses") / n / (n - 1)
    mean = F.coalesce(F.col("qty") / n, F.lit(0.0))
    recent_mean = F.coalesce(ratio(F.col("recent_qty"), F.col("recent_lines")), F.lit(0.0))
    latest = latest_version(star.dim_produto, "IDProduto")
    return (
        latest.withColumnRenamed("IDProduto", "sk_produto")
        .join(totals, "sk_produto", "left")
        .join(months, "sk_produto", "left")
        .join(orders, "sk_produto", "left")
        .withColumn("mean_qty", mean)
        .withColumn("recent_mean", recent_mean)
        .select(
            "sk_produto",
            F.col("Cod").alias("ProductID"), F.col("Descri").alias("ProductName"),
            F.col("Grupo").alias("Category"), F.col("SubGrp").alias("Subcategory"),
            F.coalesce(money(F.col("Uprc")), F.lit(0.0)).alias("ListPrice"),
            F.coalesce(money(F.col("Uprc") * (100 - margin())) / 100, F.lit(0.0))
            .alias("StandardCost"),
            F.lit("").alias("ProductClass"), F.lit("").alias("ProductLine"),
            F.coalesce("qty", F.lit(0.0)).alias("TotalQty12m"),
            F.coalesce("revenue", F.lit(0.0)).alias("TotalRevenue12m"),
            F.coalesce("profit", F.lit(0.0)).alias("TotalProfit12m"),
            F.col("mean_qty").alias("AvgMonthlyQty"),
            F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)))).otherwise(0.0)
            .alias("StdDevQty"),
            money(margin()).alias("AvgMargin"),
            F.coalesce("months", F.lit(0)).alias("MonthsWithSales"),
            F.coalesce("orders", F.lit(0)).alias("OrderCount"),
            F.coalesce("recent_qty", F.lit(0.0)).alias("TotalQty3m"),
            F.col("recent_mean").alias("AvgMonthlyQty3m"),
            F.when(
                F.col("mean_qty") > 0,
                round_half_up(
                    (F.col("recent_mean") - F.col("mean_qty")) / F.col("mean_qty") * 100, 2),
            ).otherwise(0.0).alias("TrendPct"),
        )
    )


def sales_by_territory(star: StarSchema, months: int = 12) -> DataFrame:
    """Monthly sales per customer state; products without a natural key count too."""
    calendar = star.calendar(since=window_start(star, months))
    in_window = valid_sales(star).join(calendar.select("IDTempo"), "IDTempo")
    states = latest_version(star.dim_cliente, "IDCliente").select("IDCliente", "Est")
    day = F.col("Data")
    state = F.coalesce(F.col("Territory"), F.lit("N/I"))
    return (
        order_totals(in_window, product_margins(star), "IDTempo")
        .join(states, "IDCliente")
        .join(star.calendar(), "IDTempo")
        .groupBy(
            F.col("Est").alias("Territory"),
            F.year(day).cast("long").alias("Year"), F.month(day).cast("long").alias("Month"),
            F.quarter(day).cast("long").alias("Quarter"), F.col("NomeMes").alias("MonthName"),
        )
        .agg(
            money(F.sum("qty")).alias("TotalQty"), money(F.sum("revenue")).alias("TotalRevenue"),
            (money(F.sum("revenue_margin")) / 100).alias("TotalProfit"),
            F.count_distinct("IDPed").alias("OrderCount"),
            F.count_distinct("IDCliente").alias("UniqueCustomers"),
        )
        .select(
            state.alias("Territory"), state.alias("Country"), F.lit("Brasil").alias("Region"),
            "Year", "Month", "Quarter", "MonthName", "TotalQty", "TotalRevenue", "TotalProfit",
            "OrderCount", "UniqueCustomers",
        )
        .orderBy("Year", "Month", "Territory")
    )


def seller_totals(star: StarSchema, months: int | None = None) -> DataFrame:
    """Seller performance rows in no particular order."""
    sales = valid_sales(star)
    if months is not None:
        calendar = star.calendar(since=window_start(star, months))
        sales = sales.join(calendar.select("IDTempo"), "IDTempo")
    totals = (
        order_totals(sales, product_margins(star), "IDVendedor")
        .filter(F.col("IDVendedor").isNotNull())
        .groupBy("IDVendedor")
        .agg(
            money(F.sum("revenue")).alias("TotalRevenue"),
            (money(F.sum("revenue_margin")) / 100).alias("TotalProfit"),
            money(F.sum("qty")).alias("TotalQty"),
            F.count_distinct("IDPed").alias("OrderCount"),
            F.count_distinct("IDCliente").alias("UniqueCustomers"),
            (money(F.sum("margin")) / F.sum("lines")).alias("AvgMargin"),
        )
    )
    return totals.join(latest_version(star.dim_vendedor, "IDVendedor"), "IDVendedor").select(
        F.col("IDVendedor").alias("SellerID"), F.col("Nome").alias("SellerName"),
        F.coalesce("Equipe", "Mun").alias("Territory"),
        F.lit(0).cast("long").alias("AnnualQuota"), F.lit(0).cast("long").alias("CommissionPct"),
        "TotalRevenue", "TotalProfit", "TotalQty", "OrderCount", "UniqueCustomers", "AvgMargin",
        F.lit(None).cast("double").alias("QuotaAttainmentPct"),
    )


def seller_performance(star: StarSchema, months: int | None = None) -> DataFrame:
    """Totals per seller by revenue. Without ``months`` the whole history counts."""
    return seller_totals(star, months).orderBy(F.desc("TotalRevenue"), "SellerID")


def top_sellers(
    star: StarSchema, n: int = 5, months: int | None = None, with_id: bool = False
) -> DataFrame:
    """The ``n`` sellers with the most revenue; ``with_id`` adds what they are ordered by."""
    extra = ["SellerID", F.col("TotalRevenue").alias("revenue")] if with_id else []
    return (
        seller_totals(star, months)
        .orderBy(F.desc("TotalRevenue"), "SellerID").limit(n)
        .select(
            "SellerName", "Territory",
            round_half_even(F.coalesce("TotalRevenue", F.lit(0.0)), 2).alias("TotalRevenue"),
            round_half_even(F.coalesce("QuotaAttainmentPct", F.lit(0.0)), 2)
            .alias("QuotaAttainmentPct"), *extra,
        )
    )


def promotion_impact(spark: SparkSession) -> DataFrame:
    """Always empty, as the schema has no promotions; the columns are part of the API."""
    return spark.createDataFrame([], (
        "PromotionName string, DiscountType string, PromotionCategory string, "
        "DiscountPct double, OrderCount bigint, TotalQty double, GrossRevenue double, "
        "NetRevenue double, TotalProfit double, TotalDiscount double, AvgMargin double"
    ))


def dashboard_kpis(star: StarSchema) -> DataFrame:
    """One row of 14 figures. Year over year sets a partial year against a full one."""
    last = sale_dates(star).select("last_day").scalar()
    orders = order_totals(valid_sales(star), product_margins(star), "IDTempo")
    day, revenue = F.col("Data"), F.col("revenue")
    year_gap = F.year(last) - F.year(day)
    month_gap = F.months_between(month_start(last), month_start(day))

    def revenue_where(condition):
        return money(F.sum(F.when(condition, revenue).otherwise(0)))

    totals = orders.join(star.calendar(), "IDTempo").agg(
        money(F.sum("revenue")).alias("revenue"),
        (money(F.sum("revenue_margin")) / 100).alias("profit"),
        F.sum("qty").cast("long").alias("qty"),
        F.count_distinct("IDPed").alias("orders"),
        F.count_distinct("IDCliente").alias("customers"),
        ratio(money(F.sum("margin")), F.sum("lines")).alias("margin"),
        revenue_where(month_gap == 0).alias("this_month"),
        revenue_where(month_gap == 1).alias("last_month"),
        revenue_where(year_gap == 0).alias("this_year"),
        revenue_where(year_gap == 1).alias("last_year"),
    )

    def cents(name: str, alias: str):
        return round_half_even(F.coalesce(F.col(name), F.lit(0.0)), 2).alias(alias)

    def whole(name: str, alias: str):
        return F.coalesce(F.col(name), F.lit(0)).cast("long").alias(alias)

    return totals.select(
        cents("revenue", "total_revenue"), cents("profit", "total_profit"),
        whole("qty", "total_qty"), whole("orders", "total_orders"),
        whole("customers", "unique_customers"), cents("margin", "avg_margin_pct"),
        cents("this_month", "current_month_revenue"), cents("last_month", "prev_month_revenue"),
        pct_change(F.col("this_month"), F.col("last_month")).alias("mom_change_pct"),
        cents("this_year", "ytd_revenue"), cents("last_year", "prev_year_revenue"),
        pct_change(F.col("this_year"), F.col("last_year")).alias("yoy_change_pct"),
        month_text(last).alias("reference_month"),
        F.year(last).cast("long").alias("reference_year"),
    )


def table_row_counts(star: StarSchema) -> DataFrame:
    """Row count of each table, or the error met when it was read.

    The tables are counted here and now, because only so an error becomes a row.
    """
    def count(df: DataFrame) -> tuple[int | None, bool, str | None]:
        try:
            return df.count(), True, None
        except (PySparkException, Py4JJavaError) as error:
            return None, False, str(error).strip().splitlines()[0]

    rows = [(name, *count(df)) for name, df in star.tables().items()]
    return star.ft_vendas.sparkSession.createDataFrame(
        rows, "table_name string, row_count bigint, ok boolean, error string")
