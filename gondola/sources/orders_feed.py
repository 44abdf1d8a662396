"""Adapter: order-management tables (orders, line items, parts) as the star schema.

Each part number stands for one version of a product, two versions to a product.
Some products, states and teams get no value, and some products are shaped to sell
never, late or ever less, so that every branch of the operators is exercised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.sources.schema import MONEY, PERCENT, StarSchema

# Declared, so that building a query starts no job to infer them.
FEED_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, "
                "l_extendedprice double, l_discount double, l_returnflag string",
}

MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
               "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _half(column: str) -> Column:
    return F.expr(f"{column} div 2")


def _day_key(day: Column) -> Column:
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("long")


def _net_value() -> Column:
    price = F.col("l_extendedprice").cast(MONEY)
    kept = (F.lit(1) - F.col("l_discount")).cast("decimal(5,2)")
    return (price * kept).cast(MONEY)


def _quantity(product: Column, day: Column) -> Column:
    qty = F.col("l_quantity")
    fading = day >= F.lit("1998-04-01").cast("date")
    return (
        F.when(product % 19 == 0, 0)
        .when((product % 13 == 4) & (day < F.lit("2001-04-01").cast("date")), 0)
        .when((product % 13 == 6) & (day < F.lit("2000-11-01").cast("date")), 0)
        .when((product % 11 == 3) & fading, F.ceil(qty * 0.2))
        .when((product % 11 == 5) & fading, F.ceil(qty * 0.65))
        .otherwise(qty)
        .cast(MONEY)
    )


def _sales(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Order lines with their order's customer and day.

    Both sides grow with the data, so they meet in a sort-merge join at every scale;
    the lines come out partitioned by order, which later order counts reuse.
    """
    headers = orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    headers = headers.hint("merge")
    day = F.col("day")
    return lineitem.join(headers, F.col("l_orderkey") == F.col("o_orderkey")).select(
        _day_key(day).alias("IDTempo"),
        F.col("l_partkey").cast("long").alias("IDProduto"),
        _half("o_custkey").alias("IDCliente"),
        _half("l_suppkey").alias("IDVendedor"),
        F.col("l_orderkey").alias("IDPed"),
        _quantity(_half("l_partkey"), day).alias("Quant"),
        _net_value().alias("TotLiq"),
        (F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")) / 100)
        .cast(MONEY).alias("PrVenda"),
    )


def _products(part: DataFrame) -> DataFrame:
    product = _half("p_partkey")
    return part.select(
        F.col("p_partkey").alias("IDSK"),
        F.when(product % 10 != 7, product).alias("IDProduto"),
        F.concat(F.lit("P"), product.cast("string")).alias("Cod"),
        F.col("p_name").alias("Descri"),
        F.col("p_brand").alias("Grupo"),
        F.col("p_type").alias("SubGrp"),
        F.when(F.col("p_size") % 17 != 0, (F.lit(10) + F.col("p_size") % 40).cast(PERCENT))
        .alias("Margem"),
        F.when(product % 23 != 0, F.col("p_retailprice").cast(MONEY)).alias("Uprc"),
    )


def line_count(spark: SparkSession, path: str) -> int:
    """Order lines in ``path``, by far the most rows of the feed."""
    return spark.read.schema(FEED_SCHEMAS["lineitem"]).parquet(f"{path}/lineitem.parquet").count()


def star_from_orders(spark: SparkSession, path: str) -> StarSchema:
    """The star schema over the Parquet tables in ``path``; nothing is read yet.

    Later steps reuse the partitioning by order, for which Spark leaves the lines of one
    giant order in one task unless the session sets
    ``spark.sql.adaptive.forceOptimizeSkewedJoin``.
    """
    def table(name: str) -> DataFrame:
        return spark.read.schema(FEED_SCHEMAS[name]).parquet(f"{path}/{name}.parquet")

    nation, region = table("nation"), table("region")
    orders, lineitem = table("orders"), table("lineitem")
    day = F.col("Data")

    customers = table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    sellers = (
        table("supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return StarSchema(
        ft_vendas=_sales(lineitem, orders),
        dim_produto=_products(table("part")),
        dim_cliente=customers.select(
            F.col("c_custkey").alias("IDSK"),
            _half("c_custkey").alias("IDCliente"),
            F.when(F.col("n_nationkey") % 8 != 5, F.col("n_name")).alias("Est"),
        ),
        dim_vendedor=sellers.select(
            F.col("s_suppkey").alias("IDSK"),
            _half("s_suppkey").alias("IDVendedor"),
            F.col("s_name").alias("Nome"),
            F.when(F.col("s_suppkey") % 5 != 1, F.col("r_name")).alias("Equipe"),
            F.col("n_name").alias("Mun"),
        ),
        dim_tempo=orders.select(F.to_date("o_orderdate").alias("Data")).distinct().select(
            _day_key(day).alias("IDSK"),
            day,
            F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.month(day)).alias("NomeMes"),
        ),
        ft_trocas=lineitem.filter(F.col("l_returnflag") == "R").select(
            F.col("l_orderkey").alias("IDPed"),
            F.col("l_partkey").alias("IDProduto"),
            _net_value().alias("TotLiq"),
        ),
    )
