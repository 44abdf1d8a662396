"""Data-quality rules and profile figures of the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.functions.columns import money, month_diff, month_number
from gondola.operators.sales import latest_version, margin, sale_dates
from gondola.sources.schema import StarSchema

# The tag of a passed rule, of a failed "must be 0" rule (minimum -1)
# and of a count below its minimum.
TAG_OK, TAG_WARNING, TAG_ERROR = "OK", "ATENCAO", "ERRO"
MUST_BE_ZERO = -1
MIN_SALES_ROWS, MIN_DAYS, MIN_MEMBERS = 1000, 365, 1


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def dq_checks(star: StarSchema) -> DataFrame:
    """Twelve rules; one pass over each table whatever its number of rules."""
    def rules(df: DataFrame, *checks: tuple[str, Column, int]) -> DataFrame:
        values = df.agg(*[value.alias(f"v{i}") for i, (_, value, _) in enumerate(checks)])
        return values.select(F.explode(F.array(*[
            F.struct(
                F.lit(text).alias("description"),
                F.col(f"v{i}").alias("value"),
                F.lit(minimum).cast("long").alias("minimum"),
            )
            for i, (text, _, minimum) in enumerate(checks)
        ])).alias("rule")).select("rule.*")

    col = F.col
    found = [
        rules(
            star.ft_vendas,
            ("ft_vendas: rows", F.count("*"), MIN_SALES_ROWS),
            ("ft_vendas: null IDTempo", _count_if(col("IDTempo").isNull()), MUST_BE_ZERO),
            ("ft_vendas: null IDProduto", _count_if(col("IDProduto").isNull()), MUST_BE_ZERO),
            ("ft_vendas: null IDCliente", _count_if(col("IDCliente").isNull()), MUST_BE_ZERO),
            ("ft_vendas: null IDVendedor", _count_if(col("IDVendedor").isNull()), MUST_BE_ZERO),
            ("ft_vendas: Quant not positive", _count_if(col("Quant") <= 0), MUST_BE_ZERO),
            ("ft_vendas: TotLiq not positive", _count_if(col("TotLiq") <= 0), MUST_BE_ZERO),
        ),
        rules(
            star.dim_produto,
            ("dim_produto: products", F.count_distinct("IDProduto"), MIN_MEMBERS),
            ("dim_produto: Uprc null or zero",
             _count_if(col("Uprc").isNull() | (col("Uprc") == 0)), MUST_BE_ZERO),
        ),
        rules(star.dim_tempo, ("dim_tempo: days", F.count("*"), MIN_DAYS)),
        rules(star.dim_cliente,
              ("dim_cliente: customers", F.count_distinct("IDCliente"), MIN_MEMBERS)),
        rules(star.dim_vendedor,
              ("dim_vendedor: sellers", F.count_distinct("IDVendedor"), MIN_MEMBERS)),
    ]
    value, minimum = col("value"), col("minimum")
    ok = F.when(minimum == MUST_BE_ZERO, value == 0).otherwise(value >= minimum)
    return reduce(DataFrame.unionByName, found).withColumn("ok", ok).withColumn(
        "tag",
        F.when(col("ok"), TAG_OK).when(minimum == MUST_BE_ZERO, TAG_WARNING).otherwise(TAG_ERROR),
    )


def dq_overall(star: StarSchema) -> DataFrame:
    """One row: whether every rule holds, and how many do not."""
    return dq_checks(star).agg(
        F.bool_and("ok").alias("all_ok"), _count_if(~F.col("ok")).alias("failed")
    )


def data_period(star: StarSchema) -> DataFrame:
    """First and last day in the sales fact, valid or not, and the months between."""
    return sale_dates(star, star.ft_vendas).select(
        "first_day", "last_day",
        month_diff(F.col("first_day"), F.col("last_day")).alias("months"),
    )


def _by_product(star: StarSchema) -> DataFrame:
    """Every sale, valid or not, summed per product under its latest version's texts."""
    versions = star.dim_produto.filter(F.col("IDProduto").isNotNull()).select(
        F.col("IDSK").alias("version"), F.col("IDProduto").alias("sk_produto"))
    latest = latest_version(star.dim_produto, "IDProduto").select(
        F.col("IDProduto").alias("sk_produto"), "Grupo", margin().alias("Margem"))
    return (
        star.ft_vendas.groupBy(F.col("IDProduto").alias("version"))
        .agg(F.sum("Quant").alias("qty"), F.sum("TotLiq").alias("revenue"))
        .join(versions, "version")
        .groupBy("sk_produto")
        .agg(F.sum("qty").alias("qty"), F.sum("revenue").alias("revenue"))
        .join(latest, "sk_produto")
    )


def revenue_profit_total(star: StarSchema) -> DataFrame:
    """Net revenue, and profit at each product's latest margin."""
    return _by_product(star).agg(
        money(F.sum("revenue")).alias("revenue"),
        (money(F.sum(F.col("revenue") * F.col("Margem"))) / 100).alias("approx_profit"),
    )


def eligible_products(star: StarSchema, by: str = "version") -> DataFrame:
    """How many products have at least 6 and at least 12 months with a sale, valid or not.

    ``by="version"`` counts product versions as sold, ``by="product"`` natural products.
    """
    sold = star.ft_vendas.join(star.calendar(), "IDTempo").select(
        "IDProduto", month_number(F.col("Data")).alias("month")).distinct()
    if by == "product":
        versions = star.dim_produto.filter(F.col("IDProduto").isNotNull()).select(
            F.col("IDSK").alias("version"), F.col("IDProduto").alias("sk_produto"))
        sold = (
            sold.withColumnRenamed("IDProduto", "version").join(versions, "version")
            .select(F.col("sk_produto").alias("IDProduto"), "month")
        )
    elif by != "version":
        raise ValueError(f"by must be 'version' or 'product', not {by!r}")
    months = sold.groupBy("IDProduto").agg(F.count_distinct("month").alias("months"))
    return months.agg(
        _count_if(F.col("months") >= 6).alias("products_6_months"),
        _count_if(F.col("months") >= 12).alias("products_12_months"),
    )


def top_groups(star: StarSchema, n: int = 5) -> DataFrame:
    """The ``n`` product groups with the most revenue."""
    return (
        _by_product(star).groupBy("Grupo")
        .agg(money(F.sum("qty")).alias("TotalQty"), money(F.sum("revenue")).alias("TotalRevenue"))
        .orderBy(F.desc("TotalRevenue"), "Grupo").limit(n)
    )


def returns_summary(star: StarSchema) -> DataFrame:
    """Number and net value of returned lines."""
    return star.ft_trocas.agg(
        F.count("*").alias("returns"),
        F.coalesce(money(F.sum("TotLiq")), F.lit(0.0)).alias("net_value"),
    )
