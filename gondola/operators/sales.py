"""Building blocks shared by the reports: valid sales, windows, versions, partial sums.

The sales fact is the only table that grows without limit, so it is reduced before
it meets anything else: to one row per product version and month, or to one row per
order, customer and day. Spark combines both on the map side, which also takes the
weight out of a product or customer that holds a large share of all rows. Dimensions
other than the calendar carry no broadcast hint; Spark broadcasts them only while
their measured size is under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise
sorts and merges, splitting skewed keys at run time.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.functions.columns import month_diff, month_start
from gondola.functions.lineage import cut_lineage
from gondola.sources.schema import StarSchema


def margin() -> Column:
    """Margin in percent, 0 where unknown."""
    return F.coalesce(F.col("Margem"), F.lit(0).cast("decimal(9,4)"))


def valid_rows(sales: DataFrame) -> DataFrame:
    return sales.filter((F.col("Quant") > 0) & (F.col("TotLiq") > 0))


def valid_sales(star: StarSchema) -> DataFrame:
    return valid_rows(star.ft_vendas)


def with_stored_sales(star: StarSchema) -> StarSchema:
    """The star with its valid sales written once, for jobs that read them several times.

    A star over another system's tables joins its sales anew for every read, and the reads of
    one report take different columns, so that Spark cannot share them.
    """
    return replace(star, ft_vendas=cut_lineage(valid_sales(star)))


def sale_dates(star: StarSchema, sales: DataFrame | None = None) -> DataFrame:
    """One row: first and last date with a (valid) sale.

    Reduces the fact to its distinct day keys before the calendar is looked at.
    """
    days = (valid_sales(star) if sales is None else sales).select("IDTempo").distinct()
    return days.join(star.calendar(), "IDTempo").agg(
        F.min("Data").alias("first_day"), F.max("Data").alias("last_day")
    )


def window_start(star: StarSchema, months: int) -> Column:
    """First day of the month ``months`` before the last sales month (N+1 months in all)."""
    dates = sale_dates(star)
    return dates.select(F.add_months(month_start(F.col("last_day")), -months)).scalar()


def recent_start(star: StarSchema) -> Column:
    """Start of the recent half: half the month distance after the first sale."""
    first, last = F.col("first_day"), F.col("last_day")
    half = F.floor(month_diff(first, last) / 2).cast("int")
    return sale_dates(star).select(F.add_months(first, half)).scalar()


def latest_version(dim: DataFrame, key: str) -> DataFrame:
    """The row with the largest surrogate for each natural key, in one pass."""
    newest = F.max_by(F.struct(*[c for c in dim.columns if c != key]), "IDSK")
    return dim.filter(F.col(key).isNotNull()).groupBy(key).agg(newest.alias("v")).select(key, "v.*")


def product_margins(star: StarSchema) -> DataFrame:
    """Product version and margin only; inner-joining it keeps null natural keys."""
    return star.dim_produto.select(F.col("IDSK").alias("IDProduto"), margin().alias("Margem"))


def named_products(star: StarSchema) -> DataFrame:
    """Product versions that have a natural key."""
    return star.dim_produto.filter(F.col("IDProduto").isNotNull()).select(
        F.col("IDProduto").alias("sk_produto"), F.col("IDSK").alias("IDProduto"),
        "Cod", "Descri", "Grupo", "SubGrp", margin().alias("Margem"),
    )


def order_totals(sales: DataFrame, margins: DataFrame, by: str) -> DataFrame:
    """Sums per order, customer and ``by``, with revenue weighted by margin.

    Few rows remain of an order, so counting distinct orders and customers, for which
    Spark copies every row, starts from less; the keys spread evenly whatever the product.
    """
    return sales.join(margins, "IDProduto").groupBy("IDPed", "IDCliente", by).agg(
        F.sum("Quant").alias("qty"),
        F.sum("TotLiq").alias("revenue"),
        F.sum(F.col("TotLiq") * F.col("Margem")).alias("revenue_margin"),
        F.sum("Margem").alias("margin"),
        F.count("*").alias("lines"),
    )
