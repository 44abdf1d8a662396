"""Readers and writers for a stored star schema, and for model outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from gondola.sources.schema import SCHEMAS, StarSchema, conform

DAY_WRITERS = 16
MOST_DAYS = 200_000


def read_star(spark: SparkSession, path: str, fmt: str = "parquet") -> StarSchema:
    """Read a stored star schema; ``path`` holds one folder per table."""
    star = StarSchema(**{
        name: conform(name, spark.read.format(fmt).schema(schema).load(f"{path}/{name}"))
        for name, schema in SCHEMAS.items()
    })
    # The calendar is broadcast, so its size is checked here: a count from file footers.
    days = star.dim_tempo.count()
    if days > MOST_DAYS:
        raise ValueError(f"dim_tempo has {days} rows; {MOST_DAYS} days are the most that is broadcast")
    return star


def read_star_jdbc(
    spark: SparkSession,
    url: str,
    properties: dict[str, str],
    partitioning: dict[str, dict] | None = None,
) -> StarSchema:
    """Read the star schema from a database.

    Credentials come from the caller's ``properties``. ``partitioning`` gives, per
    table, the ``column``, ``lowerBound``, ``upperBound`` and ``numPartitions`` of a
    parallel read; filters and column lists are pushed down to the database.
    """
    def table(name: str) -> DataFrame:
        split = (partitioning or {}).get(name, {})
        df = spark.read.jdbc(url=url, table=name, properties=properties, **split)
        kinds = SCHEMAS[name]
        return conform(name, df.select(*[F.col(f.name).cast(f.dataType) for f in kinds]))

    return StarSchema(**{name: table(name) for name in SCHEMAS})


def write_star(
    star: StarSchema, path: str, fmt: str = "parquet", sales_by_day: bool = False
) -> None:
    """Store the star schema.

    ``sales_by_day`` gives the sales fact one folder per day, which turns month windows
    into partition pruning; it pays once a day holds at least some hundred megabytes.
    Rows are then spread by day *and* order, so that several tasks share a busy day and
    no task writes to more than a few folders at once.
    """
    for name, df in star.tables().items():
        by_day = sales_by_day and name == "ft_vendas"
        if by_day:
            df = df.repartition(
                "IDTempo", F.pmod(F.xxhash64("IDPed"), F.lit(DAY_WRITERS)))
        writer = df.write.format(fmt).mode("overwrite")
        (writer.partitionBy("IDTempo") if by_day else writer).save(f"{path}/{name}")


def write_json_records(df: DataFrame, path: str) -> None:
    """Write a result as JSON records, one object per line."""
    df.write.mode("overwrite").json(path)


def as_json_records(df: DataFrame) -> DataFrame:
    """One ``record`` column holding each row as a JSON object, nulls included."""
    plain = [
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}).alias("record"))
