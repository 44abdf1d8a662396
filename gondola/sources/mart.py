"""A sales mart kept up to date from the files that changed.

The sales fact lies in folders, one for each slice of days. For every slice the mart keeps
partial results that can be merged: sums and counts per day and product version, and the
distinct orders per day and product version. A refresh lists the files, reads the slices
whose files differ from those it knows, and replaces their partials; other slices are
not read. Products, margins and names join when the mart is read, so a changed dimension
needs no refresh.

Each refresh first notes its slices as pending and, when their partials are written, the
state of their files. After a broken run the pending slices are done again, so a run may
be repeated at any time. One refresh runs at a time. Rows without a day are no valid sales
and are left out. The number of slices is bounded by the calendar and is checked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gondola.functions.columns import month_start
from gondola.operators.reports import history_of
from gondola.operators.sales import named_products, sale_dates, valid_rows
from gondola.sources.schema import SCHEMAS, StarSchema
from gondola.sources.warehouse import MOST_DAYS

PENDING = "pending"
LOG = "n long, slice long, state string"
WRITERS = 4


@dataclass(frozen=True)
class Refresh:
    """Slices whose partials a refresh wrote anew, and slices that it took out."""

    written: list[int]
    removed: list[int]


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Several tasks share a slice, and a task writes to few folders at once."""
    return df.repartition("slice", F.pmod(F.xxhash64(key), F.lit(WRITERS)))


def write_slices(sales: DataFrame, path: str, width: int = 1) -> None:
    """Store sales with a folder for each ``width`` day keys; slices stored before are replaced
    where ``sales`` has rows of them. With keys like 20240131 a width of 100 makes months."""
    sliced = sales.withColumn("slice", F.floor(F.col("IDTempo") / width).cast("long"))
    _spread(sliced, "IDPed").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "slice").parquet(path)


def file_states(spark: SparkSession, path: str) -> DataFrame:
    """``slice`` and ``state``, a digest of names, lengths and times of its files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.parquet").load(path)
    return files.select(
        F.regexp_extract("path", r"/slice=(-?\d+)/", 1).alias("slice"),
        F.xxhash64(F.regexp_extract("path", r"[^/]+$", 0), "length", F.unix_micros("modificationTime")).alias("file"),
    ).filter("slice != ''").groupBy(F.col("slice").cast("long").alias("slice")).agg(
        F.concat_ws(":", F.count("*"), F.bit_xor("file"), F.sum(F.col("file").cast("decimal(20,0)"))).alias("state"))


class SalesMart:
    """Partials under ``path`` of the sales slices under ``sales_path``."""

    def __init__(self, spark: SparkSession, sales_path: str, path: str):
        self.spark, self.sales_path, self.path = spark, sales_path, path

    def _file_system(self, path: str):
        context = self.spark.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(context._jsc.hadoopConfiguration()), place

    def _stored(self, name: str, schema: str) -> DataFrame:
        files, place = self._file_system(f"{self.path}/{name}")
        if not files.exists(place):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _note(self, n: int, states: dict[int, str | None]) -> None:
        rows = [(n, s, state) for s, state in states.items()]
        self.spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _drop(self, slices: list[int]) -> None:
        for name in ("partials", "orders"):
            for s in slices:
                files, place = self._file_system(f"{self.path}/{name}/slice={s}")
                files.delete(place, True)

    def partials(self) -> DataFrame:
        return self._stored("partials", (
            "IDTempo long, IDProduto long, qty decimal(28,4), revenue decimal(28,4), "
            "price decimal(28,4), priced long, lines long, slice long"))

    def orders(self) -> DataFrame:
        return self._stored("orders", "IDTempo long, IDProduto long, IDPed long, slice long")

    def refresh(self) -> Refresh:
        """Bring the partials up to date; slices whose files are as before are not read."""
        log = self._stored("log", LOG)
        known = log.groupBy("slice").agg(F.max_by("state", "n").alias("known"))
        differing = file_states(self.spark, self.sales_path).join(known, "slice", "full").filter(
            ~F.col("state").eqNullSafe(F.col("known")))
        rows = differing.limit(MOST_DAYS + 1).collect()
        if len(rows) > MOST_DAYS:
            raise ValueError(f"more than {MOST_DAYS} slices")
        if not rows:
            return Refresh([], [])
        n = (log.agg(F.max("n")).first()[0] or 0) + 1
        self._note(n, {r["slice"]: PENDING for r in rows})
        self._drop([r["slice"] for r in rows if r["known"] is not None])
        written = sorted(r["slice"] for r in rows if r["state"] is not None)
        if written:
            self._add(written)
        self._note(n + 1, {r["slice"]: r["state"] for r in rows})
        return Refresh(written, sorted(r["slice"] for r in rows if r["state"] is None))

    def _add(self, slices: list[int]) -> None:
        schema = StructType([*SCHEMAS["ft_vendas"].fields, StructField("slice", LongType())])
        sales = valid_rows(self.spark.read.schema(schema).parquet(self.sales_path).filter(
            F.col("slice").isin(slices)))
        keys = ["slice", "IDTempo", "IDProduto"]
        partials = sales.groupBy(*keys).agg(
            F.sum("Quant").alias("qty"), F.sum("TotLiq").alias("revenue"), F.sum("PrVenda").alias("price"),
            F.count("PrVenda").alias("priced"), F.count("*").alias("lines"))
        for name, frame, key in (("partials", partials, "IDProduto"),
                                 ("orders", sales.select(*keys, "IDPed").distinct(), "IDPed")):
            _spread(frame, key).write.mode("append").partitionBy("slice").parquet(f"{self.path}/{name}")

    def history(self, star: StarSchema, months: int = 36) -> DataFrame:
        """The rows of ``monthly_sales``, from the partials and the dimensions of ``star``."""
        partials = self.partials()
        start = sale_dates(star, partials).select(F.add_months(month_start(F.col("last_day")), -months)).scalar()
        days = star.calendar(since=start)

        def by_month(df: DataFrame) -> DataFrame:
            return df.join(days, "IDTempo").withColumn("SaleMonth", month_start(F.col("Data")))

        sums = [F.sum(c).cast("decimal(28,4)").alias(c) for c in ("qty", "revenue", "price")]
        measures = by_month(partials).groupBy("IDProduto", "SaleMonth").agg(
            *sums, F.sum("priced").alias("priced"), F.sum("lines").alias("lines"))
        return history_of(measures, by_month(self.orders()), named_products(star))
