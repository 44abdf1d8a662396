"""Exact order statistics and dense numbering without a single-task sort.

A global ``row_number`` or ``percentile`` gathers a whole column in one task. Here
the work is split by value instead: a histogram says which narrow slice holds the
answer, or how many rows precede each slice, and only slices are ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK_ACCURACY = 100_000
HASH_BUCKET_BITS = 12




def quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], keys: list[str] | None = None
) -> DataFrame:
    """Exact linearly interpolated quantiles of ``value`` per group, one column for each name.

    Groups are few (labels, clusters) and may be of any size. A mergeable sketch, right
    to within ``n / RANK_ACCURACY`` ranks, first brackets each wanted rank; one more pass
    counts the rows below the bracket and sorts only the distinct values inside it.
    """
    keys = keys or []
    # In a large group four sketch errors to each side are at least four rows beyond the
    # error itself, so both rows to interpolate between are inside. A small group is
    # taken whole.
    margin = 5.0 / RANK_ACCURACY
    small = F.col("_rows") <= RANK_ACCURACY
    rows = df.select(*keys, F.col(value).alias("_x")).filter(F.col("_x").isNotNull())
    counts = rows.groupBy(*keys, "_x").agg(F.count("*").alias("_n"))
    ends = [
        end for p in probabilities.values()
        for end in (max(0.0, p - margin), min(1.0, p + margin))
    ]
    bounds = rows.groupBy(*keys).agg(
        F.count("*").alias("_rows"),
        F.percentile_approx("_x", ends, RANK_ACCURACY).alias("_ends"),
        F.min("_x").alias("_least"), F.max("_x").alias("_most"),
    )
    brackets = bounds.select(*keys, "_rows", F.explode(F.array(*[
        F.struct(
            F.lit(name).alias("_name"),
            (F.lit(p) * (F.col("_rows") - 1)).alias("_rank"),
            F.when(small | F.lit(p <= margin), F.col("_least"))
            .otherwise(F.col("_ends")[2 * i]).alias("_low"),
            F.when(small | F.lit(p >= 1 - margin), F.col("_most"))
            .otherwise(F.col("_ends")[2 * i + 1]).alias("_high"),
        )
        for i, (name, p) in enumerate(probabilities.items())
    ])).alias("_b")).select(*keys, "_b.*")
    groups = brackets.select(*[F.col(k).alias(f"_key_{k}") for k in keys],
                             "_name", "_rank", "_low", "_high")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    # A handful of rows: one per group and wanted quantile.
    near = counts.join(F.broadcast(groups), on & (F.col("_x") <= F.col("_high")))
    inside = F.col("_x") >= F.col("_low")
    # All values below a bracket shrink to one row that carries their number.
    slices = near.groupBy(
        *keys, "_name", "_rank", F.when(inside, F.col("_x")).alias("_x")
    ).agg(F.sum("_n").alias("_n"))
    order = Window.partitionBy(*keys, "_name").orderBy(F.col("_x").asc_nulls_first())
    seen = slices.withColumn(
        "_seen", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    floor = F.floor("_rank")
    found = seen.groupBy(*keys, "_name").agg(
        F.min(F.when(F.col("_seen") > floor, F.col("_x"))).alias("_a"),
        F.min(F.when(F.col("_seen") > F.ceil("_rank"), F.col("_x"))).alias("_c"),
        F.first("_rank").alias("_rank"),
        F.coalesce(F.max(F.when(F.col("_x").isNull(), F.col("_seen"))), F.lit(0)).alias("_below"),
    ).withColumn(
        # A rank outside its bracket would give another value; it fails instead.
        "_q", F.when((F.col("_below") > floor) | F.col("_a").isNull() | F.col("_c").isNull(),
                     F.raise_error("a quantile lies outside its bracket"))
        .otherwise(F.col("_a") + (F.col("_c") - F.col("_a")) * (F.col("_rank") - floor)))
    return found.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_name") == name, F.col("_q"))).alias(name) for name in probabilities
    ])


def numbered_by_hash(
    df: DataFrame, hash_column: str, keys: list[str] | None = None, alias: str = "row_index"
) -> DataFrame:
    """Number rows from 0 in the order of a hash, within each group of ``keys``.

    Equal to ``row_number() - 1`` over the hash, but the group is cut into 4,096 slices
    by its leading hash bits; each is numbered apart and offset by the rows before it.
    """
    keys = keys or []
    sliced = df.withColumn(
        "_slice", F.shiftrightunsigned(F.col(hash_column), 64 - HASH_BUCKET_BITS))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_size"))
    # At most 4,096 rows per group.
    offsets = sizes.select(
        *keys, "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy(*keys)).alias("_group_size"),
    )
    within = Window.partitionBy(*keys, "_slice").orderBy(hash_column)
    return (
        sliced.withColumn("_place", F.row_number().over(within))
        .join(F.broadcast(offsets), [*keys, "_slice"])
        .withColumn(alias, F.col("_before") + F.col("_place") - 1)
        .withColumnRenamed("_group_size", "group_size")
        .drop("_slice", "_before", "_place")
    )
