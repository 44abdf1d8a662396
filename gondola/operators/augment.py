"""Augmentation: noisy copies of sales series, class balancing, mixing of rows.

Every draw is a hash of the seed and the row's keys, so results do not depend on how
the data is partitioned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.functions.columns import hash_beta, hash_key, hash_normal, hash_uniform
from gondola.functions.lineage import cut_lineage
from gondola.functions.neighbours import nearest_in_class
from gondola.functions.ordering import numbered_by_hash


def augment_gaussian(
    history: DataFrame, noise_share: float = 0.05, copies: int = 2, seed: int = 42,
    keep_copy: bool = False,
) -> DataFrame:
    """The sales history followed by noisy copies of it.

    The noise is a share of each product's mean. Quantities are rounded, and nothing
    falls below 0; products with a mean of 0 or less are copied as they are.
    """
    product = Window.partitionBy("sk_produto")
    qty, revenue = F.col("TotalQty"), F.col("TotalRevenue")
    original = F.col("copy") == 0

    def noisy(value: Column, mean: str, name: str) -> Column:
        draw = hash_normal(seed, F.lit(name), "sk_produto", "SaleMonth", "copy")
        return F.greatest(value + draw * F.col(mean) * noise_share, F.lit(0.0))

    dead = original | (F.col("mean_qty") <= 0)
    result = (
        history.withColumn("mean_qty", F.avg(qty).over(product))
        .withColumn("mean_revenue", F.avg(revenue).over(product))
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
        .withColumn("TotalQty", F.when(dead, qty).otherwise(
            F.bround(noisy(qty, "mean_qty", "qty"), 0)))
        .withColumn("TotalRevenue", F.when(dead | (F.col("mean_revenue") <= 0), revenue).otherwise(
            noisy(revenue, "mean_revenue", "revenue")))
    )
    return result.select(*history.columns, *(["copy"] if keep_copy else []))


def smote(rows: DataFrame, k_neighbors: int = 3, seed: int = 42) -> DataFrame:
    """Raise every class to the size of the largest.

    ``rows`` has ``row_id``, ``label`` and ``x``. A synthetic row lies between a random
    row of its class and one of that row's nearest neighbours in the class. Equal rows
    are one point with a number of copies, so a mass of copies costs no comparisons.
    """
    spark = rows.sparkSession
    # One count per class.
    sizes = {r["label"]: r["n"] for r in
             rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return rows
    largest = max(sizes.values())
    k = min(k_neighbors, max(1, min(sizes.values()) - 1))
    short = [(label, n) for label, n in sorted(sizes.items()) if n < largest]
    if not short:
        return rows

    draws = reduce(DataFrame.unionByName, [
        spark.range(largest - n).select(
            F.lit(label).alias("label"), F.col("id").alias("draw"), F.lit(n).alias("size"))
        for label, n in short
    ])

    def uniform(name: str) -> Column:
        return hash_uniform(seed, F.lit(name), "label", "draw")

    draws = draws.select(
        "label", "draw", F.floor(uniform("base") * F.col("size")).alias("row_index"),
        (F.floor(uniform("neighbour") * k) + 1).cast("int").alias("pick"),
        uniform("gap").alias("gap"))
    minority = rows.filter(F.col("label").isin([label for label, _ in short]))
    numbered = numbered_by_hash(
        minority.withColumn("_h", hash_key(seed, "row_id")), "_h", ["label"])
    # Both are read by several of the steps that follow.
    points = cut_lineage(minority.groupBy("label", "x").agg(
        F.min("row_id").alias("point_id"), F.count("*").alias("copies")))
    base = cut_lineage(
        draws.join(numbered.select("label", "row_index", "x"), ["label", "row_index"])
        .join(points, ["label", "x"]))
    near = nearest_in_class(
        points.select("label", "point_id", "x"), base.select("point_id").distinct(), k)
    others = points.select(
        F.col("point_id").alias("neighbour_id"), F.col("copies").alias("others"))
    # At most k entries per point, each standing for at most k equal rows.
    ranked = near.join(others, "neighbour_id").groupBy("point_id").agg(
        F.sort_array(F.collect_list(F.struct("distance", "neighbour_id", "others"))).alias("near"))
    each = F.flatten(F.transform("near", lambda p: F.array_repeat(
        p["neighbour_id"], F.least(p["others"], F.lit(k)).cast("int"))))
    # A row's own copies are its nearest neighbours.
    rank = F.col("pick") - (F.col("copies") - 1)
    chosen = F.when(rank > 0, F.get(each, (rank - 1).cast("int")))
    target = points.select(F.col("point_id").alias("chosen"), F.col("x").alias("y"))
    synthetic = (
        base.join(ranked, "point_id", "left")
        .withColumn("chosen", F.coalesce(chosen, F.col("point_id")))
        .join(target, "chosen")
        .select(
            hash_key(seed, F.lit("smote"), "label", "draw").alias("row_id"), "label",
            F.zip_with("x", "y", lambda a, b: a + F.col("gap") * (b - a)).alias("x"))
    )
    return rows.select("row_id", "label", "x").unionByName(synthetic)


def mixup(rows: DataFrame, n_samples: int = 100, alpha: float = 0.2, seed: int = 42) -> DataFrame:
    """Append rows mixed of two random rows, labelled as the heavier of the two."""
    numbered = numbered_by_hash(
        rows.select("row_id", "label", "x", hash_key(seed, "row_id").alias("_h")), "_h")
    size = rows.agg(F.count("*")).scalar()
    weight = F.col("weight")
    draws = rows.sparkSession.range(n_samples).select(
        F.col("id").alias("draw"),
        F.floor(hash_uniform(seed, F.lit("first"), "id") * size).alias("i"),
        F.floor(hash_uniform(seed, F.lit("second"), "id") * size).alias("j"),
        hash_beta(alpha, seed, "id").alias("weight"))

    def side(index: str, label: str, x: str) -> DataFrame:
        return numbered.select(
            F.col("row_index").alias(index), F.col("label").alias(label), F.col("x").alias(x))

    mixed = (
        draws.join(side("i", "label_i", "x_i"), "i").join(side("j", "label_j", "x_j"), "j")
        .select(
            hash_key(seed, F.lit("mixup"), "draw").alias("row_id"),
            F.when(weight >= 0.5, F.col("label_i")).otherwise(F.col("label_j")).alias("label"),
            F.zip_with("x_i", "x_j", lambda a, b: weight * a + (1 - weight) * b).alias("x"))
    )
    return rows.select("row_id", "label", "x").unionByName(mixed)


def augment_classifier(
    rows: DataFrame, use_smote: bool = True, use_mixup: bool = True, mixup_samples: int = 150,
    seed: int = 42,
) -> DataFrame:
    """Balance the classes, then mix; either step can be left out."""
    if use_smote:
        rows = smote(rows, seed=seed)
        if use_mixup:
            # Mixing reads its input several times.
            rows = cut_lineage(rows)
    if use_mixup:
        rows = mixup(rows, n_samples=mixup_samples, seed=seed)
    return rows
