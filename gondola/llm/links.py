"""Connected components of a table of links, by alternating star operations.

Every round is a few joins and grouped minima; the links are written to the shared
checkpoint folder after each round, so that a lost executor costs one round at most. A
node with very many links is a hot join key: minima are combined before they are
shuffled, and the join's other side has one row per node, so Spark can split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.functions.lineage import cut_lineage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Tie the larger (or the smaller) neighbours of each node to the least one."""
    both = links if not large else links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        least.select("u", F.col("m").alias("v"))).where("u <> v")


def components(links: DataFrame) -> DataFrame:
    """``u`` and its component ``v``, the least node that links lead to.

    ``links`` has two columns of one orderable type, each link in any direction and any
    number of times. Nodes that are the least of their component have no row, and so do
    nodes without links. Null ends are ignored.
    """
    a, b = links.columns
    now = cut_lineage(links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = None
    while True:
        now = cut_lineage(_star(_star(now, True).distinct(), False).distinct())
        told = now.agg(F.count("*").alias("n"), F.coalesce(
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if (told.n, told.h) == state:
            return now
        state = (told.n, told.h)
