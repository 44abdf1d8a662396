"""Quality figures of a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.functions.columns import round_half_up


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def class_report(predictions: DataFrame, label: str = "label", predicted: str = "predicted",
                 digits: int = 6) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and the two means.

    Rows are counted into the confusion matrix first; the rest works on one row per class.
    A class never predicted has precision 0. Accuracy is shown in the F1 column.
    """
    n = F.col("n")
    confusion = predictions.groupBy(
        F.col(label).alias("_y"), F.col(predicted).alias("_p")).agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    sides = confusion.select(F.explode(F.array(
        F.struct(F.col("_y").alias("class"), n.alias("support"), zero.alias("claimed"),
                 F.when(F.col("_y") == F.col("_p"), n).otherwise(0).alias("hit")),
        F.struct(F.col("_p").alias("class"), zero.alias("support"), n.alias("claimed"),
                 zero.alias("hit")),
    )).alias("s")).select("s.*")
    hit, support = F.col("hit"), F.col("support")
    classes = sides.groupBy("class").agg(
        *[F.sum(c).alias(c) for c in ("support", "claimed", "hit")]
    ).select(
        "class", "support", "hit",
        _share(hit, F.col("claimed")).alias("precision"), _share(hit, support).alias("recall"),
        _share(2 * hit, support + F.col("claimed")).alias("f1_score"),
    )
    scores = ["precision", "recall", "f1_score"]

    def line(name: str, precision, recall, f1) -> Column:
        return F.struct(F.lit(name).alias("class"), precision.alias("precision"),
                        recall.alias("recall"), f1.alias("f1_score"), F.col("n").alias("support"))

    unknown = F.lit(None).cast("double")
    summary = classes.agg(
        F.collect_list(F.struct("class", *scores, "support")).alias("classes"),
        F.sum("support").alias("n"),
        _share(F.sum("hit"), F.sum("support")).alias("accuracy"),
        *[F.avg(c).alias(f"macro_{c}") for c in scores],
        *[_share(F.sum(F.col(c) * support), F.sum("support")).alias(f"weighted_{c}")
          for c in scores],
    )
    lines = F.concat("classes", F.array(
        line("accuracy", unknown, unknown, F.col("accuracy")),
        line("macro avg", *[F.col(f"macro_{c}") for c in scores]),
        line("weighted avg", *[F.col(f"weighted_{c}") for c in scores]),
    ))
    return summary.select(F.inline(lines)).select(
        "class", *[round_half_up(F.col(c), digits).alias(c) for c in scores], "support")
