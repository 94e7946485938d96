"""Rule-based evaluation.

The confusion counts are one ``groupBy(true, pred)`` (at most 25 groups);
metrics are computed from that 25-row table, never from the rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..functions import scoring as S


def label_rows(df: DataFrame) -> DataFrame:
    """F42 + F43: ``reference_label`` and clamped ``predicted_label``."""
    return df.withColumns({"reference_label": S.eval_reference_label(),
                           "predicted_label": S.eval_clamp_label("attack_type")})


def _labels(spark, name: str) -> DataFrame:
    return spark.createDataFrame([(i, l) for i, l in enumerate(C.EVAL_LABELS)],
                                 f"{name}_idx int, {name} string")


def confusion_matrix(df: DataFrame) -> DataFrame:
    """The full 5 x 5 grid (true x predicted) with zero cells."""
    spark = df.sparkSession
    counts = (label_rows(df).groupBy(F.col("reference_label").alias("true_label"),
                                     F.col("predicted_label"))
                            .agg(F.count(F.lit(1)).alias("count")))
    t = _labels(spark, "true_label")
    p = _labels(spark, "predicted_label")
    grid = (t.withColumn("_k", F.lit(1)).join(p.withColumn("_k", F.lit(1)), "_k").drop("_k"))
    return (grid.join(counts, ["true_label", "predicted_label"], "left")
                .select("true_label_idx", "true_label", "predicted_label_idx", "predicted_label",
                        F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def top_confusions(df: DataFrame, k: int = C.CONFUSION_TOP_K) -> DataFrame:
    """Largest off-diagonal cells (ties in label order)."""
    m = confusion_matrix(df)
    return (m.where((F.col("true_label") != F.col("predicted_label")) & (F.col("count") > 0))
             .orderBy(F.desc("count"), "true_label_idx", "predicted_label_idx").limit(k)
             .select("true_label", "predicted_label", "count"))


def metrics_from_matrix(m: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision/recall/F1 (zero division
    gives 0), rounded to 4 places, from the confusion grid."""
    tp = m.where(F.col("true_label") == F.col("predicted_label")).select(
        F.col("true_label").alias("label"), F.col("count").alias("tp"))
    support = m.groupBy(F.col("true_label").alias("label")).agg(F.sum("count").alias("support"))
    predicted = m.groupBy(F.col("predicted_label").alias("label")).agg(
        F.sum("count").alias("predicted"))
    per = tp.join(support, "label").join(predicted, "label")
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.withColumns({"p": prec, "r": rec})
    per = per.withColumn("f", F.when(F.col("p") + F.col("r") > 0,
                                     2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")))
                         .otherwise(0.0))
    n = F.sum("support")

    def wavg(c):
        return F.when(n > 0, F.sum(F.col(c) * F.col("support")) / n).otherwise(0.0)
    return per.agg(
        F.round(F.when(n > 0, F.sum("tp") / n).otherwise(0.0), 4).alias("accuracy"),
        F.round(wavg("p"), 4).alias("precision_weighted"),
        F.round(wavg("r"), 4).alias("recall_weighted"),
        F.round(wavg("f"), 4).alias("f1_weighted"),
        n.cast("bigint").alias("support"))


def evaluate_predictions(df: DataFrame) -> DataFrame:
    return metrics_from_matrix(confusion_matrix(df))
