"""Attack-type classifier.

Labels are indexed alphabetically (like a label encoder), a 100-tree random
forest (``sqrt`` feature subsets, seed 42, see ``forest``) is trained on a
stratified 80 % split and applied to every alert.  With fewer than 10 alerts, or a class with a
single alert (a stratified split cannot place it), the step is skipped and
the alerts come back unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import constants as C
from ..session import checkpoint_dir
from . import forest as FO
from .clustering import cluster_feature_columns

SLICE_BITS = 12   # hash ranges in which the rows of a class are ranked


def _prepared(alerts: DataFrame):
    cols = cluster_feature_columns(alerts)
    df = alerts.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("string").try_cast("double"),
                                                   F.lit(0.0)) for c in cols})
    return df, [f"_f_{c}" for c in cols]


def split_column(df: DataFrame, seed: int = C.RANDOM_SEED,
                 test_fraction: float = C.CLASSIFIER_TEST_FRACTION) -> DataFrame:
    """``df`` with ``_test``, true for ``test_fraction`` of the rows of every
    class (rounded half up, one row at least stays for training).

    Rows are ranked by a seeded hash inside their class, by ``2 ** SLICE_BITS`` ranges
    of the hash: the ranges of a class are ranked one by one and added up, so
    a class is spread over many tasks however many rows it has."""
    keys = [F.col(c) for c in ("log_type", "row_id") if c in df.columns] or [F.struct(*df.columns)]
    u = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 1)
    marked = df.withColumns({"_u": u, "_slice": F.shiftrightunsigned(u, 63 - SLICE_BITS)})
    sizes = marked.groupBy("attack_type", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy("attack_type")
    upto = every.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_n").over(every)
    take = F.least(F.floor(total * test_fraction + 0.5), total - 1)
    sizes = sizes.select(F.col("attack_type").alias("_class"), F.col("_slice").alias("_at"),
                         (take - F.coalesce(F.sum("_n").over(upto), F.lit(0))).alias("_take"))
    own = Window.partitionBy("attack_type", "_slice").orderBy("_u", *keys)
    ranked = marked.withColumn("_rank", F.row_number().over(own))
    return ranked.join(sizes, F.col("attack_type").eqNullSafe(F.col("_class")) & (F.col("_slice") == F.col("_at"))
                       ).withColumn("_test", F.col("_rank") <= F.col("_take")).drop(
        "_u", "_slice", "_rank", "_class", "_at", "_take")


def fit_classifier(alerts: DataFrame, seed: int = C.RANDOM_SEED, trees: int = C.CLASSIFIER_TREES,
                   max_depth: int = 30, max_bins: int = 64):
    """Fitted forest, or ``None`` when the step must be skipped: fewer
    than ``CLASSIFIER_MIN_ROWS`` alerts, or a class with one alert.  Trees grow
    to ``max_depth``; ``max_bins`` is the number of split candidates a feature."""
    if "attack_type" not in alerts.columns:
        raise ValueError("alerts must have an 'attack_type' column for training.")
    alerts = alerts.where(F.col("attack_type").isNotNull())
    counts = alerts.groupBy("attack_type").count().collect()   # one row per class
    n = sum(r["count"] for r in counts)
    if n < C.CLASSIFIER_MIN_ROWS or (len(counts) > 1 and min(r["count"] for r in counts) < 2):
        return None
    df, fcols = _prepared(alerts)
    checkpoint_dir(alerts.sparkSession)
    train = split_column(df, seed).where(~F.col("_test")).select("attack_type", *fcols).checkpoint()
    labels = sorted((r["attack_type"] for r in counts), key=lambda t: t.encode())
    return FO.fit_forest(train, "attack_type", fcols, labels, trees, max_depth, max_bins, seed)


def predict(model, alerts: DataFrame) -> DataFrame:
    """M8: ``predicted_attack_type`` and ``classification_confidence``.  The
    true type is not looked at, so rows without one are predicted too."""
    if model is None:
        return alerts
    scored = FO.predict(model, _prepared(alerts)[0], "predicted_attack_type", "_conf")
    return scored.withColumn("classification_confidence", F.rint(F.col("_conf") * 100 * 10) / 10).select(
        *alerts.columns, "predicted_attack_type", "classification_confidence")


def holdout_metrics(pairs: DataFrame) -> DataFrame:
    """A15 on (y, p): precision, recall, F1 and support of every label that
    occurs as truth or as prediction."""
    both = pairs.select(F.col("y").alias("label"), F.lit(1).alias("s"), F.lit(0).alias("p"),
                        (F.col("y") == F.col("p")).cast("int").alias("t")).union(
        pairs.select("p", F.lit(0), F.lit(1), F.lit(0)))
    per = both.groupBy("label").agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("t").alias("tp"))

    def share(of: str):
        return F.when(F.col(of) > 0, F.col("tp") / F.col(of)).otherwise(0.0)
    per = per.withColumns({"precision": share("predicted"), "recall": share("support")})
    f1 = F.when(F.col("tp") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return per.withColumn("f1_score", F.coalesce(f1, F.lit(0.0))).select(
        "label", "precision", "recall", "f1_score", "support")


def holdout_report(model, alerts: DataFrame) -> DataFrame:
    """Per-class precision / recall / F1 / support on the held-out split."""
    test = split_column(alerts.where(F.col("attack_type").isNotNull())).where(F.col("_test")).drop("_test")
    return holdout_metrics(predict(model, test).select(F.col("attack_type").alias("y"),
                                                      F.col("predicted_attack_type").alias("p")))


def classify(alerts: DataFrame, **kw) -> DataFrame:
    return predict(fit_classifier(alerts, **kw), alerts)
