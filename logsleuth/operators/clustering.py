"""Campaign clustering.

Both algorithms are fitted on the standardised alert features after collapsing
identical feature vectors into one weighted point (hour and severity are
discrete, so alerts repeat a lot): K-Means moves all its starts in one pass over
them and labels rows by a narrow ``transform``; DBSCAN uses the weights as neighbour
counts and joins labels back on the feature values as read.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..session import checkpoint_dir, ship_package
from .density import dbscan
from .lloyd import multi_start
from .scaling import column_stats, standardise


def cluster_feature_columns(df: DataFrame) -> list[str]:
    """The primary list if any is present, else the network list."""
    cols = [c for c in C.CLUSTER_FEATURES if c in df.columns]
    return cols or [c for c in C.CLUSTER_FEATURES_NET if c in df.columns]


def _numbers(alerts: DataFrame, cols: list[str]):
    """(alerts with helper columns of doubles, their names, one row of their mean and sd)."""
    xcols = [f"_x_{c}" for c in cols]
    num = alerts.withColumns({x: F.coalesce(F.col(c).cast("string").try_cast("double"),
                                            F.lit(0.0)) for x, c in zip(xcols, cols)})
    checkpoint_dir(alerts.sparkSession)
    return num, xcols, column_stats(num, xcols).checkpoint()


def _points(num: DataFrame, xcols: list[str], stats: DataFrame, order: list[str]):
    """Weighted distinct feature vectors, as read and standardised, with the
    first row that has each."""
    okey = F.struct(*[F.col(c) for c in order]) if order else F.lit(0)
    pts = num.groupBy(*xcols).agg(F.count(F.lit(1)).cast("double").alias("weight"), F.min(okey).alias("_first"))
    return standardise(pts, xcols, prefix="_z", stats=stats), [f"_z{x}" for x in xcols]


def _order_cols(df: DataFrame) -> list[str]:
    return [c for c in ("log_type", "row_id") if c in df.columns]


def fit_kmeans(alerts: DataFrame, k: int = C.KMEANS_N_CLUSTERS, n_init: int = C.KMEANS_N_INIT,
               seed: int = C.RANDOM_SEED, max_iter: int = 300) -> PipelineModel:
    """M5: the best of ``n_init`` starts by cost, see ``lloyd``, as a stored
    statement over the feature columns that gives the label ``_lbl``.  Clusters
    are numbered by sorted centroid."""
    cols = cluster_feature_columns(alerts)
    num, xcols, stats = _numbers(alerts, cols)
    pts, zc = _points(num, xcols, stats, _order_cols(alerts))
    pts = pts.select(*zc, "weight").checkpoint()
    ship_package(alerts.sparkSession)
    centres, _ = multi_start(pts, zc, k, n_init, seed, max_iter)
    row = stats.first()
    z = [f"((coalesce(try_cast(CAST(`{c}` AS STRING) AS DOUBLE), 0D) - ({float(row[f'_mean_{x}'] or 0)!r}D))"
         f" / {float(row[f'_sd_{x}'] or 1)!r}D)" for c, x in zip(cols, xcols)]
    far = [" + ".join(f"power({v} - ({m!r}D), 2)" for v, m in zip(z, centre)) for centre in centres.tolist()]
    far = ", ".join(far) or "0D"
    statement = (f"SELECT * EXCEPT (_far), cast(array_position(_far, array_min(_far)) - 1 AS int) AS _lbl "
                 f"FROM (SELECT *, array({far}) AS _far FROM __THIS__)")
    return PipelineModel(stages=[SQLTransformer(statement=statement)])


def assign_kmeans(model: PipelineModel, alerts: DataFrame, out: str = "cluster_kmeans") -> DataFrame:
    """Labels of a fitted (or loaded) model for any alerts: a narrow projection."""
    return model.transform(alerts).select(*[F.col(f"`{c}`") for c in alerts.columns], F.col("_lbl").alias(out))


def kmeans_labels(alerts: DataFrame, k: int = C.KMEANS_N_CLUSTERS, out: str = "cluster_kmeans", **kw) -> DataFrame:
    """M5: k = min(k, n) clusters.  Fewer than ``CLUSTER_MIN_ROWS`` alerts:
    every row gets cluster 0 (a rule of the operator)."""
    n = alerts.count()
    if n < C.CLUSTER_MIN_ROWS:
        return alerts.withColumn(out, F.lit(0))
    return assign_kmeans(fit_kmeans(alerts, min(k, n), **kw), alerts, out)


def dbscan_labels(alerts: DataFrame, eps: float = C.DBSCAN_EPS,
                  min_samples: int = C.DBSCAN_MIN_SAMPLES, out: str = "cluster_dbscan") -> DataFrame:
    """M6: DBSCAN on the standardised features, see ``density``.  Clusters are
    numbered by their earliest core row; border points take the smallest
    adjacent cluster; noise is -1."""
    n = alerts.count()
    if n < C.CLUSTER_MIN_ROWS:
        return alerts.withColumn(out, F.lit(0))
    cols = cluster_feature_columns(alerts)
    num, xcols, stats = _numbers(alerts, cols)
    pts, zc = _points(num, xcols, stats, _order_cols(alerts))
    # ids are given once: the checkpoint fixes them
    pts = pts.withColumnRenamed("_first", "first").withColumn("pid", F.monotonically_increasing_id()).checkpoint()
    lab = pts.select("pid", *xcols).join(dbscan(pts, zc, eps, min_samples), "pid").select(
        *xcols, F.col("label").cast("int").alias(out))
    # joined on the values as read, not on computed ones
    return num.join(lab, xcols, "left").drop(*xcols)


def fit_predict(alerts: DataFrame, **kw) -> DataFrame:
    """Both label columns, as the clustering stage of the intel job adds them."""
    n = alerts.count()
    if n < C.CLUSTER_MIN_ROWS:
        return alerts.withColumns({"cluster_kmeans": F.lit(0), "cluster_dbscan": F.lit(0)})
    return dbscan_labels(kmeans_labels(alerts, **kw))
