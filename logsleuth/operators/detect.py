"""Anomaly ensemble (M3, M4): two detectors, scaled over the batch, combined.

``fit_detector`` standardises the feature columns (A17), grows the isolation
forest (M1) and fits the one-class model (M2) on a stored table that holds the
features only.  ``raw_scores`` adds both raw scores by one vectorised function
of the feature columns; ``combine_scores`` applies A16 and the weighted
threshold (M3) to stored scores, over the batch or over a frozen range.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..session import checkpoint_dir, ship_package, stored
from . import iforest as IF, ocsvm as OC
from .scaling import column_range, column_stats, minmax, standardise

RAW = ("iforest_raw", "ocsvm_raw")


def combine_scores(df: DataFrame, raw_if: str = RAW[0], raw_oc: str = RAW[1],
                   threshold: float = C.ANOMALY_SCORE_THRESHOLD, fit: DataFrame | None = None) -> DataFrame:
    """M3: min-max both raw scores, 0.65/0.35 blend, threshold.

    ``fit`` (see ``scaling.column_range``) freezes the range; by default it is
    that of the batch."""
    df = minmax(df, {raw_if: "iforest_score", raw_oc: "ocsvm_score"}, fit=fit)
    score = (F.lit(C.ENSEMBLE_WEIGHT_IFOREST) * F.col("iforest_score")
             + F.lit(C.ENSEMBLE_WEIGHT_OCSVM) * F.col("ocsvm_score"))
    return df.withColumn("anomaly_score", score).withColumn(
        "is_anomaly", (F.col("anomaly_score") >= threshold).cast("int"))


@dataclass
class Detector:
    name: str
    features: list[str]
    stats: DataFrame          # one row: feature means and population sds
    forest: DataFrame         # node table of the isolation forest
    ocsvm: DataFrame          # one row: weights over random Fourier features
    range: DataFrame | None = None  # one row: raw score range of the batch it was fitted on


def fit_detector(df: DataFrame, features: list[str], name: str = "detector",
                 n_trees: int = C.IFOREST_N_ESTIMATORS, seed: int = C.RANDOM_SEED) -> Detector:
    """M4: fit one detector on a feature frame (``row_id`` identifies rows),
    which is read twice and should be stored; the standardised columns, which
    the fits read many times, are stored here."""
    checkpoint_dir(df.sparkSession)
    stats = column_stats(df, features).checkpoint()
    zcols = [f"z_{c}" for c in features]
    z = stored(standardise(df.select("row_id", *features), features, "z_", stats).select("row_id", *zcols), "detector-features")
    forest = IF.fit_forest(z, zcols, n_trees=n_trees, seed=seed).checkpoint()
    return Detector(name, features, stats, forest, OC.fit_ocsvm(z, zcols, seed=seed).checkpoint())


def raw_scores(det: Detector, df: DataFrame) -> DataFrame:
    """``df`` with both raw scores (higher = more anomalous), in one evaluation
    that takes the standardised feature columns alone into Python."""
    ship_package(df.sparkSession)
    forest, linear = IF.model_of(df.sparkSession, det.forest), OC.model_of(det.ocsvm)

    @F.pandas_udf(f"{RAW[0]} double, {RAW[1]} double")
    def score(x: pd.DataFrame) -> pd.DataFrame:
        values = x.to_numpy(dtype=float)
        return pd.DataFrame({RAW[0]: IF.raw_score(values, forest), RAW[1]: OC.raw_score(values, linear)})
    zcols = [f"z_{c}" for c in det.features]
    z = standardise(df, det.features, "z_", det.stats).withColumn("_raw", score(F.struct(*zcols)))
    return z.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_raw.{r}").alias(r) for r in RAW])


def score_detector(det: Detector, df: DataFrame, frozen: bool = False) -> DataFrame:
    """Scores of a batch, over its own range or (``frozen``) that of the fit."""
    checkpoint_dir(df.sparkSession)
    scored = stored(raw_scores(det, df), "raw-scores")
    return combine_scores(scored, fit=det.range if frozen else None)


def detect(df: DataFrame, features: list[str], name: str = "detector", **kw) -> tuple[DataFrame, Detector]:
    """Fit on the batch and score the same batch (what the detection job does):
    the scored rows, and the detector with the batch's range."""
    det = fit_detector(df, features, name, **kw)
    scored = stored(raw_scores(det, df), "raw-scores")
    det.range = column_range(scored, list(RAW)).checkpoint()
    return combine_scores(scored, fit=det.range), det
