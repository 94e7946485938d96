"""One-class kernel model (M2): one-class SVM on random Fourier features.

The RBF kernel is approximated by ``FEATURES`` random cosines (Rahimi and
Recht, 2007), which turns the one-class SVM of Schoelkopf et al. (2001) into a
linear problem over all rows:

    min |w|^2 / 2   over   w = sum a_i f(x_i),  0 <= a_i <= 1 / (nu n),  sum a = 1.

It is solved by Frank-Wolfe steps with exact line search.  The best vertex for
the current ``w`` is the mean of the ``nu`` share of rows with the smallest
``w . f(x)``, so a step is one pass: tasks sum the feature vectors by score
range (``BINS`` ranges, a fixed size whatever the input), the sums are added by
a Spark aggregate, and the lowest ranges that hold the ``nu`` share give the
step.  Every row takes part in every step; no row leaves its task.

The raw score is ``rho - w . f(x)`` (higher = more anomalous), ``rho`` being
the ``nu`` quantile.  Only its order matters downstream, where the ensemble
scales it over the batch.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..session import ship_package

FEATURES = 64
STEPS = 20
BINS = 256
TOLERANCE = 1e-3
MODEL_SCHEMA = "gamma double, rho double, w array<double>, seed int, n_features int"


def cosines(x: np.ndarray, gamma: float, seed: int, n: int = FEATURES) -> np.ndarray:
    """Random Fourier features of the rows of ``x`` for exp(-gamma |x - y|^2)."""
    rng = np.random.default_rng(seed)
    freq = rng.normal(0.0, math.sqrt(2.0 * gamma), (x.shape[1], n))
    shift = rng.uniform(0.0, 2.0 * math.pi, n)
    return np.cos(x @ freq + shift) * math.sqrt(2.0 / n)


def kernel_width(z: DataFrame, zcols: list[str]) -> float:
    """gamma = 1 / (columns x variance of all entries)."""
    each = F.array(*[F.col(c) for c in zcols])
    total = z.select(F.explode(each).alias("v")).agg(F.var_pop("v")).first()[0]
    return 1.0 / (len(zcols) * total) if total else 1.0


def _pass(z: DataFrame, zcols: list[str], gamma: float, seed: int, w: np.ndarray, low: float, high: float):
    """Rows and feature sums by range of ``w . f(x)`` between ``low`` and
    ``high``; the outer ranges take what lies beyond.  (n, sums) by range."""
    def sums(batches):
        count, total = np.zeros(BINS), np.zeros((BINS, FEATURES))
        for b in batches:
            f = cosines(b.to_numpy(dtype=float), gamma, seed)
            at = np.clip((f @ w - low) * (BINS / (high - low)), 0, BINS - 1).astype(int)
            count += np.bincount(at, minlength=BINS)
            total += np.bincount((at[:, None] * FEATURES + np.arange(FEATURES)).ravel(), f.ravel(),
                                 BINS * FEATURES).reshape(BINS, FEATURES)
        full = np.flatnonzero(count)
        if len(full):   # a task without rows has no lists to tell their type by
            yield pd.DataFrame({"bin": full, "n": count[full], "f": [total[i].tolist() for i in full]})
    parts = z.select(*zcols).mapInPandas(sums, "bin long, n double, f array<double>")
    rows = parts.groupBy("bin").agg(
        F.sum("n").alias("n"), *[F.sum(F.get("f", F.lit(i))).alias(f"f{i}") for i in range(FEATURES)])
    count, total = np.zeros(BINS), np.zeros((BINS, FEATURES))
    for r in rows.collect():  # at most BINS rows
        count[r["bin"]] = r["n"]
        total[r["bin"]] = [r[f"f{i}"] for i in range(FEATURES)]
    return count, total


def _lowest(count: np.ndarray, total: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """Mean feature vector of the ``share`` rows with the smallest scores (the
    range that is reached in part counts by that part), and how many ranges
    that takes."""
    before = np.concatenate([[0.0], np.cumsum(count)[:-1]])
    part = np.divide(np.clip(share - before, 0.0, count), count, out=np.zeros(BINS), where=count > 0)
    return part @ total / share, float(part.sum() + ((count == 0) & (before < share)).sum())


def fit_ocsvm(z: DataFrame, zcols: list[str], nu: float = C.OCSVM_NU, steps: int = STEPS,
              seed: int = C.RANDOM_SEED) -> DataFrame:
    """One row: gamma, rho, weights and what the features are drawn from.
    ``z`` is read once a step and should be stored.

    A step moves every score by a known amount at most, so the score ranges of
    the next pass are laid around the last quantile and grow finer."""
    spark = z.sparkSession
    ship_package(spark)
    gamma = kernel_width(z, zcols)
    count, total = _pass(z, zcols, gamma, seed, np.zeros(FEATURES), -1.0, 1.0)
    n = count.sum()
    if not n:
        return spark.createDataFrame([], MODEL_SCHEMA)
    w = total.sum(0) / n
    reach = math.sqrt(2.0)   # the length of a feature vector is at most this
    low, high = -reach * float(np.linalg.norm(w)), reach * float(np.linalg.norm(w))
    rho = 0.0
    for step in range(steps + 1):
        count, total = _pass(z, zcols, gamma, seed, w, low, max(high, low + 1e-12))
        vertex, ranges = _lowest(count, total, nu * n)
        rho = low + (high - low) * ranges / BINS
        move = w - vertex
        gap = float(w @ move)
        if step == steps or gap <= TOLERANCE * float(w @ w):
            break
        pace = min(1.0, gap / float(move @ move))
        w = w - pace * move
        shift = pace * float(np.linalg.norm(move)) * reach + (high - low) / BINS
        low, high = rho - shift, rho + shift
    model = [(gamma, rho, [float(x) for x in w], int(seed), FEATURES)]
    return spark.createDataFrame(model, MODEL_SCHEMA)


def model_of(table: DataFrame) -> dict | None:
    """The one row of a fitted model as plain values, or None if it is empty."""
    row = table.first()
    return None if row is None else json.loads(json.dumps(row.asDict()))


def raw_score(x: np.ndarray, model: dict | None) -> np.ndarray:
    if model is None:
        return np.zeros(len(x))
    f = cosines(x, model["gamma"], model["seed"], model["n_features"])
    return model["rho"] - f @ np.asarray(model["w"])


def score_ocsvm(z: DataFrame, model: DataFrame, zcols: list[str], out: str = "ocsvm_raw") -> DataFrame:
    """Add the raw score; only the feature columns go to Python."""
    ship_package(z.sparkSession)
    fitted = model_of(model)

    @F.pandas_udf("double")
    def score(x: pd.DataFrame) -> pd.Series:
        return pd.Series(raw_score(x.to_numpy(dtype=float), fitted))
    return z.withColumn(out, score(F.struct(*zcols)))
