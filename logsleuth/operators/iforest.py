"""Isolation forest (M1), Liu, Ting & Zhou (2008), as Spark jobs.

fit
    1. Each tree needs ``psi = min(256, n)`` rows drawn without replacement.
       Row ``r`` gets a uniform key ``u(r, t) = hash(r, seed, t)`` per tree and
       tree ``t`` takes the ``psi`` smallest keys.  Only rows that pass a cheap
       one-hash pre-filter (expected ``8 * psi`` per tree) are expanded per
       tree, so the full table is read once and never multiplied.
    2. ``groupBy(tree).applyInPandas`` grows each tree on its <= 256 rows:
       random non-constant feature, uniform split in (min, max), height limit
       ``ceil(log2(psi))``.  Output: a node table with at most
       ``n_trees * (2 * psi - 1)`` rows (51,100 for 100 trees) - a fixed bound.
score
    The node table is shipped to executors as a broadcast variable and a
    pandas function of the feature columns walks all trees for a whole Arrow
    batch at once; the raw score is ``2 ** (-mean path length / c(psi))`` (higher = more
    anomalous), i.e. the negated ``score_samples`` of the usual formulation.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .. import constants as C
from ..session import ship_package

# ``max_samples`` rows a tree (256, the sub-sample size of the published
# method) is a parameter of the method, not a limit on the input.
NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "size int, depth int")
EULER_GAMMA = 0.5772156649015329


def avg_path_length(n) -> np.ndarray:
    """c(n): average path length of an unsuccessful BST search."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _grow(pdf: pd.DataFrame, zcols: list[str], seed: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    X = pdf[zcols].to_numpy(dtype=float)
    psi = len(X)
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    rng = np.random.default_rng([seed, tree])
    rows = []
    stack = [(0, np.arange(psi), 0)]
    next_id = 1
    while stack:
        node, idx, depth = stack.pop()
        sub = X[idx]
        lo, hi = (sub.min(axis=0), sub.max(axis=0)) if len(idx) else (None, None)
        usable = np.flatnonzero(hi > lo) if len(idx) > 1 else np.array([], dtype=int)
        if depth >= max_depth or len(idx) < 2 or len(usable) == 0:
            rows.append((tree, node, -1, 0.0, -1, -1, len(idx), depth))
            continue
        f = int(rng.choice(usable))
        thr = float(rng.uniform(lo[f], hi[f]))
        if thr >= hi[f]:  # keep both sides non-empty
            thr = float(np.nextafter(hi[f], lo[f]))
        left_mask = sub[:, f] <= thr
        l_id, r_id = next_id, next_id + 1
        next_id += 2
        rows.append((tree, node, f, thr, l_id, r_id, len(idx), depth))
        stack.append((r_id, idx[~left_mask], depth + 1))
        stack.append((l_id, idx[left_mask], depth + 1))
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right",
                                       "size", "depth"])


def tree_samples(z: DataFrame, zcols: list[str], n_trees: int, psi: int, n: int,
                 seed: int, key: str = "row_id") -> DataFrame:
    """(tree, zcols...) with ``psi`` rows per tree drawn without replacement."""
    per_tree = min(1.0, 8.0 * psi / max(n, 1))
    any_tree = min(1.0, per_tree * n_trees)
    u0 = (F.abs(F.xxhash64(F.col(key), F.lit(seed))) % 1_000_000_007) / 1_000_000_007.0
    cand = z.select(key, *zcols).where(u0 < any_tree)
    t = F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree")
    u = (F.abs(F.xxhash64(F.col(key), F.lit(seed), F.col("tree"))) % 1_000_000_007) / 1_000_000_007.0
    cond = per_tree / any_tree if any_tree > 0 else 1.0
    picked = cand.select("*", t).withColumn("_u", u).where(F.col("_u") < cond)
    w = Window.partitionBy("tree").orderBy("_u", key)
    return (picked.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= psi)
                  .select("tree", *zcols))


def fit_forest(z: DataFrame, zcols: list[str], n_trees: int = C.IFOREST_N_ESTIMATORS,
               max_samples: int = C.IFOREST_MAX_SAMPLES, seed: int = C.RANDOM_SEED,
               key: str = "row_id") -> DataFrame:
    """Node table of a fitted forest (tree, node, feature, threshold, ...)."""
    ship_package(z.sparkSession)
    n = z.count()
    psi = max(1, min(max_samples, n))
    sample = tree_samples(z, zcols, n_trees, psi, n, seed, key)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        return _grow(pdf, zcols, seed)
    return sample.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).withColumn(
        "psi", F.lit(psi))


def _pack(nodes: pd.DataFrame):
    """Dense per-tree arrays for vectorised traversal: feature, threshold, both
    children (right, left) side by side, height, and the depth of each tree.  A
    leaf is its own child, so a walk needs no test for it."""
    n_trees = int(nodes["tree"].max()) + 1
    width = int(nodes["node"].max()) + 1
    feat = np.zeros((n_trees, width), dtype=np.int64)
    thr = np.zeros((n_trees, width))
    child = np.zeros((n_trees, 2 * width), dtype=np.int64)
    leaf_h = np.zeros((n_trees, width))
    deep = np.zeros(n_trees, dtype=np.int64)
    t, nd, f = nodes["tree"].to_numpy(), nodes["node"].to_numpy(), nodes["feature"].to_numpy()
    feat[t, nd] = np.maximum(f, 0)
    thr[t, nd] = nodes["threshold"].to_numpy()
    child[t, 2 * nd] = np.where(f < 0, nd, nodes["right"].to_numpy())
    child[t, 2 * nd + 1] = np.where(f < 0, nd, nodes["left"].to_numpy())
    leaf_h[t, nd] = nodes["depth"].to_numpy() + avg_path_length(nodes["size"].to_numpy())
    np.maximum.at(deep, t, nodes["depth"].to_numpy())
    return feat, thr, child, leaf_h, deep


def path_lengths(X: np.ndarray, packed) -> np.ndarray:
    """Mean path length over all trees for every row of ``X``."""
    feat, thr, child, leaf_h, deep = packed
    n_trees = feat.shape[0]
    values = np.ascontiguousarray(X, dtype=float).ravel()
    first = np.arange(len(X)) * X.shape[1]
    total = np.zeros(len(X))
    for t in range(n_trees):
        node = np.zeros(len(X), dtype=np.int64)
        for _ in range(deep[t]):
            node = child[t].take(2 * node + (values.take(first + feat[t].take(node)) <= thr[t].take(node)))
        total += leaf_h[t].take(node)
    return total / n_trees


def model_of(spark, nodes: DataFrame):
    """The fitted forest as a broadcast of packed arrays and c(psi); the node
    table has at most n_trees * (2 * psi - 1) rows.  None for an empty one."""
    pdf = nodes.toPandas()
    if not len(pdf):
        return None
    psi = int(pdf["psi"].iloc[0])
    return spark.sparkContext.broadcast(_pack(pdf)), float(avg_path_length(np.array([psi]))[0]) or 1.0


def raw_score(x: np.ndarray, model) -> np.ndarray:
    """2 ** (-E[h(x)] / c(psi)) of each row; higher is more anomalous."""
    if model is None or not len(x):
        return np.zeros(len(x))
    packed, denom = model
    return np.power(2.0, -path_lengths(x, packed.value) / denom)


def score_forest(z: DataFrame, nodes: DataFrame, zcols: list[str], out: str = "iforest_raw") -> DataFrame:
    """Add the raw score; only the feature columns go to Python."""
    ship_package(z.sparkSession)
    model = model_of(z.sparkSession, nodes)

    @F.pandas_udf("double")
    def score(x: pd.DataFrame) -> pd.Series:
        return pd.Series(raw_score(x.to_numpy(dtype=float), model))
    return z.withColumn(out, score(F.struct(*zcols)))
