"""Random forest on binned features, for any number of rows.

The method is that of Spark ML's forest: features are cut at ``max_bins``
quantiles (at every value where there are fewer), a tree sees each row as often
as a Poisson(1) draw says, a node looks at ``sqrt`` of the features and takes
the cut with the largest Gini gain, siblings that predict alike are merged, and
the trees' class shares are averaged.

A tree reads bins and classes only, so rows with the same bins are one *cell*
with a count for each class.  The rows are read once to count the cells; the
Poisson(1) draws of ``c`` equal rows add up to one Poisson(c) draw, so growing
on cells is the same bagging as growing on rows.  Cells do not grow with the
rows beyond the product of the bins: an alert's score and confidence are one
value, or the fixed confidence of the rules, which leaves some ten thousand.
Trees are grown, and walked, side by side as groups of a Spark job; rows get
the prediction of their cell by a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint_dir, ship_package

NODE_SCHEMA = "tree int, node int, feature int, bin int, left int, right int, share array<double>"
QUANTILE_ERROR = 1e-3


@dataclass
class Forest:
    labels: list[str]
    trees: int
    splits: dict[str, list[float]]   # feature -> inner bounds of its bins
    nodes: DataFrame                 # node table of all trees, stored


def find_splits(df: DataFrame, cols: list[str], max_bins: int) -> dict[str, list[float]]:
    """Ascending bounds between the bins of each column: midpoints where it has
    at most ``max_bins`` values, else quantiles.  A value that spans several
    quantiles gets a bin of its own."""
    seen = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
    small = [c for c in cols if seen[c] <= 2 * max_bins]
    values = df.agg(*[F.collect_set(c).alias(c) for c in small]).first() if small else {}
    out = {}
    for c in small:
        v = np.unique([x for x in values[c] if math.isfinite(x)])
        if len(v) <= max_bins:
            out[c] = ((v[:-1] + v[1:]) / 2).tolist()
    large = [c for c in cols if c not in out]
    if large:
        shares = [i / max_bins for i in range(1, max_bins)]
        for c, q in zip(large, df.approxQuantile(large, shares, QUANTILE_ERROR)):
            v, times = np.unique(q, return_counts=True)
            out[c] = np.unique([*v, *np.nextafter(v[times > 1], np.inf)]).tolist()
    return out


def binned(df: DataFrame, splits: dict[str, list[float]]) -> tuple[DataFrame, list[str]]:
    """``df`` with the bin of each split column, and their names."""
    cut = {c: s for c, s in splits.items() if s}
    if cut:
        df = Bucketizer(splitsArray=[[-math.inf, *s, math.inf] for s in cut.values()], inputCols=list(cut),
                        outputCols=[f"_b{c}" for c in cut], handleInvalid="keep").transform(df)
    return df.withColumns({f"_b{c}": F.col(f"_b{c}").cast("int") if c in cut else F.lit(0) for c in splits}), \
        [f"_b{c}" for c in splits]


def _gini(counts: np.ndarray) -> np.ndarray:
    """Rows x (1 - sum of squared shares): the impurity times the weight."""
    total = counts.sum(-1)
    return total - np.divide((counts ** 2).sum(-1), total, out=np.zeros_like(total), where=total > 0)


def _best_cuts(at: np.ndarray, bins: np.ndarray, weight: np.ndarray, looks: np.ndarray):
    """Best (gain, feature, bin) of each node; ``at`` is the node of a cell and
    ``looks`` says which features a node may use."""
    nodes, features = looks.shape
    totals = np.zeros((nodes, weight.shape[1]))
    np.add.at(totals, at, weight)
    whole = _gini(totals)
    gain, feature, cut = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, int)
    for f in range(features):
        own = np.flatnonzero(looks[at, f])
        if not len(own):
            continue
        width = int(bins[:, f].max()) + 1
        key = at[own] * width + bins[own, f]
        order = np.argsort(key, kind="stable")
        key, start = np.unique(key[order], return_index=True)
        sums = np.cumsum(np.add.reduceat(weight[own[order]], start), axis=0)
        node = key // width
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        before = np.vstack([np.zeros(weight.shape[1]), sums])[first]
        left = sums - np.repeat(before, np.diff(np.r_[first, len(node)]), axis=0)
        won = whole[node] - _gini(left) - _gini(totals[node] - left)
        won[np.r_[node[1:] != node[:-1], True]] = 0.0   # nothing is left on the right
        order = np.lexsort((key, -won, node))
        top = order[np.flatnonzero(np.r_[True, node[order][1:] != node[order][:-1]])]
        better = top[won[top] > gain[node[top]] + 1e-9]
        gain[node[better]], feature[node[better]], cut[node[better]] = won[better], f, key[better] % width
    return totals, feature, cut


def grow(cells: np.ndarray, counts: np.ndarray, tree: int, seed: int, max_depth: int) -> pd.DataFrame:
    """One tree over cells (rows of bins) with their class counts."""
    order = np.lexsort(cells.T)   # rows come in any order from a shuffle
    bins, rng = cells[order], np.random.default_rng([seed, tree])
    weight = rng.poisson(counts[order]).astype(float)
    drawn = weight.sum(1) > 0
    bins, weight = bins[drawn], weight[drawn]
    features = bins.shape[1]
    look = math.ceil(math.sqrt(features))
    at, levels, base = np.zeros(len(bins), int), [], 0
    size = 1
    while size:
        looks = rng.random((size, features)).argsort(1).argsort(1) < look
        if len(levels) == max_depth:
            looks[:] = False
        totals, feature, cut = _best_cuts(at, bins, weight, looks)
        inner = feature >= 0
        child = np.full(size, -1)
        child[inner] = base + size + 2 * np.arange(inner.sum())
        levels.append((base, totals, feature, cut, child))
        going = inner[at]
        at, bins, weight = at[going], bins[going], weight[going]
        right = bins[np.arange(len(at)), feature[at]] > cut[at]
        at = child[at] - base - size + right
        base, size = base + size, 2 * int(inner.sum())
    _merge_alike(levels)
    totals = np.vstack([v[1] for v in levels])
    feature, cut, child = (np.concatenate([v[i] for v in levels]) for i in (2, 3, 4))
    kept = _reached(feature, child)
    number = np.cumsum(kept) - 1
    inner = feature >= 0
    share = totals / np.maximum(totals.sum(1, keepdims=True), 1e-300)
    return pd.DataFrame({
        "tree": tree, "node": number, "feature": feature, "bin": cut,
        "left": np.where(inner, number[child], -1), "right": np.where(inner, number[np.minimum(child + 1, len(number) - 1)], -1),
        "share": [None if i else s.tolist() for i, s in zip(inner, share)]})[kept]


def _merge_alike(levels: list) -> None:
    """From the bottom: a node whose two children are leaves of one class
    becomes a leaf itself."""
    for upper, lower in zip(levels[-2::-1], levels[:0:-1]):
        base, totals, feature, _, _ = lower
        inner = np.flatnonzero(upper[2] >= 0)
        kids = upper[4][inner] - base
        alike = ((feature[kids] < 0) & (feature[kids + 1] < 0)
                 & (totals[kids].argmax(1) == totals[kids + 1].argmax(1)))
        upper[2][inner[alike]] = -1
        upper[4][inner[alike]] = -1


def _reached(feature: np.ndarray, child: np.ndarray) -> np.ndarray:
    kept = np.zeros(len(feature), bool)
    now = np.array([0])
    while len(now):
        kept[now] = True
        down = child[now[feature[now] >= 0]]
        now = np.concatenate([down, down + 1])
    return kept


def walk(nodes: pd.DataFrame, cells: np.ndarray) -> np.ndarray:
    """Class shares of the leaf that each cell reaches in one tree."""
    nodes = nodes.sort_values("node")
    feature, cut, left, right = (nodes[c].to_numpy() for c in ("feature", "bin", "left", "right"))
    at, moving = np.zeros(len(cells), int), np.arange(len(cells))
    while len(moving):
        moving = moving[feature[at[moving]] >= 0]
        here = at[moving]
        at[moving] = np.where(cells[moving, feature[here]] <= cut[here], left[here], right[here])
    leaves = np.flatnonzero(feature < 0)
    shares = np.zeros((len(nodes), len(nodes["share"].iloc[leaves[0]])))
    shares[leaves] = np.vstack(nodes["share"].iloc[leaves].to_list())
    return shares[at]


def _by_tree(cells: DataFrame, trees: int) -> DataFrame:
    """The cells once for each tree, a task a tree."""
    every = cells.sparkSession.range(trees).select(F.col("id").cast("int").alias("tree"))
    return cells.crossJoin(F.broadcast(every)).repartition(trees, "tree")


def fit_forest(rows: DataFrame, label: str, features: list[str], labels: list[str], trees: int,
               max_depth: int, max_bins: int, seed: int) -> Forest:
    """``rows`` (label, features as doubles without nulls) is read three times
    and should be stored."""
    spark = rows.sparkSession
    checkpoint_dir(spark)
    ship_package(spark)
    splits = find_splits(rows, features, max_bins)
    with_bins, bcols = binned(rows.select(label, *features), splits)
    ncols = [f"_n{i}" for i in range(len(labels))]
    cells = with_bins.groupBy(*bcols).agg(
        *[F.count_if(F.col(label) == name).alias(n) for name, n in zip(labels, ncols)]).checkpoint()

    def tree_of(pdf: pd.DataFrame) -> pd.DataFrame:
        return grow(pdf[bcols].to_numpy(), pdf[ncols].to_numpy(), int(pdf["tree"].iloc[0]), seed, max_depth)
    nodes = _by_tree(cells, trees).groupBy("tree").applyInPandas(tree_of, NODE_SCHEMA).checkpoint()
    return Forest(labels, trees, splits, nodes)


def predict(model: Forest, rows: DataFrame, label: str, share: str) -> DataFrame:
    """``rows`` with the predicted label and the mean share its class has in
    the trees.  A row's features go into its bins only; each combination of
    bins walks the trees once."""
    ship_package(rows.sparkSession)
    with_bins, bcols = binned(rows, model.splits)
    cells = with_bins.select(*bcols).distinct()

    def shares(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = walk(right, left[bcols].to_numpy()) if len(left) else []
        return left[bcols].assign(_share=pd.Series(list(found), left.index, dtype=object))
    each = _by_tree(cells, model.trees).groupBy("tree").cogroup(model.nodes.groupBy("tree")).applyInPandas(
        shares, ", ".join(f"`{c}` int" for c in bcols) + ", _share array<double>")
    mean = [F.sum(F.get("_share", F.lit(i))).alias(f"_p{i}") for i in range(len(model.labels))]
    sums = F.array(*[F.col(f"_p{i}") for i in range(len(model.labels))])
    best = F.array_max("_sums")
    told = each.groupBy(*bcols).agg(*mean).withColumn("_sums", sums).select(
        *bcols, (best / model.trees).alias(share),
        F.get(F.array(*[F.lit(x) for x in model.labels]), F.array_position("_sums", best) - 1).alias(label))
    return with_bins.join(told, bcols, "left").drop(*bcols)
