"""DBSCAN over units against comparing all points."""

import numpy as np
import pytest

from logsleuth.operators import density
from tests.test_models import _brute_dbscan


def _run(spark, X, w, first, eps, least):
    d = X.shape[1]
    rows = [(i, float(w[i]), int(first[i]), *map(float, x)) for i, x in enumerate(X)]
    df = spark.createDataFrame(rows, "pid long, weight double, first long, " + ", ".join(f"x{i} double" for i in range(d))).checkpoint()
    got = {r["pid"]: r["label"] for r in density.dbscan(df, [f"x{i}" for i in range(d)], eps, least).collect()}
    return np.array([got[i] for i in range(len(X))])


def _clouds(rng, n, d, kind):
    if kind == "blobs":
        X = rng.normal(rng.choice([0, 2, 5], (n, 1)), 0.6, (n, d))
    elif kind == "grid":         # many distances of exactly eps
        X = rng.integers(-6, 7, (n, d)) / 2.0
    elif kind == "sheets":       # dense cells just nearer and just farther than eps
        X = rng.uniform(0, 0.05, (n, d))
        X[:, 0] += rng.choice([0, 0.51, 1.04, 1.56, 4.0], n)
    else:                        # one crowded cell with a halo
        X = np.concatenate([rng.uniform(0, 0.1, (n - n // 6, d)), rng.uniform(-1.5, 1.5, (n // 6, d))])
    return np.unique(np.round(X, 3), axis=0)


@pytest.mark.parametrize("kind", ["blobs", "grid", "sheets", "crowd"])
@pytest.mark.parametrize("d", [2, 3])
def test_equals_brute_force(spark, kind, d):
    from logsleuth.session import checkpoint_dir
    checkpoint_dir(spark)
    rng = np.random.default_rng(hash((len(kind), d)) % 1000)
    X = _clouds(rng, 500, d, kind)
    w = rng.choice([1.0, 1.0, 2.0, 6.0], len(X))
    first = rng.permutation(len(X))
    want = _brute_dbscan(X, w, first, 0.5, 5)
    assert (_run(spark, X, w, first, 0.5, 5) == want).all()


def test_pairs_of_boxes_stay_few_between_crowded_cells(spark):
    """Two cells of 4,000 points each, nearer than eps in one corner only: the
    rounds look at a small part of the 16 million pairs."""
    from logsleuth.session import checkpoint_dir
    checkpoint_dir(spark)
    rng = np.random.default_rng(6)
    X = np.unique(np.concatenate([rng.uniform(0, 0.3, (4000, 2)), rng.uniform(0, 0.3, (4000, 2)) + [0.66, 0.36]]), axis=0)
    rows = [(i, 1.0, i, *map(float, x)) for i, x in enumerate(X)]
    df = spark.createDataFrame(rows, "pid long, weight double, first long, x0 double, x1 double").checkpoint()
    units = density._Units(df, ["x0", "x1"], 0.5, 5)
    looked = []
    halved = units._halved
    units._halved = lambda *a: (lambda out: (looked.append(out.count()), out)[1])(halved(*a))
    pairs, _ = units.adjacent()
    near = ((X[:4000, None, :] - X[None, 4000:, :]) ** 2).sum(-1) <= 0.25
    assert near.any() and (pairs.count() > 0) and sum(looked) < 400_000, looked
