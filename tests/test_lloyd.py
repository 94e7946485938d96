"""Multi-start K-Means against Spark ML and on small inputs."""

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler

from logsleuth.operators.lloyd import multi_start


def _points(spark, x, w):
    return spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, w)],
                                 "a double, b double, weight double").repartition(3).checkpoint()


def test_cost_is_not_above_the_best_of_single_fits(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getCheckpointDir() or str(tmp_path))
    rnd = np.random.default_rng(7)
    x = np.vstack([rnd.normal(c, 0.6, (60, 2)) for c in ((0, 0), (5, 0), (0, 5), (5, 5), (2.5, 9))])
    w = rnd.integers(1, 9, len(x))
    pts = _points(spark, x, w)
    centres, cost = multi_start(pts, ["a", "b"], 5, 10, 42)
    vec = VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(pts).checkpoint()
    single = min(KMeans(k=5, seed=s, featuresCol="v", weightCol="weight", maxIter=300).fit(vec).summary.trainingCost
                 for s in range(10))
    assert cost <= single * (1 + 1e-6)
    d = ((x[:, None] - centres[None]) ** 2).sum(-1)
    assert abs((d.min(1) * w).sum() - cost) < 1e-6 * cost
    for j in range(5):   # a fixed point: every centre is the mean of its points
        own = d.argmin(1) == j
        assert np.abs(np.average(x[own], axis=0, weights=w[own]) - centres[j]).max() < 1e-3
    again, same = multi_start(pts.repartition(5).checkpoint(), ["a", "b"], 5, 10, 42)
    assert np.abs(again - centres).max() < 1e-9 and abs(same - cost) < 1e-6


def test_few_points_one_point_and_none(spark):
    two = _points(spark, [(0, 0), (3, 4)], [1, 1000])
    centres, cost = multi_start(two, ["a", "b"], 5, 3, 1)
    assert centres.tolist() == [[0, 0], [3, 4]] and cost == 0
    centres, _ = multi_start(two, ["a", "b"], 1, 2, 1)
    assert np.abs(centres - [[3000 / 1001, 4000 / 1001]]).max() < 1e-12
    centres, cost = multi_start(two.limit(0), ["a", "b"], 3, 2, 1)
    assert centres.shape == (0, 2) and cost == 0
