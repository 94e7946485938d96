"""Multi-start K-Means: all starts move in one aggregate a step.

A step is one pass over the weighted points.  A task holds the centres of every
start (starts x k x dimensions numbers) and hands over one row for each start
and centre; these are summed by ``groupBy``.  Seeding draws a point with a
probability in proportion to its weight and squared distance: the point with
the smallest exponential key -log(u) / (weight * distance), where u is a hash
of the point, so a rerun draws the same points whatever their partitions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

TOLERANCE = 1e-4   # a start has converged when no centre moves further

_GOLDEN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) for each row of ``x``, by its values and ``salt``."""
    h = np.full(len(x), salt * _GOLDEN & _MASK, np.uint64)
    for column in (x + 0.0).T:   # -0.0 and 0.0 are one value
        h = _mix((h ^ np.ascontiguousarray(column).view(np.uint64)) + np.uint64(_GOLDEN))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - centres[None]) ** 2).sum(-1)


def _seed_step(points: DataFrame, zcols: list[str], centres: list[np.ndarray], seed: int) -> list[np.ndarray]:
    """One more centre for every start."""
    at = len(centres[0])

    def draw(batches):
        best = {}
        for pdf in batches:
            x, w = pdf[zcols].to_numpy(np.float64), pdf["weight"].to_numpy(np.float64)
            for s, have in enumerate(centres):
                odds = w * _distances(x, have).min(1) if at else w
                with np.errstate(divide="ignore"):
                    key = -np.log(_uniform(x, (seed * 1009 + s) * 1009 + at)) / odds
                i = int(np.argmin(key)) if len(key) else -1
                if i >= 0 and key[i] < best.get(s, (np.inf,))[0]:
                    best[s] = (key[i], x[i])
        if best:
            yield pd.DataFrame({"start": list(best), "key": [b[0] for b in best.values()],
                                "x": [b[1].tolist() for b in best.values()]})
    drawn = points.mapInPandas(draw, "start int, key double, x array<double>").groupBy("start").agg(
        F.min(F.struct("key", "x")).alias("best"))
    found = {r["start"]: r["best"]["x"] for r in drawn.collect()}   # one row for each start
    return [np.vstack([have, found[s]]) if s in found else have for s, have in enumerate(centres)]


def _step(points: DataFrame, zcols: list[str], centres: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, float]]:
    """Start -> (centres moved to the mean of their points, cost of the old ones)."""
    dims = len(zcols)
    sums = ["w", "cost", *[f"s{i}" for i in range(dims)]]

    def assign(batches):
        total = {s: np.zeros((len(c), dims + 2)) for s, c in centres.items()}
        for pdf in batches:
            x, w = pdf[zcols].to_numpy(np.float64), pdf["weight"].to_numpy(np.float64)
            for s, have in centres.items():
                d = _distances(x, have)
                own = d.argmin(1)
                parts = [w, w * d[np.arange(len(x)), own], *(x * w[:, None]).T]
                total[s] += np.stack([np.bincount(own, p, len(have)) for p in parts], axis=1)
        for s, t in total.items():
            yield pd.DataFrame(t, columns=sums).assign(start=s, centre=np.arange(len(t)))[["start", "centre", *sums]]
    schema = "start int, centre int, " + ", ".join(f"{c} double" for c in sums)
    rows = points.mapInPandas(assign, schema).groupBy("start", "centre").agg(*[F.sum(c).alias(c) for c in sums]).collect()
    moved, cost = {s: c.copy() for s, c in centres.items()}, dict.fromkeys(centres, 0.0)
    for r in rows:   # starts x k rows
        cost[r["start"]] += r["cost"]
        if r["w"] > 0:   # a centre without points stays
            moved[r["start"]][r["centre"]] = [r[f"s{i}"] / r["w"] for i in range(dims)]
    return {s: (moved[s], cost[s]) for s in centres}


def multi_start(points: DataFrame, zcols: list[str], k: int, n_init: int, seed: int,
                max_iter: int = 300) -> tuple[np.ndarray, float]:
    """(centres in ascending order, cost) of the best of ``n_init`` starts.

    ``points`` (zcols, weight) has distinct rows without nulls and is read once
    a step, so it should be stored.  Fewer points than ``k`` give a centre each;
    no point gives no centre."""
    centres = [np.empty((0, len(zcols)))] * n_init
    for _ in range(k):
        centres = _seed_step(points, zcols, centres, seed)
    if not len(centres[0]):
        return centres[0], 0.0
    final = dict(enumerate(centres))
    moving = dict(final)
    for _ in range(max_iter):
        done = []
        for s, (new, _) in _step(points, zcols, moving).items():
            if np.sqrt(((new - moving[s]) ** 2).sum(1)).max() <= TOLERANCE:
                done.append(s)
            final[s] = moving[s] = new
        for s in done:
            del moving[s]
        if not moving:
            break
    costs = {s: cost for s, (_, cost) in _step(points, zcols, final).items()}
    best = min(costs, key=lambda s: (costs[s], s))
    return np.array(sorted(final[best].tolist())), costs[best]
