"""Exact DBSCAN of weighted points over a graph of units.

Space is cut into fine cells of side eps / sqrt(d), so points of one cell are
neighbours.  A cell with ``min_weight`` or more is *heavy*: all its points are
core and it is one unit.  Other cells hold fewer points than ``min_weight``;
each of these is a unit of its own.  Which units are adjacent (some point of
one within eps of some point of the other), and how much weight lies within
eps of a light unit, is found without forming pairs of points:

1. coarse cells that are not empty and touch each other give pairs of units;
2. a pair of bounding boxes that are farther apart than eps is dropped, one
   that is within eps as a whole is accepted with its weight;
3. the boxes of the other pairs are halved in every dimension and looked at
   again.  Once two heavy units are adjacent their other boxes are dropped,
   and so are those of a light unit that is core and knows the neighbour.

A box is the hull of the points in it, so a box of one point is decided at
once, and rounds end when every pair is.  Distances are sums of squares in one
order, so results equal those of comparing all points.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from .components import connected_components
from .ordering import global_position


def _cells(cols: list[str], side: float) -> Column:
    return F.array(*[F.floor(F.col(c) / side).cast("long") for c in cols])


def _hull(cols: list[str]) -> list[Column]:
    return [F.sum("weight").alias("w"), *[f(c).alias(f"{p}{i}") for i, c in enumerate(cols)
                                         for p, f in (("lo", F.min), ("hi", F.max))]]


def _box(prefix: str, d: int) -> list[Column]:
    return [F.col(f"{p}{i}").alias(f"{prefix}{p}{i}") for i in range(d) for p in ("lo", "hi")]


def _gaps(d: int) -> tuple[Column, Column]:
    """Squares of the least and the greatest distance of the boxes a and b."""
    near, far = [], []
    for i in range(d):
        alo, ahi, blo, bhi = (F.col(f"{s}{p}{i}") for s in "ab" for p in ("lo", "hi"))
        near.append(F.greatest(alo - bhi, blo - ahi, F.lit(0.0)))
        far.append(F.greatest(ahi - blo, bhi - alo))
    return tuple(reduce(lambda x, y: x + y, [g * g for g in side]) for side in (near, far))


class _Units:
    def __init__(self, points: DataFrame, cols: list[str], eps: float, min_weight: float):
        """``points``: pid, weight, first and the coordinates ``cols``; stored."""
        self.cols, self.d, self.eps2, self.min_weight = cols, len(cols), eps * eps, min_weight
        self.side = eps / math.sqrt(self.d)
        cells = points.withColumn("fine", _cells(cols, self.side))
        heavy = cells.groupBy("fine").agg(F.sum("weight").alias("cw"), F.min("pid").alias("hub")).where(
            F.col("cw") >= min_weight).select("fine", "hub")
        # ids of units: the smallest point of a heavy cell, a light point itself
        self.points = cells.join(heavy, "fine", "left").select(
            "pid", "weight", "first", *cols, F.coalesce("hub", "pid").alias("unit"), F.col("hub").isNotNull().alias("heavy"),
            F.transform("fine", lambda x: F.floor(x / math.ceil(math.sqrt(self.d)))).alias("coarse")).checkpoint()
        self.units = self.points.groupBy("unit", "heavy", "coarse").agg(*_hull(cols), F.min("first").alias("first")).checkpoint()

    def candidates(self) -> DataFrame:
        """Pairs of units (a < b) in one or in touching coarse cells."""
        near = [list(o) for o in product((-1, 0, 1), repeat=self.d)]
        coarse = self.units.select("coarse").distinct()
        # touching cells are at least one side of a coarse cell, so eps or more, wide
        probe = coarse.select(F.col("coarse").alias("here"), F.explode(F.transform(
            F.array(*[F.array(*[F.lit(x) for x in o]) for o in near]),
            lambda o: F.zip_with("coarse", o, lambda x, y: x + y))).alias("coarse"))
        ties = probe.join(coarse, "coarse").select("here", F.col("coarse").alias("there"))
        a = self.units.select(F.col("unit").alias("a"), F.col("heavy").alias("aheavy"), F.col("w").alias("aw"),
                              F.col("coarse").alias("here"), *_box("a", self.d))
        b = self.units.select(F.col("unit").alias("b"), F.col("heavy").alias("bheavy"), F.col("w").alias("bw"),
                              F.col("coarse").alias("there"), *_box("b", self.d))
        none = F.array().cast("array<bigint>")
        return a.join(ties, "here").join(b, "there").where("a < b").drop("here", "there").withColumns(
            {"akey": none, "bkey": none})

    def _boxes(self, level: int) -> DataFrame:
        """Boxes of the heavy units at a level: unit, parent, key, hull."""
        side = self.side / 2 ** level
        parts = self.points.where("heavy").withColumn("key", _cells(self.cols, side))
        parts = parts.groupBy("unit", "key").agg(*_hull(self.cols))
        up = F.transform("key", lambda x: F.floor(x / 2)) if level > 1 else F.array().cast("array<bigint>")
        return parts.withColumn("up", up).checkpoint()

    def _halved(self, pairs: DataFrame, boxes: DataFrame, s: str) -> DataFrame:
        """Pairs with the box on side ``s`` replaced by its parts, where heavy."""
        rest = [c for c in pairs.columns if not c.startswith((f"{s}lo", f"{s}hi")) and c not in (f"{s}w", f"{s}key")]
        parts = boxes.select(F.col("unit").alias(s), F.col("up").alias(f"{s}key"), F.col("key").alias("_k"),
                             F.col("w").alias(f"{s}w"), *_box(s, self.d))
        split = pairs.where(f"{s}heavy").select(*rest, f"{s}key").join(parts, [s, f"{s}key"])
        split = split.drop(f"{s}key").withColumnRenamed("_k", f"{s}key")
        return split.unionByName(pairs.where(f"NOT {s}heavy"))

    def adjacent(self) -> tuple[DataFrame, DataFrame]:
        """(adjacent units (a, b), a < b; weight within eps of light units (unit, w))."""
        near, far = _gaps(self.d)
        found, open_, level = None, self.candidates(), 0
        while True:
            seen = open_.withColumns({"_n": near, "_f": far}).where(F.col("_n") <= self.eps2).withColumn(
                "inside", F.col("_f") <= self.eps2).drop("_n", "_f").checkpoint()
            done = seen.where("inside").groupBy("a", "b", "aheavy", "bheavy").agg(F.sum("aw").alias("aw"), F.sum("bw").alias("bw"))
            found = (done if found is None else found.unionByName(done).groupBy("a", "b", "aheavy", "bheavy").agg(
                F.sum("aw").alias("aw"), F.sum("bw").alias("bw"))).checkpoint()
            weights = self._weights(found)
            core = weights.where(F.col("w") >= self.min_weight).select("unit")
            known = found.join(core.select(F.col("unit").alias("a"), F.lit(True).alias("ac")), "a", "left").join(
                core.select(F.col("unit").alias("b"), F.lit(True).alias("bc")), "b", "left").where(
                "(aheavy OR ac) AND (bheavy OR bc)").select("a", "b")
            open_ = seen.where("NOT inside").drop("inside").join(known, ["a", "b"], "left_anti").checkpoint()
            if open_.isEmpty():
                return found.select("a", "b"), weights
            level += 1
            boxes = self._boxes(level)
            open_ = self._halved(self._halved(open_, boxes, "a"), boxes, "b")

    def _weights(self, found: DataFrame) -> DataFrame:
        """Weight found so far within eps of each light unit, itself included.
        A pair counts each box of the heavy side once, and the light unit's own
        weight for the other side."""
        own = self.units.where("NOT heavy").select("unit", "w")
        sides = found.where("NOT aheavy").select(F.col("a").alias("unit"), F.col("bw").alias("w")).union(
            found.where("NOT bheavy").select(F.col("b").alias("unit"), F.col("aw").alias("w")))
        return own.union(sides).groupBy("unit").agg(F.sum("w").alias("w"))


def dbscan(points: DataFrame, cols: list[str], eps: float, min_weight: float) -> DataFrame:
    """(pid, label) for each of the distinct ``points`` (pid, weight, first,
    coordinates ``cols``).  Core: weight within eps, its own included, of
    ``min_weight`` or more.  Clusters are numbered from 0 by the least
    ``first`` of their core points; a border point gets the smallest adjacent
    cluster, noise -1."""
    units = _Units(points, cols, eps, min_weight)
    pairs, weights = units.adjacent()
    core = units.units.where("heavy").select("unit").union(
        weights.where(F.col("w") >= min_weight).select("unit")).checkpoint()
    first, second = (core.select(F.col("unit").alias(c)) for c in "ab")
    comps = connected_components(pairs.join(first, "a", "left_semi").join(second, "b", "left_semi"))
    labels = core.join(comps.withColumnRenamed("node", "unit"), "unit", "left").select(
        "unit", F.coalesce("component", "unit").alias("comp"))
    starts = labels.join(units.units.select("unit", "first"), "unit").groupBy("comp").agg(F.min("first").alias("f"))
    numbers = global_position(starts, ["f", "comp"], "pos").select("comp", F.col("pos").cast("int").alias("label"))
    inner = labels.join(numbers, "comp").select("unit", "label").checkpoint()
    both = pairs.union(pairs.select(F.col("b"), F.col("a"))).toDF("unit", "other")
    border = (both.join(core, "unit", "left_anti").join(inner.withColumnRenamed("unit", "other"), "other")
              .groupBy("unit").agg(F.min("label").alias("label")))
    return units.points.select("pid", "unit").join(inner.union(border), "unit", "left").select(
        "pid", F.coalesce("label", F.lit(-1)).alias("label"))
