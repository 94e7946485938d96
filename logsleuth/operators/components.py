"""Connected components of an edge table by alternating star contraction.

Large-star links every larger neighbour of a node to the smallest node around
it, small-star does the same for the smaller neighbours.  The alternation ends
in stars whose centre is the smallest node of the component, after a number of
rounds logarithmic in the path length.  A round is two aggregates and two
joins over the edges; no neighbour list is gathered, so a hub is split by the
adaptive skew join.  Each round is cut with ``checkpoint()``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logsleuth.session import checkpoint_dir


def _star(pairs: DataFrame) -> DataFrame:
    """Each (u, v) of ``pairs`` with ``m``, the smallest of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("low")).select(
        "u", F.least("u", "low").alias("m"))
    return pairs.join(least, "u")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = (_star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .where("u <> v").distinct())
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _star(down)
    return (starred.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(starred.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node that has an edge; ``component`` is
    the smallest node reachable.  Edges with a null end are ignored, self-loops
    and repeated edges change nothing, an empty table gives an empty result.
    Runs to convergence: the edge set of a round is compared with the last by
    count and an order-free checksum."""
    spark = edges.sparkSession
    checkpoint_dir(spark)
    now = (edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
           .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint())

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                      F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = mark(now)
    while seen[0]:
        now = _round(now).checkpoint()
        new = mark(now)
        if new == seen:
            break
        seen = new
    return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(now.select("v", "v")).distinct())
