"""Batch statistics used for scaling.

Both are one global aggregate (partial per task, one row merged) attached to
every row as a single broadcast row: the statistics never grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from .views import attach_scalars


def column_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and population standard deviation of each column (nulls as 0)."""
    aggs = []
    for c in cols:
        v = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        aggs += [F.avg(v).alias(f"_mean_{c}"), F.stddev_pop(v).alias(f"_sd_{c}")]
    return df.agg(*aggs)


def standardise(df: DataFrame, cols: list[str], prefix: str = "z_",
                stats: DataFrame | None = None) -> DataFrame:
    """(x - mean) / sd with population sd; a constant column gives 0.

    ``stats`` lets a fitted scaler (``column_stats`` of the training batch)
    be reused on another batch."""
    stats = stats if stats is not None else column_stats(df, cols)
    joined = attach_scalars(df, stats)
    zs = {}
    for c in cols:
        v = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        sd = F.col(f"_sd_{c}")
        zs[f"{prefix}{c}"] = F.when(sd == 0, v - F.col(f"_mean_{c}")).otherwise(
            (v - F.col(f"_mean_{c}")) / sd)
    return joined.withColumns(zs).drop(*[f"_mean_{c}" for c in cols],
                                        *[f"_sd_{c}" for c in cols])


def column_range(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row with the smallest and largest value of each column."""
    return df.agg(*[F.min(c).alias(f"_min_{c}") for c in cols], *[F.max(c).alias(f"_max_{c}") for c in cols])


def minmax(df: DataFrame, cols: dict[str, str], eps: float = C.MINMAX_EPS,
           fit: DataFrame | None = None) -> DataFrame:
    """(x - min) / (max - min + eps) over the batch, which is read twice
    and should be stored.

    ``fit`` (see ``column_range``) freezes the range for incremental scoring."""
    joined = attach_scalars(df, fit if fit is not None else column_range(df, list(cols)))
    outs = {o: (F.col(i) - F.col(f"_min_{i}")) / (F.col(f"_max_{i}") - F.col(f"_min_{i}") + eps)
            for i, o in cols.items()}
    return joined.withColumns(outs).drop(*[f"_min_{c}" for c in cols],
                                         *[f"_max_{c}" for c in cols])
