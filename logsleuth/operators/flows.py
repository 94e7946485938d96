"""Flow grouping (A1): collapse repeated observations of the same event.

Rows that agree on the 15 key fields (compared case-insensitively) become
one row: the fields of the earliest row, the number of rows as
``connection_observation_count`` and ``last - first`` seconds (>= 0, rounded
half-even to 3 places) as ``duration_sec``.  ``failed_count`` is the first
row's value, not a sum.  It is one hash aggregate with map-side partial
aggregation (``min``/``max``/``count`` all merge), so a key
holding a third of the rows is pre-reduced in every task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..functions.clock import parse_log_time


def group_flows(rows: DataFrame, keys: list[str] = C.FLOW_KEYS,
                time_col: str = "timestamp") -> DataFrame:
    inst, _ = parse_log_time(rows, time_col)
    df = rows.withColumn("_t", inst)
    gkeys = [F.lower(F.col(k).cast("string")).alias(f"_k_{k}") for k in keys]
    payload = [c for c in rows.columns]
    order = [c for c in ("row_id",) if c in payload]  # equal times: by row id, else by content
    agg = df.groupBy(*gkeys).agg(
        F.min(F.struct("_t", *[F.col(c) for c in order], F.struct(*[F.col(c) for c in payload]).alias("_p"))).alias("_min"),
        F.count(F.lit(1)).alias("connection_observation_count"),
        F.min("_t").alias("_t0"), F.max("_t").alias("_t1"))
    secs = (F.unix_micros("_t1") - F.unix_micros("_t0")) / 1e6
    dur = F.rint(F.greatest(secs, F.lit(0.0)) * 1000) / 1000
    return agg.select(*[F.col(f"_min._p.{c}").alias(c) for c in payload],
                      "connection_observation_count",
                      dur.alias("duration_sec"))
