"""Alert building.

``build_alerts`` is a narrow filter + projection over the scored feature
frame: no shuffle.  Ordering (T1) is a separate step because a global sort of
a large table is only worth paying for when the order is consumed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..functions import scoring as S


def _any_flag(df: DataFrame, cols: list[str]) -> Column:
    present = [F.coalesce(F.col(c) == 1, F.lit(False)) for c in cols if c in df.columns]
    return reduce(lambda a, b: a | b, present, F.lit(False))


def detected_at_now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def build_alerts(df: DataFrame, log_type: str = "system", detected_at: str | None = None,
                 keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Rows flagged by the model (``is_anomaly == 1``) or by any heuristic.

    ``df`` carries ``anomaly_score`` and ``is_anomaly`` next to the features.
    ``detected_at`` fixes the detection-time text (tests); default is now.
    Extra columns named in ``keep`` are carried when present.
    """
    heur = C.SYSTEM_HEURISTICS if log_type == "system" else C.NETWORK_HEURISTICS
    mask = _any_flag(df, heur)
    anomalous = F.coalesce(F.col("is_anomaly") == 1, F.lit(False))
    out = df.where(anomalous | mask).withColumn(
        "rule_based_alert", (~anomalous & mask).cast("int"))
    attack = S.system_attack_type() if log_type == "system" else S.network_attack_type()
    for h in heur:
        if h not in out.columns:
            out = out.withColumn(h, F.lit(0))
    out = out.withColumn("attack_type", attack)
    out = out.withColumns({
        "base_severity": S.base_severity(),
        "confidence": S.confidence(),
    })
    out = out.withColumns({
        "severity": S.boosted_severity(),
        "description": S.description(),
        "recommendation": S.recommendation(),
        "log_type": F.lit(log_type),
        "detected_at": F.lit(detected_at) if detected_at else detected_at_now(),
        "data_origin": F.lit(C.DATA_ORIGIN),
    })
    cols = list(C.ALERT_FIXED_COLUMNS)
    cols += [c for c in C.ALERT_OPTIONAL_COLUMNS if c in out.columns]
    cols += [c for c in keep if c in out.columns and c not in cols]
    return out.select(*cols)


def sort_alerts(alerts: DataFrame) -> DataFrame:
    """Severity desc, confidence desc, row order as tie-breaker."""
    tie = [F.col("row_id")] if "row_id" in alerts.columns else []
    return alerts.orderBy(F.desc("severity"), F.desc("confidence"), *tie)


def alert_head(alerts: DataFrame, n: int = C.CONSOLE_HEAD) -> DataFrame:
    """The first ``n`` alerts in T1 order (TakeOrderedAndProject)."""
    return sort_alerts(alerts).limit(n)


def union_alerts(*frames: DataFrame) -> DataFrame:
    """Union by column name, null-filling columns a frame lacks."""
    frames = [f for f in frames if f is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
