"""Risk scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import is_external_ip_strict, scoring as S


def score_alerts(alerts: DataFrame, per_row_external: bool = False) -> DataFrame:
    """Add ``risk_score`` (0-10, 2 d.p.) and ``risk_level``.

    External flag (F36): the ``is_external_ip`` column when it exists (null ->
    0, so network rows of a mixed store score 0), else the strict address
    test on ``source_ip``, else 0.  ``per_row_external=True`` falls back to
    ``is_external_src`` per row instead.
    """
    cols = set(alerts.columns)
    if "is_external_ip" in cols:
        ext = F.col("is_external_ip").cast("string").try_cast("double")
        if per_row_external and "is_external_src" in cols:
            ext = F.coalesce(ext, F.col("is_external_src").cast("string").try_cast("double"))
        ext = F.coalesce(ext, F.lit(0.0))
    elif "source_ip" in cols:
        ext = is_external_ip_strict("source_ip")
    else:
        ext = F.lit(0.0)
    hour = F.col("hour").cast("double") if "hour" in cols else None
    sev = F.col("severity").cast("double")
    conf = F.col("confidence").cast("double")
    out = alerts.withColumn("risk_score", S.risk_score(sev, conf, ext, F.col("attack_type"), hour))
    out = out.withColumn("risk_level", S.risk_level())
    return drop_helpers(out)


def drop_helpers(df: DataFrame) -> DataFrame:
    """Drop every column whose name starts with ``_``."""
    helpers = [c for c in df.columns if c.startswith("_")]
    return df.drop(*helpers) if helpers else df
