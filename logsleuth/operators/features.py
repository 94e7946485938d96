"""Feature engineering: look-back window stats and heuristics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..functions import scoring as S
from .windows import DEFAULT_BUCKET_MS, window_counts, window_distinct

# what the window stats and heuristics read of a cleaned log
SYSTEM_INPUTS = ["source_ip", "ts_ms", "failed_count", "event_code"]
NETWORK_INPUTS = ["source_ip", "ts_ms", "destination_port", "has_destination_port", "has_destination_ip",
                  "is_firewall_event", "is_external_dst", "connection_observation_count", "duration_sec"]


def system_features(df: DataFrame, window_minutes: int = C.WINDOW_MINUTES,
                    method: str = "prefix", bucket_ms: int = DEFAULT_BUCKET_MS) -> DataFrame:
    """W1/W2 + F21/F22 on a cleaned system log (needs ``source_ip``, ``ts_ms``)."""
    wms = window_minutes * 60_000
    sums = {"ip_failed_count": "failed_count"} if "failed_count" in df.columns else {}
    out = window_counts(df, "source_ip", "ts_ms", wms, sums=sums,
                        count_out="ip_event_count", method=method, bucket_ms=bucket_ms)
    if not sums:
        out = out.withColumn("ip_failed_count", F.lit(0).cast("bigint"))
    out = out.withColumns({
        "heuristic_brute_force": S.brute_force(),
        "heuristic_priv_esc": S.priv_esc(),
    })
    return _fill_features(out, C.SYSTEM_FEATURE_COLS)


def network_features(df: DataFrame, window_minutes: int = C.WINDOW_MINUTES,
                     method: str = "prefix", bucket_ms: int = DEFAULT_BUCKET_MS) -> DataFrame:
    """W3 + F23-F26 on a cleaned network log."""
    wms = window_minutes * 60_000
    out = window_distinct(df, "source_ip", "ts_ms", "destination_port", wms,
                          out="ip_unique_dst_ports", method=method, bucket_ms=bucket_ms)
    out = out.withColumns({
        "heuristic_port_scan": S.port_scan(),
        "heuristic_dos": S.dos(),
        "heuristic_exfil": S.exfil(),
        "heuristic_firewall_activity": S.firewall_activity(),
    })
    return _fill_features(out, C.NETWORK_FEATURE_COLS)


def _fill_features(df: DataFrame, cols: list[str]) -> DataFrame:
    missing = {c: F.lit(0) for c in cols if c not in df.columns}
    return df.withColumns(missing) if missing else df


def flag_counts(df: DataFrame, a: str = "heuristic_brute_force",
                b: str = "heuristic_priv_esc") -> DataFrame:
    """Two-column value counts."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("row_count"))
