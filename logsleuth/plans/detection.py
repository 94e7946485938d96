"""Detection job (R6, phase 1): logs -> features -> model ensemble + rules -> alerts.

Actions happen where the models need them (feature rows and raw scores are
stored, the fitted node table and weights are of fixed size) and at the final
write.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .. import constants as C
from ..operators import alerts as AL, detect as DT, features as FE
from ..operators.clean import stored_clean
from ..session import stored
from ..sources import alert_store, csv_logs


def _columns(features: list[str], inputs: list[str], keep: tuple[str, ...]) -> list[str]:
    """Columns of a cleaned log that the features, the model or the alerts read."""
    return [*C.ALERT_FIXED_COLUMNS, *C.ALERT_OPTIONAL_COLUMNS, *features, *inputs, *keep, "row_id"]


def _alerts(feats: DataFrame, columns: list[str], kind: str, detected_at: str | None, n_trees: int,
            keep: tuple[str, ...]) -> DataFrame:
    """Features are stored once: the fit reads their feature columns, the
    scoring reads the rows."""
    scored, _ = DT.detect(stored(feats, f"{kind}-features"), columns, f"{kind}_detector", n_trees=n_trees)
    return AL.build_alerts(scored, kind, detected_at, keep)


def system_alerts(raw: DataFrame, window_minutes: int = C.WINDOW_MINUTES,
                  detected_at: str | None = None, n_trees: int = C.IFOREST_N_ESTIMATORS,
                  keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    log = stored_clean(raw, "system", _columns(C.SYSTEM_FEATURE_COLS, FE.SYSTEM_INPUTS, keep))
    feats = FE.system_features(log, window_minutes)
    return _alerts(feats, C.SYSTEM_FEATURE_COLS, "system", detected_at, n_trees, keep)


def network_alerts(raw: DataFrame, window_minutes: int = C.WINDOW_MINUTES,
                   detected_at: str | None = None, n_trees: int = C.IFOREST_N_ESTIMATORS,
                   keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    log = stored_clean(raw, "network", _columns(C.NETWORK_FEATURE_COLS, FE.NETWORK_INPUTS, keep))
    feats = FE.network_features(log, window_minutes)
    return _alerts(feats, C.NETWORK_FEATURE_COLS, "network", detected_at, n_trees, keep)


def run_detection(spark: SparkSession, system_path: str, network_path: str, store_path: str,
                  window_minutes: int = C.WINDOW_MINUTES, reset: bool = True, run: str | None = None) -> str:
    """Phase 1 over CSV logs: detect and store the alerts of both logs as one
    run, then commit it; returns its name.  With ``reset`` the run replaces the
    earlier ones.  Nothing is seen of a run that stopped half way; the same run
    once more (``run``) replaces what it stored."""
    run = run or uuid.uuid4().hex
    alert_store.reset_alerts(spark, store_path, run)
    sys_raw = csv_logs.read_system_logs(spark, system_path, file_order=True)
    if not sys_raw.isEmpty():
        alert_store.save_alerts(system_alerts(sys_raw, window_minutes), store_path, run)
    net_raw = csv_logs.read_network_logs(spark, network_path, file_order=True)
    if not net_raw.isEmpty():
        alert_store.save_alerts(network_alerts(net_raw, window_minutes), store_path, run)
    alert_store.commit_run(spark, store_path, run, replace=reset)
    return run
