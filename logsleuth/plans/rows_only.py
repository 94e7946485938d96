"""Registered queries without an exact SQL twin (rows-only check), but for the
response assignment, whose twin is in ``ingest``.

Learned models (their random streams cannot match an external engine), the
whole jobs and the nested report.  Each still reads the whole
``events`` table through the bindings; their properties are tested in
``tests/`` (scores in range, planted outliers ranked high, DBSCAN against
brute force, assignment against exhaustive search).
"""

from __future__ import annotations

import uuid

from .. import constants as C
from ..operators import classify as CL, clustering as CU, features as FE
from ..operators import iforest as IF, ocsvm as OC, triage as TR, views as V
from ..operators.scaling import standardise
from ..session import checkpoint_dir
from ..sources import alert_store
from ..sources.report_io import report_json
from . import bindings as B, catalog as Q, detection as D, intel as I


def _sys_z(spark, d):
    """Standardised features of the system log, stored: the fits read them more than once."""
    feats = FE.system_features(Q.sys_clean_df(spark, d), Q.W_SHORT)
    zc = [f"z_{c}" for c in C.SYSTEM_FEATURE_COLS]
    checkpoint_dir(spark)
    return standardise(feats, C.SYSTEM_FEATURE_COLS, prefix="z_").select("row_id", *zc).checkpoint(), zc


def q_iforest(spark, d):
    z, zc = _sys_z(spark, d)
    return IF.score_forest(z, IF.fit_forest(z, zc), zc).select("row_id", "iforest_raw")


def q_ocsvm(spark, d):
    z, zc = _sys_z(spark, d)
    return OC.score_ocsvm(z, OC.fit_ocsvm(z, zc), zc).select("row_id", "ocsvm_raw")


def q_detect_system(spark, d):
    raw = B.security_log(Q.events(spark, d))
    return Q.out(D.system_alerts(raw, Q.W_LONG, Q.DETECTED_AT))


def q_detect_network(spark, d):
    raw = B.network_log(Q.events(spark, d))
    return Q.out(D.network_alerts(raw, Q.W_LONG, Q.DETECTED_AT))


def q_kmeans(spark, d):
    return CU.kmeans_labels(Q.scored_df(spark, d)).select("log_type", "row_id", "cluster_kmeans")


def q_dbscan(spark, d):
    return CU.dbscan_labels(Q.scored_df(spark, d)).select("log_type", "row_id", "cluster_dbscan")


def q_rf_classify(spark, d):
    out = CL.classify(Q.scored_df(spark, d))
    return out.select("log_type", "row_id", "attack_type", "predicted_attack_type",
                      "classification_confidence")


def q_rf_holdout(spark, d):
    scored = Q.scored_df(spark, d)
    return CL.holdout_report(CL.fit_classifier(scored), scored)


def q_response_assignment(spark, d):
    return TR.response_assignment(Q.scored_df(spark, d))


def q_report(spark, d):
    alerts = Q.clustered_df(spark, d)
    summary = V.cluster_summary(alerts)
    rep = I.generate_report(alerts, summary, TR.triage_queue(alerts),
                            TR.response_assignment(alerts), Q.DETECTED_AT)
    return report_json(rep)


def q_detection_job(spark, d):
    """R6 phase 1: both logs as CSV, detected and stored; the stored alerts by type."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/detection-{uuid.uuid4().hex}"
    raw = Q.events(spark, d)
    B.security_log(raw).drop("row_id").write.option("header", True).csv(f"{folder}/system")
    B.network_log(raw).drop("row_id").write.option("header", True).csv(f"{folder}/network")
    D.run_detection(spark, f"{folder}/system", f"{folder}/network", f"{folder}/store", Q.W_LONG)
    return alert_store.load_alerts(spark, f"{folder}/store").groupBy("log_type", "attack_type", "rule_based_alert").count()


def q_intel_job(spark, d):
    """R6 phase 3 on the alert table: clusters, risk, classifier, triage, plan, report."""
    return report_json(I.run_intel(Q.alerts_df(spark, d), generated_at=Q.DETECTED_AT).report)


QUERIES = {
    "detection_job": q_detection_job,
    "intel_job": q_intel_job,
    "iforest": q_iforest,
    "ocsvm": q_ocsvm,
    "detect_system": q_detect_system,
    "detect_network": q_detect_network,
    "kmeans": q_kmeans,
    "dbscan": q_dbscan,
    "rf_classify": q_rf_classify,
    "rf_holdout": q_rf_holdout,
    "response_assignment": q_response_assignment,
    "report": q_report,
}
