"""Intel job (R6 phase 3, R1, R2, R7): stored alerts -> clusters, risk,
classifier, triage, response plan -> one-row nested report.

Every report section is an aggregate over an already small result (top-k
lists, the hour grid, per-cluster rows, 8 recommendation rules), folded into
an array of structs with ``collect_list`` and ordered by explicit sort keys.
The one-row sections are stacked and folded into one row; no alert row is
ever collected to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import constants as C
from ..functions import clock
from ..operators import classify as CL, clustering as CU, risk as RK, triage as TR, views as V
from ..sources import alert_store


def _ordered_list(df: DataFrame, keys: list, fields: list[str], name: str) -> DataFrame:
    """One row: ``name`` = array of struct(fields) ordered by ``keys``."""
    k = [c.alias(f"_k{i}") for i, c in enumerate(keys)]
    items = F.collect_list(F.struct(*k, F.struct(*[F.col(f) for f in fields]).alias("_v")))
    return df.agg(F.transform(F.array_sort(items), lambda x: x["_v"]).alias(name))


def one_row(parts: list[DataFrame]) -> DataFrame:
    """Columns of several one-row frames side by side in one row.

    The parts are stacked with ``unionByName`` (each fills only its own
    columns) and folded by one aggregate; unlike a chain of joins the plan
    grows linearly with the number of parts."""
    if len(parts) == 1:
        return parts[0]
    names = [c for p in parts for c in p.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])


def executive_summary(alerts: DataFrame) -> DataFrame:
    levels = V.risk_level_counts(alerts)
    types = V.attack_counts(alerts).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("attack_type", "alert_count"))))
        .alias("attack_type_breakdown"))
    srcs = V.unique_sources(alerts).select("unique_sources")
    t = F.col("timestamp").cast("timestamp")
    window = alerts.agg(F.struct(clock.utc_text(F.min(t)).alias("start"),
                                 clock.utc_text(F.max(t)).alias("end")).alias("observation_window"))
    one = one_row([levels, types, srcs, window])
    return one.select(F.struct(
        F.col("total").alias("total_alerts"), F.col("critical").alias("critical_alerts"),
        F.col("high").alias("high_alerts"), "attack_type_breakdown", "unique_sources",
        "observation_window").alias("executive_summary"))


def generate_report(alerts: DataFrame, summary: DataFrame | None = None,
                    triage: DataFrame | None = None, response: DataFrame | None = None,
                    generated_at: str | None = None) -> DataFrame:
    """The report as one row of nested columns (``S10`` writes it as JSON)."""
    spark = alerts.sparkSession
    if alerts.isEmpty():
        return spark.createDataFrame([(C.REPORT_EMPTY_ERROR,)], "error string")
    gen = F.lit(generated_at) if generated_at else F.date_format(F.current_timestamp(),
                                                                 "yyyy-MM-dd HH:mm:ss")
    parts = [executive_summary(alerts)]
    iocs = V.ioc_top(alerts)
    parts.append(_ordered_list(iocs, [-F.col("event_count"), F.col("value")],
                               ["type", "value", "event_count", "attack_types"],
                               "indicators_of_compromise"))
    tl = V.hourly_timeline(alerts)
    parts.append(_ordered_list(tl, [F.col("hour_start")], ["timestamp", "alert_count"],
                               "attack_timeline_hourly"))
    if summary is not None:
        camp = V.campaigns(summary)
        parts.append(_ordered_list(camp, [-F.col("avg_severity"), F.col("cluster_id")],
                                   ["cluster_id", "dominant_attack", "event_count", "unique_ips",
                                    "avg_severity", "max_severity", "time_range"],
                                   "attack_campaigns"))
    recs = V.recommendations(alerts)
    parts.append(_ordered_list(recs, [F.col("rule_no")], ["priority", "action", "rationale"],
                               "recommendations"))
    if "risk_score" in alerts.columns:
        tie = [F.col(c) for c in ("log_type", "row_id") if c in alerts.columns]
        top = V._fill_text(alerts.orderBy(F.desc("risk_score"), *tie).limit(C.TOP_ALERTS_K))
        parts.append(_ordered_list(top, [-F.col("risk_score"), *tie],
                                   [c for c in C.TOP_ALERT_COLUMNS if c in alerts.columns],
                                   "top_alerts"))
    if triage is not None:
        q = _ordered_list(triage, [-F.col("priority"), F.col("source_ip")],
                          ["source_ip", "attack_type", "severity", "confidence", "risk_score",
                           "priority"], "queue")
        parts.append(q.select(F.struct(F.lit(C.TRIAGE_ALGORITHM).alias("algorithm"), "queue",
                                       F.lit(C.TRIAGE_NOTES).alias("notes"))
                              .alias("unit2_best_first_triage")))
    if response is not None:
        assigned = response.where(F.col("assigned_to").isNotNull())
        a = _ordered_list(assigned, [F.col("rank")],
                          ["source_ip", "attack_type", "severity", "risk_score", "assigned_to"],
                          "assignments")
        un = response.agg(F.coalesce(F.max("unassigned"), F.lit(0)).alias("unassigned"))
        parts.append(one_row([a, un]).select(F.struct(
            F.lit(C.RESPONSE_ALGORITHM).alias("algorithm"), "assignments", "unassigned",
            F.lit(C.RESPONSE_NOTES).alias("notes")).alias("unit3_csp_response_plan")))
    out = one_row(parts)
    return out.select(gen.alias("report_generated_at"), *out.columns)


@dataclass
class IntelResult:
    alerts: DataFrame
    cluster_summary: DataFrame
    triage: DataFrame
    response: DataFrame
    report: DataFrame


def run_intel(alerts: DataFrame, n_init: int = C.KMEANS_N_INIT, generated_at: str | None = None,
              with_classifier: bool = True) -> IntelResult:
    """Phase 3 over loaded alerts: cluster, score, classify, triage, plan, report."""
    clustered = CU.fit_predict(alerts, n_init=n_init).checkpoint()
    summary = V.cluster_summary(clustered)
    scored = RK.score_alerts(clustered)
    if with_classifier:   # skipped by its own rule when there is too little to learn from
        scored = CL.classify(scored)
    scored = scored.checkpoint()
    triage = TR.triage_queue(scored)
    response = TR.response_assignment(scored)
    report = generate_report(scored, summary, triage, response, generated_at)
    return IntelResult(scored, summary, triage, response, report)


def scored_on_read(alerts: DataFrame | None) -> DataFrame | None:
    """Loaded alerts with risk scores."""
    return None if alerts is None else RK.score_alerts(alerts)


def create_scored_view(spark: SparkSession, store: str, view: str = "scored_alerts") -> bool:
    """R7 for SQL users: a view over the alert store with ``risk_score`` and
    ``risk_level``, computed by the scalar functions ``alert_risk_score`` and
    ``alert_risk_level`` when it is read.  False, and no view, without stored
    alerts.  Like the view, the functions belong to the session."""
    alerts = alert_store.load_alerts(spark, store)
    if alerts is None:
        return False
    weights = " ".join(f"WHEN {_text(k)} THEN {v}D" for k, v in C.COMPLEXITY.items())
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION alert_risk_score(
            severity DOUBLE, confidence DOUBLE, external DOUBLE, attack STRING, at_hour DOUBLE, has_hour BOOLEAN)
        RETURNS DOUBLE
        RETURN rint(CASE WHEN severity IS NOT NULL AND confidence IS NOT NULL AND external IS NOT NULL THEN least(greatest((
            {C.RISK_WEIGHT_SEVERITY}D * (least(greatest(severity, 0D), {C.TOP_SEVERITY}D) / {C.TOP_SEVERITY}D)
            + {C.RISK_WEIGHT_CONFIDENCE}D * (least(greatest(confidence, 0D), 100D) / 100D)
            + {C.RISK_WEIGHT_EXTERNAL}D * external
            + {C.RISK_WEIGHT_COMPLEXITY}D * CASE attack {weights} ELSE {C.RISK_DEFAULT_COMPLEXITY}D END
            + {C.RISK_WEIGHT_TIME}D * CASE WHEN NOT has_hour THEN {C.RISK_TIME_UNKNOWN}D
                WHEN at_hour < {C.NIGHT_END_HOUR} OR at_hour >= {C.NIGHT_START_HOUR} THEN {C.RISK_TIME_NIGHT}D
                ELSE {C.RISK_TIME_DAY}D END) * 10, 0D), 10D) END * 100) / 100""")
    steps = " ".join(f"WHEN score >= {least}D THEN {_text(name)}" for name, least in C.RISK_LEVELS)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION alert_risk_level(score DOUBLE) RETURNS STRING "
              f"RETURN CASE {steps} ELSE {_text(C.RISK_LEVEL_DEFAULT)} END")
    alerts.createOrReplaceTempView(f"{view}_stored")
    names = set(alerts.columns)
    external = "coalesce(try_cast(CAST(is_external_ip AS STRING) AS DOUBLE), 0D)" if "is_external_ip" in names else "0D"
    hour = "CAST(hour AS DOUBLE)" if "hour" in names else "CAST(NULL AS DOUBLE)"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY VIEW {view} AS
        SELECT *, alert_risk_level(risk_score) AS risk_level FROM (
            SELECT *, alert_risk_score(CAST(severity AS DOUBLE), CAST(confidence AS DOUBLE), {external},
                                       attack_type, {hour}, {"true" if "hour" in names else "false"}) AS risk_score
            FROM {view}_stored)""")
    return True


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
