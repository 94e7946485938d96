"""Registered queries of sources and sinks: scans and stores that are written
from ``events`` below the checkpoint folder and read back, network event
exports, and held-out metrics.  ``SQL`` has the DuckDB twin of each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import constants as C
from ..operators import views as V
from ..operators.classify import holdout_metrics
from ..operators.clean import clean_system, first_seen_codes
from ..operators.clustering import kmeans_labels
from ..operators.density import dbscan
from ..session import checkpoint_dir
from ..sources import alert_store, aliases, csv_logs, winevent
from . import bindings as B, catalog as Q, intel, oracle
from .oracle import RESPONSE_CANDIDATES, _recommendations, _skills, _with


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def q_csv_scan(spark, d) -> DataFrame:
    """S1 over a folder of two CSV files whose columns stand in different order."""
    raw = B.security_log(Q.events(spark, d)).drop("value", "user_id")
    path = _scratch(spark, "csv")
    odd = F.col("row_id").cast("long") % 2 == 1
    raw.where(odd).write.option("header", True).csv(f"{path}/a")
    raw.where(~odd).select(*sorted(raw.columns)).write.option("header", True).csv(f"{path}/b")
    both = [csv_logs.read_system_logs(spark, f"{path}/{x}") for x in "ab"]
    rows = clean_system(both[0].unionByName(both[1]))
    return rows.select(F.col("row_id").cast("long").alias("row_id"), "source_ip", "event", "failed_count", "hour")


def q_csv_folders(spark, d) -> DataFrame:
    """Codes by first appearance over nested folders of unequal files."""
    raw = B.security_log(Q.events(spark, d))
    path = _scratch(spark, "nested")
    few = F.col("row_id").cast("long") % 11 == 3
    for folder, rows in (("a/day=2", raw.where(few)), ("b/x/day=1", raw.where(~few))):
        # files are named by partition, so paths follow row_id inside a folder
        rows.withColumn("name", F.concat(F.lit("u"), F.pmod(F.col("row_id") * 7919, F.lit(101)))).repartitionByRange(
            5, "row_id").sortWithinPartitions("row_id").select(F.col("row_id").alias("given"), "timestamp", "name").write.option(
            "header", True).csv(f"{path}/{folder}")
    log = csv_logs.read_log_csv(spark, path, [], "nested log", file_order=True)
    return first_seen_codes(log, "name", "row_id").groupBy("name", "name_code").agg(F.count(F.lit(1)).alias("n"))


def q_alert_store_runs(spark, d) -> DataFrame:
    """A run that is written twice, one that was not committed, one that
    replaces all before it."""
    path = _scratch(spark, "runs")
    sys_alerts, net_alerts = Q.sys_alerts_df(spark, d), Q.net_alerts_df(spark, d)
    alert_store.save_alerts(net_alerts, path, "old")
    alert_store.commit_run(spark, path, "old")
    for _ in range(2):
        alert_store.save_alerts(sys_alerts, path, "new")
    alert_store.commit_run(spark, path, "new", replace=True)
    alert_store.save_alerts(sys_alerts, path, "broken")
    alert_store.save_alerts(net_alerts.where("severity = 4"), path, "more")
    alert_store.commit_run(spark, path, "more")
    return alert_store.load_alerts(spark, path).groupBy("log_type", "attack_type", "severity").agg(F.count(F.lit(1)).alias("n"))


def q_scored_view(spark, d) -> DataFrame:
    """The view over a store of both logs, asked by SQL text."""
    path, view = _scratch(spark, "view"), f"scored_{uuid.uuid4().hex}"
    alert_store.save_alerts(Q.sys_alerts_df(spark, d), path)
    alert_store.save_alerts(Q.net_alerts_df(spark, d), path)
    intel.create_scored_view(spark, path, view)
    return spark.sql(f"SELECT log_type, row_id, attack_type, risk_score, risk_level FROM {view} "
                     "WHERE risk_score >= 4")


def q_dbscan_grid(spark, d) -> DataFrame:
    """M6 on whole numbers: users by hour of day, weighted by their events."""
    checkpoint_dir(spark)
    e = Q.events(spark, d).select(F.col("event_id"), (F.col("user_id") % 40).cast("double").alias("x"),
                                  F.hour("ts").cast("double").alias("y"), F.when(F.col("event_type") == "error", 2.0).otherwise(0.0).alias("z"))
    points = e.groupBy("x", "y", "z").agg(F.count(F.lit(1)).cast("double").alias("weight"), F.min("event_id").alias("first"))
    points = points.withColumn("pid", F.monotonically_increasing_id()).checkpoint()
    least = e.count() / 520
    return points.join(dbscan(points, ["x", "y", "z"], 1.0, least), "pid").select("x", "y", "z", "weight", "label")


def q_kmeans_groups(spark, d) -> DataFrame:
    """M5 on four groups of alerts that lie far apart; clusters are numbered by centroid."""
    group, noise = F.col("user_id") % 4, F.col("event_id") % 10
    alerts = Q.events(spark, d).select(
        F.lit("system").alias("log_type"), F.col("event_id").alias("row_id"), (group + noise / 100).alias("anomaly_score"),
        F.lit(3).alias("severity"), (50 - group * group + noise / 200).alias("confidence"), F.lit(0).alias("hour"))
    return kmeans_labels(alerts, 4).select("log_type", "row_id", "cluster_kmeans")


def q_event_store(spark, d) -> DataFrame:
    """S6 on a store of event documents by day and id."""
    path = _scratch(spark, "event-store")
    winevent.store_events(Q.event_xml(spark, d), path)
    left = winevent.stored_events(spark, path, "2024-01-15 00:00:00", [C.LOGON_FAILED_ID], 800)
    return winevent.parse_events(left.drop("win_event_id")).select("row_id", "win_event_id", "time_created", "provider")


def q_alert_store_roundtrip(spark, d) -> DataFrame:
    """Two appends with different optional columns, read as one."""
    path = _scratch(spark, "alerts")
    alert_store.save_alerts(Q.sys_alerts_df(spark, d), path)
    alert_store.save_alerts(Q.net_alerts_df(spark, d), path)
    stored = alert_store.load_alerts(spark, path)
    return stored.select("log_type", "row_id", "attack_type", "severity", "confidence", "source_ip", "destination_ip")


def q_network_alias(spark, d) -> DataFrame:
    """A network log under foreign names, scanned from CSV."""
    e = Q.events(spark, d)
    rows = e.select(B.ts_text(F.col("ts")).alias(" Event_Time"), F.concat(F.lit("10.1."), F.col("user_id") % 90, F.lit(".4")).alias("CLIENT_IP"),
                    (F.col("event_id") % 1000 + 1).alias("Port"), F.col("event_type").alias("Proto"),
                    F.col("user_id").alias("pkts"), (F.col("event_id") * 10).alias("Bytes"), F.col("event_id").alias("row_id"))
    path = _scratch(spark, "flows")
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return aliases.load_network_logs(spark, path)


def network_xml(spark, d) -> tuple[DataFrame, DataFrame]:
    """Firewall and DNS events as exported XML documents, derived from events."""
    e = Q.events(spark, d)
    eid, uid = F.col("event_id"), F.col("user_id")

    def document(number, data):
        pairs = F.concat(*[F.concat(F.lit(f'<Data Name="{k}">'), v, F.lit("</Data>")) for k, v in data.items()])
        return F.concat(F.lit('<Event><System><Provider Name="Net  Source"/><EventID>'), number,
                        F.lit('</EventID><TimeCreated SystemTime="'), B.ts_text(F.col("ts")),
                        F.lit('"/></System><EventData>'), pairs, F.lit("</EventData><Message>seen "),
                        F.col("event_type"), F.lit("</Message></Event>"))
    number = F.element_at(F.array(*[F.lit(str(x)) for x in (2010, 2011, 2052, 2059, 2097, 3000)]), (uid % 6 + 1).cast("int"))
    wall = document(number, {
        "Protocol": F.when(eid % 2 == 0, F.lit("TCP")).otherwise(F.lit(" ")),
        "SourceAddress": F.when(eid % 3 == 0, F.lit("-")).otherwise(F.concat(F.lit("10.2.0."), (uid % 250).cast("string"))),
        "LocalAddress": F.lit(" 10.9.9.9 "), "SourcePort": F.when(eid % 4 == 0, F.lit("any")).otherwise((uid % 5000).cast("string")),
        "LocalPort": F.lit("77"), "DestinationPort": (eid % 600).cast("string"), "Direction": F.lit("in  bound")})
    dns = document(F.lit("3008"), {
        "Name": F.concat(F.lit("host"), (uid % 40).cast("string"), F.lit(".example.org")), "QueryType": (eid % 30).cast("string"),
        "ClientAddress": F.concat(F.lit("10.3.0."), (uid % 250).cast("string")), "DnsServerAddress": F.lit("127.0.0.1"),
        "DestinationAddress": F.lit("10.0.0.53")})
    error = F.col("event_type").isin("error", "click")
    return (e.where(error).select(eid.alias("row_id"), wall.alias("xml")),
            e.where(~error).select(eid.alias("row_id"), dns.alias("xml")))


def q_network_rows(spark, d) -> DataFrame:
    """Firewall and DNS events to collector rows."""
    wall, dns = (winevent.parse_events(x) for x in network_xml(spark, d))
    return winevent.network_rows(winevent.firewall_rows(wall, ("row_id",)), winevent.dns_rows(dns, ("row_id",)))


def q_network_sink(spark, d) -> DataFrame:
    """The 19 network columns written as CSV and read back."""
    path = _scratch(spark, "network")
    csv_logs.write_table(csv_logs.network_table(q_network_rows(spark, d)), path)
    back = csv_logs.read_log_csv(spark, path, C.NETWORK_OUTPUT_COLUMNS, "network table")
    return back.groupBy("log_type", "event_type", "action").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("destination_port").cast("long")).alias("ports"),
        F.count("source_ip").alias("sources"), F.count("connection_observation_count").alias("observed"))


def q_holdout_metrics(spark, d) -> DataFrame:
    """A15 on fixed predictions: one type is predicted that never occurs."""
    e = Q.events(spark, d)
    guess = F.when(F.col("user_id") % 7 == 0, "never").when(F.col("user_id") % 5 == 0, "click").otherwise(F.col("event_type"))
    return holdout_metrics(e.select(F.col("event_type").alias("y"), guess.alias("p")))


def q_report_summary(spark, d) -> DataFrame:
    """The report's summary and the length of its sections."""
    alerts = Q.clustered_df(spark, d)
    report = intel.generate_report(alerts, V.cluster_summary(alerts), generated_at=Q.DETECTED_AT)
    return report.select(
        "executive_summary.total_alerts", "executive_summary.critical_alerts", "executive_summary.high_alerts",
        "executive_summary.unique_sources", F.size("executive_summary.attack_type_breakdown").alias("n_types"),
        F.size("indicators_of_compromise").alias("n_indicators"), F.size("attack_timeline_hourly").alias("n_hours"),
        F.size("attack_campaigns").alias("n_campaigns"), F.size("recommendations").alias("n_recommendations"),
        F.size("top_alerts").alias("n_top"), F.aggregate(
            "attack_timeline_hourly", F.lit(0).cast("long"), lambda s, x: s + x["alert_count"]).alias("alerts_in_hours"))


QUERIES = {
    "report_summary": q_report_summary,
    "csv_folders": q_csv_folders, "alert_store_runs": q_alert_store_runs, "dbscan_grid": q_dbscan_grid,
    "scored_view": q_scored_view, "kmeans_groups": q_kmeans_groups, "event_store": q_event_store,
    "csv_scan": q_csv_scan, "alert_store_roundtrip": q_alert_store_roundtrip, "network_alias": q_network_alias,
    "network_rows": q_network_rows, "network_sink": q_network_sink, "holdout_metrics": q_holdout_metrics,
}

_TS = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"
_WALL = f"""
wall AS (
  SELECT eid AS row_id, {_TS} AS "timestamp", 'firewall' AS log_type,
    CASE uid % 6 WHEN 0 THEN 'FIREWALL_PROFILE_CHANGE' WHEN 1 THEN 'FIREWALL_BLOCK_NOTIFICATION'
         WHEN 2 THEN 'FIREWALL_RULE_DELETED' WHEN 3 THEN 'FIREWALL_RULE_MODIFIED'
         WHEN 4 THEN 'FIREWALL_RULE_ADDED' ELSE 'FIREWALL_EVENT' END AS event_type,
    CASE uid % 6 WHEN 0 THEN 2010 WHEN 1 THEN 2011 WHEN 2 THEN 2052 WHEN 3 THEN 2059 WHEN 4 THEN 2097 ELSE 3000 END AS event_id,
    'seen ' || et AS event_message,
    CASE WHEN eid % 3 = 0 THEN '10.9.9.9' ELSE '10.2.0.' || CAST(uid % 250 AS VARCHAR) END AS source_ip,
    '10.9.9.9' AS destination_ip, CASE WHEN eid % 4 = 0 THEN 77 ELSE uid % 5000 END AS source_port,
    eid % 600 AS destination_port,
    CASE WHEN eid % 2 = 0 THEN 'TCP' WHEN uid % 6 = 0 THEN 'N/A' ELSE '' END AS protocol, '' AS "user",
    'Net Source' AS service, 0 AS failed_count,
    CASE WHEN uid % 6 IN (1, 2) THEN 'WARNING' ELSE 'INFORMATION' END AS log_level,
    '' AS query_name, '' AS query_type, 'in bound' AS action
  FROM ev WHERE et IN ('error', 'click')),
dns AS (
  SELECT eid AS row_id, {_TS} AS "timestamp", 'dns' AS log_type, 'DNS_EVENT' AS event_type, 3008 AS event_id,
    'seen ' || et AS event_message, '10.3.0.' || CAST(uid % 250 AS VARCHAR) AS source_ip, '10.0.0.53' AS destination_ip,
    0 AS source_port, 0 AS destination_port, 'DNS' AS protocol, '' AS "user", '' AS service, 0 AS failed_count,
    'INFORMATION' AS log_level, 'host' || CAST(uid % 40 AS VARCHAR) || '.example.org' AS query_name,
    CAST(eid % 30 AS VARCHAR) AS query_type, '' AS action
  FROM ev WHERE et NOT IN ('error', 'click'))"""

_NAMES = ", ".join(f"'{n}'" for n, _ in C.ANALYSTS)

SQL = {
    "event_store": oracle.SQL["source_filter"],
    "kmeans_groups": _with("SELECT 'system' AS log_type, eid AS row_id, uid % 4 AS cluster_kmeans FROM ev"),
    # every assignment by analyst numbers, alert after alert; the smallest that fills all
    "response_assignment": _with(f""", cand AS ({RESPONSE_CANDIDATES}),
elig AS (
  SELECT c.rank, s.analyst_idx FROM cand c JOIN {_skills()} ON s.attack_type = c.attack_type
    OR s.attack_type = '{C.FALLBACK_SKILL}' AND c.attack_type NOT IN (SELECT attack_type FROM {_skills().replace(' s(', ' s2(')})),
best AS (SELECT min(path) AS path FROM (
  WITH RECURSIVE rec AS (
    SELECT 0 AS k, CAST([] AS BIGINT[]) AS path
    UNION ALL
    SELECT k + 1, list_append(path, CAST(e.analyst_idx AS BIGINT)) FROM rec JOIN elig e ON e.rank = rec.k
    WHERE len(list_filter(path, lambda x: x = e.analyst_idx)) < {C.RESPONSE_MAX_PER_ANALYST})
  SELECT path FROM rec WHERE k = (SELECT count(*) FROM cand)))
SELECT cand.rank, source_ip, attack_type, severity, risk_score,
  CASE WHEN path IS NOT NULL THEN [{_NAMES}][path[cand.rank + 1] + 1] END AS assigned_to,
  CASE WHEN path IS NULL THEN (SELECT count(*) FROM cand) ELSE 0 END AS unassigned
FROM cand, best"""),
    "report_summary": _with(
        "SELECT count(*) AS total_alerts, count(*) FILTER (WHERE risk_level = 'Critical') AS critical_alerts, "
        "count(*) FILTER (WHERE risk_level = 'High') AS high_alerts, "
        "(SELECT least(count(*), 10) FROM ioc) AS unique_sources, count(DISTINCT attack_type) AS n_types, "
        "(SELECT least(count(*), 10) FROM ioc) AS n_indicators, "
        "date_diff('hour', min(date_trunc('hour', \"timestamp\")), max(date_trunc('hour', \"timestamp\"))) + 1 AS n_hours, "
        "count(DISTINCT cluster_kmeans) AS n_campaigns, "
        f"(SELECT count(*) FROM ({_recommendations()})) AS n_recommendations, least(count(*), {C.TOP_ALERTS_K}) AS n_top, "
        "count(attack_type) AS alerts_in_hours FROM clustered"),
    "csv_folders": _with(
        ", f AS (SELECT 'u' || CAST(eid * 7919 % 101 AS VARCHAR) AS name, eid % 11 <> 3 AS later, eid FROM ev), "
        "o AS (SELECT *, row_number() OVER (ORDER BY later, eid) AS pos FROM f), "
        "g AS (SELECT name, min(pos) AS first, count(*) AS n FROM o GROUP BY name) "
        "SELECT name, row_number() OVER (ORDER BY first) - 1 AS name_code, n FROM g"),
    "alert_store_runs": _with(
        "SELECT log_type, attack_type, severity, count(*) AS n FROM alerts "
        "WHERE log_type = 'system' OR severity = 4 GROUP BY ALL"),
    "scored_view": _with("SELECT log_type, row_id, attack_type, risk_score, risk_level FROM scored WHERE risk_score >= 4"),
    "dbscan_grid": _with(
        """, pt AS (SELECT uid % 40 AS x, hour(ts) AS y, CASE WHEN et = 'error' THEN 2 ELSE 0 END AS z, count(*) AS weight, min(eid) AS first
         FROM ev GROUP BY ALL),
nb AS (SELECT a.x, a.y, a.z, b.x AS x2, b.y AS y2, b.z AS z2, b.weight AS w2 FROM pt a JOIN pt b
       ON abs(a.x - b.x) + abs(a.y - b.y) <= 1 AND a.z = b.z),
core AS (SELECT x, y, z FROM nb GROUP BY ALL HAVING sum(w2) >= (SELECT count(*) FROM ev) / 520),
link AS (SELECT nb.* FROM nb JOIN core USING (x, y, z) JOIN core c2 ON (x2, y2, z2) = (c2.x, c2.y, c2.z)),
reach AS (
  WITH RECURSIVE r AS (
    SELECT x, y, z, x AS hx, y AS hy, z AS hz FROM core
    UNION SELECT link.x2, link.y2, link.z2, r.hx, r.hy, r.hz FROM r JOIN link USING (x, y, z))
  SELECT r.x, r.y, r.z, min(pt.first) AS first FROM r JOIN pt ON (pt.x, pt.y, pt.z) = (hx, hy, hz) GROUP BY ALL),
lab AS (SELECT x, y, z, dense_rank() OVER (ORDER BY first) - 1 AS label FROM reach),
edge AS (SELECT nb.x, nb.y, nb.z, min(label) AS label FROM nb JOIN lab ON (x2, y2, z2) = (lab.x, lab.y, lab.z) GROUP BY ALL)
SELECT pt.x, pt.y, pt.z, weight, coalesce(lab.label, edge.label, -1) AS label FROM pt
LEFT JOIN lab ON (pt.x, pt.y, pt.z) = (lab.x, lab.y, lab.z) LEFT JOIN edge ON (pt.x, pt.y, pt.z) = (edge.x, edge.y, edge.z)"""),
    "csv_scan": _with("SELECT row_id, source_ip, event, failed_count, hour FROM sys_clean"),
    "alert_store_roundtrip": _with(
        "SELECT log_type, row_id, attack_type, severity, confidence, nullif(source_ip, '') AS source_ip, "
        "nullif(destination_ip, '') AS destination_ip FROM alerts"),
    "network_alias": _with(
        f"SELECT {_TS} AS \"timestamp\", '10.1.' || CAST(uid % 90 AS VARCHAR) || '.4' AS src_ip, "
        "CAST(eid % 1000 + 1 AS VARCHAR) AS dst_port, et AS protocol, CAST(uid AS VARCHAR) AS packets, "
        "CAST(eid * 10 AS VARCHAR) AS bytes_sent, CAST(eid AS VARCHAR) AS row_id, 'unknown' AS dst_ip FROM ev"),
    "network_rows": _with(f", {_WALL.strip()} SELECT * FROM wall UNION ALL BY NAME SELECT * FROM dns"),
    "network_sink": _with(
        f", {_WALL.strip()} SELECT log_type, event_type, nullif(action, '') AS action, count(*) AS rows, "
        "CAST(sum(destination_port) AS BIGINT) AS ports, count(nullif(source_ip, '')) AS sources, 0 AS observed "
        "FROM (SELECT * FROM wall UNION ALL BY NAME SELECT * FROM dns) GROUP BY ALL"),
    "holdout_metrics": """
WITH x AS (SELECT event_type AS y, CASE WHEN user_id % 7 = 0 THEN 'never' WHEN user_id % 5 = 0 THEN 'click' ELSE event_type END AS p FROM events),
l AS (SELECT y AS label FROM x UNION SELECT p FROM x),
c AS (SELECT label, (SELECT count(*) FROM x WHERE y = label) AS support, (SELECT count(*) FROM x WHERE p = label) AS predicted,
             (SELECT count(*) FROM x WHERE y = label AND p = label) AS tp FROM l),
r AS (SELECT label, support, tp, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
             CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM c)
SELECT label, precision, recall, CASE WHEN tp > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1_score, support FROM r""",
}
