"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

They read the driver's tables (``events``) through ``plans.bindings`` and run
the library operators over whole tables.  Learned columns are replaced by the
deterministic stand-ins of ``bindings.standin_scores`` (and
``cluster_kmeans = user_id % 5``) where the operator under test sits
downstream of a model, so that DuckDB can check it exactly; the models
themselves are registered separately (rows-only checks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import constants as C
from ..functions import (ipv4_to_long, is_external_ip, is_external_ip_strict)
from ..operators import alerts as AL, evaluate as EV, features as FE, risk as RK
from ..operators import triage as TR, views as V
from ..operators.clean import clean_network, clean_system, first_seen_codes, stored_clean
from ..session import apply_runtime_defaults, stored
from . import bindings as B

W_SHORT = C.WINDOW_MINUTES       # default look-back
W_LONG = 120                     # the test data is sparse: 10 minutes never reaches 10 ports
W_STREAM = 360                   # the look-back at which the brute-force rule fires here
DETECTED_AT = "2024-02-01 00:00:00"


# ---- shared building blocks ------------------------------------------------

def events(spark: SparkSession, d: str) -> DataFrame:
    apply_runtime_defaults(spark)
    return B.read_table(spark, d, "events")


_SHARED: dict[tuple, DataFrame] = {}


def shared(spark: SparkSession, key: tuple, build) -> DataFrame:
    """A table that many queries start from, written as Parquet below the
    shared ``spark.checkpoint.dir`` like the stored alerts of a run, and kept
    per application and folder."""
    k = (spark.sparkContext.applicationId, *key)
    if k not in _SHARED:
        _SHARED[k] = stored(build(), key[0])
    return _SHARED[k]


def release_shared(spark: SparkSession) -> None:
    """Forget this application's shared tables; their files go with the
    checkpoint folder."""
    app = spark.sparkContext.applicationId
    for k in [k for k in _SHARED if k[0] == app]:
        del _SHARED[k]


def sys_clean_df(spark, d) -> DataFrame:
    """Not stored: each query scans the columns it needs.  Alerts need most, and store them."""
    return clean_system(B.security_log(events(spark, d)))


def net_clean_df(spark, d) -> DataFrame:
    return clean_network(B.network_log(events(spark, d)))


def sys_feat_df(spark, d, minutes=W_LONG) -> DataFrame:
    return FE.system_features(sys_clean_df(spark, d), minutes)


def net_feat_df(spark, d, minutes=W_LONG) -> DataFrame:
    return FE.network_features(net_clean_df(spark, d), minutes)


KEEP = ("row_id", "user_id")


ALERT_INPUTS = [*C.ALERT_FIXED_COLUMNS, *C.ALERT_OPTIONAL_COLUMNS, *KEEP, "value"]


def sys_alerts_df(spark, d) -> DataFrame:
    log = stored_clean(B.security_log(events(spark, d)), "system", ALERT_INPUTS + FE.SYSTEM_INPUTS)
    feats = FE.system_features(log, W_LONG)
    return AL.build_alerts(B.standin_scores(feats), "system", DETECTED_AT, KEEP)


def net_alerts_df(spark, d) -> DataFrame:
    log = stored_clean(B.network_log(events(spark, d)), "network", ALERT_INPUTS + FE.NETWORK_INPUTS)
    feats = FE.network_features(log, W_LONG)
    return AL.build_alerts(B.standin_scores(feats), "network", DETECTED_AT, KEEP)


def alerts_df(spark, d) -> DataFrame:
    """The alert table every view reads (the stored alerts of a run)."""
    return shared(spark, ("alerts", d),
                  lambda: AL.union_alerts(sys_alerts_df(spark, d), net_alerts_df(spark, d)))


def scored_df(spark, d) -> DataFrame:
    return RK.score_alerts(alerts_df(spark, d))


def clustered_df(spark, d) -> DataFrame:
    return scored_df(spark, d).withColumn("cluster_kmeans", (F.col("user_id") % 5).cast("int"))


def out(df: DataFrame) -> DataFrame:
    """Present instants as UTC wall clocks (TIMESTAMP_NTZ) for comparison."""
    cols = [F.col(f.name).cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


# addresses with the result that Python's ipaddress gives (1 public, 0 not)
STRICT_ADDRESSES = {
    "00:1a:2b:3c:4d:5e": 0, "12:34": 0, "fd1::1": 1, "fc::1": 1, "fc00::1": 0, "fdff::1": 0, "fe90::1": 0,
    "febf::1": 0, "fec0::1": 1, "2001::1": 0, "2001:200::1": 1, "2002::1": 0, "2001:db8::8": 0, "2606:4700::1111": 1,
    "2001:4:112::1": 1, "2001:20::7": 1, "3fff::1": 1, "::ffff:8.8.8.8": 1, "::ffff:10.0.0.1": 0, "::8.8.8.8": 1,
    "64:ff9b:1::1": 0, "64:ff9b::1": 1, "100::1": 0, "1::2::3": 0, "::": 0, "1:2:3:4:5:6:7:8": 1, "1:2:3:4:5:6:7::": 1,
    "1:2:3:4:5:6:7:8::": 0, "192.0.0.8": 0, "192.0.0.9": 1, "192.0.0.100": 0, "192.0.1.1": 1, "198.20.0.1": 1,
    "255.255.255.255": 0, "9999999999999.1.1.1": 0, "99999999999999999999.1.1.1": 0,
}


def address_probe(spark, d) -> DataFrame:
    """Address texts derived from events, covering the F3-F5 edge shapes."""
    e = events(spark, d)
    a, b = F.col("user_id") % 300, F.col("event_id") % 256
    c = (F.col("event_id") * 7) % 256
    v = F.pmod(F.col("event_id"), F.lit(12))
    dotted = F.concat_ws(".", a.cast("string"), b.cast("string"), c.cast("string"),
                         (F.col("user_id") % 256).cast("string"))
    strict = F.get(F.array(*[F.lit(x) for x in STRICT_ADDRESSES]),
                   F.pmod(F.floor(F.col("event_id") / 12), F.lit(len(STRICT_ADDRESSES))).cast("int"))
    text = (F.when(v == 0, dotted)
             .when(v == 1, F.concat(dotted, F.lit(".7")))
             .when(v == 2, F.concat_ws(".", a.cast("string"), b.cast("string"), c.cast("string")))
             .when(v == 3, F.concat(F.lit("host-"), F.col("user_id").cast("string")))
             .when(v == 4, F.concat(F.lit("172."), (F.col("event_id") % 40).cast("string"), F.lit(".0.1")))
             .when(v == 5, F.concat(F.lit("192.168."), b.cast("string"), F.lit(".1")))
             .when(v == 6, F.concat(F.lit("10."), b.cast("string"), F.lit(".0.1")))
             .when(v == 7, F.lit("::1"))
             .when(v == 8, F.concat(F.lit("198.18."), b.cast("string"), F.lit(".1")))
             .when(v == 9, F.concat(F.lit("100.64.0."), b.cast("string")))
             .when(v == 10, strict)
             .otherwise(F.lit("unknown")))
    return e.select(F.col("event_id").alias("row_id"), text.alias("address"))


# ---- queries ---------------------------------------------------------------

def q_sys_clean(spark, d):
    df = sys_clean_df(spark, d)
    return out(df.select("row_id", "timestamp", "source_ip", "user", "service", "event",
                         "event_id", "failed_count", "log_level", "hour", "minute",
                         "day_of_week", "is_night", "event_code", "log_level_code",
                         "source_ip_int", "is_external_ip", "is_privileged_user"))


def q_net_clean(spark, d):
    df = net_clean_df(spark, d)
    return out(df.select(
        "row_id", "timestamp", "log_type", "event_type", "event_id", "event_message",
        "source_ip", "destination_ip", "source_port", "destination_port", "protocol", "service",
        "log_level", "connection_observation_count", "duration_sec", "hour", "is_night",
        "protocol_code", "log_type_code", "event_type_code", "source_ip_int",
        "destination_ip_int", "is_external_src", "is_external_dst", "has_source_ip",
        "has_destination_ip", "has_source_port", "has_destination_port", "has_protocol",
        "event_message_length", "is_firewall_event", "is_dns_event", "is_security_event",
        "connection_observation_rate", "is_well_known_port"))


def q_ipv4_encode(spark, d):
    p = address_probe(spark, d)
    return p.select("row_id", "address", ipv4_to_long("address").alias("address_int"))


def q_external_ip(spark, d):
    p = address_probe(spark, d)
    return p.select("row_id", "address", is_external_ip("address").alias("is_external"))


def q_external_ip_strict(spark, d):
    p = address_probe(spark, d)
    return p.select("row_id", "address", is_external_ip_strict("address").alias("is_external"))


def q_category_codes(spark, d):
    net = clean_network(B.network_log(events(spark, d)), order_col="_none")  # no first-seen codes asked for
    return net.select("row_id", "protocol", "protocol_code", "log_type", "log_type_code")


def q_first_seen_code(spark, d):
    net = clean_network(B.network_log(events(spark, d)), order_col="_none").drop("event_type_code")
    coded = first_seen_codes(net, "event_type", "row_id", "event_type_code")
    return coded.select("event_type", "event_type_code").distinct()


def q_calendar_features(spark, d):
    return sys_clean_df(spark, d).select("row_id", "hour", "minute", "day_of_week", "is_night")


def q_ip_event_window(spark, d):
    df = FE.system_features(sys_clean_df(spark, d), W_SHORT)
    return df.select("row_id", "source_ip", "ip_event_count", "ip_failed_count")


def q_ip_failed_window(spark, d):
    df = sys_feat_df(spark, d, W_LONG)
    return df.select("row_id", "source_ip", "ip_event_count", "ip_failed_count")


def q_ip_distinct_ports(spark, d):
    df = net_feat_df(spark, d, W_LONG)
    return df.select("row_id", "source_ip", "ip_unique_dst_ports")


def q_sys_heuristics(spark, d):
    df = sys_feat_df(spark, d, W_LONG)
    return df.select("row_id", "ip_event_count", "ip_failed_count", "heuristic_brute_force",
                     "heuristic_priv_esc")


def q_net_heuristics(spark, d):
    df = net_feat_df(spark, d, W_LONG)
    return df.select("row_id", "ip_unique_dst_ports", "heuristic_port_scan", "heuristic_dos",
                     "heuristic_exfil", "heuristic_firewall_activity")


def q_flag_counts(spark, d):
    return FE.flag_counts(sys_feat_df(spark, d, W_LONG))


def q_standardise(spark, d):
    from ..operators.scaling import standardise
    df = FE.system_features(sys_clean_df(spark, d), W_SHORT)
    z = standardise(df, C.SYSTEM_FEATURE_COLS, prefix="z_")
    return z.select("row_id", *[f"z_{c}" for c in C.SYSTEM_FEATURE_COLS])


def raw_scores(spark, d) -> DataFrame:
    """Stand-in raw detector scores for the A16/M3 checks."""
    e = events(spark, d)
    return e.select(F.col("event_id").alias("row_id"), F.col("value").alias("raw_if"),
                    ((F.col("event_id") % 97) / 7.0).alias("raw_oc"))


def q_minmax(spark, d):
    from ..operators.scaling import minmax
    df = minmax(raw_scores(spark, d), {"raw_if": "if_norm", "raw_oc": "oc_norm"})
    return df.select("row_id", "if_norm", "oc_norm")


def q_ensemble_score(spark, d):
    from ..operators.detect import combine_scores
    df = combine_scores(raw_scores(spark, d), "raw_if", "raw_oc")
    return df.select("row_id", "anomaly_score", "is_anomaly")


def q_sys_alerts(spark, d):
    return out(sys_alerts_df(spark, d))


def q_net_alerts(spark, d):
    return out(net_alerts_df(spark, d))


def q_alert_union(spark, d):
    return out(alerts_df(spark, d))


def q_alert_head(spark, d):
    return out(AL.alert_head(alerts_df(spark, d)).select(
        "log_type", "row_id", "attack_type", "severity", "confidence"))


def q_risk_score(spark, d):
    return scored_df(spark, d).select("log_type", "row_id", "attack_type", "severity",
                                      "confidence", "risk_score", "risk_level")


def q_risk_levels(spark, d):
    return V.risk_level_counts(scored_df(spark, d))


def q_attack_counts(spark, d):
    return V.attack_counts(scored_df(spark, d))


def q_timeline_hourly(spark, d):
    return V.hourly_timeline(scored_df(spark, d))


def q_ioc_top(spark, d):
    t = V.ioc_top(scored_df(spark, d))
    return t.select("value", "type", "event_count",
                    F.array_join("attack_types", ",").alias("attack_types"))


def q_unique_sources(spark, d):
    return V.unique_sources(scored_df(spark, d))


def q_source_top(spark, d):
    return V.source_top(scored_df(spark, d))


def q_heatmap(spark, d):
    return V.day_hour_heatmap(scored_df(spark, d))


def q_risk_histogram(spark, d):
    return V.risk_histogram(scored_df(spark, d))


def q_severity_distribution(spark, d):
    return V.severity_distribution(scored_df(spark, d))


def q_cluster_summary(spark, d):
    return out(V.cluster_summary(clustered_df(spark, d)))


def q_cluster_count(spark, d):
    return V.cluster_count(clustered_df(spark, d))


def q_campaigns(spark, d):
    return V.campaigns(V.cluster_summary(clustered_df(spark, d)))


def q_recommendations(spark, d):
    return V.recommendations(scored_df(spark, d))


def q_top_alerts(spark, d):
    return V.top_alerts(scored_df(spark, d))


def q_latest_alerts(spark, d):
    return V.latest_alerts(scored_df(spark, d))


def q_triage_queue(spark, d):
    return TR.triage_queue(scored_df(spark, d))


def q_response_candidates(spark, d):
    return TR.response_candidates(scored_df(spark, d))


def q_skill_eligibility(spark, d):
    return TR.skill_eligibility(scored_df(spark, d))


def q_eval_labels(spark, d):
    df = EV.label_rows(B.eval_input(events(spark, d)))
    return df.select("grp", "day", "reference_label", "predicted_label")


def q_confusion_matrix(spark, d):
    return EV.confusion_matrix(B.eval_input(events(spark, d))).select(
        "true_label", "predicted_label", "count")


def q_top_confusions(spark, d):
    return EV.top_confusions(B.eval_input(events(spark, d)))


def q_eval_metrics(spark, d):
    return EV.evaluate_predictions(B.eval_input(events(spark, d)))


def q_observation_window(spark, d):
    return V.observation_window(scored_df(spark, d))


def q_exec_stats(spark, d):
    s = V.exec_stats(scored_df(spark, d))

    def flat(m):
        return F.array_join(F.array_sort(F.transform(
            F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))),
            ";")
    return s.select("total", "critical", "high", "medium", "low",
                    flat("attack_types").alias("attack_types"), flat("top_ips").alias("top_ips"))


QUERIES = {
    "sys_clean": q_sys_clean,
    "net_clean": q_net_clean,
    "ipv4_encode": q_ipv4_encode,
    "external_ip": q_external_ip,
    "external_ip_strict": q_external_ip_strict,
    "category_codes": q_category_codes,
    "first_seen_code": q_first_seen_code,
    "calendar_features": q_calendar_features,
    "ip_event_window": q_ip_event_window,
    "ip_failed_window": q_ip_failed_window,
    "ip_distinct_ports": q_ip_distinct_ports,
    "sys_heuristics": q_sys_heuristics,
    "net_heuristics": q_net_heuristics,
    "flag_counts": q_flag_counts,
    "standardise": q_standardise,
    "minmax": q_minmax,
    "ensemble_score": q_ensemble_score,
    "sys_alerts": q_sys_alerts,
    "net_alerts": q_net_alerts,
    "alert_union": q_alert_union,
    "alert_head": q_alert_head,
    "risk_score": q_risk_score,
    "risk_levels": q_risk_levels,
    "attack_counts": q_attack_counts,
    "timeline_hourly": q_timeline_hourly,
    "ioc_top": q_ioc_top,
    "unique_sources": q_unique_sources,
    "source_top": q_source_top,
    "heatmap": q_heatmap,
    "risk_histogram": q_risk_histogram,
    "severity_distribution": q_severity_distribution,
    "cluster_summary": q_cluster_summary,
    "cluster_count": q_cluster_count,
    "campaigns": q_campaigns,
    "recommendations": q_recommendations,
    "top_alerts": q_top_alerts,
    "latest_alerts": q_latest_alerts,
    "triage_queue": q_triage_queue,
    "response_candidates": q_response_candidates,
    "skill_eligibility": q_skill_eligibility,
    "eval_labels": q_eval_labels,
    "confusion_matrix": q_confusion_matrix,
    "top_confusions": q_top_confusions,
    "eval_metrics": q_eval_metrics,
    "observation_window": q_observation_window,
    "exec_stats": q_exec_stats,
}


# ---- sources, ingestion and streaming -------------------------------------

def aliased_system_log(spark, d) -> DataFrame:
    """A system log with foreign header names (mixed case, padded)."""
    e = events(spark, d)
    return e.select(
        B.ts_text(F.col("ts")).alias(" Event_Time "),
        F.concat(F.lit("10.0."), (F.col("user_id") % 50).cast("string"), F.lit(".1")).alias("SRC_IP"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("Account"),
        F.upper(F.col("event_type")).alias("Action"),
        F.col("props").alias("Extra_Field"),
        F.col("event_id").alias("row_id"))


def q_alias_resolve(spark, d):
    from ..sources.aliases import normalize_headers, resolve_aliases
    return resolve_aliases(normalize_headers(aliased_system_log(spark, d)),
                           C.SYSTEM_COLUMN_ALIASES, "system")


def event_xml(spark, d) -> DataFrame:
    """Windows logon events as exported XML documents, derived from events."""
    e = events(spark, d)
    u, eid = F.col("user_id"), F.col("event_id")

    def data(name, value):
        return F.concat(F.lit(f'<Data Name="{name}">'), value, F.lit("</Data>"))
    ip = (F.when(u % 4 == 0, F.lit("-"))
           .when(u % 4 == 1, F.concat(F.lit("  10.0.0."), (u % 250).cast("string"), F.lit("  ")))
           .when(u % 4 == 2, F.lit(""))
           .otherwise(F.concat(F.lit("192.168.1."), (u % 200).cast("string"))))
    target = F.when(eid % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("user"), u.cast("string")))
    dup = F.when(eid % 7 == 0, data("TargetUserName", F.concat(F.lit("dup"), u.cast("string")))) \
           .otherwise(F.lit(""))
    wid = F.when(F.col("event_type") == "error", F.lit("4625")).otherwise(F.lit("4624"))
    xml = F.concat(
        F.lit('<Event><System><Provider Name="Security-Auditing"/><EventID>'), wid,
        F.lit('</EventID><TimeCreated SystemTime="'), B.ts_text(F.col("ts")),
        F.lit('"/><Channel>Security</Channel></System><EventData>'),
        data("IpAddress", ip),
        data("SourceNetworkAddress", F.concat(F.lit("172.16.0."), (eid % 250).cast("string"))),
        data("TargetUserName", target),
        data("SubjectUserName", F.concat(F.lit("svc"), (u % 7).cast("string"))),
        dup,
        F.lit("</EventData><Message>An  account\n logon "), F.col("event_type"),
        F.lit("</Message></Event>"))
    return e.select(eid.alias("row_id"), xml.alias("xml"))


def parsed_events(spark, d) -> DataFrame:
    from ..sources.winevent import parse_events
    return parse_events(event_xml(spark, d)).withColumn(
        "time_ts", F.col("time_created").try_cast("timestamp"))


def q_event_extract(spark, d):
    from ..sources.winevent import security_rows
    return security_rows(parsed_events(spark, d), keep=("row_id",))


def q_flow_group(spark, d):
    from ..operators.flows import group_flows
    e = events(spark, d)
    u, eid = F.col("user_id"), F.col("event_id")
    rows = e.select(
        B.ts_text(F.col("ts")).alias("timestamp"),
        F.lit("firewall").alias("log_type"),
        F.when(u % 3 == 0, "FIREWALL_RULE_ADDED").when(u % 3 == 1, "FIREWALL_RULE_MODIFIED")
         .otherwise("FIREWALL_BLOCK_NOTIFICATION").alias("event_type"),
        (F.lit(2000) + u % 3).cast("int").alias("event_id"),
        F.concat(F.lit("Rule changed "), (u % 4).cast("string")).alias("event_message"),
        F.when(eid % 2 == 0, F.concat(F.lit("Host-"), (u % 5).cast("string")))
         .otherwise(F.concat(F.lit("host-"), (u % 5).cast("string"))).alias("source_ip"),
        F.lit("").alias("destination_ip"),
        (u % 2).cast("int").alias("source_port"),
        (F.lit(440) + u % 4).cast("int").alias("destination_port"),
        F.when(eid % 3 == 0, "TCP").otherwise("tcp").alias("protocol"),
        F.lit("").alias("user"), F.lit("fw").alias("service"),
        (eid % 2).cast("int").alias("failed_count"),
        F.lit("INFORMATION").alias("log_level"),
        F.lit("").alias("query_name"), F.lit("").alias("query_type"),
        F.when(eid % 5 == 0, "Allow").otherwise("allow").alias("action"))
    return group_flows(rows)


def q_source_filter(spark, d):
    from ..sources.winevent import parse_events, quick_fields, source_filter
    left = source_filter(quick_fields(event_xml(spark, d)), "2024-01-15 00:00:00",
                         ids=[C.LOGON_FAILED_ID], max_events=800)
    parsed = parse_events(left.drop("win_event_id"))
    return parsed.select("row_id", "win_event_id", "time_created", "provider")


def q_table_sink(spark, d):
    from ..sources.csv_logs import system_table
    from ..sources.winevent import security_rows
    return system_table(security_rows(parsed_events(spark, d)))


def events_stream(spark, d, schema) -> DataFrame:
    """The events table as a file stream (new files in the folder arrive as batches)."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet")
                 .option("maxFilesPerTrigger", 1).parquet(d))


def judged_stream(spark, d, minutes: int, keep: tuple[str, ...] = ()) -> str:
    """Folder of the rule's output on a stream of the events table."""
    from ..streaming.live import append_to, brute_force_stream
    e = events(spark, d)
    clean = B.standin_scores(clean_system(B.security_log(events_stream(spark, d, e.schema))))
    return append_to(spark, brute_force_stream(clean, minutes, keep))


def q_live_counts(spark, d):
    """Z1 on the stored output of the rule stream: alerts per event-time hour,
    by model score, privilege escalation or brute force."""
    from ..streaming.live import hourly_counts, upsert_to
    judged = judged_stream(spark, d, W_STREAM, ("is_anomaly", "event_code"))
    schema = spark.read.parquet(judged).schema
    rows = spark.readStream.schema(schema).parquet(judged)
    alerts = rows.where((F.col("is_anomaly") == 1) | (F.col("event_code") == 2)
                        | (F.col("heuristic_brute_force") == 1))
    res = upsert_to(spark, hourly_counts(alerts), "hour_start")
    return res.select(F.col("hour_start").cast("timestamp_ntz").alias("hour_start"), "alert_count")


def q_rule_stream(spark, d):
    """Z2 on a stream of the events table: look-back brute-force rule."""
    return spark.read.parquet(judged_stream(spark, d, W_STREAM)).select(
        "row_id", "ip_event_count", "ip_failed_count", "heuristic_brute_force")


QUERIES.update({
    "alias_resolve": q_alias_resolve,
    "event_extract": q_event_extract,
    "flow_group": q_flow_group,
    "source_filter": q_source_filter,
    "table_sink": q_table_sink,
    "live_counts": q_live_counts,
    "rule_stream": q_rule_stream,
})
