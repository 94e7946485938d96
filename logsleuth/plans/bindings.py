"""Input bindings: log tables derived from the driver's ``events`` table.

The library reads security/network logs; the test data has an ``events``
table instead.  These functions derive raw logs from it (string columns, as a
header CSV scan would give) so that every job's work grows with ``events``.
The same derivations are written in SQL in ``plans/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as C


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(col: Column, pairs: list[tuple], default) -> Column:
    out = None
    for k, v in pairs:
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out.otherwise(default)


def ts_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def standin_scores(df: DataFrame) -> DataFrame:
    """Deterministic stand-ins for the learned columns (FIXTURES §3)."""
    score = F.least(F.col("value") / 200, F.lit(1.0))
    return df.withColumns({
        "anomaly_score": score,
        "is_anomaly": (score >= C.ANOMALY_SCORE_THRESHOLD).cast("int"),
    })


def security_log(events: DataFrame) -> DataFrame:
    """Raw system/auth log (``SYSTEM_REQUIRED`` columns + event_id, row_id, value)."""
    u, et = F.col("user_id"), F.col("event_type")
    return events.select(
        F.col("event_id").alias("row_id"),
        ts_text(F.col("ts")).alias("timestamp"),
        _case(u % 6, [(0, "10.1.0.7"), (1, "192.168.7.1"), (2, "172.16.4.9"),
                      (3, "172.32.4.9"), (4, "203.0.113.5")], "unknown").alias("source_ip"),
        _case(u % 4, [(0, "root"), (1, "Administrator"), (2, "admin")],
              F.concat(F.lit("user"), u.cast("string"))).alias("user"),
        _case(u % 3, [(0, "sshd"), (1, F.lit(None).cast("string"))], " winlogon ").alias("service"),
        _case(et, [("error", "LOGIN_FAILED"), ("signup", "PRIVILEGE_ESCALATION"),
                   ("view", "OTHER")], "LOGIN_SUCCESS").alias("event"),
        F.when(et == "error", "4625").otherwise("4624").alias("event_id"),
        F.when(et == "error", "1").otherwise("0").alias("failed_count"),
        F.when(et == "error", "WARNING").otherwise("INFORMATION").alias("log_level"),
        F.col("value"),
        F.col("user_id"),
    )


def network_log(events: DataFrame) -> DataFrame:
    """Raw network log (firewall / dns / security rows) with the optional columns."""
    u, et, eid = F.col("user_id"), F.col("event_type"), F.col("event_id")
    return events.select(
        eid.alias("row_id"),
        ts_text(F.col("ts")).alias("timestamp"),
        _case(et, [("error", "firewall"), ("click", "dns")], "security").alias("log_type"),
        _case(et, [("error", "FIREWALL_BLOCK_NOTIFICATION"), ("click", "DNS_EVENT"),
                   ("purchase", "outbound_flow"), ("view", "inbound_flow")],
              "session_open").alias("event_type"),
        (F.lit(2000) + u % 100).cast("string").alias("event_id"),
        F.concat(F.lit("observed "), et, F.lit(" "), F.col("props")).alias("event_message"),
        _case(u % 6, [(0, ""), (1, "10.1.0.7"), (2, "172.16.4.9"), (3, "172.32.4.9"),
                      (4, "203.0.113.5")], "8.8.8.8").alias("source_ip"),
        _case(et, [("purchase", "93.184.216.34"), ("view", "192.168.1.10")], "")
            .alias("destination_ip"),
        ((eid * 13) % 65536).cast("string").alias("source_port"),
        F.when(et == "signup", F.lit(0)).otherwise(1 + (eid * 37) % 2000).cast("string")
            .alias("destination_port"),
        _case(u % 4, [(0, "tcp"), (1, " UDP "), (2, "DNS")], "").alias("protocol"),
        _case(u % 5, [(0, "nan"), (1, "fwsvc")], "").alias("service"),
        F.when(et == "error", "warning").alias("log_level"),
        F.floor(F.col("value") / 5).cast("int").cast("string")
            .alias("connection_observation_count"),
        (F.col("value") * 1.5).cast("string").alias("duration_sec"),
        F.col("value"),
        F.col("user_id"),
    )


def eval_input(events: DataFrame) -> DataFrame:
    """Evaluation input (F42 columns + predicted ``attack_type``) per
    (user group, day) of ``events``."""
    g = F.col("user_id") % 25
    day = F.to_date(F.col("ts"))
    agg = (events.groupBy(g.alias("grp"), day.alias("day"))
                 .agg((F.count(F.lit(1)) * 10).alias("request_frequency"),
                      (F.sum("value") * 100).alias("packets_sum"),
                      (F.count_if(F.col("event_type") == "error") * 4).alias("failed_login_count"),
                      F.count_distinct((F.col("event_id") * 37) % 2000).alias("unique_ports"),
                      (F.sum("value") * 20000).alias("bytes_sum")))
    pred = _case(F.col("grp") % 6, [(0, "DoS"), (1, "Brute Force"), (2, "Port Scan"),
                                    (3, "Data Exfiltration"), (4, "data_exfiltration")],
                 "Unknown")
    return agg.withColumn("attack_type", pred)
