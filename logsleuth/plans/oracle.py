"""DuckDB twins of the registered queries (``plans/catalog.py``).

Written directly in SQL over the pre-registered ``events`` view, as an
independent statement of each operator's semantics.  Every literal that
feeds floating-point arithmetic is cast to DOUBLE so DuckDB does not switch
to exact decimal arithmetic.
"""

from __future__ import annotations

from .. import constants as C
from .catalog import DETECTED_AT, STRICT_ADDRESSES, W_LONG, W_SHORT, W_STREAM


def _ipint(x: str) -> str:
    parts = [f"CAST(TRY_CAST(split_part({x}, '.', {i}) AS BIGINT) AS HUGEINT)" for i in range(1, 5)]
    return (f"COALESCE(TRY_CAST({parts[0]} * 16777216 + {parts[1]} * 65536 + {parts[2]} * 256 "
            f"+ {parts[3]} AS BIGINT), 0)")


def _ext(x: str) -> str:
    return (f"CASE WHEN trim({x}) = '' OR lower(trim({x})) IN ('unknown','none','nan','-') THEN 0 "
            f"WHEN starts_with({x}, '10.') OR starts_with({x}, '127.') "
            f"OR starts_with({x}, '192.168.') OR starts_with({x}, '169.254.') THEN 0 "
            f"WHEN starts_with({x}, '172.') AND TRY_CAST(split_part({x}, '.', 2) AS INTEGER) "
            f"BETWEEN 16 AND 31 THEN 0 "
            f"WHEN {x} IN ('::1', '::', '0.0.0.0') THEN 0 ELSE 1 END")


def _strict(x: str) -> str:
    """Expected results by probe shape: fixed rows for the listed texts, octet
    by octet for the dotted ones."""
    listed = " ".join(f"WHEN '{k}' THEN {v}" for k, v in STRICT_ADDRESSES.items())
    o = [f"TRY_CAST(split_part({x}, '.', {i}) AS BIGINT)" for i in range(1, 5)]
    private = (f"{o[0]} IN (0, 10, 127) OR {o[0]} >= 240 OR {o[0]} = 169 AND {o[1]} = 254 "
               f"OR {o[0]} = 172 AND {o[1]} BETWEEN 16 AND 31 OR {o[0]} = 192 AND {o[1]} = 168 "
               f"OR {o[0]} = 192 AND {o[1]} = 0 AND {o[2]} = 0 AND {o[3]} NOT IN (9, 10) "
               f"OR {o[0]} = 192 AND {o[1]} = 0 AND {o[2]} = 2 OR {o[0]} = 198 AND {o[1]} IN (18, 19) "
               f"OR {o[0]} = 198 AND {o[1]} = 51 AND {o[2]} = 100 OR {o[0]} = 203 AND {o[1]} = 0 AND {o[2]} = 113")
    return (f"CASE {x} {listed} ELSE CASE WHEN len(string_split({x}, '.')) <> 4 OR {o[0]} IS NULL OR {o[0]} > 255 "
            f"OR {private} THEN 0 ELSE 1 END END")


def _case_map(x: str, mapping: dict, default, quote_val=True) -> str:
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return str(v)
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"CASE {x} {whens} ELSE {lit(default)} END"


def _cal(ts: str) -> str:
    return (f"CAST(hour({ts}) AS INTEGER) AS hour, CAST(minute({ts}) AS INTEGER) AS minute, "
            f"CAST(isodow({ts}) - 1 AS INTEGER) AS day_of_week, "
            f"CASE WHEN hour({ts}) < 6 OR hour({ts}) >= 22 THEN 1 ELSE 0 END AS is_night")


def base_ctes(w_sys: int = W_LONG, w_net: int = W_LONG) -> str:
    ws, wn = w_sys * 60000, w_net * 60000
    strict_texts = ", ".join(f"'{x}'" for x in STRICT_ADDRESSES)
    sev = _case_map("attack_type", C.ATTACK_SEVERITY, C.DEFAULT_BASE_SEVERITY)
    desc = _case_map("attack_type", C.DESCRIPTIONS, None).replace("ELSE None", "ELSE NULL")
    rec = _case_map("attack_type", C.RECOMMENDATIONS, None).replace("ELSE None", "ELSE NULL")
    cx = _case_map("attack_type", C.COMPLEXITY, C.RISK_DEFAULT_COMPLEXITY)
    return f"""
ev AS (SELECT event_id AS eid, ts, user_id AS uid, event_type AS et, value, props FROM events),
sec AS (
  SELECT eid AS row_id, ts, value, uid AS user_id,
    CASE uid % 6 WHEN 0 THEN '10.1.0.7' WHEN 1 THEN '192.168.7.1' WHEN 2 THEN '172.16.4.9'
         WHEN 3 THEN '172.32.4.9' WHEN 4 THEN '203.0.113.5' ELSE 'unknown' END AS source_ip,
    CASE uid % 4 WHEN 0 THEN 'root' WHEN 1 THEN 'Administrator' WHEN 2 THEN 'admin'
         ELSE 'user' || CAST(uid AS VARCHAR) END AS user_name,
    CASE uid % 3 WHEN 0 THEN 'sshd' WHEN 1 THEN 'nan' ELSE 'winlogon' END AS service,
    CASE et WHEN 'error' THEN 'LOGIN_FAILED' WHEN 'signup' THEN 'PRIVILEGE_ESCALATION'
         WHEN 'view' THEN 'OTHER' ELSE 'LOGIN_SUCCESS' END AS event,
    CASE WHEN et = 'error' THEN 4625 ELSE 4624 END AS event_id,
    CASE WHEN et = 'error' THEN 1 ELSE 0 END AS failed_count,
    CASE WHEN et = 'error' THEN 'WARNING' ELSE 'INFORMATION' END AS log_level
  FROM ev),
sys_clean AS (
  SELECT *, epoch_ms(ts) AS ts_ms, {_cal('ts')},
    CASE event WHEN 'LOGIN_SUCCESS' THEN 0 WHEN 'LOGIN_FAILED' THEN 1
         WHEN 'PRIVILEGE_ESCALATION' THEN 2 ELSE 3 END AS event_code,
    CASE log_level WHEN 'INFO' THEN 0 WHEN 'WARNING' THEN 1 WHEN 'ERROR' THEN 2 ELSE 0 END
      AS log_level_code,
    {_ipint('source_ip')} AS source_ip_int,
    {_ext('source_ip')} AS is_external_ip,
    CASE WHEN user_name IN ('root', 'admin', 'administrator') THEN 1 ELSE 0 END
      AS is_privileged_user
  FROM sec WHERE lower(source_ip) NOT IN ('', 'unknown', 'none', 'nan', '-', '::1')),
sys_feat AS (
  SELECT *, COUNT(*) OVER w AS ip_event_count,
    CAST(SUM(failed_count) OVER w AS BIGINT) AS ip_failed_count
  FROM sys_clean
  WINDOW w AS (PARTITION BY source_ip ORDER BY ts_ms RANGE BETWEEN {ws} PRECEDING AND CURRENT ROW)),
sys_flag AS (
  SELECT *,
    CASE WHEN failed_count >= 5 OR ip_failed_count >= 5 THEN 1 ELSE 0 END AS heuristic_brute_force,
    CASE WHEN event_code = 2 THEN 1 ELSE 0 END AS heuristic_priv_esc,
    least(value / 200, CAST(1.0 AS DOUBLE)) AS anomaly_score
  FROM sys_feat),
sys_al0 AS (
  SELECT *, CASE WHEN anomaly_score >= 0.55 THEN 1 ELSE 0 END AS is_anomaly,
    CASE WHEN heuristic_priv_esc = 1 THEN 'privilege_escalation'
         WHEN heuristic_brute_force = 1 THEN 'brute_force' ELSE 'unknown_anomaly' END AS attack_type
  FROM sys_flag),
sys_al1 AS (
  SELECT *, CASE WHEN is_anomaly = 1 THEN 0 ELSE 1 END AS rule_based_alert, {sev} AS base_severity,
    CASE WHEN is_anomaly = 1 THEN round_even(anomaly_score * 100 * 10, 0) / 10
         ELSE CAST(75.0 AS DOUBLE) END AS confidence
  FROM sys_al0 WHERE is_anomaly = 1 OR heuristic_brute_force = 1 OR heuristic_priv_esc = 1),
sys_alerts AS (
  SELECT '{DETECTED_AT}' AS detected_at, ts AS "timestamp", source_ip, attack_type,
    CAST(CASE WHEN confidence > 85 THEN least(5, base_severity + 1) ELSE base_severity END
         AS INTEGER) AS severity,
    confidence, anomaly_score, {desc} AS description, {rec} AS recommendation,
    'system' AS log_type, 'real_collected' AS data_origin, rule_based_alert,
    hour, is_external_ip, user_name AS "user", service, event, event_id, log_level,
    row_id, user_id
  FROM sys_al1),
net AS (
  SELECT eid AS row_id, ts, value, uid AS user_id,
    CASE et WHEN 'error' THEN 'firewall' WHEN 'click' THEN 'dns' ELSE 'security' END AS log_type,
    CASE et WHEN 'error' THEN 'FIREWALL_BLOCK_NOTIFICATION' WHEN 'click' THEN 'DNS_EVENT'
         WHEN 'purchase' THEN 'OUTBOUND_FLOW' WHEN 'view' THEN 'INBOUND_FLOW'
         ELSE 'SESSION_OPEN' END AS event_type,
    CAST(2000 + uid % 100 AS INTEGER) AS event_id,
    'observed ' || et || ' ' || props AS event_message,
    CASE uid % 6 WHEN 0 THEN '' WHEN 1 THEN '10.1.0.7' WHEN 2 THEN '172.16.4.9'
         WHEN 3 THEN '172.32.4.9' WHEN 4 THEN '203.0.113.5' ELSE '8.8.8.8' END AS source_ip,
    CASE et WHEN 'purchase' THEN '93.184.216.34' WHEN 'view' THEN '192.168.1.10' ELSE '' END
      AS destination_ip,
    CAST((eid * 13) % 65536 AS INTEGER) AS source_port,
    CAST(CASE WHEN et = 'signup' THEN 0 ELSE 1 + (eid * 37) % 2000 END AS INTEGER)
      AS destination_port,
    CASE uid % 4 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' WHEN 2 THEN 'DNS' ELSE '' END AS protocol,
    '' AS user_name, CASE uid % 5 WHEN 0 THEN 'nan' WHEN 1 THEN 'fwsvc' ELSE '' END AS service,
    '' AS query_name, '' AS query_type, '' AS action, 0 AS failed_count,
    CASE WHEN et = 'error' THEN 'WARNING' ELSE 'INFORMATION' END AS log_level,
    CAST(floor(value / 5) AS INTEGER) AS connection_observation_count,
    value * CAST(1.5 AS DOUBLE) AS duration_sec
  FROM ev),
et_codes AS (
  SELECT event_type,
    CAST(row_number() OVER (ORDER BY min(row_id), event_type) - 1 AS INTEGER) AS event_type_code
  FROM net GROUP BY event_type),
net_clean AS (
  SELECT n.*, epoch_ms(ts) AS ts_ms, {_cal('ts')},
    CASE protocol WHEN 'TCP' THEN 0 WHEN 'UDP' THEN 1 WHEN 'ICMP' THEN 2 WHEN 'DNS' THEN 3
         ELSE 4 END AS protocol_code,
    CASE log_type WHEN 'security' THEN 0 WHEN 'firewall' THEN 1 WHEN 'dns' THEN 2 ELSE 3 END
      AS log_type_code,
    c.event_type_code,
    {_ipint('source_ip')} AS source_ip_int, {_ipint('destination_ip')} AS destination_ip_int,
    {_ext('source_ip')} AS is_external_src, {_ext('destination_ip')} AS is_external_dst,
    CASE WHEN length(source_ip) > 0 THEN 1 ELSE 0 END AS has_source_ip,
    CASE WHEN length(destination_ip) > 0 THEN 1 ELSE 0 END AS has_destination_ip,
    CASE WHEN source_port > 0 THEN 1 ELSE 0 END AS has_source_port,
    CASE WHEN destination_port > 0 THEN 1 ELSE 0 END AS has_destination_port,
    CASE WHEN length(protocol) > 0 THEN 1 ELSE 0 END AS has_protocol,
    CAST(length(event_message) AS INTEGER) AS event_message_length,
    CASE WHEN log_type = 'firewall' THEN 1 ELSE 0 END AS is_firewall_event,
    CASE WHEN log_type = 'dns' THEN 1 ELSE 0 END AS is_dns_event,
    CASE WHEN log_type = 'security' THEN 1 ELSE 0 END AS is_security_event,
    connection_observation_count / (duration_sec + CAST(0.001 AS DOUBLE))
      AS connection_observation_rate,
    CASE WHEN destination_port > 0 AND destination_port < 1024 THEN 1 ELSE 0 END
      AS is_well_known_port
  FROM net n JOIN et_codes c USING (event_type)),
net_feat AS (
  SELECT *, CAST(COUNT(DISTINCT destination_port) OVER w AS INTEGER) AS ip_unique_dst_ports
  FROM net_clean
  WINDOW w AS (PARTITION BY source_ip ORDER BY ts_ms RANGE BETWEEN {wn} PRECEDING AND CURRENT ROW)),
net_flag AS (
  SELECT *,
    CASE WHEN ip_unique_dst_ports >= 10 AND has_destination_port = 1 THEN 1 ELSE 0 END
      AS heuristic_port_scan,
    CASE WHEN connection_observation_count >= 25 AND (has_destination_port = 1
         OR has_destination_ip = 1 OR is_firewall_event = 1) THEN 1 ELSE 0 END AS heuristic_dos,
    CASE WHEN is_external_dst = 1 AND connection_observation_count >= 20 AND duration_sec >= 60
         THEN 1 ELSE 0 END AS heuristic_exfil,
    CASE WHEN is_firewall_event = 1 AND connection_observation_count >= 2 THEN 1 ELSE 0 END
      AS heuristic_firewall_activity,
    least(value / 200, CAST(1.0 AS DOUBLE)) AS anomaly_score
  FROM net_feat),
net_al0 AS (
  SELECT *, CASE WHEN anomaly_score >= 0.55 THEN 1 ELSE 0 END AS is_anomaly,
    CASE WHEN heuristic_firewall_activity = 1 THEN 'firewall_activity'
         WHEN heuristic_dos = 1 THEN 'dos' WHEN heuristic_exfil = 1 THEN 'data_exfiltration'
         WHEN heuristic_port_scan = 1 THEN 'port_scan' ELSE 'unknown_anomaly' END AS attack_type
  FROM net_flag),
net_al1 AS (
  SELECT *, CASE WHEN is_anomaly = 1 THEN 0 ELSE 1 END AS rule_based_alert, {sev} AS base_severity,
    CASE WHEN is_anomaly = 1 THEN round_even(anomaly_score * 100 * 10, 0) / 10
         ELSE CAST(75.0 AS DOUBLE) END AS confidence
  FROM net_al0 WHERE is_anomaly = 1 OR heuristic_port_scan = 1 OR heuristic_dos = 1
    OR heuristic_exfil = 1 OR heuristic_firewall_activity = 1),
net_alerts AS (
  SELECT '{DETECTED_AT}' AS detected_at, ts AS "timestamp", source_ip, attack_type,
    CAST(CASE WHEN confidence > 85 THEN least(5, base_severity + 1) ELSE base_severity END
         AS INTEGER) AS severity,
    confidence, anomaly_score, {desc} AS description, {rec} AS recommendation,
    'network' AS log_type, 'real_collected' AS data_origin, rule_based_alert,
    destination_ip, destination_port, connection_observation_count, connection_observation_rate,
    duration_sec, hour, is_external_src, user_name AS "user", service, event_type, event_id,
    event_message, log_level, query_name, query_type, action, row_id, user_id
  FROM net_al1),
alerts AS (SELECT * FROM sys_alerts UNION ALL BY NAME SELECT * FROM net_alerts),
scored0 AS (
  SELECT *, round_even(least(greatest((
      CAST(0.35 AS DOUBLE) * (least(greatest(CAST(severity AS DOUBLE), 0), 5) / 5)
    + CAST(0.25 AS DOUBLE) * (least(greatest(confidence, 0), 100) / 100)
    + CAST(0.15 AS DOUBLE) * COALESCE(CAST(is_external_ip AS DOUBLE), CAST(0 AS DOUBLE))
    + CAST(0.15 AS DOUBLE) * {cx}
    + CAST(0.1 AS DOUBLE) * CASE WHEN hour < 6 OR hour >= 22 THEN CAST(1.0 AS DOUBLE)
                                ELSE CAST(0.5 AS DOUBLE) END) * 10, 0), 10) * 100, 0) / 100
    AS risk_score
  FROM alerts),
scored AS (
  SELECT *, CASE WHEN risk_score >= 8.0 THEN 'Critical' WHEN risk_score >= 6.0 THEN 'High'
                 WHEN risk_score >= 4.0 THEN 'Medium' ELSE 'Low' END AS risk_level
  FROM scored0),
clustered AS (SELECT *, CAST(user_id % 5 AS INTEGER) AS cluster_kmeans FROM scored),
probe AS (
  SELECT eid AS row_id,
    CASE eid % 12
      WHEN 0 THEN concat_ws('.', uid % 300, eid % 256, (eid * 7) % 256, uid % 256)
      WHEN 1 THEN concat_ws('.', uid % 300, eid % 256, (eid * 7) % 256, uid % 256) || '.7'
      WHEN 2 THEN concat_ws('.', uid % 300, eid % 256, (eid * 7) % 256)
      WHEN 3 THEN 'host-' || CAST(uid AS VARCHAR)
      WHEN 4 THEN '172.' || CAST(eid % 40 AS VARCHAR) || '.0.1'
      WHEN 5 THEN '192.168.' || CAST(eid % 256 AS VARCHAR) || '.1'
      WHEN 6 THEN '10.' || CAST(eid % 256 AS VARCHAR) || '.0.1'
      WHEN 7 THEN '::1'
      WHEN 8 THEN '198.18.' || CAST(eid % 256 AS VARCHAR) || '.1'
      WHEN 9 THEN '100.64.0.' || CAST(eid % 256 AS VARCHAR)
      WHEN 10 THEN [{strict_texts}][(eid // 12) % {len(STRICT_ADDRESSES)} + 1]
      ELSE 'unknown' END AS address
  FROM ev),
evalin AS (
  SELECT uid % 25 AS grp, CAST(ts AS DATE) AS day, count(*) * 10 AS request_frequency,
    sum(value) * 100 AS packets_sum, count(*) FILTER (WHERE et = 'error') * 4 AS failed_login_count,
    count(DISTINCT (eid * 37) % 2000) AS unique_ports, sum(value) * 20000 AS bytes_sum
  FROM ev GROUP BY 1, 2),
evlab AS (
  SELECT grp, day,
    CASE WHEN request_frequency > 120 AND packets_sum > 15000 THEN 'DoS'
         WHEN failed_login_count > 10 THEN 'Brute Force' WHEN unique_ports > 12 THEN 'Port Scan'
         WHEN bytes_sum > 10000000 AND request_frequency < 20 THEN 'Data Exfiltration'
         ELSE 'Unknown' END AS reference_label,
    CASE grp % 6 WHEN 0 THEN 'DoS' WHEN 1 THEN 'Brute Force' WHEN 2 THEN 'Port Scan'
         WHEN 3 THEN 'Data Exfiltration' ELSE 'Unknown' END AS predicted_label
  FROM evalin),
labels AS (SELECT * FROM (VALUES (0, 'DoS'), (1, 'Brute Force'), (2, 'Port Scan'),
                                 (3, 'Data Exfiltration'), (4, 'Unknown')) t(idx, label)),
confusion AS (
  SELECT t.idx AS true_idx, t.label AS true_label, p.idx AS pred_idx, p.label AS predicted_label,
    CAST(COALESCE(c.n, 0) AS BIGINT) AS count
  FROM labels t CROSS JOIN labels p
  LEFT JOIN (SELECT reference_label, predicted_label, count(*) AS n FROM evlab GROUP BY 1, 2) c
    ON c.reference_label = t.label AND c.predicted_label = p.label),
src_lab AS (
  SELECT CASE WHEN l IN ('nan', 'None', 'none', 'unknown', '-') THEN '' ELSE l END AS source_label
  FROM (SELECT CASE WHEN f <> '' THEN f WHEN trim(COALESCE(service, '')) <> ''
                    THEN trim(COALESCE(service, '')) ELSE trim(COALESCE(log_type, '')) END AS l
        FROM (SELECT *, CASE WHEN trim(COALESCE(source_ip, '')) IN ('nan', 'None', 'none',
                    'unknown', '-') THEN '' ELSE trim(COALESCE(source_ip, '')) END AS f
              FROM scored))),
ioc0 AS (
  SELECT CASE WHEN lower(trim(COALESCE(source_ip, 'nan'))) IN ('', 'nan', 'none', 'unknown')
              THEN trim(COALESCE(event_type, 'nan')) ELSE trim(COALESCE(source_ip, 'nan')) END
           AS value,
         CASE WHEN lower(trim(COALESCE(source_ip, 'nan'))) IN ('', 'nan', 'none', 'unknown')
              THEN 'event_signature' ELSE 'ip_address' END AS type,
         row_id AS o,
         CASE WHEN trim(COALESCE(attack_type, 'unknown')) NOT IN ('', 'unknown')
              THEN trim(attack_type) END AS atk
  FROM scored),
ioc AS (
  SELECT value, arg_min(type, o) AS type, count(*) AS event_count,
    array_to_string(list_sort(list_distinct(list(atk))), ',')
      AS attack_types
  FROM ioc0 WHERE value <> '' AND value <> 'unknown' GROUP BY value)
"""


def _with(body: str, w_sys: int = W_LONG, w_net: int = W_LONG) -> str:
    return "WITH " + base_ctes(w_sys, w_net) + "\n" + body


def _risk_levels() -> str:
    return ("SELECT count(*) AS total, count(*) FILTER (WHERE risk_level = 'Critical') AS critical, "
            "count(*) FILTER (WHERE risk_level = 'High') AS high, "
            "count(*) FILTER (WHERE risk_level = 'Medium') AS medium, "
            "count(*) FILTER (WHERE risk_level = 'Low') AS low FROM scored")


def _cluster_summary() -> str:
    return """, dom AS (
  SELECT cluster_kmeans, attack_type, row_number() OVER (PARTITION BY cluster_kmeans
         ORDER BY count(*) DESC, attack_type) AS rn
  FROM clustered WHERE attack_type IS NOT NULL GROUP BY cluster_kmeans, attack_type),
summ AS (
  SELECT c.cluster_kmeans AS cluster_id, count(c.attack_type) AS count,
    COALESCE(any_value(d.attack_type), 'unknown') AS dominant_attack,
    avg(CAST(severity AS DOUBLE)) AS avg_severity, max(CAST(severity AS DOUBLE)) AS max_severity,
    avg(confidence) AS avg_confidence, count(DISTINCT nullif(source_ip, '')) AS unique_ips,
    min("timestamp") AS start_time, max("timestamp") AS end_time
  FROM clustered c LEFT JOIN dom d ON d.cluster_kmeans = c.cluster_kmeans AND d.rn = 1
  GROUP BY c.cluster_kmeans)
"""


def _ts_text(x: str) -> str:
    return (f"strftime({x}, '%Y-%m-%d %H:%M:%S') || CASE WHEN epoch_us({x}) % 1000000 = 0 "
            f"THEN '' ELSE '.' || strftime({x}, '%f') END || '+00:00'")


def _heatmap() -> str:
    hs = ", ".join(f"count(*) FILTER (WHERE h = {h}) AS h{h:02d}" for h in range(24))
    cs = ", ".join(f"CAST(COALESCE(g.h{h:02d}, 0) AS BIGINT) AS h{h:02d}" for h in range(24))
    days = ", ".join(f"({i}, '{n}')" for i, n in enumerate(C.DAY_NAMES))
    return (f"SELECT d.day_index, d.day, {cs} FROM (VALUES {days}) d(day_index, day) "
            f"LEFT JOIN (SELECT CAST(isodow(\"timestamp\") - 1 AS INTEGER) AS day_index, {hs} "
            f"FROM (SELECT \"timestamp\", hour(\"timestamp\") AS h FROM scored) GROUP BY 1) g "
            f"USING (day_index)")


def _recommendations() -> str:
    rows = ", ".join(
        "({}, {}, '{}', '{}', '{}')".format(n, "NULL" if a is None else f"'{a}'", p,
                                           act.replace("'", "''"), why.replace("'", "''"))
        for n, a, p, act, why in C.REPORT_RECOMMENDATIONS)
    return (f"SELECT rule_no, priority, action, rationale FROM (VALUES {rows}) "
            f"r(rule_no, attack_type, priority, action, rationale) "
            f"WHERE attack_type IS NULL OR attack_type IN (SELECT attack_type FROM scored)")


def _skills() -> str:
    rows = ", ".join(f"({i}, '{n}', '{s}')" for i, (n, sk) in enumerate(C.ANALYSTS) for s in sk)
    return f"(VALUES {rows}) s(analyst_idx, analyst, attack_type)"


def _text_or_blank(c: str) -> str:
    return f"COALESCE({c}, '') AS {c}"


SQL: dict[str, str] = {}
RESPONSE_CANDIDATES = (
    "SELECT COALESCE(source_ip, 'nan') AS source_ip, "
    "COALESCE(attack_type, 'unknown_anomaly') AS attack_type, "
    "CAST(COALESCE(severity, 0) AS INTEGER) AS severity, round(COALESCE(risk_score, 0), 2) "
    "AS risk_score, CAST(row_number() OVER (ORDER BY risk_score DESC, log_type, row_id) - 1 "
    "AS INTEGER) AS rank FROM scored ORDER BY risk_score DESC, log_type, row_id LIMIT 8")


def _build() -> None:
    q = SQL
    q["sys_clean"] = _with(
        "SELECT row_id, ts AS \"timestamp\", source_ip, user_name AS \"user\", service, event, "
        "event_id, failed_count, log_level, hour, minute, day_of_week, is_night, event_code, "
        "log_level_code, source_ip_int, is_external_ip, is_privileged_user FROM sys_clean")
    q["net_clean"] = _with(
        "SELECT row_id, ts AS \"timestamp\", log_type, event_type, event_id, event_message, "
        "source_ip, destination_ip, source_port, destination_port, protocol, service, log_level, "
        "connection_observation_count, duration_sec, hour, is_night, protocol_code, log_type_code, "
        "event_type_code, source_ip_int, destination_ip_int, is_external_src, is_external_dst, "
        "has_source_ip, has_destination_ip, has_source_port, has_destination_port, has_protocol, "
        "event_message_length, is_firewall_event, is_dns_event, is_security_event, "
        "connection_observation_rate, is_well_known_port FROM net_clean")
    q["ipv4_encode"] = _with(f"SELECT row_id, address, {_ipint('address')} AS address_int FROM probe")
    q["external_ip"] = _with(
        f"SELECT row_id, address, CAST({_ext('address')} AS INTEGER) AS is_external FROM probe")
    q["external_ip_strict"] = _with(
        f"SELECT row_id, address, CAST({_strict('address')} AS INTEGER) AS is_external FROM probe")
    q["category_codes"] = _with(
        "SELECT row_id, protocol, protocol_code, log_type, log_type_code FROM net_clean")
    q["first_seen_code"] = _with("SELECT event_type, event_type_code FROM et_codes")
    q["calendar_features"] = _with(
        "SELECT row_id, hour, minute, day_of_week, is_night FROM sys_clean")
    q["ip_event_window"] = _with(
        "SELECT row_id, source_ip, ip_event_count, ip_failed_count FROM sys_feat", W_SHORT)
    q["ip_failed_window"] = _with(
        "SELECT row_id, source_ip, ip_event_count, ip_failed_count FROM sys_feat")
    q["ip_distinct_ports"] = _with("SELECT row_id, source_ip, ip_unique_dst_ports FROM net_feat")
    q["sys_heuristics"] = _with(
        "SELECT row_id, ip_event_count, ip_failed_count, heuristic_brute_force, heuristic_priv_esc "
        "FROM sys_flag")
    q["net_heuristics"] = _with(
        "SELECT row_id, ip_unique_dst_ports, heuristic_port_scan, heuristic_dos, heuristic_exfil, "
        "heuristic_firewall_activity FROM net_flag")
    q["flag_counts"] = _with(
        "SELECT heuristic_brute_force, heuristic_priv_esc, count(*) AS row_count FROM sys_flag "
        "GROUP BY 1, 2")
    zs = []
    for c in C.SYSTEM_FEATURE_COLS:
        v = f"CAST(COALESCE({c}, 0) AS DOUBLE)"
        zs.append(f"CASE WHEN stddev_pop({v}) OVER () = 0 THEN {v} - avg({v}) OVER () "
                  f"ELSE ({v} - avg({v}) OVER ()) / stddev_pop({v}) OVER () END AS z_{c}")
    q["standardise"] = _with(
        "SELECT row_id, " + ", ".join(zs) + " FROM (SELECT *, "
        "CASE WHEN failed_count >= 5 OR ip_failed_count >= 5 THEN 1 ELSE 0 END AS heuristic_brute_force, "
        "CASE WHEN event_code = 2 THEN 1 ELSE 0 END AS heuristic_priv_esc FROM sys_feat)", W_SHORT)
    raw = ("(SELECT eid AS row_id, value AS raw_if, (eid % 97) / CAST(7.0 AS DOUBLE) AS raw_oc "
           "FROM ev)")
    mm = ("(raw_if - min(raw_if) OVER ()) / (max(raw_if) OVER () - min(raw_if) OVER () "
          "+ CAST(1e-9 AS DOUBLE)) AS if_norm, (raw_oc - min(raw_oc) OVER ()) / "
          "(max(raw_oc) OVER () - min(raw_oc) OVER () + CAST(1e-9 AS DOUBLE)) AS oc_norm")
    q["minmax"] = _with(f"SELECT row_id, {mm} FROM {raw}")
    q["ensemble_score"] = _with(
        f"SELECT row_id, s AS anomaly_score, CAST(s >= 0.55 AS INTEGER) AS is_anomaly FROM ("
        f"SELECT row_id, CAST(0.65 AS DOUBLE) * if_norm + CAST(0.35 AS DOUBLE) * oc_norm AS s "
        f"FROM (SELECT row_id, {mm} FROM {raw}))")
    q["sys_alerts"] = _with("SELECT * FROM sys_alerts")
    q["net_alerts"] = _with("SELECT * FROM net_alerts")
    q["alert_union"] = _with("SELECT * FROM alerts")
    q["alert_head"] = _with(
        "SELECT log_type, row_id, attack_type, severity, confidence FROM alerts "
        "ORDER BY severity DESC, confidence DESC, row_id LIMIT 15")
    q["risk_score"] = _with(
        "SELECT log_type, row_id, attack_type, severity, confidence, risk_score, risk_level "
        "FROM scored")
    q["risk_levels"] = _with(_risk_levels())
    q["attack_counts"] = _with(
        "SELECT attack_type, count(*) AS alert_count FROM scored WHERE attack_type IS NOT NULL "
        "GROUP BY 1")
    q["timeline_hourly"] = _with(
        "SELECT g.h AS hour_start, strftime(g.h, '%Y-%m-%d %H:%M') AS \"timestamp\", "
        "COALESCE(c.alert_count, 0) AS alert_count, COALESCE(c.row_count, 0) AS row_count "
        "FROM (SELECT unnest(generate_series(min(date_trunc('hour', \"timestamp\")), "
        "max(date_trunc('hour', \"timestamp\")), INTERVAL 1 HOUR)) AS h FROM scored) g "
        "LEFT JOIN (SELECT date_trunc('hour', \"timestamp\") AS h, count(attack_type) AS alert_count, "
        "count(*) AS row_count FROM scored GROUP BY 1) c USING (h)")
    q["ioc_top"] = _with(
        "SELECT value, type, event_count, attack_types FROM ioc "
        "ORDER BY event_count DESC, value LIMIT 10")
    q["unique_sources"] = _with(
        "SELECT least(count(*), 10) AS unique_sources, count(*) AS unique_sources_total FROM ioc")
    q["source_top"] = _with(
        "SELECT source_label, count(*) AS alert_count FROM src_lab WHERE source_label <> '' "
        "GROUP BY 1 ORDER BY alert_count DESC, source_label LIMIT 10")
    q["heatmap"] = _with(_heatmap())
    q["risk_histogram"] = _with(
        "SELECT b.bin, b.bin * CAST(0.5 AS DOUBLE) AS bin_start, "
        "(b.bin + 1) * CAST(0.5 AS DOUBLE) AS bin_end, COALESCE(c.n, 0) AS alert_count "
        "FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(20)) b LEFT JOIN "
        "(SELECT CAST(least(floor(risk_score / CAST(0.5 AS DOUBLE)), 19) AS INTEGER) AS bin, "
        "count(*) AS n FROM scored WHERE risk_score IS NOT NULL GROUP BY 1) c USING (bin)")
    q["severity_distribution"] = _with(
        "SELECT risk_level AS level, count(*) AS alert_count FROM scored GROUP BY 1")
    q["cluster_summary"] = _with(_cluster_summary() + "SELECT * FROM summ")
    q["cluster_count"] = _with(
        "SELECT count(DISTINCT cluster_kmeans) AS n_clusters FROM clustered")
    q["campaigns"] = _with(
        _cluster_summary() + "SELECT CAST(cluster_id AS INTEGER) AS cluster_id, dominant_attack, "
        "count AS event_count, unique_ips, round(avg_severity, 2) AS avg_severity, "
        "CAST(max_severity AS INTEGER) AS max_severity, "
        f"{_ts_text('start_time')} || ' → ' || {_ts_text('end_time')} AS time_range FROM summ")
    q["recommendations"] = _with(_recommendations())
    q["top_alerts"] = _with(
        "SELECT detected_at, COALESCE(source_ip, '') AS source_ip, attack_type, severity, "
        "risk_score, risk_level, description, recommendation FROM scored "
        "ORDER BY risk_score DESC, log_type, row_id LIMIT 20")
    dash = [c for c in C.DASHBOARD_ALERT_COLUMNS]
    text_cols = {"detected_at", "source_ip", "destination_ip", "attack_type", "risk_level",
                 "description", "recommendation", "log_type", "data_origin", "event_type",
                 "event_message", "log_level"}
    sel = ", ".join(_text_or_blank(c) if c in text_cols else c for c in dash)
    q["latest_alerts"] = _with(
        f"SELECT {sel}, (SELECT count(*) FROM scored) AS total FROM scored "
        f"ORDER BY severity DESC, log_type, row_id LIMIT 100")
    prio = ("CAST(2.0 AS DOUBLE) * COALESCE(CAST(severity AS DOUBLE), 0) + CAST(0.06 AS DOUBLE) * "
            "COALESCE(confidence, 0) + CAST(0.8 AS DOUBLE) * COALESCE(risk_score, 0)")
    q["triage_queue"] = _with(
        f"SELECT COALESCE(source_ip, 'nan') AS source_ip, COALESCE(attack_type, 'nan') AS attack_type, "
        f"CAST(COALESCE(severity, 0) AS INTEGER) AS severity, round(COALESCE(confidence, 0), 1) "
        f"AS confidence, round(COALESCE(risk_score, 0), 2) AS risk_score, round({prio}, 2) AS priority "
        f"FROM scored ORDER BY {prio} DESC, log_type, row_id LIMIT 10")
    q["response_candidates"] = _with(RESPONSE_CANDIDATES)
    skills = _skills()
    q["skill_eligibility"] = _with(
        f"SELECT a.log_type, a.row_id, a.attack_type, s.analyst_idx, s.analyst FROM scored a "
        f"JOIN {skills} ON s.attack_type = a.attack_type UNION ALL "
        f"SELECT a.log_type, a.row_id, a.attack_type, s.analyst_idx, s.analyst FROM scored a "
        f"JOIN {skills} ON s.attack_type = '{C.FALLBACK_SKILL}' WHERE a.attack_type NOT IN "
        f"(SELECT attack_type FROM {skills.replace(' s(', ' s2(')})")
    q["eval_labels"] = _with("SELECT grp, day, reference_label, predicted_label FROM evlab")
    q["confusion_matrix"] = _with("SELECT true_label, predicted_label, count FROM confusion")
    q["top_confusions"] = _with(
        "SELECT true_label, predicted_label, count FROM confusion "
        "WHERE true_label <> predicted_label AND count > 0 "
        "ORDER BY count DESC, true_idx, pred_idx LIMIT 10")
    q["eval_metrics"] = _with("""
, per AS (
  SELECT l.label, COALESCE(tp.n, 0) AS tp, COALESCE(s.n, 0) AS support, COALESCE(p.n, 0) AS predicted
  FROM labels l
  LEFT JOIN (SELECT true_label AS label, count AS n FROM confusion WHERE true_label = predicted_label) tp USING (label)
  LEFT JOIN (SELECT true_label AS label, sum(count) AS n FROM confusion GROUP BY 1) s USING (label)
  LEFT JOIN (SELECT predicted_label AS label, sum(count) AS n FROM confusion GROUP BY 1) p USING (label)),
pr AS (
  SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE CAST(0 AS DOUBLE) END AS p,
            CASE WHEN support > 0 THEN tp / support ELSE CAST(0 AS DOUBLE) END AS r FROM per),
prf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE CAST(0 AS DOUBLE) END AS f FROM pr)
SELECT round(CASE WHEN sum(support) > 0 THEN sum(tp) / sum(support) ELSE 0 END, 4) AS accuracy,
  round(CASE WHEN sum(support) > 0 THEN sum(p * support) / sum(support) ELSE 0 END, 4) AS precision_weighted,
  round(CASE WHEN sum(support) > 0 THEN sum(r * support) / sum(support) ELSE 0 END, 4) AS recall_weighted,
  round(CASE WHEN sum(support) > 0 THEN sum(f * support) / sum(support) ELSE 0 END, 4) AS f1_weighted,
  CAST(sum(support) AS BIGINT) AS support FROM prf""")
    q["observation_window"] = _with(
        "SELECT min(\"timestamp\") AS start, max(\"timestamp\") AS \"end\", count(*) AS total_alerts "
        "FROM scored")
    q["exec_stats"] = _with(
        f", lv AS ({_risk_levels()}), "
        "ty AS (SELECT string_agg(attack_type || '=' || CAST(n AS VARCHAR), ';' ORDER BY "
        "attack_type || '=' || CAST(n AS VARCHAR)) AS attack_types FROM (SELECT attack_type, "
        "count(*) AS n FROM scored WHERE attack_type IS NOT NULL GROUP BY 1)), "
        "tp AS (SELECT string_agg(source_label || '=' || CAST(n AS VARCHAR), ';' ORDER BY "
        "source_label || '=' || CAST(n AS VARCHAR)) AS top_ips FROM (SELECT source_label, count(*) "
        "AS n FROM src_lab WHERE source_label <> '' GROUP BY 1 ORDER BY n DESC, source_label "
        "LIMIT 5)) SELECT * FROM lv, ty, tp")


_build()


def _ts_iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S.%f')"


def _security_rows_sql() -> str:
    return f"""
SELECT eid AS row_id, {_ts_iso('ts')} AS "timestamp", 'security' AS log_type,
  CASE WHEN et = 'error' THEN 'LOGIN_FAILED' ELSE 'LOGIN_SUCCESS' END AS event_type,
  CASE WHEN et = 'error' THEN 4625 ELSE 4624 END AS event_id,
  'An account logon ' || et AS event_message,
  CASE uid % 4 WHEN 1 THEN '10.0.0.' || CAST(uid % 250 AS VARCHAR)
       WHEN 3 THEN '192.168.1.' || CAST(uid % 200 AS VARCHAR)
       ELSE '172.16.0.' || CAST(eid % 250 AS VARCHAR) END AS source_ip,
  '' AS destination_ip, 0 AS source_port, 0 AS destination_port, '' AS protocol,
  CASE WHEN eid % 7 = 0 THEN 'dup' || CAST(uid AS VARCHAR)
       WHEN eid % 5 = 0 THEN 'svc' || CAST(uid % 7 AS VARCHAR)
       ELSE 'user' || CAST(uid AS VARCHAR) END AS "user",
  'Security-Auditing' AS service,
  CASE WHEN et = 'error' THEN 1 ELSE 0 END AS failed_count,
  CASE WHEN et = 'error' THEN 'WARNING' ELSE 'INFORMATION' END AS log_level,
  '' AS query_name, '' AS query_type, '' AS action
FROM ev"""


def _flow_sql() -> str:
    payload = ["timestamp", "log_type", "event_type", "event_id", "event_message", "source_ip",
               "destination_ip", "source_port", "destination_port", "protocol", "user",
               "service", "failed_count", "log_level", "query_name", "query_type", "action"]
    firsts = ", ".join(f'arg_min("{c}", ts) AS "{c}"' for c in payload)
    keys = ", ".join(f'lower(CAST("{k}" AS VARCHAR))' for k in C.FLOW_KEYS)
    return f"""
, r AS (
  SELECT {_ts_iso('ts')} AS "timestamp", ts, 'firewall' AS log_type,
    CASE uid % 3 WHEN 0 THEN 'FIREWALL_RULE_ADDED' WHEN 1 THEN 'FIREWALL_RULE_MODIFIED'
         ELSE 'FIREWALL_BLOCK_NOTIFICATION' END AS event_type,
    CAST(2000 + uid % 3 AS INTEGER) AS event_id,
    'Rule changed ' || CAST(uid % 4 AS VARCHAR) AS event_message,
    CASE WHEN eid % 2 = 0 THEN 'Host-' ELSE 'host-' END || CAST(uid % 5 AS VARCHAR) AS source_ip,
    '' AS destination_ip, CAST(uid % 2 AS INTEGER) AS source_port,
    CAST(440 + uid % 4 AS INTEGER) AS destination_port,
    CASE WHEN eid % 3 = 0 THEN 'TCP' ELSE 'tcp' END AS protocol, '' AS "user", 'fw' AS service,
    CAST(eid % 2 AS INTEGER) AS failed_count, 'INFORMATION' AS log_level, '' AS query_name,
    '' AS query_type, CASE WHEN eid % 5 = 0 THEN 'Allow' ELSE 'allow' END AS action
  FROM ev)
SELECT {firsts}, count(*) AS connection_observation_count,
  round_even(greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0) * 1000, 0) / 1000
    AS duration_sec
FROM r GROUP BY {keys}"""


def _build_sources() -> None:
    q = SQL
    q["alias_resolve"] = _with(
        f"SELECT {_ts_iso('ts')} AS \"timestamp\", 'user' || CAST(uid AS VARCHAR) AS \"user\", "
        f"'10.0.' || CAST(uid % 50 AS VARCHAR) || '.1' AS ip, upper(et) AS event_type, "
        f"props AS extra_field, eid AS row_id, 'unknown' AS process_name FROM ev")
    q["event_extract"] = _with(_security_rows_sql())
    q["flow_group"] = _with(_flow_sql())
    q["source_filter"] = _with(
        f"SELECT eid AS row_id, 4625 AS win_event_id, {_ts_iso('ts')} AS time_created, "
        f"'Security-Auditing' AS provider FROM ev WHERE et = 'error' "
        f"AND ts >= TIMESTAMP '2024-01-15 00:00:00' ORDER BY ts DESC, eid LIMIT 800")
    q["table_sink"] = _with(
        "SELECT \"timestamp\", source_ip, \"user\", service, event_type AS event, event_id, "
        f"failed_count, log_level FROM ({_security_rows_sql()})")
    q["live_counts"] = _with(
        "SELECT date_trunc('hour', ts) AS hour_start, count(*) AS alert_count FROM sys_flag "
        "WHERE anomaly_score >= 0.55 OR event_code = 2 OR heuristic_brute_force = 1 GROUP BY 1", W_STREAM)
    q["rule_stream"] = _with(
        "SELECT row_id, ip_event_count, ip_failed_count, heuristic_brute_force FROM sys_flag", W_STREAM)


_build_sources()
