"""Fixed values that results depend on.

FIXED VALUES: everything in this module must equal the behaviour being
reproduced (thresholds, lookup tables, texts, label sets).  They are stated
plainly and in their natural order; operators read them from here.
"""

from __future__ import annotations

# ---- FIXED VALUES: detection thresholds -----------------------------------
WINDOW_MINUTES = 10
BRUTE_FORCE_FAILED_LOGINS = 5
PORT_SCAN_UNIQUE_PORTS = 10
DOS_CONNECTION_OBSERVATIONS = 25
EXFIL_CONNECTION_OBSERVATIONS = 20
EXFIL_MIN_DURATION_SEC = 60
FIREWALL_MIN_OBSERVATIONS = 2
ANOMALY_SCORE_THRESHOLD = 0.55
ENSEMBLE_WEIGHT_IFOREST = 0.65
ENSEMBLE_WEIGHT_OCSVM = 0.35
MINMAX_EPS = 1e-9
IFOREST_N_ESTIMATORS = 100
IFOREST_MAX_SAMPLES = 256
OCSVM_NU = 0.05
RANDOM_SEED = 42
KMEANS_N_CLUSTERS = 5
KMEANS_N_INIT = 10
DBSCAN_EPS = 0.5
DBSCAN_MIN_SAMPLES = 5
CLUSTER_MIN_ROWS = 5
CLASSIFIER_MIN_ROWS = 10
CLASSIFIER_TREES = 100
CLASSIFIER_TEST_FRACTION = 0.2
RULE_CONFIDENCE = 75.0
SEVERITY_BOOST_CONFIDENCE = 85.0
MAX_SEVERITY = 5
DEFAULT_BASE_SEVERITY = 3
DATA_ORIGIN = "real_collected"

# ---- FIXED VALUES: attack severity (1=low ... 5=critical) -----------------
ATTACK_SEVERITY = {
    "normal": 0,
    "brute_force": 4,
    "port_scan": 2,
    "dos": 5,
    "data_exfiltration": 5,
    "firewall_activity": 3,
    "privilege_escalation": 4,
    "unknown_anomaly": 3,
}
TOP_SEVERITY = max(ATTACK_SEVERITY.values())

# ---- FIXED VALUES: alert texts by attack type ------------------------------
RECOMMENDATIONS = {
    "brute_force": "Block source IP. Enforce MFA. Implement account lockout after 5 failures.",
    "privilege_escalation": "Audit sudo rules. Review PAM config. Alert SOC immediately.",
    "port_scan": "Block source IP at firewall. Review exposed services. Enable IDS rules.",
    "dos": "Rate-limit source IP. Enable CDN/WAF. Scale or failover target service.",
    "data_exfiltration": "Isolate source host. Revoke credentials. Capture network forensics.",
    "firewall_activity": "Review recent firewall rule or profile changes. Confirm they match approved change control.",
    "unknown_anomaly": "Investigate manually. Capture full logs for the source IP in this window.",
}

DESCRIPTIONS = {
    "brute_force": "Repeated failed login attempts detected from a single source.",
    "privilege_escalation": "Attempt to gain elevated system privileges detected.",
    "port_scan": "Rapid probe of multiple destination ports from a single source.",
    "dos": "Sustained high-rate connection observations targeting a host/service.",
    "data_exfiltration": "Sustained outbound connection observations toward external destinations.",
    "firewall_activity": "Firewall rule or profile change activity detected in the Windows event logs.",
    "unknown_anomaly": "Anomalous behaviour detected by ML model without matching heuristic.",
}

# ---- FIXED VALUES: risk score weights and complexity -----------------------
RISK_WEIGHT_SEVERITY = 0.35
RISK_WEIGHT_CONFIDENCE = 0.25
RISK_WEIGHT_EXTERNAL = 0.15
RISK_WEIGHT_COMPLEXITY = 0.15
RISK_WEIGHT_TIME = 0.10
RISK_DEFAULT_COMPLEXITY = 0.7
RISK_TIME_NIGHT = 1.0
RISK_TIME_DAY = 0.5
RISK_TIME_UNKNOWN = 0.7
COMPLEXITY = {
    "dos": 0.5,
    "port_scan": 0.4,
    "brute_force": 0.6,
    "privilege_escalation": 0.8,
    "data_exfiltration": 0.9,
    "unknown_anomaly": 1.0,
}
# risk level lower bounds, highest first
RISK_LEVELS = [("Critical", 8.0), ("High", 6.0), ("Medium", 4.0)]
RISK_LEVEL_DEFAULT = "Low"

# ---- FIXED VALUES: triage priority weights ---------------------------------
TRIAGE_W_SEVERITY = 2.0
TRIAGE_W_CONFIDENCE = 0.06
TRIAGE_W_RISK = 0.8
TRIAGE_LIMIT = 10

# ---- FIXED VALUES: response planning ---------------------------------------
# analysts in their fixed order, each with the attack types they handle
ANALYSTS = [
    ("analyst_alpha", ["brute_force", "privilege_escalation", "unknown_anomaly"]),
    ("analyst_bravo", ["dos", "port_scan", "unknown_anomaly"]),
    ("analyst_charlie", ["data_exfiltration", "privilege_escalation", "unknown_anomaly"]),
]
FALLBACK_SKILL = "unknown_anomaly"
RESPONSE_MAX_ASSIGNMENTS = 8
RESPONSE_MAX_PER_ANALYST = 3

# ---- FIXED VALUES: report recommendation rules -----------------------------
# (rule number, attack type that triggers it or None for always, priority, action, rationale)
REPORT_RECOMMENDATIONS = [
    (1, "brute_force", "HIGH",
     "Enforce MFA across all remote access services (SSH, VPN, RDP).",
     "Brute force attacks detected against login services."),
    (2, "brute_force", "HIGH",
     "Implement IP-based account lockout after 5 consecutive failures.",
     "Limit attacker retry rate."),
    (3, "port_scan", "MEDIUM",
     "Review firewall rules — block non-essential ports at perimeter.",
     "Port scanning activity suggests attacker reconnaissance."),
    (4, "dos", "CRITICAL",
     "Enable rate limiting and DDoS protection on public-facing services.",
     "DoS attacks detected targeting internal hosts."),
    (5, "data_exfiltration", "CRITICAL",
     "Isolate suspected hosts immediately and conduct forensic review.",
     "Large outbound data transfers detected to external IPs."),
    (6, "data_exfiltration", "CRITICAL",
     "Deploy DLP (Data Loss Prevention) policies on egress traffic.",
     "Prevent future exfiltration attempts."),
    (7, "privilege_escalation", "HIGH",
     "Audit and tighten sudo/PAM configuration on all servers.",
     "Privilege escalation attempts detected."),
    (8, None, "MEDIUM",
     "Deploy centralised SIEM for real-time log correlation.",
     "Improve detection speed and reduce mean time to respond (MTTR)."),
]

# ---- FIXED VALUES: evaluation labels and rule thresholds -------------------
EVAL_LABELS = ["DoS", "Brute Force", "Port Scan", "Data Exfiltration", "Unknown"]
EVAL_DOS_FREQUENCY = 120
EVAL_DOS_PACKETS = 15_000
EVAL_BRUTE_FAILED = 10
EVAL_SCAN_PORTS = 12
EVAL_EXFIL_BYTES = 10_000_000
EVAL_EXFIL_MAX_FREQUENCY = 20

# ---- FIXED VALUES: cleaning vocabularies -----------------------------------
# tokens a pandas CSV read turns into missing values
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null"]
# placeholder source addresses dropped from system logs (compared lower-case)
SYSTEM_IP_PLACEHOLDERS = ["", "unknown", "none", "nan", "-", "::1"]
# values that count as "no address" for the external-IP test (lower-case)
EXTERNAL_IP_BLANKS = ["unknown", "none", "nan", "-"]
INTERNAL_IP_PREFIXES = ["10.", "127.", "192.168.", "169.254."]
INTERNAL_IP_EXACT = ["::1", "::", "0.0.0.0"]
PRIVILEGED_USERS = ["root", "admin", "administrator"]
# labels treated as blank for source labels (exact match)
SOURCE_LABEL_BLANKS = ["nan", "None", "none", "unknown", "-"]
# IOC value placeholders (compared lower-case)
IOC_BLANKS = ["", "nan", "none", "unknown"]
# characters str.strip() removes (ASCII and common Unicode spaces)
STRIP_CHARS = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
               "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")

# ---- FIXED VALUES: category codes ------------------------------------------
EVENT_CODES = {"LOGIN_SUCCESS": 0, "LOGIN_FAILED": 1, "PRIVILEGE_ESCALATION": 2}
EVENT_CODE_DEFAULT = 3
LOG_LEVEL_CODES = {"INFO": 0, "WARNING": 1, "ERROR": 2}
LOG_LEVEL_CODE_DEFAULT = 0
PROTOCOL_CODES = {"TCP": 0, "UDP": 1, "ICMP": 2, "DNS": 3}
PROTOCOL_CODE_DEFAULT = 4
LOG_TYPE_CODES = {"security": 0, "firewall": 1, "dns": 2}
LOG_TYPE_CODE_DEFAULT = 3
NIGHT_START_HOUR = 22
NIGHT_END_HOUR = 6

# ---- FIXED VALUES: Windows event ids ---------------------------------------
LOGON_SUCCESS_ID = 4624
LOGON_FAILED_ID = 4625
FIREWALL_EVENT_TYPES = {
    2010: "FIREWALL_PROFILE_CHANGE",
    2011: "FIREWALL_BLOCK_NOTIFICATION",
    2052: "FIREWALL_RULE_DELETED",
    2059: "FIREWALL_RULE_MODIFIED",
    2097: "FIREWALL_RULE_ADDED",
    2099: "FIREWALL_RULE_MODIFIED",
}
FIREWALL_EVENT_DEFAULT = "FIREWALL_EVENT"
DNS_EVENT_TYPE = "DNS_EVENT"
WARNING_EVENT_IDS = [4625, 2011, 2052]
FIREWALL_PROFILE_CHANGE_ID = 2010
# values never used as an address taken from event data
EVENT_DATA_IGNORED = ["-", "::1", "127.0.0.1"]
# event-data keys searched in order, per output field
SECURITY_KEYS = {
    "source_ip": ["IpAddress", "SourceNetworkAddress", "ClientAddress", "SourceAddress"],
    "user": ["TargetUserName", "SubjectUserName", "AccountName"],
}
FIREWALL_KEYS = {
    "protocol": ["Protocol"],
    "source_ip": ["SourceAddress", "LocalAddress", "RemoteAddress"],
    "destination_ip": ["DestinationAddress", "LocalAddress", "RemoteAddress"],
    "source_port": ["SourcePort", "LocalPort", "Port"],
    "destination_port": ["DestinationPort", "Port", "LocalPort"],
    "action": ["Action", "Direction"],
}
DNS_KEYS = {
    "query_name": ["QueryName", "Name", "HostName"],
    "query_type": ["QueryType", "Type"],
    "source_ip": ["InterfaceIpAddress", "Address", "ClientAddress"],
    "destination_ip": ["ServerAddress", "DnsServerAddress", "DestinationAddress"],
}

# ---- FIXED VALUES: column sets ---------------------------------------------
SYSTEM_REQUIRED = ["timestamp", "source_ip", "user", "service", "event",
                   "failed_count", "log_level"]
SYSTEM_NOT_NULL = ["timestamp", "source_ip", "event", "failed_count", "log_level"]
NETWORK_REQUIRED = ["timestamp", "log_type", "event_type", "event_id", "event_message",
                    "connection_observation_count", "duration_sec"]
NETWORK_NOT_NULL = ["timestamp", "log_type", "event_type", "event_id", "event_message"]
NETWORK_TEXT_OPTIONAL = ["source_ip", "destination_ip", "protocol", "user", "service",
                         "query_name", "query_type", "action"]
NETWORK_NUMERIC = ["source_port", "destination_port", "event_id", "failed_count",
                   "connection_observation_count", "duration_sec"]
FLOW_KEYS = ["log_type", "event_type", "event_id", "event_message", "source_ip",
             "destination_ip", "source_port", "destination_port", "protocol", "user",
             "service", "query_name", "query_type", "action", "log_level"]
SYSTEM_OUTPUT_COLUMNS = ["timestamp", "source_ip", "user", "service", "event", "event_id",
                         "failed_count", "log_level"]
NETWORK_OUTPUT_COLUMNS = ["timestamp", "log_type", "event_type", "event_id", "event_message",
                          "source_ip", "destination_ip", "source_port", "destination_port",
                          "protocol", "user", "service", "failed_count", "log_level",
                          "query_name", "query_type", "action",
                          "connection_observation_count", "duration_sec"]

SYSTEM_FEATURE_COLS = [
    "failed_count", "event_code", "log_level_code", "hour", "is_night",
    "is_external_ip", "is_privileged_user", "ip_event_count", "ip_failed_count",
    "heuristic_brute_force", "heuristic_priv_esc",
]
NETWORK_FEATURE_COLS = [
    "duration_sec", "connection_observation_count", "connection_observation_rate",
    "log_type_code", "event_id", "event_type_code", "event_message_length",
    "protocol_code", "source_port", "destination_port", "is_well_known_port",
    "is_external_src", "is_external_dst", "has_source_ip", "has_destination_ip",
    "has_source_port", "has_destination_port", "has_protocol", "is_firewall_event",
    "is_dns_event", "is_security_event", "hour", "is_night",
    "heuristic_port_scan", "heuristic_dos", "heuristic_exfil",
    "heuristic_firewall_activity",
]
SYSTEM_HEURISTICS = ["heuristic_brute_force", "heuristic_priv_esc"]
NETWORK_HEURISTICS = ["heuristic_port_scan", "heuristic_dos", "heuristic_exfil",
                      "heuristic_firewall_activity"]

ALERT_FIXED_COLUMNS = ["detected_at", "timestamp", "source_ip", "attack_type", "severity",
                       "confidence", "anomaly_score", "description", "recommendation",
                       "log_type", "data_origin", "rule_based_alert"]
ALERT_OPTIONAL_COLUMNS = ["destination_ip", "destination_port", "connection_observation_count",
                          "connection_observation_rate", "duration_sec", "hour",
                          "is_external_ip", "is_external_src", "user", "service", "event",
                          "event_type", "event_id", "event_message", "log_level",
                          "query_name", "query_type", "action"]
DASHBOARD_ALERT_COLUMNS = ["detected_at", "source_ip", "destination_ip", "destination_port",
                           "attack_type", "severity", "confidence", "risk_score",
                           "risk_level", "description", "recommendation", "log_type",
                           "data_origin", "event_type", "event_id", "event_message",
                           "log_level", "connection_observation_count",
                           "connection_observation_rate", "duration_sec"]
TOP_ALERT_COLUMNS = ["detected_at", "source_ip", "attack_type", "severity", "risk_score",
                     "risk_level", "description", "recommendation"]
CLUSTER_FEATURES = ["anomaly_score", "severity", "confidence", "hour", "is_external_ip"]
CLUSTER_FEATURES_NET = ["anomaly_score", "severity", "confidence", "hour",
                        "connection_observation_count", "connection_observation_rate"]

# ---- FIXED VALUES: column-name aliases (target -> candidates in order) -----
SYSTEM_COLUMN_ALIASES = {
    "timestamp": ["timestamp", "time", "event_time", "datetime", "ts"],
    "user": ["user", "username", "account", "principal", "actor"],
    "ip": ["ip", "src_ip", "source_ip", "client_ip", "host_ip"],
    "event_type": ["event_type", "event", "action", "event_name", "status"],
    "process_name": ["process_name", "process", "proc", "service", "application"],
}
NETWORK_COLUMN_ALIASES = {
    "timestamp": ["timestamp", "time", "event_time", "datetime", "ts"],
    "src_ip": ["src_ip", "source_ip", "ip", "client_ip", "src"],
    "dst_ip": ["dst_ip", "destination_ip", "dest_ip", "server_ip", "dst"],
    "dst_port": ["dst_port", "destination_port", "port", "server_port"],
    "protocol": ["protocol", "proto", "transport"],
    "packets": ["packets", "packet_count", "pkt_count", "pkts"],
    "bytes_sent": ["bytes_sent", "bytes", "bytes_out", "byte_count", "payload_bytes"],
}
SYSTEM_ALIAS_REQUIRED = ["timestamp", "ip", "event_type"]
NETWORK_ALIAS_REQUIRED = ["timestamp", "src_ip", "dst_port", "packets", "bytes_sent"]
SYSTEM_ALIAS_DEFAULTS = {"user": "unknown", "process_name": "unknown"}
NETWORK_ALIAS_DEFAULTS = {"dst_ip": "unknown", "protocol": "UNKNOWN"}

# ---- FIXED VALUES: report / chart shapes -----------------------------------
IOC_TOP_K = 10
TOP_ALERTS_K = 20
LATEST_ALERTS_LIMIT = 100
SOURCE_TOP_STATS = 5
SOURCE_TOP_CHART = 10
CONFUSION_TOP_K = 10
CONSOLE_HEAD = 15
HISTOGRAM_BINS = 20
HISTOGRAM_MAX = 10.0
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
TRIAGE_ALGORITHM = "Best-First Search"
TRIAGE_NOTES = "Higher priority indicates earlier triage order."
TRIAGE_EMPTY_NOTES = "No alerts available."
RESPONSE_ALGORITHM = "CSP Backtracking"
RESPONSE_NOTES = "Capacity + skill constraints applied."
REPORT_EMPTY_ERROR = "No alerts available for report generation."
