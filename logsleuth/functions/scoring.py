"""Rule, severity, risk and label expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as C
from .codes import lookup
from .text import py_strip


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 int (null counts as 0, like a pandas mask)."""
    return F.when(cond, 1).otherwise(0)


def rint_round(col, digits: int) -> Column:
    """pandas/numpy ``round``: rint(x * 10^d) / 10^d (half to even)."""
    scale = 10 ** digits
    return F.rint(_c(col) * scale) / scale


# ---- heuristics ------------------------------------------------------------

def brute_force(failed_count="failed_count", ip_failed_count="ip_failed_count") -> Column:
    """F21."""
    return flag((_c(failed_count) >= C.BRUTE_FORCE_FAILED_LOGINS)
                | (_c(ip_failed_count) >= C.BRUTE_FORCE_FAILED_LOGINS))


def priv_esc(event_code="event_code") -> Column:
    """F22."""
    return flag(_c(event_code) == 2)


def port_scan(ports="ip_unique_dst_ports", has_dst_port="has_destination_port") -> Column:
    """F23."""
    return flag((_c(ports) >= C.PORT_SCAN_UNIQUE_PORTS) & (_c(has_dst_port) == 1))


def dos(obs="connection_observation_count", has_dst_port="has_destination_port",
        has_dst_ip="has_destination_ip", is_fw="is_firewall_event") -> Column:
    """F24."""
    return flag((_c(obs) >= C.DOS_CONNECTION_OBSERVATIONS)
                & ((_c(has_dst_port) == 1) | (_c(has_dst_ip) == 1) | (_c(is_fw) == 1)))


def exfil(ext_dst="is_external_dst", obs="connection_observation_count",
          duration="duration_sec") -> Column:
    """F25."""
    return flag((_c(ext_dst) == 1) & (_c(obs) >= C.EXFIL_CONNECTION_OBSERVATIONS)
                & (_c(duration) >= C.EXFIL_MIN_DURATION_SEC))


def firewall_activity(is_fw="is_firewall_event", obs="connection_observation_count") -> Column:
    """F26."""
    return flag((_c(is_fw) == 1) & (_c(obs) >= C.FIREWALL_MIN_OBSERVATIONS))


# ---- alerts ----------------------------------------------------------------

def system_attack_type() -> Column:
    """priv_esc > brute_force > unknown_anomaly."""
    return (F.when(F.col("heuristic_priv_esc") == 1, "privilege_escalation")
             .when(F.col("heuristic_brute_force") == 1, "brute_force")
             .otherwise("unknown_anomaly"))


def network_attack_type() -> Column:
    """firewall_activity > dos > data_exfiltration > port_scan > unknown_anomaly."""
    return (F.when(F.col("heuristic_firewall_activity") == 1, "firewall_activity")
             .when(F.col("heuristic_dos") == 1, "dos")
             .when(F.col("heuristic_exfil") == 1, "data_exfiltration")
             .when(F.col("heuristic_port_scan") == 1, "port_scan")
             .otherwise("unknown_anomaly"))


def base_severity(attack_type="attack_type") -> Column:
    """F30."""
    return lookup(attack_type, C.ATTACK_SEVERITY, C.DEFAULT_BASE_SEVERITY).cast("int")


def confidence(score="anomaly_score", rule_based="rule_based_alert") -> Column:
    """round(score*100, 1), or the fixed rule confidence."""
    model = F.rint(_c(score) * 100 * 10) / 10
    return F.when(_c(rule_based) == 1, F.lit(C.RULE_CONFIDENCE)).otherwise(model)


def boosted_severity(base="base_severity", conf="confidence") -> Column:
    """F32."""
    return F.when(_c(conf) > C.SEVERITY_BOOST_CONFIDENCE,
                  F.least(F.lit(C.MAX_SEVERITY), _c(base) + 1)).otherwise(_c(base)).cast("int")


def description(attack_type="attack_type") -> Column:
    return lookup(attack_type, C.DESCRIPTIONS)


def recommendation(attack_type="attack_type") -> Column:
    return lookup(attack_type, C.RECOMMENDATIONS)


# ---- risk ------------------------------------------------------------------

def _clip(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def risk_score(severity: Column, conf: Column, ext: Column, attack_type: Column,
               hour: Column | None) -> Column:
    """weighted sum scaled to 0-10, clipped, rounded half-even to 2 d.p.
    A null severity, confidence or external flag gives a null score."""
    sev_norm = _clip(severity.cast("double"), 0, C.TOP_SEVERITY) / C.TOP_SEVERITY
    conf_norm = _clip(conf.cast("double"), 0, 100) / 100
    complexity = lookup(attack_type, C.COMPLEXITY, C.RISK_DEFAULT_COMPLEXITY)
    if hour is None:
        tfac = F.lit(C.RISK_TIME_UNKNOWN)
    else:
        tfac = F.when((hour < C.NIGHT_END_HOUR) | (hour >= C.NIGHT_START_HOUR),
                      F.lit(C.RISK_TIME_NIGHT)).otherwise(F.lit(C.RISK_TIME_DAY))
    raw = (F.lit(C.RISK_WEIGHT_SEVERITY) * sev_norm
           + F.lit(C.RISK_WEIGHT_CONFIDENCE) * conf_norm
           + F.lit(C.RISK_WEIGHT_EXTERNAL) * ext.cast("double")
           + F.lit(C.RISK_WEIGHT_COMPLEXITY) * complexity
           + F.lit(C.RISK_WEIGHT_TIME) * tfac)
    return rint_round(_clip(raw * 10, 0, 10), 2)


def risk_level(score="risk_score") -> Column:
    """F37."""
    s = _c(score)
    out = None
    for name, lo in C.RISK_LEVELS:
        out = F.when(s >= lo, name) if out is None else out.when(s >= lo, name)
    return out.otherwise(C.RISK_LEVEL_DEFAULT)


def triage_priority(severity="severity", conf="confidence", risk="risk_score") -> Column:
    """null inputs count as 0."""
    def z(c):
        return F.coalesce(_c(c).cast("double"), F.lit(0.0))
    return (F.lit(C.TRIAGE_W_SEVERITY) * z(severity) + F.lit(C.TRIAGE_W_CONFIDENCE) * z(conf)
            + F.lit(C.TRIAGE_W_RISK) * z(risk))


# ---- labels ----------------------------------------------------------------

def source_label(source_ip: Column, service: Column, log_type: Column) -> Column:
    """ip, else service, else log_type; placeholders blanked at the
    first step and once more at the end.  Blank means 'drop'."""
    def txt(c):
        return py_strip(F.coalesce(c.cast("string"), F.lit("")))
    first = txt(source_ip)
    first = F.when(first.isin(C.SOURCE_LABEL_BLANKS), F.lit("")).otherwise(first)
    label = (F.when(first != "", first)
              .when(txt(service) != "", txt(service))
              .otherwise(txt(log_type)))
    return F.when(label.isin(C.SOURCE_LABEL_BLANKS), F.lit("")).otherwise(label)


def ioc_key(source_ip: Column, fallback: Column) -> tuple[Column, Column]:
    """(value, type).  Placeholder ip -> fallback text as an event signature.

    ``fallback`` is ``event_type`` (or ``service`` if that column is absent);
    a null fallback renders as ``nan`` (``str(NaN)``).
    """
    ip = py_strip(F.coalesce(source_ip.cast("string"), F.lit("nan")))
    is_blank = F.lower(ip).isin(C.IOC_BLANKS)
    fb = py_strip(F.coalesce(fallback.cast("string"), F.lit("nan")))
    value = F.when(is_blank, fb).otherwise(ip)
    kind = F.when(is_blank, "event_signature").otherwise("ip_address")
    return value, kind


def eval_reference_label() -> Column:
    """rule label for evaluation."""
    f, p = F.col("request_frequency"), F.col("packets_sum")
    return (F.when((f > C.EVAL_DOS_FREQUENCY) & (p > C.EVAL_DOS_PACKETS), "DoS")
             .when(F.col("failed_login_count") > C.EVAL_BRUTE_FAILED, "Brute Force")
             .when(F.col("unique_ports") > C.EVAL_SCAN_PORTS, "Port Scan")
             .when((F.col("bytes_sum") > C.EVAL_EXFIL_BYTES) & (f < C.EVAL_EXFIL_MAX_FREQUENCY),
                   "Data Exfiltration")
             .otherwise("Unknown"))


def eval_clamp_label(col="attack_type") -> Column:
    """F43."""
    return F.when(_c(col).isin(C.EVAL_LABELS), _c(col)).otherwise("Unknown")
