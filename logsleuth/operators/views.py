"""Aggregate views over the alert table.

All of these are one ``groupBy`` (map-side partial aggregation, then a small
shuffle) or an ``orderBy().limit()`` (``TakeOrderedAndProject``: a per-task
top-k, then a merge of k rows per task).  Zero-fill grids are built from tiny
dimension frames (hours between the first and last alert, 7 days x 24 hours,
20 histogram bins, 5 x 5 labels) and joined to the aggregate, which is
already small; nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as C
from ..functions import clock, scoring as S
from ..functions.text import py_strip


def _tie(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in ("log_type", "row_id") if c in df.columns]


def _time_col(df: DataFrame) -> str | None:
    """prefer the event time, fall back to the detection time."""
    if "timestamp" in df.columns:
        return "timestamp"
    if "detected_at" in df.columns:
        return "detected_at"
    return None


def _instant(df: DataFrame, col: str) -> Column:
    dtype = df.schema[col].dataType.typeName()
    if dtype in ("timestamp", "timestamp_ntz", "date"):
        return F.col(col).cast("timestamp")
    ts, _ = clock.parse_log_time(df, col)
    return ts


def attack_counts(alerts: DataFrame) -> DataFrame:
    """A3: alerts per attack type (non-null types)."""
    return (alerts.where(F.col("attack_type").isNotNull()).groupBy("attack_type")
                  .agg(F.count(F.lit(1)).alias("alert_count")))


def risk_level_counts(alerts: DataFrame) -> DataFrame:
    """A4: total and per-level counts in one pass."""
    cols = [F.count(F.lit(1)).alias("total")]
    has = "risk_level" in alerts.columns
    for lvl in ("Critical", "High", "Medium", "Low"):
        c = F.count_if(F.col("risk_level") == lvl) if has else F.lit(0).cast("bigint")
        cols.append(c.alias(lvl.lower()))
    return alerts.agg(*cols)


def hourly_timeline(alerts: DataFrame) -> DataFrame:
    """A5: 1-hour bins (UTC) from the first to the last alert, zero-filled.

    ``alert_count`` counts rows with an attack type (report); ``row_count``
    counts rows (chart).  The hour grid is generated from the min/max only.
    """
    tcol = _time_col(alerts)
    t = _instant(alerts, tcol)
    binned = (alerts.select(F.date_trunc("hour", t).alias("hour_start"),
                            F.col("attack_type"))
                    .where(F.col("hour_start").isNotNull()))
    counts = binned.groupBy("hour_start").agg(
        F.count("attack_type").alias("alert_count"), F.count(F.lit(1)).alias("row_count"))
    grid = (counts.agg(F.min("hour_start").alias("lo"), F.max("hour_start").alias("hi"))
                  .where(F.col("lo").isNotNull())
                  .select("lo", "hi", F.explode(F.sequence(F.date_trunc("day", "lo"), F.date_trunc("day", "hi"),
                                                           F.expr("INTERVAL 1 DAY"))).alias("day"))
                  .repartition("day")   # a stray date may stretch the grid: days are made in one task, hours in many
                  .select("lo", "hi", F.explode(F.sequence("day", F.col("day") + F.expr("INTERVAL 23 HOUR"),
                                                           F.expr("INTERVAL 1 HOUR"))).alias("hour_start"))
                  .where("hour_start BETWEEN lo AND hi").select("hour_start"))
    out = grid.join(counts, "hour_start", "left")
    return out.select(
        clock.as_wall_clock("hour_start").alias("hour_start"),
        clock.minute_text("hour_start").alias("timestamp"),
        F.coalesce("alert_count", F.lit(0)).alias("alert_count"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"))


def ioc_table(alerts: DataFrame) -> DataFrame:
    """A6 (uncapped): one row per indicator value with its count, type of
    its first row, and sorted distinct attack types (excluding blank and
    ``unknown``).  The type set is bounded by the attack-type vocabulary."""
    fallback = (F.col("event_type") if "event_type" in alerts.columns
                else F.col("service") if "service" in alerts.columns else F.lit("unknown"))
    ip = F.col("source_ip") if "source_ip" in alerts.columns else F.lit("")
    value, kind = S.ioc_key(ip, fallback)
    order = F.col("row_id") if "row_id" in alerts.columns else F.monotonically_increasing_id()
    at = py_strip(F.coalesce(F.col("attack_type").cast("string"), F.lit("unknown")))
    keyed = alerts.select(value.alias("value"), kind.alias("type"), order.alias("_o"),
                          F.when((at != "") & (at != "unknown"), at).alias("_at"))
    keyed = keyed.where((F.col("value") != "") & (F.col("value") != "unknown"))
    return keyed.groupBy("value").agg(
        F.min_by("type", "_o").alias("type"),
        F.count(F.lit(1)).alias("event_count"),
        F.array_sort(F.collect_set("_at")).alias("attack_types"))


def ioc_top(alerts: DataFrame, k: int = C.IOC_TOP_K) -> DataFrame:
    """A6 + T6: top ``k`` indicators by event count (ties: value)."""
    return ioc_table(alerts).orderBy(F.desc("event_count"), "value").limit(k)


def unique_sources(alerts: DataFrame, k: int = C.IOC_TOP_K) -> DataFrame:
    """The report's capped count (size of the top-k IOC list) and the
    uncapped number of indicator values."""
    t = ioc_table(alerts)
    return t.agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("unique_sources"),
                 F.count(F.lit(1)).alias("unique_sources_total"))


def observation_window(alerts: DataFrame) -> DataFrame:
    """First and last event time (UTC wall clock) and row count."""
    t = _instant(alerts, _time_col(alerts))
    return alerts.agg(clock.as_wall_clock(F.min(t)).alias("start"),
                      clock.as_wall_clock(F.max(t)).alias("end"),
                      F.count(F.lit(1)).alias("total_alerts"))


def labelled_sources(alerts: DataFrame) -> DataFrame:
    """F39 labels, blanks dropped."""
    def get(c):
        return F.col(c) if c in alerts.columns else F.lit("")
    lab = S.source_label(get("source_ip"), get("service"), get("log_type"))
    return alerts.select(lab.alias("source_label")).where(F.col("source_label") != "")


def source_top(alerts: DataFrame, k: int = C.SOURCE_TOP_CHART) -> DataFrame:
    """A9 + T6: top ``k`` source labels (ties: label)."""
    return (labelled_sources(alerts).groupBy("source_label")
              .agg(F.count(F.lit(1)).alias("alert_count"))
              .orderBy(F.desc("alert_count"), "source_label").limit(k))


def severity_distribution(alerts: DataFrame) -> DataFrame:
    """A10: counts by risk level, or by severity when unscored."""
    col = "risk_level" if "risk_level" in alerts.columns else "severity"
    return (alerts.groupBy(F.col(col).cast("string").alias("level"))
                  .agg(F.count(F.lit(1)).alias("alert_count")))


def day_hour_heatmap(alerts: DataFrame) -> DataFrame:
    """7 x 24 grid of counts (UTC), Monday first, zeros filled.

    ``pivot`` with the 24 hour values listed up front needs no extra pass to
    discover the pivot values."""
    t = _instant(alerts, _time_col(alerts))
    base = (alerts.select(F.weekday(t).alias("day_index"), F.hour(t).alias("hour"))
                  .where(F.col("day_index").isNotNull()))
    piv = base.groupBy("day_index").pivot("hour", list(range(24))).agg(F.count(F.lit(1)))
    spark = alerts.sparkSession
    days = spark.createDataFrame([(i, n) for i, n in enumerate(C.DAY_NAMES)],
                                 "day_index int, day string")
    out = days.join(piv, "day_index", "left")
    return out.select("day_index", "day", *[F.coalesce(F.col(str(h)), F.lit(0)).cast("bigint")
                                           .alias(f"h{h:02d}") for h in range(24)])


def risk_histogram(alerts: DataFrame, bins: int = C.HISTOGRAM_BINS,
                   top: float = C.HISTOGRAM_MAX) -> DataFrame:
    """Fixed-width bins over [0, top]; the top edge joins the last bin;
    null / non-numeric scores dropped; empty bins reported as 0."""
    width = top / bins
    s = F.col("risk_score").cast("string").try_cast("double")
    b = F.least(F.floor(s / width), F.lit(bins - 1)).cast("int")
    counts = (alerts.select(b.alias("bin")).where(F.col("bin").isNotNull())
                    .groupBy("bin").agg(F.count(F.lit(1)).alias("alert_count")))
    grid = alerts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin", (F.col("bin") * width).alias("bin_start"),
        ((F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("alert_count", F.lit(0)).alias("alert_count"))


def cluster_summary(alerts: DataFrame, cluster_col: str = "cluster_kmeans") -> DataFrame:
    """A2: per-cluster statistics, ordered by average severity (desc).

    The dominant attack is the most frequent type, the smallest on ties
    (``mode(c, deterministic=True)``).  Blank addresses count as missing."""
    cols = set(alerts.columns)
    aggs = [F.count("attack_type").alias("count"),
            F.coalesce(F.mode("attack_type", True), F.lit("unknown")).alias("dominant_attack")]
    num = lambda c: F.col(c).cast("string").try_cast("double")
    aggs += ([F.avg(num("severity")).alias("avg_severity"),
              F.max(num("severity")).alias("max_severity")] if "severity" in cols else
             [F.lit(0.0).alias("avg_severity"), F.lit(0.0).alias("max_severity")])
    aggs.append(F.avg(num("confidence")).alias("avg_confidence") if "confidence" in cols
                else F.lit(0.0).alias("avg_confidence"))
    aggs.append(F.count_distinct(F.nullif(F.col("source_ip"), F.lit(""))).alias("unique_ips")
                if "source_ip" in cols else F.lit(0).cast("bigint").alias("unique_ips"))
    if "timestamp" in cols:
        t = _instant(alerts, "timestamp")
        aggs += [F.min(t).alias("start_time"), F.max(t).alias("end_time")]
    else:
        aggs += [F.lit(None).cast("timestamp").alias("start_time"),
                 F.lit(None).cast("timestamp").alias("end_time")]
    return (alerts.groupBy(F.col(cluster_col).alias("cluster_id")).agg(*aggs)
                  .orderBy(F.desc("avg_severity"), "cluster_id"))


def campaigns(summary: DataFrame) -> DataFrame:
    """R2: the report's campaign entries from a cluster summary."""
    return summary.select(
        F.col("cluster_id").cast("int").alias("cluster_id"),
        "dominant_attack",
        F.col("count").alias("event_count"),
        F.col("unique_ips"),
        F.round("avg_severity", 2).alias("avg_severity"),
        F.col("max_severity").cast("int").alias("max_severity"),
        clock.range_text("start_time", "end_time").alias("time_range"))


def recommendation_rules(spark) -> DataFrame:
    rows = [(n, a, p, act, why) for n, a, p, act, why in C.REPORT_RECOMMENDATIONS]
    return spark.createDataFrame(
        rows, "rule_no int, attack_type string, priority string, action string, rationale string")


def recommendations(alerts: DataFrame) -> DataFrame:
    """Rules whose attack type occurs in the alerts (semi join on the
    distinct types, U3) plus the always-on rule, in rule order."""
    rules = recommendation_rules(alerts.sparkSession)
    present = alerts.select("attack_type").where(F.col("attack_type").isNotNull()).distinct()
    hit = rules.join(present, "attack_type", "left_semi")
    always = rules.where(F.col("attack_type").isNull())
    return (hit.unionByName(always).orderBy("rule_no")
               .select("rule_no", "priority", "action", "rationale"))


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row aggregate to every row of ``df``.

    The aggregate has exactly one row by construction, so this is an
    equi-join on a constant key against a single broadcast row."""
    return (df.withColumn("_one", F.lit(1))
              .join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one")
              .drop("_one"))


def _fill_text(df: DataFrame) -> DataFrame:
    strings = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    return df.na.fill("", subset=strings) if strings else df


def top_alerts(alerts: DataFrame, k: int = C.TOP_ALERTS_K) -> DataFrame:
    """Highest risk first, 8 columns, missing text as ''."""
    cols = [c for c in C.TOP_ALERT_COLUMNS if c in alerts.columns]
    top = alerts.orderBy(F.desc("risk_score"), *_tie(alerts)).limit(k)
    return _fill_text(top.select(*cols))


def latest_alerts(alerts: DataFrame, limit: int = C.LATEST_ALERTS_LIMIT) -> DataFrame:
    """By severity (desc), dashboard projection, plus the total before the limit."""
    cols = [c for c in C.DASHBOARD_ALERT_COLUMNS if c in alerts.columns]
    total = alerts.agg(F.count(F.lit(1)).alias("total"))
    top = alerts.orderBy(F.desc("severity"), *_tie(alerts)).limit(limit).select(*cols)
    return attach_scalars(_fill_text(top), total)


def cluster_count(alerts: DataFrame, col: str = "cluster_kmeans") -> DataFrame:
    """A19."""
    return alerts.agg(F.count_distinct(col).alias("n_clusters"))


def exec_stats(alerts: DataFrame, k: int = C.SOURCE_TOP_STATS) -> DataFrame:
    """One row with level totals, attack-type counts and top sources.

    Every part is an aggregate already reduced to a few rows; they are
    attached to each other as single rows."""
    levels = risk_level_counts(alerts)
    types = attack_counts(alerts).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("attack_type", "alert_count"))))
        .alias("attack_types"))
    tops = source_top(alerts, k).agg(
        F.map_from_entries(F.collect_list(F.struct("source_label", "alert_count")))
        .alias("top_ips"))
    return attach_scalars(attach_scalars(levels, types), tops)
