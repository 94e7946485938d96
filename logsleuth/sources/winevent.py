"""Windows event exports -> collector rows.

The collector reads events through a host API; here the events arrive as
exported XML text (one ``<Event>`` document per row, e.g. from a text or
XML-per-line scan).  Parsing is ``from_xml`` with a fixed schema; the
``EventData/Data[@Name]`` pairs become a map (repeated names: last wins,
``spark.sql.mapKeyDedupPolicy=LAST_WIN``; a document that fails to parse
gives an empty map).  All extraction is column expressions - no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import constants as C
from ..functions import codes, text

EVENT_XML_SCHEMA = (
    "System STRUCT<Provider: STRUCT<_Name: STRING>, EventID: STRING, "
    "TimeCreated: STRUCT<_SystemTime: STRING>, Channel: STRING>, "
    "EventData STRUCT<Data: ARRAY<STRUCT<_Name: STRING, _VALUE: STRING>>>, "
    "Message STRING")


def parse_events(xml_rows: DataFrame, col: str = "xml") -> DataFrame:
    """(event_id, time_created, provider, channel, message, data map)."""
    ev = F.from_xml(F.col(col), EVENT_XML_SCHEMA, {"mode": "PERMISSIVE"}).alias("_e")
    parsed = xml_rows.select("*", ev)
    pairs = F.filter(F.coalesce(F.col("_e.EventData.Data"), F.array()),
                     lambda d: F.btrim(F.coalesce(d["_Name"], F.lit("")), F.lit(C.STRIP_CHARS)) != "")
    data = F.map_from_entries(F.transform(pairs, lambda d: F.struct(
        d["_Name"].alias("key"), F.coalesce(d["_VALUE"], F.lit("")).alias("value"))))
    return parsed.select(
        *[c for c in xml_rows.columns if c != col],
        F.col("_e.System.EventID").try_cast("int").alias("win_event_id"),
        F.col("_e.System.TimeCreated._SystemTime").alias("time_created"),
        F.col("_e.System.Provider._Name").alias("provider"),
        F.col("_e.System.Channel").alias("channel"),
        F.col("_e.Message").alias("message"),
        F.coalesce(data, F.create_map().cast("map<string,string>")).alias("data"))


def quick_fields(xml_rows: DataFrame, col: str = "xml") -> DataFrame:
    """``win_event_id`` and ``time_ts`` cut from the document text, so that
    ``source_filter`` can drop documents before they are parsed."""
    return xml_rows.withColumns({
        "win_event_id": F.regexp_extract(col, r"<EventID[^>]*>\s*([0-9]+)\s*</EventID>", 1).try_cast("int"),
        "time_ts": F.regexp_extract(col, r"<TimeCreated[^>]*SystemTime=[\"']([^\"']+)[\"']", 1).try_cast("timestamp")})


def source_filter(events: DataFrame, start: Column | str, ids: list[int] | None = None,
                  max_events: int | None = None, time_col: str = "time_ts",
                  tie: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Time and id predicates (pushed to the scan on a partitioned store)
    and the collector's newest-first event cap (``max_events``); equal times
    are cut by the ``tie`` columns."""
    start_c = F.lit(start).cast("timestamp") if isinstance(start, str) else start
    out = events.where(F.col(time_col) >= start_c)
    if ids:
        out = out.where(F.col("win_event_id").isin(ids))
    if max_events:
        out = out.orderBy(F.desc(time_col), *[c for c in tie if c in out.columns]).limit(max_events)
    return out


def store_events(xml_rows: DataFrame, folder: str, col: str = "xml") -> None:
    """Event documents as a store that time and id predicates prune.

    Documents go to folders by day and id; inside, files and row groups hold
    ranges of time, so a day with most of the events is many files.  Documents
    without a time or an id have folders of their own."""
    rows = quick_fields(xml_rows, col).withColumn("event_day", F.to_date("time_ts"))
    order = ["event_day", "win_event_id", "time_ts"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy(
        "event_day", "win_event_id").parquet(folder)


def stored_events(spark: SparkSession, folder: str, start: Column | str, ids: list[int] | None = None,
                  max_events: int | None = None, tie: tuple[str, ...] = ("row_id",),
                  schema: StructType | None = None) -> DataFrame:
    """S6 on a store of ``store_events``: ``source_filter`` with the day of
    ``start`` as a partition predicate.  Folders of other days and ids are not
    opened, row groups before ``start`` are skipped by their statistics.
    Without the ``schema`` of the store Spark reads it from any one footer."""
    rows = (spark.read.schema(schema) if schema else spark.read).parquet(folder)
    rows = rows.withColumns({"event_day": F.col("event_day").cast("date"),
                             "win_event_id": F.col("win_event_id").cast("int")})
    begin = F.lit(start).cast("timestamp") if isinstance(start, str) else start
    return source_filter(rows.where(F.col("event_day") >= F.to_date(begin)), begin, ids, max_events, tie=tie
                         ).drop("event_day")


def _row(ts: Column, log_type: str, event_type: Column, event_id: Column, message: Column,
         **fields: Column) -> list[Column]:
    defaults = {
        "source_ip": F.lit(""), "destination_ip": F.lit(""), "source_port": F.lit(0),
        "destination_port": F.lit(0), "protocol": F.lit(""), "user": F.lit(""),
        "service": F.lit(""), "failed_count": F.lit(0), "log_level": F.lit("INFORMATION"),
        "query_name": F.lit(""), "query_type": F.lit(""), "action": F.lit(""),
    }
    defaults.update(fields)
    return [ts.alias("timestamp"), F.lit(log_type).alias("log_type"),
            event_type.alias("event_type"), event_id.cast("int").alias("event_id"),
            message.alias("event_message"),
            *[v.alias(k) for k, v in defaults.items()]]


def security_rows(ev: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Logon events (4624/4625) -> collector rows."""
    eid = F.col("win_event_id")
    et = codes.security_event_type(eid)
    keys = C.SECURITY_KEYS
    return ev.select(*keep, *_row(
        F.col("time_created"), "security", et, eid, text.collapse_ws("message"),
        source_ip=text.usable_map_value("data", keys["source_ip"]),
        user=text.usable_map_value("data", keys["user"]),
        service=text.collapse_ws("provider"),
        failed_count=codes.failed_flag(et),
        log_level=codes.event_log_level(eid)))


def firewall_rows(ev: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    eid = F.col("win_event_id")
    k = C.FIREWALL_KEYS
    proto = text.usable_map_value("data", k["protocol"])
    proto = F.when(proto == "", F.when(eid == C.FIREWALL_PROFILE_CHANGE_ID, F.lit("N/A"))
                   .otherwise(F.lit(""))).otherwise(proto)
    return ev.select(*keep, *_row(
        F.col("time_created"), "firewall", codes.firewall_event_type(eid), eid,
        text.collapse_ws("message"),
        source_ip=text.usable_map_value("data", k["source_ip"]),
        destination_ip=text.usable_map_value("data", k["destination_ip"]),
        source_port=text.int_map_value("data", k["source_port"]),
        destination_port=text.int_map_value("data", k["destination_port"]),
        protocol=proto,
        service=text.collapse_ws("provider"),
        log_level=codes.event_log_level(eid),
        action=text.usable_map_value("data", k["action"])))


def dns_rows(ev: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    eid = F.col("win_event_id")
    k = C.DNS_KEYS
    return ev.select(*keep, *_row(
        F.col("time_created"), "dns", F.lit(C.DNS_EVENT_TYPE), eid, text.collapse_ws("message"),
        source_ip=text.usable_map_value("data", k["source_ip"]),
        destination_ip=text.usable_map_value("data", k["destination_ip"]),
        protocol=F.lit("DNS"),
        log_level=codes.event_log_level(eid),
        query_name=text.usable_map_value("data", k["query_name"]),
        query_type=text.usable_map_value("data", k["query_type"])))


def network_rows(firewall: DataFrame, dns: DataFrame) -> DataFrame:
    """Firewall rows then DNS rows, by column name."""
    return firewall.unionByName(dns)
