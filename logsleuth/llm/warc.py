"""WARC archives: pages to records, records to captures.

``write_archives`` writes three records for each page (request, response or
revisit, metadata) with column functions and Spark's text sink: the line
separator is the empty line pair that ends a record, so a part file is a WARC
1.1 stream, compressed as one gzip member.  Payloads that repeat are revisits.

``read_records`` reads any archive folder, also with a gzip member for each
record, at the memory of one record: the text source cuts the stream where an
empty line is followed by ``WARC/``.  A payload can hold that sequence, so a
record is whole only when its Content-Length is met; pieces that follow are
joined on until it is.

``captures`` assembles transactions: request, response and metadata records
meet through their concurrent-to identifiers, whichever record names the
other, and give one nested row for each response or revisit.  ``resolve`` adds
to a revisit the response it refers to.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logsleuth.llm import common

MIN_REVISIT = 100  # bytes of the smallest payload that a revisit stands for
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"
_CUT = b"\r\n\r\nWARC/"
PRIMARY, SIDE = ("response", "revisit"), ("request", "metadata")


# ------------------------------------------------------------------ writing
def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column, urn: Column, headers: list[tuple[str, Column]], content: str, block: Column) -> Column:
    """A record without its end; a header whose value is null is left out."""
    lines = [F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit("")) for name, value in headers]
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), urn, *lines,
                    F.lit(f"\r\nContent-Type: {content}\r\nContent-Length: "),
                    F.octet_length(block).cast("string"), F.lit(_END), block)


def write_archives(pages: DataFrame, folder: str, date: str = DATE, min_revisit: int = MIN_REVISIT) -> None:
    """Archives of ``pages`` (page_id, url, html) below ``folder``.

    Of the pages with equal payloads of ``min_revisit`` bytes or more, the one
    with the smallest page_id is a response (null last; among rows of one
    page_id the first of the scan), the others are revisits of it.  A null html
    is an empty payload; a null url gives no target; an empty table gives no
    record.  Other columns are not read.  ``pages`` is read twice and must give
    the same rows in the same order."""
    common.prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("string").alias("id"), F.col("page_id").alias("rank"), "url",
                        F.coalesce("html", F.lit("")).alias("html"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumns({"size": F.octet_length("html"), "digest": F.sha2("html", 256)})
    first = rows.where(F.col("size") >= min_revisit).groupBy("digest").agg(
        F.min(F.struct(F.col("rank").isNull(), "rank", "row")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = common.stored(first.select("digest", "n", F.col("f.row").alias("row")), "warc-first")
    rows = common.look_up(rows, "digest", "row", first, "first")
    rows = rows.withColumn("again", F.coalesce(F.col("first.row") != F.col("row"), F.lit(False)))

    place = F.lit(folder)
    main, request, meta = (_urn(place, F.lit(k), F.col("row")) for k in ("main", "request", "metadata"))
    target = F.when(F.col("url").rlike(r"^[\x21-\x7e]+$"), F.col("url")).otherwise(F.url_encode("url"))
    origin = [("WARC-Target-URI", target), ("WARC-Date", F.lit(date))]
    host = F.regexp_extract(target, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    ask = F.concat(F.lit("GET "), F.coalesce(F.nullif(F.regexp_replace(target, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), F.lit("")),
                                            F.lit("/")),
                   F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit(_END))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("size").cast("string"), F.lit(_END))
    again = F.col("again")
    reply = _record(
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")), main,
        origin + [("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
                  ("WARC-Profile", F.when(again, F.lit(PROFILE))),
                  ("WARC-Refers-To", F.when(again, _urn(place, F.lit("main"), F.col("first.row"))))],
        "application/http;msgtype=response", F.concat(head, F.when(again, F.lit("")).otherwise(F.col("html"))))
    fields = F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), F.url_encode(value), F.lit("\r\n")), F.lit(""))
                        for name, value in (("page-id", F.col("id")), ("url", F.col("url")))])
    out = F.explode(F.array(
        _record(F.lit("request"), request, origin + [("WARC-Concurrent-To", main)], "application/http;msgtype=request",
                F.coalesce(ask, F.lit(f"GET / HTTP/1.1{_END}"))),
        reply,
        _record(F.lit("metadata"), meta, origin + [("WARC-Concurrent-To", main)], "application/warc-fields", fields)))
    rows.select(out.alias("value")).write.option("lineSep", _END).option("compression", "gzip").text(folder)


# ------------------------------------------------------------------ reading
def _named(lines: list[bytes]) -> Iterator[tuple[str, str]]:
    for line in lines:
        name, colon, value = line.partition(b":")
        if colon:
            yield name.strip().decode("utf-8", "replace").lower(), value.strip().decode("utf-8", "replace")


def _whole(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], list[str], bytes]]:
    """(headers, concurrent-to identifiers, block) of the records of a stream."""
    head, body, need, named = None, b"", 0, {}
    links: list[str] = []
    for piece in pieces:
        starts = piece.startswith(b"WARC/")  # the first of a file still has its version line
        if head is not None and not starts:
            body += _CUT + piece
        else:
            if head is not None:
                raise ValueError(f"record cut off: {head[:200]!r}")
            if not piece.strip():
                continue
            head, _, body = piece.partition(b"\r\n\r\n")
            named, links = {}, []
            for name, value in _named(head.split(b"\r\n")[1:]):
                if name == "warc-concurrent-to":
                    links.append(value)
                else:
                    named[name] = value
            need = int(named["content-length"])
        if len(body) >= need:
            yield named, links, body[:need]
            head = None
    if head is not None:
        raise ValueError(f"record cut off: {head[:200]!r}")


_RECORD = ("record_id string, type string, links array<string>, refers_to string, uri string, date string, "
           "stated_digest string, fields map<string,string>, http string, payload binary")
_KIND = pa.schema([(n, pa.string()) for n in ("record_id", "type")] + [("links", pa.list_(pa.string()))]
                  + [(n, pa.string()) for n in ("refers_to", "uri", "date", "stated_digest")]
                  + [("fields", pa.map_(pa.string(), pa.string())), ("http", pa.string()), ("payload", pa.binary())])


def _row(named: dict[str, str], links: list[str], block: bytes) -> tuple:
    kind, http, fields = named.get("content-type", ""), None, {}
    if kind.startswith("application/http"):
        top, _, block = block.partition(b"\r\n\r\n")
        http = top.decode("utf-8", "replace")
    elif kind.startswith("application/warc-fields"):
        fields = dict(_named(block.split(b"\r\n")))
    return (named.get("warc-record-id"), named.get("warc-type"), links, named.get("warc-refers-to"),
            named.get("warc-target-uri"), named.get("warc-date"), named.get("warc-payload-digest"),
            list(fields.items()), http, block)


def read_records(spark: SparkSession, folder: str, batch_bytes: int = 4 << 20) -> DataFrame:
    """One row for each record of the archives in ``folder``: record_id, type,
    links (concurrent-to), refers_to, uri, date, stated_digest (of the
    payload, as written), fields (of a warc-fields block), http (its header),
    payload (of an http block, otherwise the block).

    Files ending in .gz are decompressed; a header that is missing is null; a
    record that is cut off raises ValueError."""
    common.prepare(spark)
    pieces = spark.read.option("lineSep", _CUT.decode()).text(folder).select(F.col("value").cast("binary").alias("value"))

    def run(batches):
        rows, size = [], 0
        for named, links, block in _whole(x.as_py() for b in batches for x in b.column(0)):
            rows.append(_row(named, links, block))
            size += len(block) + 500
            if size >= batch_bytes:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)
    return pieces.mapInArrow(run, _RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _KIND)], schema=_KIND)


# ----------------------------------------------------------------- captures
def captures(records: DataFrame) -> DataFrame:
    """One row for each response or revisit record: its columns without
    ``links`` and ``fields``, and ``requests`` and ``metadata``, the records of
    the same transaction, each as an array of structs ordered by record_id.

    A request or metadata record belongs to the response or revisit that it
    names as concurrent, or that names it, or that a record concurrent to it
    belongs to.  A record may belong to several; one that belongs to none is
    left out, and a capture without them has empty arrays.  ``records`` may
    have other columns, which go with the responses; it is stored first, so
    drop the payload before if it is not wanted."""
    rows = common.stored(records.where(F.col("type").isin(*PRIMARY, *SIDE)), "warc-records")
    main = rows.where(F.col("type").isin(*PRIMARY))
    side = rows.where(F.col("type").isin(*SIDE))
    heads = main.select(F.col("record_id").alias("capture"))
    ties = side.select("record_id", F.explode("links").alias("other"))
    direct = ties.join(heads, F.col("other") == F.col("capture")).select("record_id", "capture")
    named = main.select(F.explode("links").alias("record_id"), F.col("record_id").alias("capture"))
    owner = direct.union(named)
    both = ties.union(ties.select(F.col("other").alias("record_id"), F.col("record_id").alias("other")))
    via = owner.select(F.col("record_id").alias("other"), "capture")
    lone = both.join(owner.select("record_id"), "record_id", "left_anti")
    owner = owner.union(lone.join(via, "other").select("record_id", "capture")).distinct()
    detail = F.struct("record_id", "uri", "date", "http", "fields")
    parts = side.select("record_id", "type", detail.alias("r")).join(owner, "record_id").groupBy("capture").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("type") == k, F.col("r"))), _by_id).alias(out)
        for k, out in (("request", "requests"), ("metadata", "metadata"))])
    whole = main.drop("links", "fields").join(parts, F.col("record_id") == F.col("capture"), "left").drop("capture")
    empty = F.array().cast(parts.schema["requests"].dataType)
    return whole.withColumns({c: F.coalesce(c, empty) for c in ("requests", "metadata")})


def _by_id(a: Column, b: Column) -> Column:
    return F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0)


def resolve(caps: DataFrame, wanted: list[str]) -> DataFrame:
    """``caps`` with ``original``, for a revisit the struct of the columns
    ``wanted`` of the response it refers to; null for a response.  A revisit
    whose response is not among ``caps`` raises an error."""
    asked = caps.where("type = 'revisit'").groupBy("refers_to").agg(F.count(F.lit(1)).alias("n"))
    found = caps.where("type = 'response'").select(F.col("record_id").alias("__id"), *wanted)
    table = common.stored(asked.join(found, F.col("refers_to") == F.col("__id")).drop("__id"), "warc-originals")
    out = common.look_up(caps, "refers_to", "record_id", table, "original")
    lost = F.raise_error(F.concat(F.lit("no response for revisit "), "record_id"))
    return out.withColumn("original", F.when((F.col("type") == "revisit") & F.col("original").isNull(), lost.cast(
        out.schema["original"].dataType)).otherwise(F.col("original")))


def round_trip(pages: DataFrame) -> DataFrame:
    """One row for each row of ``pages``, from archives that are written to the
    shared folder and read back: page_id, payload_bytes, payload_digest,
    record_type, refers_to (the response's page_id), url.  See
    ``write_archives``."""
    spark = pages.sparkSession
    common.prepare(spark)
    folder = common.scratch(spark, "warc")
    write_archives(pages, folder)
    records = read_records(spark, folder).withColumns({
        "payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)}).drop("payload")
    kind = pages.schema["page_id"].dataType
    about = F.element_at("metadata", 1)["fields"]
    caps = captures(records)
    caps = common.stored(caps.select(
        "record_id", "type", "refers_to", "payload_bytes", "payload_digest",
        F.url_decode(about["page-id"]).cast(kind).alias("page_id"), F.url_decode(about["url"]).alias("url")), "warc-captures")
    caps = resolve(caps, ["payload_bytes", "payload_digest", "page_id"])
    again = F.col("original").isNotNull()
    return caps.select("page_id", *[F.when(again, F.col(f"original.{c}")).otherwise(F.col(c)).alias(c)
                                    for c in ("payload_bytes", "payload_digest")],
                       F.col("type").alias("record_type"), F.col("original.page_id").alias("refers_to"), "url")


SQL = f"""
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS low FROM p)
SELECT page_id, payload_bytes, payload_digest, url,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> low THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> low THEN low END AS refers_to
FROM f
"""
