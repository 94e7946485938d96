"""Archives: round trip, standard streams, foreign archives, transactions."""

import gzip
import hashlib
import random

import pytest

from logsleuth.llm import warc
from tests.llm.helpers import rows

SCHEMA = "page_id bigint, url string, html string, record_id string, type string, digest string, row int, n long, size int"


def pages(spark, data):
    return spark.createDataFrame([(*x, "r", "t", "d", 1, 2, 3) for x in data], SCHEMA)


def fixture():
    rng = random.Random(4)
    texts = ["<p>" + "é word " * 40, "x" * 100, "y" * 99, "", None, "<b>" + "z " * 300,
             "a" * 120 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nnested\r\n\r\nWARC/1.0\r\n\r\n", "ends\r\n\r\n" * 20,
             "\r\n" * 80, "w" * 3_000_000]
    urls = ["http://a.example/x?y=1", None, "no scheme ü", "https://b.example", "http://c.example/\r\nWARC-Type: evil", ""]
    data = [(i, rng.choice(urls), rng.choice(texts[:-1])) for i in range(300)]
    data += [(None, "http://n.example/", texts[0]), (-5, None, texts[5]), (7, urls[0], texts[1]), (7, urls[0], texts[1]),
             (900, urls[0], texts[-1]), (901, urls[0], texts[-1]), (902, None, "alone " * 50)]
    rng.shuffle(data)
    return data


def brute(data):
    out, seen = [], {}
    for i, url, html in sorted(data, key=lambda x: (x[0] is None, x[0] or 0)):
        raw = (html or "").encode()
        d = hashlib.sha256(raw).hexdigest()
        again = len(raw) >= 100 and d in seen
        out.append((i, url, len(raw), d, "revisit" if again else "response", seen[d] if again else None))
        seen.setdefault(d, i)
    return sorted(out, key=str)


def test_round_trip_equals_brute_force(spark):
    data = fixture()
    df = pages(spark, data).repartition(5).checkpoint()
    got = sorted(((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                  for r in rows(warc.round_trip(df))), key=str)
    assert got == brute(data)
    assert rows(warc.round_trip(df.limit(0))) == []


def parse(raw):
    """Records of a WARC stream, cut by Content-Length alone."""
    out = []
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        named = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        n = int(named[b"Content-Length"])
        out.append((named, rest[:n]))
        assert head.startswith(b"WARC/1.1") and rest[n:n + 4] == b"\r\n\r\n"
        raw = rest[n + 4:]
    return out


def test_files_are_standard_streams(spark, tmp_path):
    data = fixture()
    warc.write_archives(pages(spark, data).coalesce(3), f"{tmp_path}/w")
    records = [r for f in tmp_path.glob("w/*.gz") for r in parse(gzip.open(f).read())]
    kinds = [n[b"WARC-Type"] for n, _ in records]
    assert len(records) == 3 * len(data) and kinds.count(b"request") == kinds.count(b"metadata") == len(data)
    ids = {n[b"WARC-Record-ID"]: n for n, _ in records}
    assert len(ids) == len(records)
    for named, block in records:
        if named[b"WARC-Type"] == b"response":
            assert hashlib.sha256(block.partition(b"\r\n\r\n")[2]).hexdigest().encode() == named[b"WARC-Payload-Digest"][7:]
        elif named[b"WARC-Type"] == b"revisit":
            first = ids[named[b"WARC-Refers-To"]]
            assert first[b"WARC-Type"] == b"response" and first[b"WARC-Payload-Digest"] == named[b"WARC-Payload-Digest"]
            assert block.endswith(b"\r\n\r\n")
        else:
            assert ids[named[b"WARC-Concurrent-To"]][b"WARC-Type"] in (b"response", b"revisit")


def record(kind, urn, block, content="application/http", **more):
    head = [f"warc-type: {kind}", f"WARC-Record-ID: <{urn}>", f"Content-Type: {content}", f"Content-Length:{len(block)}"]
    for k, v in more.items():
        head += [f"{k.replace('_', '-')}: {x}" for x in (v if isinstance(v, list) else [v])]
    return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def foreign():
    http = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\n"
    return [record("warcinfo", "i", b"software: x\r\n", "application/warc-fields"),
            # the response names its request, the metadata record names the request
            record("response", "r1", http + b"body\r\n\r\nWARC/1.0\r\nnot a record\xff\x00", WARC_Concurrent_To="<q1>",
                   WARC_Target_URI="http://x/"),
            record("request", "q1", b"GET / HTTP/1.1\r\n\r\n", WARC_Concurrent_To="<r1>"),
            record("metadata", "m1", b"fetch: 12\r\nhost: x:80\r\n", "application/warc-fields", WARC_Concurrent_To="<q1>"),
            # one request for two answers, one metadata record of nothing
            record("response", "r2", http + b"two"), record("revisit", "r3", http, WARC_Refers_To="<r2>"),
            record("request", "q2", b"GET /2 HTTP/1.1\r\n\r\n", WARC_Concurrent_To=["<r2>", "<r3>"]),
            record("metadata", "m9", b"", "application/warc-fields", WARC_Concurrent_To="<nowhere>"),
            record("response", "r4", b"", WARC_Concurrent_To="<gone>")]


@pytest.mark.parametrize("form", ["members", "whole", "plain"])
def test_foreign_archives(spark, tmp_path, form):
    parts = foreign()
    raw = b"".join(parts)
    folder = tmp_path / "in"
    folder.mkdir()
    if form == "members":
        (folder / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in parts[:5]))
        (folder / "b.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in parts[5:]))
    elif form == "whole":
        (folder / "a.warc.gz").write_bytes(gzip.compress(raw))
    else:
        (folder / "a.warc").write_bytes(raw)
    records = warc.read_records(spark, str(folder))
    got = {r["record_id"]: r for r in rows(records)}
    assert len(got) == len(parts) and bytes(got["<r1>"]["payload"]) == b"body\r\n\r\nWARC/1.0\r\nnot a record\xff\x00"
    caps = warc.captures(records)
    by = {r["record_id"]: r for r in rows(caps)}
    assert sorted(by) == ["<r1>", "<r2>", "<r3>", "<r4>"]
    assert [q["record_id"] for q in by["<r1>"]["requests"]] == ["<q1>"]
    assert by["<r1>"]["metadata"][0]["fields"] == {"fetch": "12", "host": "x:80"}
    assert [by[r]["requests"][0]["record_id"] for r in ("<r2>", "<r3>")] == ["<q2>"] * 2
    assert by["<r4>"]["requests"] == by["<r4>"]["metadata"] == [] and bytes(by["<r4>"]["payload"]) == b""
    full = {r["record_id"]: r["original"] for r in rows(warc.resolve(caps, ["payload"]))}
    assert bytes(full["<r3>"]["payload"]) == b"two" and full["<r1>"] is None


def test_cut_records_and_lost_responses_raise(spark, tmp_path):
    (tmp_path / "c.warc").write_bytes(foreign()[1][:-40])
    with pytest.raises(Exception, match="cut off"):
        rows(warc.read_records(spark, str(tmp_path)))
    (tmp_path / "c.warc").write_bytes(foreign()[5])
    with pytest.raises(Exception, match="no response for revisit"):
        rows(warc.resolve(warc.captures(warc.read_records(spark, str(tmp_path))), ["payload"]))
