"""Sources, sinks and the two jobs end to end."""

import inspect
import json
import gzip
import os
import tempfile
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from logsleuth import constants as C
from logsleuth.operators.clean import first_seen_codes
from logsleuth.plans import bindings as B, detection as D, intel as I
from logsleuth.sources import aliases, alert_store, csv_logs, models, report_io, winevent

from conftest import SF_SMALL


@pytest.fixture()
def scratch(spark):
    from logsleuth.session import checkpoint_dir
    return tempfile.mkdtemp(prefix="io-", dir=checkpoint_dir(spark).replace("file:", ""))


def _write_csv(path, header, rows):
    with open(path, "w", encoding="utf-8") as f:
        f.write(header + "\n")
        for r in rows:
            f.write(",".join(r) + "\n")


def test_system_csv_scan_null_tokens_and_errors(spark, scratch):
    p = os.path.join(scratch, "system.csv")
    _write_csv(p, "timestamp,source_ip,user,service,event,failed_count,log_level", [
        ["2024-01-01T10:00:00+05:30", "10.0.0.1", "root", "sshd", "login_failed", "3.7", "warning"],
        ["2024-01-01T10:01:00+05:30", "N/A", "root", "sshd", "login_failed", "1", "warning"],
        ["2024-01-01T10:02:00+05:30", "8.8.8.8", "", "nan", "x", "bad", "info"],
        ["bad", "8.8.8.8", "a", "b", "x", "1", "info"],
        ["2024-01-01T23:00:00", " 1.2.3.4 ", "admin", "-", "privilege_escalation", "0", "ERROR"],
    ])
    raw = csv_logs.read_system_logs(spark, p)
    from logsleuth.operators.clean import clean_system
    out = clean_system(raw).orderBy("timestamp").collect()
    assert [r["source_ip"] for r in out] == ["10.0.0.1", "1.2.3.4"]
    assert out[0]["failed_count"] == 3 and out[0]["hour"] == 10 and out[0]["event_code"] == 1
    assert out[1]["service"] == "-" and out[1]["event_code"] == 2 and out[1]["is_night"] == 1
    with pytest.raises(FileNotFoundError):
        csv_logs.read_system_logs(spark, os.path.join(scratch, "missing.csv"))
    empty = os.path.join(scratch, "empty.csv")
    open(empty, "w").close()
    assert csv_logs.read_network_logs(spark, empty).count() == 0


def test_alias_scan(spark, scratch):
    p = os.path.join(scratch, "aliased.csv")
    _write_csv(p, " Time ,SRC_IP,Status,Extra", [["2024-01-01 00:00:00", "1.1.1.1", "ok", "e"]])
    df = aliases.load_system_logs(spark, p)
    assert df.columns == ["timestamp", "ip", "event_type", "extra", "user", "process_name"]
    assert df.first()["user"] == "unknown"
    bad = os.path.join(scratch, "bad.csv")
    _write_csv(bad, "when,who", [["x", "y"]])
    with pytest.raises(ValueError, match="system log: no column found for"):
        aliases.load_system_logs(spark, bad)


def test_detection_store_intel_report(spark, scratch):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    sys_raw = B.security_log(ev)
    net_raw = B.network_log(ev)
    sys_csv, net_csv = os.path.join(scratch, "sys"), os.path.join(scratch, "net")
    sys_raw.drop("row_id").coalesce(1).write.option("header", True).csv(sys_csv)
    net_raw.drop("row_id").coalesce(1).write.option("header", True).csv(net_csv)
    store = os.path.join(scratch, "store")
    D.run_detection(spark, sys_csv, net_csv, store, window_minutes=120)
    alerts = alert_store.load_alerts(spark, store)
    assert alerts is not None and alerts.count() > 0
    assert set(alerts.columns) >= set(C.ALERT_FIXED_COLUMNS)
    scored = I.scored_on_read(alerts)
    assert scored.where(~F.col("risk_score").between(0, 10)).count() == 0
    res = I.run_intel(alerts, n_init=2, generated_at="2024-02-01 00:00:00")
    path = os.path.join(scratch, "report")
    report_io.write_report(res.report, path)
    back = report_io.read_report(spark, path).first().asDict(recursive=True)
    assert back["executive_summary"]["total_alerts"] == alerts.count()
    assert back["unit2_best_first_triage"]["algorithm"] == C.TRIAGE_ALGORITHM
    assert len(back["indicators_of_compromise"]) <= C.IOC_TOP_K
    assert back["recommendations"][-1]["priority"] == "MEDIUM"
    assert "error" in report_io.read_report(spark, os.path.join(scratch, "nope")).columns
    # append keeps earlier runs; reset removes the store
    n_before = alerts.count()
    alert_store.save_alerts(alerts.limit(3), store)
    assert alert_store.load_alerts(spark, store).count() == n_before + 3
    alert_store.reset_alerts(spark, store)
    assert alert_store.load_alerts(spark, store) is None


def test_empty_report_and_model_persistence(spark, scratch):
    empty = spark.createDataFrame([], "attack_type string, timestamp timestamp")
    assert I.generate_report(empty).first()["error"] == C.REPORT_EMPTY_ERROR
    from logsleuth.operators import detect as DT
    df = spark.createDataFrame([(i, float(i % 7), float(i % 3)) for i in range(300)],
                               "row_id long, a double, b double")
    det = DT.fit_detector(df, ["a", "b"], n_trees=10)
    models.save_detector(det, os.path.join(scratch, "det"))
    det2 = models.load_detector(spark, os.path.join(scratch, "det"), ["a", "b"])
    s1 = DT.score_detector(det, df).orderBy("row_id").select("anomaly_score").collect()
    s2 = DT.score_detector(det2, df).orderBy("row_id").select("anomaly_score").collect()
    assert s1 == s2
    assert all(0 <= r[0] <= 1 for r in s1)


def test_files_of_one_folder_are_read_by_column_name(spark, scratch):
    folder = os.path.join(scratch, "mixed")
    os.makedirs(folder)
    _write_csv(os.path.join(folder, "1.csv"), "timestamp,source_ip,user", [["2024-01-01", "1.1.1.1", "u1"]])
    _write_csv(os.path.join(folder, "2.csv"), "user,timestamp,source_ip,extra", [["u2", "2024-01-02", "2.2.2.2", "x"]])
    open(os.path.join(folder, "3.csv"), "w").close()
    got = csv_logs.read_log_csv(spark, folder, [], "log").orderBy("user").collect()
    assert [(r["user"], r["source_ip"], r["extra"]) for r in got] == [("u1", "1.1.1.1", None), ("u2", "2.2.2.2", "x")]


def test_store_gives_blank_text_back_as_null_and_takes_empty_frames(spark, scratch):
    store = os.path.join(scratch, "blank")
    rows = spark.createDataFrame([("system", "", C.DATA_ORIGIN), ("system", "1.1.1.1", C.DATA_ORIGIN), ("system", "x", "other")],
                                 "log_type string, source_ip string, data_origin string")
    alert_store.save_alerts(rows.limit(0), store)
    assert alert_store.load_alerts(spark, store) is None
    alert_store.save_alerts(rows, store)
    assert {r["source_ip"] for r in alert_store.load_alerts(spark, store).collect()} == {None, "1.1.1.1"}


def test_network_alias_scan_defaults(spark, scratch):
    p = os.path.join(scratch, "net.csv")
    _write_csv(p, "ts,Client_IP,port,pkts,BYTES", [["t", "1.1.1.1", "80", "3", "9"]])
    df = aliases.load_network_logs(spark, p)
    assert df.columns == ["timestamp", "src_ip", "dst_port", "packets", "bytes_sent", "dst_ip", "protocol"]
    assert df.first()["protocol"] == "UNKNOWN"


def test_intel_job_fits_kmeans_as_often_as_the_operator(monkeypatch):
    from logsleuth import constants as C
    from logsleuth.plans import rows_only as R
    real, n = R.I.run_intel, []

    def run(*args, **kw):
        call = inspect.signature(real).bind(*args, **kw)
        call.apply_defaults()
        n.append(call.arguments["n_init"])
        return SimpleNamespace(report=None)
    monkeypatch.setattr(R.I, "run_intel", run)
    monkeypatch.setattr(R.Q, "alerts_df", lambda spark, d: None)
    monkeypatch.setattr(R, "report_json", lambda report: report)
    R.q_intel_job(None, None)
    assert n == [C.KMEANS_N_INIT]


def _lines(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    opener = gzip.open if path.endswith(".gz") else open
    with opener(path, "wt", encoding="utf-8", newline="") as f:
        f.write("\n".join(lines) + "\n")


def test_nested_folders_in_file_order(spark, scratch):
    """Splits are dealt by size; row ids follow paths and lines all the same."""
    root = os.path.join(scratch, "order log")
    values = {"a/day=1/small {x}.csv": ["zeta", "beta"], "b/big.csv": [f"v{i}" for i in range(60_000)] + ["beta"],
              "b/c/d/tiny.csv": ["last"], "b/c/zip.csv.gz": ["packed", "v3"], "0/other header.csv": ["first"]}
    for name, vals in values.items():
        head, row = ("extra,name", "e,{}") if "other" in name else ("name,extra", "{},e")
        _lines(os.path.join(root, name), [head] + [row.format(v) for v in vals])
    open(os.path.join(root, "b", "empty.csv"), "w").close()
    _lines(os.path.join(root, "b", "_hidden.csv"), ["name,extra", "no,no"])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for most, cost in (old, ("40k", "4k")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            log = csv_logs.read_log_csv(spark, root, [], file_order=True)
            assert spark.conf.get("spark.sql.files.openCostInBytes") == cost
            got = [r["name"] for r in log.orderBy("row_id").collect()]
            assert got == [v for name in sorted(values) for v in values[name]]
            codes = {r["name"]: r["name_code"] for r in first_seen_codes(log, "name").distinct().collect()}
            assert [codes[v] for v in ("first", "zeta", "beta", "v0", "v59999", "last", "packed")] == [0, 1, 2, 3, 60_002, 60_003, 60_004]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert csv_logs.read_log_csv(spark, root, []).count() == sum(map(len, values.values()))


def _some(spark, kind, n, **extra):
    return spark.range(n).selectExpr(f"'{kind}' AS log_type", "id AS row_id", f"'{C.DATA_ORIGIN}' AS data_origin",
                                     *[f"{v} AS {k}" for k, v in extra.items()])


def test_runs_are_repeatable_and_seen_when_committed(spark, scratch):
    store = os.path.join(scratch, "run store")
    assert alert_store.load_alerts(spark, store) is None
    for _ in range(2):  # interrupted after the first log, then repeated
        alert_store.save_alerts(_some(spark, "system", 5), store, "1")
    assert alert_store.load_alerts(spark, store) is None
    alert_store.save_alerts(_some(spark, "network", 3, port=80), store, "1")
    alert_store.commit_run(spark, store, "1", replace=True)
    assert alert_store.load_alerts(spark, store).count() == 8
    alert_store.save_alerts(_some(spark, "system", 100), store, "2")
    assert alert_store.load_alerts(spark, store).count() == 8
    alert_store.commit_run(spark, store, "2")
    assert alert_store.load_alerts(spark, store).count() == 108
    alert_store.save_alerts(_some(spark, "system", 7), store, "3")
    alert_store.commit_run(spark, store, "3", replace=True)
    assert alert_store.load_alerts(spark, store).count() == 7
    alert_store.reset_alerts(spark, store, "3")
    assert alert_store.load_alerts(spark, store).count() == 0
    alert_store.reset_alerts(spark, store)
    assert alert_store.load_alerts(spark, store) is None


def test_csv_store_skips_long_lines(spark, scratch):
    path = os.path.join(scratch, "csv store")
    o = C.DATA_ORIGIN
    _lines(os.path.join(path, "a.csv"), ["data_origin,a,b", f"{o},1,x", f"{o},2", f"{o},3,y,z", f"{o},4,y,", f'{o},"5,5",', f"{o},6,", o,
                                         f'{o},"7","p,q"', f"{o},8,,,,", "else,9,x"])
    got = sorted((r["a"] or "", r["b"]) for r in alert_store.load_alerts_csv(spark, path).collect())
    assert got == [("", None), ("1", "x"), ("2", None), ("5,5", None), ("6", None), ("7", "p,q")]


def test_event_store_opens_only_days_and_ids_asked_for(spark, scratch):
    def doc(i, day, event_id):
        time = f' SystemTime="2024-01-{day:02d}T{i % 24:02d}:30:00"' if day else ""
        return (i, f'<Event><System><EventID>{event_id}</EventID><TimeCreated{time}/></System></Event>')
    docs = [doc(i, 1 + i % 3, 4624 + i // 3 % 2) for i in range(144)] + [doc(900, 0, 4625), doc(901, 3, ""), (902, None)]
    rows = spark.createDataFrame(docs, "row_id int, xml string").repartition(4)
    path = os.path.join(scratch, "event-store")
    winevent.store_events(rows, path)
    winevent.store_events(rows, path)   # a repeated run leaves one copy
    schema = spark.read.parquet(path).schema

    def ids(**kw):
        got = winevent.stored_events(spark, path, "2024-01-03 12:00:00", schema=schema, **kw)
        return sorted(r["row_id"] for r in got.collect())
    late = [i for i in range(144) if i % 3 == 2 and i % 24 >= 12] + [901]   # 901: 2024-01-03 13:30, without an id
    assert ids() == sorted(late)
    asked = [i for i in late if i < 144 and 4624 + i // 3 % 2 == 4625]
    plan = winevent.stored_events(spark, path, "2024-01-03 12:00:00", [4625])._jdf.queryExecution().executedPlan().toString()
    assert "event_day" in plan.split("PartitionFilters")[1] and "GreaterThanOrEqual(time_ts" in plan.split("PushedFilters")[1]
    broken = 0
    for folder, _, files in os.walk(path):
        if "event_day=2024-01-03/win_event_id=4625" not in folder:
            for f in files:   # what is not opened may hold anything
                if f.endswith(".parquet"):
                    with open(os.path.join(folder, f), "wb") as out:
                        out.write(b"PAR1 no table PAR1")
                    os.remove(os.path.join(folder, f".{f}.crc"))
                    broken += 1
    assert broken >= 6
    spark.catalog.refreshByPath(path)
    assert ids(ids=[4625]) == asked and asked
    newest = winevent.stored_events(spark, path, "2024-01-03 12:00:00", [4625], 2, schema=schema).collect()
    assert [r["row_id"] for r in newest] == sorted(asked, key=lambda i: (-(i % 24), i))[:2]
    with pytest.raises(Exception):
        ids()
