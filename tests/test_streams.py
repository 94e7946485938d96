"""The keyed table of a stream: bounded files, batches that come again.  The
look-back rule: restarts, and a stored batch as first state."""

import os
import random
from datetime import datetime, timezone

from logsleuth.session import checkpoint_dir
from logsleuth.streaming import live


def _batch(spark, rng, number):
    keys = rng.sample(range(40), 6)
    return {k: number * 1000 + k for k in keys}, spark.createDataFrame(
        [(k, number * 1000 + k, None if k % 2 else "x") for k in keys], "k int, v long, t string").coalesce(1)


def test_files_stay_bounded_and_repeated_batches_change_nothing(spark):
    folder = f"{checkpoint_dir(spark)}/keyed-{random.random()}"
    rng, want, batches = random.Random(3), {}, []
    assert live.latest(spark, folder, "k") is None
    for number in range(23):
        now, df = _batch(spark, rng, number)
        batches.append(df)
        want.update(now)
        live.merge_batch(df, number, folder, "k", every=3)
        if number in (4, 11):  # after a failure the last batch is run again, an older one never wins
            live.merge_batch(df, number, folder, "k", every=3)
            live.merge_batch(batches[0], 0, folder, "k", every=3)
    got = live.latest(spark, folder, "k")
    assert {r["k"]: r["v"] for r in got.collect()} == want
    assert all((r["t"] is None) == (r["k"] % 2 == 1) for r in got.collect())
    local = folder.replace("file:", "")
    assert len(os.listdir(f"{local}/base")) <= 2 and len(os.listdir(f"{local}/delta")) <= 6


def test_an_unfinished_base_is_not_read(spark):
    folder = f"{checkpoint_dir(spark)}/keyed-{random.random()}"
    rng = random.Random(5)
    want = {}
    for number in range(4):
        now, df = _batch(spark, rng, number)
        want.update(now)
        live.merge_batch(df, number, folder, "k", every=3)
    os.makedirs(f"{folder.replace('file:', '')}/base/batch=9")  # a merge that was interrupted
    assert {r["k"]: r["v"] for r in live.latest(spark, folder, "k").collect()} == want


LOGINS = "row_id long, source_ip string, ts_ms long, failed_count int, timestamp timestamp"


def _logins(seed, n=240):
    rng, ms, out = random.Random(seed), 1_700_000_000_000, []
    for i in range(n):
        ms += rng.choice([0, 1, 700, 20_000, 90_000])
        out.append((i, rng.choice(["10.0.0.1", "10.0.0.1", "10.0.0.2"]), ms, rng.choice([None, 0, 1, 2]),
                    datetime.fromtimestamp(ms / 1000, timezone.utc)))
    return out


def _look_back(rows, window=300_000):
    out = {}
    for i, ip, ms, _, _ in rows:
        near = [r for r in rows if r[1] == ip and ms - window <= r[2] <= ms]
        out[i] = (len(near), sum(r[3] or 0 for r in near))
    return out


def _run(spark, folder, rows, before=None):
    spark.createDataFrame(rows, LOGINS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(LOGINS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    live.append_to(spark, live.brute_force_stream(stream, 5, before=before), f"{folder}/out")
    got = spark.read.parquet(f"{folder}/out/rows").collect()
    return {r["row_id"]: (r["ip_event_count"], r["ip_failed_count"]) for r in got}, len(got)


def test_rule_goes_on_after_restarts(spark):
    folder, rows, size = f"{checkpoint_dir(spark)}/rule-{random.random()}", _logins(1), 0
    cuts = [0, 90, 91, 200, len(rows)]
    for a, b in zip(cuts, cuts[1:]):  # each run is a query of its own on the same state
        got, size = _run(spark, folder, rows[a:b])
    assert got == _look_back(rows) and size == len(rows)


def test_rule_begins_with_a_stored_batch(spark):
    folder, rows = f"{checkpoint_dir(spark)}/rule-{random.random()}", _logins(2)
    before = spark.createDataFrame(rows[:120], LOGINS)
    got, size = _run(spark, folder, rows[120:], before)
    want = _look_back(rows)
    assert got == {i: want[i] for i in range(120, len(rows))} and size == len(rows) - 120
