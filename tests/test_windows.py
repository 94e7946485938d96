"""Look-back windows: both physical forms against a brute-force loop."""

import random

import pytest
from pyspark.sql import functions as F

from logsleuth.operators import windows
from logsleuth.operators.windows import window_counts, window_distinct

W = 600_000


def _fixture():
    rnd = random.Random(7)
    rows, rid = [], 0
    # exact frame ends, 1 ms outside, equal timestamps, a hot key and a blank key
    for key, base in (("a", 0), ("b", 5_000_000)):
        for t in (base, base + W, base + W + 1, base + W + 1, base + 2 * W + 2):
            rows.append((rid, key, t, rnd.randint(0, 3), rnd.randint(0, 2)))
            rid += 1
    for _ in range(1500):                       # hot blank key
        rows.append((rid, "", rnd.randint(0, 20 * W), rnd.randint(0, 1), rnd.randint(0, 40)))
        rid += 1
    for _ in range(500):
        rows.append((rid, rnd.choice("xyz"), rnd.randint(0, 5 * W), rnd.randint(0, 2),
                     rnd.randint(0, 5)))
        rid += 1
    return rows


def _brute(rows):
    out = {}
    for rid, k, t, v, p in rows:
        sel = [r for r in rows if r[1] == k and t - W <= r[2] <= t]
        out[rid] = (len(sel), sum(r[3] for r in sel), len({r[4] for r in sel}))
    return out


@pytest.mark.parametrize("method,bucket", [("prefix", 60_000), ("prefix", 7_777), ("range", 0)])
def test_windows_match_brute_force(spark, method, bucket):
    rows = _fixture()
    df = spark.createDataFrame(rows, "row_id long, k string, ms long, v int, port int")
    kw = {"bucket_ms": bucket} if bucket else {}
    c = window_counts(df, "k", "ms", W, {"s": "v"}, "n", method=method, **kw)
    d = window_distinct(c, "k", "ms", "port", W, "dp", method=method, **kw)
    got = {r["row_id"]: (r["n"], r["s"], r["dp"]) for r in d.collect()}
    assert len(got) == len(rows)
    assert got == _brute(rows)


def test_global_position_matches_row_number(spark):
    from pyspark.sql import Window, functions as F
    from logsleuth.operators.ordering import global_position
    rows = [(i * 7919 % 1000 - 500, f"v{i % 13}") for i in range(400)] + [(2 ** 40, "big")]
    df = spark.createDataFrame(rows, "k long, s string").dropDuplicates(["k", "s"])
    got = {(r.k, r.s): r.pos for r in global_position(df, ["k", "s"], "pos", buckets=7).collect()}
    want = {(r.k, r.s): r.pos for r in
            df.withColumn("pos", F.row_number().over(Window.orderBy("k", "s")) - 1).collect()}
    assert got == want
    plan = global_position(df, ["k", "s"], "pos", buckets=7)._jdf.queryExecution() \
        .executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def test_global_position_string_key(spark):
    from pyspark.sql import Window, functions as F
    from logsleuth.operators.ordering import global_position
    df = spark.createDataFrame([(f"k{i * 31 % 97:03d}", i) for i in range(200)], "s string, i long")
    got = {(r.s, r.i): r.pos for r in global_position(df, ["s", "i"], "pos", buckets=5).collect()}
    want = {(r.s, r.i): r.pos for r in
            df.withColumn("pos", F.row_number().over(Window.orderBy("s", "i")) - 1).collect()}
    assert got == want


def test_null_keys_are_a_group_of_their_own(spark):
    rows = [(None, 0, 1), (None, 30_000, 1), (None, 90_000, 2), ("a", 10_000, 1), ("a", 70_000, 2)]
    df = spark.createDataFrame(rows, "k string, ms long, port int")
    for fn in (lambda m: window_counts(df, "k", "ms", 300_000, method=m),
               lambda m: window_distinct(df, "k", "ms", "port", 300_000, method=m)):
        assert sorted(map(str, fn("prefix").collect())) == sorted(map(str, fn("range").collect()))


def test_a_burst_minute_is_spread_over_tasks(spark):
    """A third of all rows in one minute of one address: no task of the window
    plan holds them, and values equal the single-task form."""
    n = 30_000
    df = spark.range(n).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 97) END AS k",
        "CASE WHEN id % 3 = 0 THEN 600000 + pmod(xxhash64(id), 60000) ELSE pmod(xxhash64(id, 1), 7200000) END AS ms",
        "pmod(id, 5) AS v", "repeat('wide', 50) AS payload")
    got = window_counts(df, "k", "ms", 120_000, {"s": "v"})
    want = window_counts(df, "k", "ms", 120_000, {"s": "v"}, method="range")
    assert got.exceptAll(want).isEmpty() and got.count() == n
    ports = window_distinct(df, "k", "ms", "v", 120_000).drop("payload")
    assert ports.exceptAll(window_distinct(df, "k", "ms", "v", 120_000, method="range").drop("payload")).isEmpty()
    points = windows._prefix_sums(df.selectExpr("k AS _k", "ms AS _t", "1L AS _n", "true AS _at"), ["_n"], 60_000)
    assert "payload" not in got.select("id", "window_count")._jdf.queryExecution().optimizedPlan().toString()
    assert points.where("_k = 'hot'").count() == df.where("k = 'hot'").select("ms").distinct().count()
    # the join spreads the burst by ms: the fullest of 64 partitions has a small part of it
    spread = df.where("k = 'hot'").repartition(64, "k", "ms").groupBy(F.spark_partition_id()).count()
    assert spread.agg(F.max("count")).first()[0] < n / 3 / 20


def test_distinct_counts_join_once_and_share_the_points(spark):
    """Gaps are found by one aggregate, without a join back to the rows, and
    the points are shuffled once for running sums and bucket totals."""
    df = spark.createDataFrame(_fixture(), "row_id long, k string, ms long, v int, port int")
    out = window_distinct(df, "k", "ms", "port", W, "dp")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2   # offsets of the buckets, rows to their points
    for frame in (out, window_counts(df, "k", "ms", W, {"s": "v"})):
        frame.collect()
        assert "ReusedExchange" in frame._jdf.queryExecution().executedPlan().toString()


def test_gaps_at_bucket_edges(spark):
    """One value at times one bucket, one window and one ms more apart."""
    at = [0, W - 1, W, 2 * W - 1, 2 * W, 3 * W, 4 * W + 1, 6 * W + 1, 6 * W + 1, 8 * W]
    df = spark.createDataFrame([(i, "a", t, 7 + i % 2) for i, t in enumerate(at)], "row_id long, k string, ms long, port int")
    got = window_distinct(df, "k", "ms", "port", W, "dp")
    assert got.exceptAll(window_distinct(df, "k", "ms", "port", W, "dp", method="range")).isEmpty()
