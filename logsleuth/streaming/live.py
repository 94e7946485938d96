"""Structured Streaming jobs.

Z2 ``brute_force_stream``: the per-source look-back rule (W1, W2, F21) on
arrival.  State is keyed by (address, time slice), a slice being as long as the
window.  A row goes to its own slice, where it is judged, and to the next one,
where it is context; so a judgement needs one state only, a busy address is
spread over its slices, and a slice is dropped when the watermark has passed
the end of the slice it serves.  State holds one entry for each millisecond of
a batch, not for each row, and a batch writes its own entries only.  A stream
can begin with the state of a stored batch.  On time-ordered input the result
equals the batch operator.

Z1 ``hourly_counts``: alerts per event-time hour with a watermark, the polling
dashboard's timeline as an incremental aggregate, without zero fill.

``append_to`` and ``upsert_to`` run a stream over everything in its source now
and write to a folder of Parquet files; nothing goes through the driver.  The
keyed table of ``upsert_to`` is compacted every ``COMPACT_EVERY`` batches, so
its files stay bounded however long a stream runs.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import constants as C
from ..session import checkpoint_dir, ship_package


COMPACT_EVERY = 8


def hourly_counts(alerts_stream: DataFrame, time_col: str = "timestamp",
                  watermark: str = "2 hours") -> DataFrame:
    """(hour_start, alert_count) per event-time hour."""
    return (alerts_stream.withWatermark(time_col, watermark)
                         .groupBy(F.window(time_col, "1 hour").alias("w"))
                         .agg(F.count(F.lit(1)).alias("alert_count"))
                         .select(F.col("w.start").alias("hour_start"), "alert_count"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SEEN = "ms bigint, n bigint, fc bigint"


def _points(pdf: pd.DataFrame) -> pd.DataFrame:
    """(ms, n, fc): rows and failed log-ins of each millisecond."""
    return pdf.groupby("ts_ms", as_index=False).agg(n=("failed_count", "size"), fc=("failed_count", "sum"))


class _BruteForce(StatefulProcessor):
    """State of one (address, slice): a list of (ms, n, fc).  A batch appends
    one entry for each of its own milliseconds and writes nothing else; a timer
    at the end of the slice drops the list."""

    def __init__(self, window_ms: int, columns: list[str]):
        self.window_ms, self.columns = window_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", SEEN)

    def _append(self, key, points: pd.DataFrame, timers) -> int:
        """End of the slice, after the points have been added to its list."""
        end = (int(key[1]) + 1) * self.window_ms
        if not self.seen.exists():
            self.handle.registerTimer(max(end, timers.getCurrentWatermarkInMs() + 1))
        self.seen.appendList([tuple(map(int, x)) for x in points.itertuples(index=False)])
        return end

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._append(key, initialState[["ms", "n", "fc"]], timerValues)

    def handleInputRows(self, key, rows, timerValues):
        start = int(key[1]) * self.window_ms
        points, own = [], []
        for pdf in rows:   # first everything that has arrived, then the judgements
            points.append(_points(pdf))
            own.append(pdf[pdf["ts_ms"] >= start])
        self._append(key, pd.concat(points), timerValues)
        if not any(map(len, own)):
            return
        seen = np.array(list(self.seen.get()), np.int64).reshape(-1, 3)
        ms, at = np.unique(seen[:, 0], return_inverse=True)
        cn, cf = (np.concatenate([[0], np.cumsum(np.bincount(at, seen[:, i], len(ms)).astype(np.int64))]) for i in (1, 2))
        for pdf in own:
            t = pdf["ts_ms"].to_numpy(np.int64)
            hi, lo = np.searchsorted(ms, t, "right"), np.searchsorted(ms, t - self.window_ms, "left")
            failed = cf[hi] - cf[lo]
            brute = (pdf["failed_count"].to_numpy() >= C.BRUTE_FORCE_FAILED_LOGINS) \
                | (failed >= C.BRUTE_FORCE_FAILED_LOGINS)
            yield pdf[self.columns].assign(ip_event_count=cn[hi] - cn[lo], ip_failed_count=failed,
                                           heuristic_brute_force=brute.astype("int32"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def _slices(rows: DataFrame, window: int) -> DataFrame:
    """Each row twice: in its own slice and, as context, in the next one."""
    own = F.floor(F.col("ts_ms") / window).cast("bigint")
    return rows.withColumn("slice", F.explode(F.array(own, own + 1)))


def brute_force_stream(clean_stream: DataFrame, window_minutes: int = C.WINDOW_MINUTES,
                       keep: tuple[str, ...] = (), lateness: str = "2 hours",
                       before: DataFrame | None = None) -> DataFrame:
    """Z2 on a cleaned system-log stream (``row_id``, ``source_ip``, ``ts_ms``,
    ``failed_count``, ``timestamp`` and the columns ``keep``).

    ``before``, a stored batch (``source_ip``, ``ts_ms``, ``failed_count``), is
    the state that the stream begins with: its rows are context and are not
    judged.  It is read when the query starts for the first time; later starts
    go on from the stream's own state."""
    spark = clean_stream.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    window = window_minutes * 60_000
    failed = F.coalesce("failed_count", F.lit(0)).cast("bigint").alias("failed_count")
    columns = ["row_id", "source_ip", "ts_ms", "timestamp", *[c for c in keep if c != "timestamp"]]
    rows = _slices(clean_stream.select(*columns, failed).withWatermark("timestamp", lateness), window)
    fields = [rows.schema[c] for c in columns] + [
        T.StructField("ip_event_count", T.LongType()), T.StructField("ip_failed_count", T.LongType()),
        T.StructField("heuristic_brute_force", T.IntegerType())]
    if before is not None:
        before = (_slices(before.select("source_ip", "ts_ms", failed), window)
                  .groupBy("source_ip", "slice", F.col("ts_ms").alias("ms"))
                  .agg(F.count(F.lit(1)).alias("n"), F.sum("failed_count").alias("fc")).groupBy("source_ip", "slice"))
    return rows.groupBy("source_ip", "slice").transformWithStateInPandas(
        _BruteForce(window, columns), T.StructType(fields), "append", "EventTime", initialState=before)


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"


def append_to(spark: SparkSession, stream: DataFrame, folder: str | None = None) -> str:
    """Run ``stream`` over all input there is now, appending its rows to a
    folder; the folder."""
    folder = folder or _folder(spark)
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option(
        "checkpointLocation", f"{folder}/state").outputMode("append").trigger(
        availableNow=True).start().awaitTermination()
    return f"{folder}/rows"


def _folders(spark: SparkSession, folder: str) -> dict[int, str]:
    """The complete folders ``batch=N`` below ``folder``, by N in ascending order."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return {}
    paths = [s.getPath().toString() for s in fs.listStatus(root)]
    done = {int(p.rsplit("=", 1)[1]): p for p in paths if "/batch=" in p
            and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}
    return dict(sorted(done.items()))


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def latest(spark: SparkSession, folder: str, key: str) -> DataFrame | None:
    """The rows of a table that ``merge_batch`` keeps, one for each key: the
    newest base and the batches after it.  None without a batch."""
    bases, deltas = _folders(spark, f"{folder}/base"), _folders(spark, f"{folder}/delta")
    version = max(bases, default=-1)
    parts = [(version, bases[version])] if bases else []
    parts += [(n, p) for n, p in deltas.items() if n > version]
    rows = None
    for number, path in parts:
        part = spark.read.parquet(path).withColumn("_batch", F.lit(number).cast("long"))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return None
    rest = [c for c in rows.columns if c not in (key, "_batch")]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "_batch").alias("_v"))
    return newest.select(key, *[F.col(f"_v.{c}").alias(c) for c in rest])


def merge_batch(batch: DataFrame, number: int, folder: str, key: str, every: int = COMPACT_EVERY) -> None:
    """Upsert the rows of a micro-batch by ``key``; its keys are distinct.

    A batch is a folder of its own; ``every`` of them are merged with the last
    base into a new one.  The base before and the batches it lacks stay for
    readers that began with them; older folders go.  A batch that comes again
    is overwritten, or passed over if a base holds it already."""
    spark = batch.sparkSession
    bases = _folders(spark, f"{folder}/base")
    version = max(bases, default=-1)
    if number <= version:
        return
    batch.write.mode("overwrite").parquet(f"{folder}/delta/batch={number}")
    deltas = _folders(spark, f"{folder}/delta")
    if sum(n > version for n in deltas) >= every:
        latest(spark, folder, key).write.mode("overwrite").parquet(f"{folder}/base/batch={number}")
        _delete(spark, [p for n, p in bases.items() if n < version] + [p for n, p in deltas.items() if n <= version])


def upsert_to(spark: SparkSession, stream: DataFrame, key: str, folder: str | None = None) -> DataFrame:
    """Run an aggregate over all input there is now; every batch upserts the
    groups it changed into a keyed table, which is read back."""
    folder = folder or _folder(spark)
    stream.writeStream.foreachBatch(lambda batch, number: merge_batch(batch, number, f"{folder}/rows", key)).option(
        "checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return latest(spark, f"{folder}/rows", key)
