"""Alert store.

The store is a Parquet table partitioned by ``run`` and ``log_type``.  Appending writes new files only (no rewrite of earlier runs);
reading merges schemas by name, so runs with different optional columns union
with nulls (U1).

A run is written with dynamic partition overwrite, so that it can be repeated,
and seen by readers only after ``commit_run`` has added it to the list of
committed runs (``_runs`` below the store, a name that scans pass over).
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import constants as C
from .csv_logs import _exists

_RUNS = "_runs"
_END = "\u0001end"


def save_alerts(alerts: DataFrame, path: str, run: str | None = None) -> None:
    """Append as a run of its own, committed at once, or write the
    partitions of a run that is committed later.  A frame without rows adds no
    data files (its write makes an empty folder at most), so the plan runs once."""
    name = run or uuid.uuid4().hex
    alerts.withColumn("run", F.lit(f"r{name}")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("run", "log_type").parquet(path)
    if run is None:
        commit_run(alerts.sparkSession, path, name)


def commit_run(spark: SparkSession, path: str, run: str, replace: bool = False) -> None:
    """Make a run visible; with ``replace`` instead of all earlier ones."""
    row = spark.createDataFrame([(time.time_ns(), f"r{run}", replace)], "at long, run string, replace boolean")
    row.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/{_RUNS}")


def committed_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run): the last commit that replaces, and those after it."""
    runs = spark.read.schema("at long, run string, replace boolean").parquet(f"{path.rstrip('/')}/{_RUNS}")
    since = runs.agg(F.coalesce(F.max(F.when(F.col("replace"), F.col("at"))), F.lit(0)).alias("since"))
    return runs.join(F.broadcast(since), F.col("at") >= F.col("since")).select("run").distinct()


def load_alerts(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored alerts of committed runs whose ``data_origin`` is the
    collected one; a store without runs is read whole.

    Blank text comes back as null.  Returns ``None`` when the store does not
    exist, holds no data or has no ``data_origin`` column."""
    if not _exists(spark, path) or not _has_data(spark, path):
        return None
    spark.catalog.refreshByPath(path)       # other runs may have appended files
    df = spark.read.option("mergeSchema", True).parquet(path)
    if "data_origin" not in df.columns:
        return None
    if "run" in df.columns:
        if not _exists(spark, f"{path.rstrip('/')}/{_RUNS}"):
            return None
        df = df.join(committed_runs(spark, path), "run", "left_semi").drop("run")
    df = df.select(*[F.when(F.col(f"`{f.name}`") != "", F.col(f"`{f.name}`")).alias(f.name)
                     if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields])
    return df.where(F.col("data_origin") == C.DATA_ORIGIN)


def _has_data(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a Parquet file, at any depth."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
    while files.hasNext():
        file = files.next().getPath()
        if file.getName().endswith(".parquet") and f"/{_RUNS}/" not in file.toString():
            return True
    return False


def load_alerts_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """S8 for a CSV store: lines with more fields than the header are left out,
    the missing fields of shorter ones are null; blank text comes back as null,
    like a pandas re-read."""
    if not _exists(spark, path):
        return None
    names = spark.read.option("header", True).csv(path).columns
    if "data_origin" not in names:
        return None
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    rows = spark.read.schema(T.StructType(schema.fields + [T.StructField("_bad", T.StringType())])).option(
        "header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)
    # a line that is not as long as the header is cut again, with a mark behind
    # its last field: the mark is among one field more if the line is short
    wide = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names) + 1)])
    cut = F.from_csv(F.concat("_bad", F.lit(f",{_END}")), ", ".join(f"{f.name} string" for f in wide.fields))
    short = F.array_contains(F.array(*[cut[f.name] for f in wide.fields]), _END)
    rows = rows.where(F.col("_bad").isNull() | F.coalesce(short, F.lit(False)))
    rows = rows.select(*[F.when(F.col(f"`{c}`") == "", None).otherwise(F.col(f"`{c}`")).alias(c) for c in names])
    return rows.where(F.col("data_origin") == C.DATA_ORIGIN)


def reset_alerts(spark: SparkSession, path: str, run: str | None = None) -> None:
    """Remove the store before a fresh detection run, or what a run has
    stored so far."""
    target = path if run is None else f"{path.rstrip('/')}/run=r{run}"
    if not _exists(spark, target):
        return
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
