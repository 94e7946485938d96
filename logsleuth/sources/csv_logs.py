"""CSV log scans and sinks.

Scans read every column as a string (no inference pass over the data), then
turn the missing-value tokens of a pandas CSV read into null.  A path is a file
or a folder with files at any depth, taken in the order of their paths.  A
missing path raises; an empty file gives an empty frame with the required
columns.  Filters and projections applied afterwards are pushed into the scan.
"""

from __future__ import annotations

import csv
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from .. import constants as C
from ..functions.text import na_to_null

_ROW_BITS = 33  # of monotonically_increasing_id, for the place in a partition


def _exists(spark: SparkSession, path: str) -> bool:
    """Asked of the file system that the path (or the cluster's default) names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


@contextmanager
def _one_split_a_task(spark: SparkSession):
    """Scans that are run inside put every split into a partition of its own."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Files by their header, read in tasks; empty files are left out.

    A task takes the first line of the split at the start of a file and stops,
    so that no more than the first batch of a file is read."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        "_metadata.file_path", F.col("_metadata.file_block_start").alias("start"), "value")

    def first(batches):
        for batch in batches:
            if batch.num_rows:
                if batch.column(1)[0].as_py() == 0:
                    yield pa.RecordBatch.from_arrays([batch.column(0)[:1].cast(pa.string()), batch.column(2)[:1].cast(pa.string())],
                                                     names=["file_path", "line"])
                return
    with _one_split_a_task(spark):
        found = lines.mapInArrow(first, "file_path string, line string").collect()  # a row for each file
    out: dict[tuple[str, ...], list[str]] = {}
    for row in sorted(found):
        if row["line"].strip("\ufeff \t\r"):
            out.setdefault(tuple(next(csv.reader([row["line"].lstrip("\ufeff")]))), []).append(row["file_path"])
    return out


def _split_numbers(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """((file_path, base), size): a split that starts at byte b of a file has
    the number base + b div size; numbers follow the order of paths.  One row
    for each file, as the driver's own listing of the scan has."""
    conf = spark._jsparkSession.sessionState().conf()
    size = min(conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes())  # no split is smaller, but for the last
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("_metadata.file_path", "length")
    before = Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum(F.expr(f"length div {size}") + 1).over(before), F.lit(0))
    return files.select("file_path", base.alias("base")), size


def _row_id(size: int) -> Column:
    """Grows with the place in the files: number of the split, place in its partition."""
    place = F.monotonically_increasing_id().bitwiseAND((1 << _ROW_BITS) - 1)
    return F.shiftleft(F.col("base") + F.floor(F.col("_start") / size), _ROW_BITS) + place


def read_log_csv(spark: SparkSession, path: str, required: list[str],
                 label: str = "log CSV", file_order: bool = False) -> DataFrame:
    """A header CSV, or a folder of them at any depth, as strings.  Columns are
    matched by name: files with another header are scanned with their own and
    united.  ``file_order`` adds ``row_id``, a number that follows the order of
    paths and of lines in a file (F14 needs it); it does not depend on how
    splits are dealt to tasks."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"{label} not found: {path}")
    headers = _headers(spark, path)
    if not headers:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in required])
        return spark.createDataFrame([], schema.add("row_id", "long") if file_order else schema)
    numbers, size = _split_numbers(spark, path) if file_order else (None, 0)
    out = None
    for names, files in headers.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
        reader = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
                  .option("multiLine", False).option("escape", '"').option("recursiveFileLookup", True))
        df = reader.csv(path if len(headers) == 1 else [_plain(f) for f in files])
        own = [na_to_null(F.col(f"`{c}`")).alias(c) for c in df.columns]
        if file_order:
            df = df.select(*own, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"))
            df = df.join(F.broadcast(numbers), F.col("_path") == F.col("file_path")).withColumn("row_id", _row_id(size)).drop(
                "_path", "_start", "file_path", "base")
        else:
            df = df.select(*own)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def _plain(uri: str) -> str:
    """A file name as a reader takes it, from the escaped form of the metadata."""
    from urllib.parse import unquote
    name = unquote(uri)
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in name)  # not a pattern


def read_system_logs(spark: SparkSession, path: str, file_order: bool = False) -> DataFrame:
    """Raw system log (clean it with ``operators.clean.clean_system``)."""
    return read_log_csv(spark, path, C.SYSTEM_REQUIRED, "System log", file_order)


def read_network_logs(spark: SparkSession, path: str, file_order: bool = False) -> DataFrame:
    """Raw network log (clean it with ``operators.clean.clean_network``)."""
    return read_log_csv(spark, path, C.NETWORK_REQUIRED, "Network log", file_order)


def system_table(rows: DataFrame) -> DataFrame:
    """S12 projection: the 8 system columns, ``event_type`` written as ``event``."""
    src = rows.withColumnRenamed("event_type", "event") if "event_type" in rows.columns else rows
    return src.select(*[F.col(c) if c in src.columns else F.lit(None).cast("string").alias(c)
                        for c in C.SYSTEM_OUTPUT_COLUMNS])


def network_table(rows: DataFrame) -> DataFrame:
    """S12 projection: the 19 network columns."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c)
                         for c in C.NETWORK_OUTPUT_COLUMNS])


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S12 sink: header CSV (a header-only file when there are no rows)."""
    df.write.mode(mode).option("header", True).csv(path)
