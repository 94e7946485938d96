"""Shared helpers of the text operators: tables, word rules, batch access.

A *word* is a maximal run of characters other than space and the five ASCII
control blanks (tab to carriage return).  ``bytes.split()`` cuts UTF-8 text
into exactly these words and ``bytes.lower()`` lower-cases A-Z only, so the
Python operators work on bytes; the native ones use ``words_col``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logsleuth.session import checkpoint_dir, ship_package

BLANKS = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder from the session, package on the Python workers."""
    checkpoint_dir(spark)
    ship_package(spark)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_col(text: Column | str) -> Column:
    """Array of the words of a text column; null and blank texts give an empty array."""
    text = F.col(text) if isinstance(text, str) else text
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def word_count(text: Column | str) -> Column:
    return F.size(words_col(text)).cast("long")


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives an empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return pc.fill_null(column.cast(kind), b"").to_pylist()


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None],
                schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = work(batch)
            if out is not None and out.num_rows:
                yield out
    return df.mapInArrow(run, schema)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the
    lineage, and its readers know its size."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


HOT = 1000  # keys of a table that are looked up by broadcast


def look_up(rows: DataFrame, key: str, spread: str, table: DataFrame, out: str) -> DataFrame:
    """``rows`` with ``out``, the struct of the row of ``table`` whose ``key``
    is the same, or null.  ``table`` is stored, has distinct values of ``key``
    and ``n``, the number of rows that ask for each.

    The ``HOT`` most wanted keys are broadcast (so many rows at most), and the
    rows that they serve go through the join with the others by ``spread``."""
    columns = [c for c in table.columns if c != key]
    hot = table.orderBy(F.desc("n"), key).limit(HOT).select(F.col(key).alias("__k1"), F.struct(*columns).alias("__v1"))
    rows = rows.join(F.broadcast(hot), F.col(key) == F.col("__k1"), "left")
    asked = F.when(F.col("__k1").isNull(), F.col(key))
    rest = table.select(F.col(key).alias("__k2"), F.lit(0).alias("__salt"), F.struct(*columns).alias("__v2"))
    rows = rows.withColumn("__served", F.when(asked.isNull(), F.xxhash64(spread)).otherwise(F.lit(0).cast("long")))
    found = (F.coalesce(asked, F.lit("")) == F.col("__k2")) & (F.col("__served") == F.col("__salt"))
    return rows.join(rest, found, "left").withColumn(out, F.coalesce("__v1", "__v2")).drop(
        "__k1", "__v1", "__k2", "__v2", "__salt", "__served")


class Memo(dict):
    """A dictionary that computes missing values and starts again when full,
    so its memory is bounded whatever the number of distinct keys."""

    def __init__(self, make: Callable, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value
