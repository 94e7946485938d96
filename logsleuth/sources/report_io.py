"""Report sink and scan.

The report is a one-row DataFrame of nested structs and arrays
(``plans.intel.generate_report``); it is written as JSON by Spark itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import constants as C
from .csv_logs import _exists


def write_report(report: DataFrame, path: str) -> None:
    """One JSON document (single row -> single part file)."""
    report.coalesce(1).write.mode("overwrite").json(path)


def report_json(report: DataFrame) -> DataFrame:
    """S10 as a string column (what an API would return)."""
    return report.select(F.to_json(F.struct(*report.columns)).alias("report_json"))


def read_report(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The stored report, or an error record when it is missing."""
    if not _exists(spark, path):
        return spark.createDataFrame([("no report has been written yet",)],
                                     "error string")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(path)


EMPTY_REPORT_ERROR = C.REPORT_EMPTY_ERROR
