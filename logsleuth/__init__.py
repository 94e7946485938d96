"""logsleuth: security and network log analytics as Spark DataFrame jobs.

Every operator takes and returns ``pyspark.sql.DataFrame`` objects; planning
and execution are left to Catalyst, AQE and the Spark scheduler.
"""

__version__ = "0.1.0"
