"""How many rows go to a Python worker at once."""

from __future__ import annotations

from pyspark.sql import SparkSession


def small_batches() -> None:
    """For this session, batches of at most 1,000 rows and 8 MB between executors and their Python workers, which hold them whole: texts are long."""
    spark = SparkSession.active()
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = spark.conf.get(key).rstrip("bB")
        if not now.isdigit() or int(now) <= 0 or int(now) > most:
            spark.conf.set(key, str(most))
