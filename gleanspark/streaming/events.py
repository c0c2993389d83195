"""Micro-batches over arriving files: windowed sums with late data, and first arrivals by key.

Both run what is there (availableNow) to a table and its checkpoint in the folder that the cluster shares, and return the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import scratch, until_exit


def _folder(spark: SparkSession, what: str) -> str:
    return scratch(spark, f"stream-{what}")


def arrivals(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The files of a table as a stream; a single file is found by its folder and name."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    return reader.option("pathGlobFilter", name if name.endswith(".parquet") else "*.parquet").parquet(folder if name.endswith(".parquet") else path)


def drained(df: DataFrame, what: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that has arrived, into a table."""
    spark = df.sparkSession
    out = _folder(spark, what)
    df.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/table").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{until_exit(spark, out)}/table")


def tumbling(spark: SparkSession, path: str, length: str = "1 hour") -> DataFrame:
    """Counts and sums by type and window. Each micro-batch writes its partial sums; reading adds them, so no late row is lost."""
    out = _folder(spark, "tumbling")

    def add(batch: DataFrame, number: int) -> None:
        by = batch.groupBy("event_type", F.window("ts", length).getField("start").alias("start"))
        by.agg(F.count("*").alias("n"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{out}/table/batch={number}")

    arrivals(spark, path).writeStream.foreachBatch(add).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{until_exit(spark, out)}/table").groupBy("event_type", "start").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


def first_arrivals(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Keys at their first arrival: state holds each key once, so polls that overlap add nothing."""
    keys = keys or ("user_id", "event_type")
    return drained(arrivals(spark, path).select(*keys).dropDuplicates(list(keys)), "arrivals")


def timed(spark: SparkSession, path: str, late: str) -> DataFrame:
    """Arriving events with a watermark; their times are read in the session's zone, since watermarks need instants."""
    return arrivals(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def sliding(spark: SparkSession, path: str, length: str = "6 hours", step: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Counts by type and overlapping windows, an extension beyond polling: windows are told once the watermark has passed them, and what comes later than `late`
    after the newest event is dropped; draining ends all windows that it can."""
    counts = timed(spark, path, late).groupBy("event_type", F.window("ts", length, step)).agg(F.count("*").alias("n"))
    return drained(counts.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n"), "sliding")


def sessions(spark: SparkSession, path: str, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Sessions of each user, an extension: events at most `gap` apart; told once the watermark has passed their end."""
    counts = timed(spark, path, late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    ends = [F.col(f"session_window.{c}").cast("timestamp_ntz").alias(c) for c in ("start", "end")]
    return drained(counts.select("user_id", *ends, "n"), "sessions")


def polled(spark: SparkSession, path: str, *keys: str, late: str = "2 days") -> DataFrame:
    """Rows of overlapping polls, each key once within `late` of its first arrival: state is dropped when the watermark has passed it, so it stays bounded."""
    keys = keys or ("event_id",)
    return drained(timed(spark, path, late).dropDuplicatesWithinWatermark(list(keys)), "polls")


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete versions in a folder of `upserted`, ascending."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = fs_path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in (fs.listStatus(root) if fs.exists(root) else [])]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(fs_path(f"{folder}/{n}/_SUCCESS")))


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The last complete version."""
    return spark.read.parquet(f"{folder}/v{versions(spark, folder)[-1]}")


def upserted(spark: SparkSession, path: str, key: str, order: str, folder: str | None = None, files_per_batch: int | None = None, keep: int = 2) -> DataFrame:
    """The latest row of each key, by micro-batch: a batch's latest rows and those of the version before make the next version. Of equal orders a row of the later batch
    counts. folder: holds the versions and the checkpoint, so that a later call goes on where this one ended, on whichever driver; without it the result lasts as
    long as this one. A version is named by its batch's number and made of the last one before it that is complete on disk, so a batch that is run again, after a
    crash anywhere, makes the same table. The last `keep` versions stay."""
    out = folder.rstrip("/") if folder else until_exit(spark, _folder(spark, "upserts"))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if versions(spark, out) and not fs.exists(hadoop.Path(f"{out}/state/offsets")):
        raise RuntimeError(f"{out} has versions but no checkpoint that they belong to")

    def merge(batch: DataFrame, number: int) -> None:
        best = lambda df, *by: df.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct(order, *by)).alias("row")).select("row.*")
        newest, before = best(batch), [v for v in versions(spark, out) if v < number]
        if before:
            both = batch.sparkSession.read.schema(batch.schema).parquet(f"{out}/v{before[-1]}").withColumn("__late", F.lit(0)).unionByName(newest.withColumn("__late", F.lit(1)))
            newest = best(both, "__late")
        newest.write.mode("overwrite").parquet(f"{out}/v{number}")
        for v in before[: 1 - keep] if keep > 1 else before:
            fs.delete(hadoop.Path(f"{out}/v{v}"), True)

    stream = arrivals(spark, path, files_per_batch)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return latest(spark, out)
