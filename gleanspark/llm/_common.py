"""What the operators of this subpackage share: shared folder, Arrow plumbing, words and shingles."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space that separates words: space and U+0009 to U+000D, which is what bytes.split() splits on.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, one of this machine if the master is local (tests), else an error:
    on a cluster executors would write to disks of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "gleanspark-shared")
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/gleanspark-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives the loss of any executor. It goes when the driver ends, or by `dropped`."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.options(**options).parquet(path)
    until_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by `written`, once nothing will read them again."""
    for t in tables:
        remove(t.sparkSession, t.scratch)


def _path(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def until_exit(spark: SparkSession, path: str) -> None:
    """Has a path deleted when the driver's JVM ends."""
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path through Hadoop's file system, whichever that is."""
    p, fs = _path(spark, path)
    fs.delete(p, True)


#: A key of a join that more than a HOT-th of all rows have is hot: there are fewer than HOT of them, whatever the sizes.
HOT = 2048


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], n: str, how: str = "inner") -> DataFrame:
    """rows joined to table (inner or left), which has one row for each key and in column n how many rows have it. Hot keys meet their rows where these are, by
    broadcast; the others by a shuffle, so no task gets all rows of a hot key. Nothing is sorted to find them: a key is hot by its share of the sum of n."""
    all_rows = F.broadcast(table.agg(F.sum(n).alias("__all_rows")))
    hot = table.join(all_rows, F.col(n) * HOT > F.col("__all_rows")).drop("__all_rows")
    rest = F.broadcast(hot.select(*keys))
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(rest, keys, "left_anti").join(table.join(rest, keys, "left_anti"), keys, how))


def whole(df: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs meets one of ours; `row.*` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def bounded(spark: SparkSession) -> None:
    """Smaller batches between executors and their Python workers for this session: whole texts are long, and both ends hold a batch."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = spark.conf.get(key).rstrip("bB")
        if not now.isdigit() or int(now) <= 0 or int(now) > most:
            spark.conf.set(key, str(most))


def text_bytes(column: pa.Array) -> list[bytes]:
    """Cells as UTF-8 bytes; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes in `column` each (a longer cell stands alone)."""
    sizes = batch.column(column).cast(pa.binary())
    ends = np.cumsum(np.array([0 if x is None else x for x in pa.compute.binary_length(sizes).to_pylist()], dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], dict], schema: str, text: str = "text") -> DataFrame:
    """Maps slices of bounded size to columns {name: values}; schema gives Spark's types."""
    bounded(df.sparkSession)
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, text):
                made = f(part)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, t) for x, t in ((made[n], arrow.field(n).type) for n in arrow.names)], schema=arrow)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema) if hasattr(StructType, "fromDDL") else spark.createDataFrame([], schema).schema)


def ascii_lower(text):
    """Lower-cases A to Z alone, as bytes.lower() does."""
    return F.translate(text, UPPER, UPPER.lower())


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_starts(words: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The words joined by one space, and where each begins; one more entry for the end."""
    at = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
    return b" ".join(words), at


def shingles(words: list[bytes], width: int) -> list[bytes]:
    """Runs of `width` words joined by spaces, repeats included; fewer words: the whole sequence; none: none."""
    if not words:
        return []
    if len(words) <= width:
        return [b" ".join(words)]
    line, at = word_starts(words)
    return [line[a:b] for a, b in zip(at[: -width].tolist(), (at[width:] - 1).tolist())]


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
