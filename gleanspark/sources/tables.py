"""Readers and writers of the document, chunk, metadata and evaluation files; schemas are always given, ids are strings."""

from __future__ import annotations

import bisect
import os
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chunk_id, file_key, make_doc_id, scrub_nan

#: Columns of the metadata files and their names here. Fixed values.
FIELDS = {
    "공고 번호": "notice_no", "공고 차수": "notice_seq", "사업명": "title", "사업 금액": "budget", "발주 기관": "agency", "공개 일자": "published_at",
    "입찰 참여 시작일": "bid_open_at", "입찰 참여 마감일": "bid_close_at", "사업 요약": "summary", "파일형식": "file_type", "파일명": "file_name", "금액구분": "budget_kind",
}
DATES = ("published_at", "bid_open_at", "bid_close_at")
CHUNK = "text string, meta map<string,string>, page_content string, page_content_for_generation string, metadata map<string,string>"


def read_metadata(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """The CSV's known columns (missing ones are skipped) by their names here, dates as yyyy-MM-dd or null, and doc_id. Without an encoding it is UTF-8, or else, if that leaves
    letters that can't be read, the older Korean one (cp949)."""
    if encoding is None and spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1).count():
        path = recoded(spark, path, "cp949")
    raw = spark.read.csv(path, header=True, encoding=encoding or "utf-8", multiLine=True, escape='"')
    raw = raw.toDF(*[c.replace("﻿", "").strip() for c in raw.columns])
    df = raw.select(*[F.col(f"`{k}`").alias(v) for k, v in FIELDS.items() if k in raw.columns])
    df = df.withColumns({c: F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd") for c in DATES if c in df.columns})
    if "budget" in df.columns:
        df = df.withColumn("budget", scrub_nan(F.col("budget").try_cast("double")))
    seq = F.col("notice_seq").try_cast("double").cast("int") if "notice_seq" in df.columns else F.lit(None).cast("int")
    return df.withColumn("doc_id", make_doc_id(F.col("notice_no"), seq, F.col("file_name")))


def recoded(spark: SparkSession, path: str, encoding: str) -> str:
    """The text files of a path again in UTF-8, in a folder that goes when the driver ends: for encodings that Spark's readers don't take. A file is one row, as it is for
    a reader of records over several lines."""

    @F.pandas_udf("string")
    def read(files: pd.Series) -> pd.Series:
        return files.map(lambda b: bytes(b).decode(encoding, "replace"))

    out = until_exit(spark, scratch(spark, "recoded"))
    spark.read.format("binaryFile").load(path).select(read("content").alias("value")).write.text(out)
    return out


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below the one that driver and executors share, spark.checkpoint.dir. Unset, one of this machine if the master is local, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "gleanspark-shared")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def until_exit(spark: SparkSession, path: str) -> str:
    """Has a path deleted when the driver's JVM ends."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def saved(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder, until the driver ends: made once, read often, and no lost executor loses it."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(until_exit(df.sparkSession, path))


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df with its rows' numbers from 0 in an order, as a long in column `name`. Rows are sorted in ranges and numbered within each; what lies before a range is added. What one
    task holds is a range; only the ranges' sizes, a row each, come together."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    at = saved(dealt.select("*", F.spark_partition_id().alias("__range"), within.alias("__within")), "numbered")
    sizes = at.groupBy("__range").agg(F.count("*").alias("__size")).collect()  # a row for each range
    before, offsets = 0, []
    for r in sorted(sizes):
        offsets.append((r["__range"], before))
        before += r["__size"]
    if not offsets:
        return df.withColumn(name, F.lit(0).cast("long"))
    starts = df.sparkSession.createDataFrame(offsets, "__range int, __before long")
    return at.join(F.broadcast(starts), "__range").withColumn(name, F.col("__before") + F.col("__within")).drop("__range", "__within", "__before")


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, where its files have fewer splits; large inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def upgraded(old: DataFrame, new_columns: list[str]) -> DataFrame:
    """Old rows under a header that has grown at its end."""
    return old.select(*old.columns, *[F.lit("").alias(c) for c in new_columns if c not in old.columns])


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk lines of either shape, native (text, meta) or pipeline (page_content, metadata): chunk_id, doc_id, order, text, gen, extra."""
    rows = spark.read.schema(CHUNK).json(path)
    renamed = F.transform_keys("metadata", lambda k, v: _english(k))
    meta = F.when(F.col("text").isNotNull(), F.col("meta")).otherwise(renamed)
    rows = rows.select(F.coalesce("text", "page_content").alias("text"), F.col("page_content_for_generation").alias("gen"), F.transform_values(meta, lambda k, v: F.when(F.lower(v).isin("nan", "null"), None).otherwise(v)).alias("extra"))
    made = make_doc_id(F.col("extra")["notice_no"], F.col("extra")["notice_seq"].try_cast("double").cast("int"), F.col("extra")["file_name"])
    doc_id = F.coalesce(F.col("extra")["doc_id"], made)
    order = F.coalesce(F.col("extra")["chunk_index"], F.col("extra")["order"], F.lit("0")).try_cast("double").cast("int")
    return rows.select(F.coalesce(F.col("extra")["chunk_id"], chunk_id(doc_id, order)).alias("chunk_id"), doc_id.alias("doc_id"), order.alias("order"), "text", "gen", "extra")


def _english(key: Column) -> Column:
    out = key
    for k, v in FIELDS.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def read_documents(spark: SparkSession, path: str, only_real: bool = False) -> DataFrame:
    """Document lines: meta, text, chars, extractor, warnings; only_real drops those whose text is a stand-in."""
    df = spark.read.schema("meta map<string,string>, text string, chars int, extractor string, warnings array<string>").json(path)
    return df.filter(~F.coalesce("extractor", F.lit("")).isin("csv-fallback", "missing", "failed")) if only_real else df


def read_evalset(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation pairs, an array (.json) or lines (.jsonl)."""
    return spark.read.schema("question string, keywords array<string>, doc_id string, type string, answerable boolean, note string, checked_by string").json(path, multiLine=path.endswith(".json"))


def evalset_path(spark: SparkSession, folder: str, name: str) -> str:
    """The file of an evaluation set by its name: name.json, else name.jsonl. FileNotFoundError, with the names that there are, if there is neither; a set's stamp
    (.meta.json) is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = {s.getPath().getName() for s in (fs.listStatus(root) if fs.exists(root) else [])}
    for found in (f"{name}.json", f"{name}.jsonl"):
        if found in names:
            return f"{folder.rstrip('/')}/{found}"
    there = sorted({n.rpartition(".")[0] for n in names if n.endswith((".json", ".jsonl")) and not n.endswith(".meta.json")})
    raise FileNotFoundError(f"no evaluation set {name} in {folder}; there are {there}")


def read_rows(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """Rows of several files, arrays (.json) or lines, each tagged with the name of the file that it came from."""
    parts = [spark.read.schema(schema).json(p, multiLine=p.endswith(".json")).withColumn("source", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def document_records(df: DataFrame) -> DataFrame:
    """meta (doc_id and the metadata columns that are there), text, chars, extractor, warnings of rows of the extraction with its metadata; NaN becomes null."""
    names = [c for c in (*FIELDS.values(), "budget_kind") if c in df.columns and c != "file_name"]
    scrubbed = [scrub_nan(F.col(c)).alias(c) if dict(df.dtypes)[c] in ("double", "float") else F.col(c) for c in dict.fromkeys(names)]
    meta = F.struct(F.concat_ws("-", F.col("notice_no"), F.col("notice_seq").try_cast("double").cast("int").cast("string")).alias("doc_id"), *scrubbed, "file_name")
    return df.select(meta.alias("meta"), F.coalesce("text", F.lit("")).alias("text"), F.length(F.coalesce("text", F.lit(""))).alias("chars"), "extractor", F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def assigned(files: DataFrame, free: DataFrame, least: int = 15) -> DataFrame:
    """key, name of files(key) and free(name): in the order of their keys, each file takes the name with the longest common beginning of at least `least` characters
    that none before it took, the first in order of several. Only names with equal heads of `least` characters can meet, so each head is settled by itself, in
    order, as the rule asks; in time of its names' number times its logarithm, since the longest common beginning is that of a neighbour in order."""

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        left, names = sorted(rows["key"].dropna()), sorted(rows["name"].dropna())
        n, out = len(names), []
        # The next free place from a place on, and the last free one up to it; both leap over what is taken.
        after, before = list(range(n + 1)), list(range(n + 1))

        def free_place(leap: list[int], at: int) -> int:
            root = at
            while leap[root] != root:
                root = leap[root]
            while leap[at] != root:
                leap[at], at = root, leap[at]
            return root

        for key in left:
            at = bisect.bisect_left(names, key)
            above, below = free_place(after, at), free_place(before, at)  # `before` counts from 1, so 0 is none
            shared = max((len(os.path.commonprefix([key, names[k]])) for k in (above, below - 1) if 0 <= k < n), default=0)
            if shared < least:
                continue
            k = free_place(after, bisect.bisect_left(names, key[:shared]))
            out.append((key, names[k]))
            after[k], before[k + 1] = k + 1, k
        return pd.DataFrame(out, columns=["key", "name"])

    head = lambda c: F.substring(c, 1, least).alias("head")
    null = F.lit(None).cast("string")
    both = files.filter(F.length("key") >= least).select(head("key"), "key", null.alias("name")).unionByName(free.filter(F.length("name") >= least).select(head("name"), null.alias("key"), "name"))
    return both.groupBy("head").applyInPandas(settle, "key string, name string")


def merge_metadata(files: DataFrame, metadata: DataFrame, least: int = 15, matched: float | None = None) -> DataFrame:
    """files(file_name, ...) with their metadata by normalised name, or else by the longest common beginning (`assigned`); match says how, null where there is
    none. Columns that both have come from the metadata as name_metadata. matched: raises ValueError where a smaller share of the files has metadata."""
    left = files.withColumn("__key", file_key(F.col("file_name")))
    own = {c: f"{c}_metadata" for c in metadata.columns if c in files.columns and c != "file_name"}
    right = metadata.withColumn("__name", file_key(F.col("file_name"))).withColumnRenamed("file_name", "metadata_file").withColumnsRenamed(own)
    exact = left.join(right, F.col("__key") == F.col("__name")).withColumn("match", F.lit("exact"))
    rest = left.join(exact.select("__key"), "__key", "left_anti")
    free = right.join(exact.select("__name"), "__name", "left_anti")
    pairs = assigned(rest.select(F.col("__key").alias("key")).distinct(), free.select(F.col("__name").alias("name")).distinct(), least)
    near = rest.join(pairs, F.col("__key") == F.col("key")).drop("key").join(free, F.col("name") == F.col("__name")).drop("name").withColumn("match", F.lit("fuzzy"))
    none = rest.join(near.select("__key"), "__key", "left_anti")
    out = exact.unionByName(near).unionByName(none, allowMissingColumns=True).drop("__key", "__name")
    if matched is not None:
        share = out.agg(F.count("match") / F.greatest(F.count("*"), F.lit(1))).first()[0]
        if share < matched:
            raise ValueError(f"{share:.0%} of the files have metadata, under {matched:.0%}")
    return out


def new_version(spark: SparkSession, df: DataFrame, folder: str) -> str:
    """Writes the next version of a table beside the older ones, whose readers go on, and returns its path."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [int(s.getPath().getName()[1:]) for s in (fs.listStatus(path) if fs.exists(path) else []) if s.getPath().getName()[:1] == "v" and s.getPath().getName()[1:].isdigit()]
    out = f"{folder}/v{max(found, default=0) + 1}"
    df.write.parquet(out)
    return out
