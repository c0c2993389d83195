"""What extraction kept, and what work costs: tables in rendered texts as grids, lines that survive, families of revisions, and the rows, bytes, tasks and seconds of stages."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.cleaning import strip
from ..sources.tables import saved
from . import retrieval

#: A row of a table with pipes, and the rule below its head.
ROW, RULE = r"^\s*\|.*\|\s*$", r"^\s*\|?[\s:|-]*-{3,}[\s:|-]*\|?\s*$"


def table_grids(docs: DataFrame) -> DataFrame:
    """doc_id, table (from 0, in the order of the text), rows, widest, cells, filled, whole (all rows have equally many cells): tables of docs(doc_id, text) are runs of lines
    that are rows with pipes; rules between them belong to a table but are no rows."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).filter(F.col("line").rlike(ROW))
    by = Window.partitionBy("doc_id").orderBy("at")
    placed = lines.withColumn("run", F.col("at") - F.row_number().over(by)).filter(~F.col("line").rlike(RULE))
    inner = F.regexp_replace(strip(F.col("line")), r"^\||\|$", "")
    cells = placed.select("doc_id", "run", F.transform(F.split(inner, r"(?<!\\)\|", -1), strip).alias("cells"))
    sizes = cells.select("doc_id", "run", F.size("cells").alias("width"), F.size(F.filter("cells", lambda c: c != "")).alias("full"))
    each = sizes.groupBy("doc_id", "run").agg(F.count("*").alias("rows"), F.max("width").alias("widest"), F.sum("width").alias("cells"), F.sum("full").alias("filled"), (F.min("width") == F.max("width")).alias("whole"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("run")) - 1
    return each.withColumn("table", number.cast("long")).drop("run")


def kept_lines(plain: Column, tabled: Column, least: int) -> Column:
    """Share of the distinct trimmed lines of at least `least` characters that the other text still has, as a line, between its marks or anywhere; null without lines."""
    lines = F.filter(F.array_distinct(F.transform(F.split(plain, "\n", -1), strip)), lambda x: F.length(x) >= least)
    return F.when(F.size(lines) > 0, F.round(F.size(F.filter(lines, lambda x: F.contains(tabled, x))) / F.size(lines), 3))


def table_quality(docs: DataFrame, rendered: DataFrame) -> DataFrame:
    """A row for each of docs(doc_id, plain, text): tables, cells, whole (share of tables whose rows are equally wide), fill (filled cells over the places of the grids), blank (share of cells that
    are empty), empty (tables without a filled cell), lost and lost_chars (of rendered(doc_id, table): tables that were rendered but aren't in the text), lines and short_lines (share of the
    plain text's lines of ten characters, or one, that are kept), chars, plain_chars. Rates of nothing are null."""
    grids = table_grids(docs.select("doc_id", "text")).groupBy("doc_id").agg(
        F.count("*").alias("tables"), F.sum("cells").alias("cells"), F.count_if("whole").alias("n_whole"), F.sum("filled").alias("n_filled"), F.sum(F.col("rows") * F.col("widest")).alias("slots"), F.count_if(F.col("filled") == 0).alias("empty")
    )
    gone = rendered.filter(F.length("table") > 0).groupBy("doc_id").agg(F.collect_list("table").alias("__rendered"))  # of one document
    missing = F.filter(F.coalesce("__rendered", F.array().cast("array<string>")), lambda t: ~F.contains(F.col("text"), t))
    none = F.lit(0).cast("long")
    met = docs.select("doc_id", F.coalesce("plain", F.lit("")).alias("plain"), F.coalesce("text", F.lit("")).alias("text")).join(grids, "doc_id", "left").join(gone, "doc_id", "left").withColumn("__missing", missing)
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 3))
    return met.select(
        "doc_id", *[F.coalesce(c, none).alias(c) for c in ("tables", "cells", "empty")], share("n_whole", "tables").alias("whole"), share("n_filled", "slots").alias("fill"), F.when(F.col("cells") > 0, F.round(1 - F.col("n_filled") / F.col("cells"), 3)).alias("blank"),
        F.size("__missing").cast("long").alias("lost"), F.aggregate("__missing", none, lambda a, t: a + F.length(t)).alias("lost_chars"), kept_lines(F.col("plain"), F.col("text"), 10).alias("lines"), kept_lines(F.col("plain"), F.col("text"), 1).alias("short_lines"),
        F.length("text").cast("long").alias("chars"), F.length("plain").cast("long").alias("plain_chars"),
    )


def similar(pairs: DataFrame, key: str, one: str, other: str) -> DataFrame:
    """key, similarity: an upper bound of how alike two texts are, by the characters that both have, whatever their order: twice their number over both lengths. Two empty
    texts are alike. Characters are counted where texts are read, and counts alone are shuffled."""
    side = lambda c, a, b: pairs.select(key, F.explode(F.regexp_extract_all(F.col(c), F.lit("(?s)."), F.lit(0))).alias("c"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    counts = side(one, 1, 0).unionByName(side(other, 0, 1)).groupBy(key, "c").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    found = counts.groupBy(key).agg((2 * F.sum(F.least("a", "b")) / F.sum(F.col("a") + F.col("b"))).alias("found"))
    return pairs.select(key).join(found, key, "left").select(key, F.round(F.coalesce("found", F.lit(1.0)), 6).alias("similarity"))


def families(docs: DataFrame) -> DataFrame:
    """notice_no, revisions, first, last, same, similarity of families of docs(notice_no, revision, text) with several revisions: the first body against the last."""
    each = docs.groupBy("notice_no").agg(F.count("*").alias("revisions"), F.min("revision").alias("first"), F.max("revision").alias("last"), F.min_by("text", "revision").alias("old"), F.max_by("text", "revision").alias("new")).filter("revisions > 1")
    return each.join(similar(each, "notice_no", "old", "new"), "notice_no").select("notice_no", "revisions", "first", "last", (F.col("old") == F.col("new")).alias("same"), "similarity")


def starvation(hits: DataFrame, chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, notice_no, revision, hits, starved of every revision of the families that asked(query_id, notice_no) ask in; hits(query_id, chunk_id), chunks(chunk_id, notice_no, revision). A revision
    is starved if the question finds others of its family and none of it."""
    known = chunks.filter("revision is not null").select("notice_no", "revision").distinct()
    found = hits.join(chunks.select("chunk_id", "notice_no", "revision"), "chunk_id").groupBy("query_id", "notice_no", "revision").agg(F.count("*").alias("hits"))
    every = asked.distinct().join(known, "notice_no").join(found, ["query_id", "notice_no", "revision"], "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))
    total = F.sum("hits").over(Window.partitionBy("query_id", "notice_no"))
    return every.withColumn("starved", (F.col("hits") == 0) & (total > 0)).select("query_id", "notice_no", "revision", "hits", "starved")


class Costs:
    """What stages cost, from their own runs: rows and bytes observed as they are written, the tasks that ran, and seconds."""

    def __init__(self):
        self.rows: list[tuple[str, int, int, int, float]] = []

    def stage(self, name: str, df: DataFrame, size: Column) -> DataFrame:
        """df as a table, its cost noted. size: the bytes of a row."""
        spark, seen, group = df.sparkSession, Observation(f"{name}-{uuid.uuid4().hex}"), f"costs-{uuid.uuid4().hex}"
        context = spark.sparkContext
        before = context.getLocalProperty("spark.jobGroup.id")
        context.setJobGroup(group, name)
        start = time.perf_counter()
        try:
            out = saved(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes")), f"stage-{name}")
        finally:
            context.setLocalProperty("spark.jobGroup.id", before)
        seconds, tracker = time.perf_counter() - start, context.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))
        self.rows.append((name, seen.get["rows"], seen.get["bytes"], tasks, seconds))
        return out

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, "stage string, rows long, bytes long, tasks int, seconds double")


def search_costs(chunks: DataFrame, queries: DataFrame, k: int = 5, token: retrieval.Tokenizer = retrieval.tokens) -> DataFrame:
    """stage, rows, bytes, tasks, seconds of a BM25 search from its own run: cutting chunks into words, the terms' index, and the search of all queries."""
    costs, spark = Costs(), chunks.sparkSession
    words = costs.stage("tokenise", chunks.select("chunk_id", token(F.col("text")).alias("words")), F.octet_length(F.array_join("words", " ")).cast("long"))
    # The index takes words as they are, joined and cut again at the same places.
    between = retrieval.BETWEEN
    index = retrieval.Bm25Index(words.select("chunk_id", F.array_join("words", between).alias("text")), lambda text: F.filter(F.split(text, between), lambda w: w != ""))
    index.raw = costs.stage("index", index.raw, F.octet_length("term").cast("long"))
    index.token = token
    costs.stage("search", retrieval.bm25(index, queries, k), F.octet_length(F.col("chunk_id").cast("string")).cast("long"))
    return costs.table(spark)
