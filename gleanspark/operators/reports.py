"""Reports over documents, chunks, tables and runs."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cleaning as C

#: A line of a table of contents: title, leader, page. Fixed value.
TOC_LINE = r"(?m)^[\s\-·•ㅁ□○◦]*(?:[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ0-9]{1,4}[.)]\s*)?([^\s.·][^\n]{1,38}?)[\s.·…\t]{2,}(\d{1,3})\s*$"
#: Headings by depth, as a whole short line. Fixed values.
DEPTHS = (
    (1, r"^[ \t]*([ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ][.)]?[ \t]*\S[^\n]{0,38})[ \t]*$"),
    (1, r"^[ \t]*(제[ \t]*\d{1,2}[ \t]*[장절][ \t]*\S[^\n]{0,38})[ \t]*$"),
    (2, r"^[ \t]*(\d{1,2}\.[ \t]*\S[^\n]{0,38})[ \t]*$"),
    (3, r"^[ \t]*([가-힣]\.[ \t]*\S[^\n]{0,38})[ \t]*$"),
    (4, r"^[ \t]*(\d{1,2}\)[ \t]*\S[^\n]{0,38})[ \t]*$"),
    (5, r"^[ \t]*([가-힣]\)[ \t]*\S[^\n]{0,38})[ \t]*$"),
    (6, r"^[ \t]*(\([0-9가-힣]{1,2}\)[ \t]*\S[^\n]{0,38})[ \t]*$"),
)


def corpus_report(docs: DataFrame, fields: list[str], parsed: tuple[str, ...] = ("hwp_raw", "pdfplumber")) -> DataFrame:
    """One row of docs(file_name, extractor, text, table_ok, tables_partial, error and the fields): documents, extracted, share with tables restored of
    those whose extractor parses them, partial tables, failed files, and the share of documents that has each field."""
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    return docs.agg(
        F.count("*").alias("documents"), share(F.length("text") > 0).alias("extracted"), F.round(F.avg(F.when(F.col("extractor").isin(*parsed), F.col("table_ok").cast("double"))), 6).alias("tables_restored"),
        F.coalesce(F.sum("tables_partial"), F.lit(0)).alias("tables_partial"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("failed"), F.count("error").alias("errors"), *[share(F.col(f).isNotNull()).alias(f"has_{f}") for f in fields],
    )


def value_counts(df: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """value, n of a column, the most frequent first (a top-k report where `most` is given)."""
    out = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    return out if most is None else out.limit(most)


def chunk_checks(chunks: DataFrame, size: int = 1500) -> DataFrame:
    """One row of chunks(doc_id, text, gen): empty texts, chunks with marks of tables left, documents, chunks a document, upper median, mean and longest
    length, and the share over `size`. The median comes from counts of lengths, not from a list of them."""
    marked = F.lit(False)
    for c in C.table_residue(F.col("text")).values():
        marked = marked | (c > 0)
    n = F.length("text")
    counted = chunks.groupBy(n.alias("n")).agg(F.count("*").alias("c"))
    upto = counted.withColumn("upto", F.sum("c").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("c").over(Window.partitionBy()))  # over distinct lengths
    median = upto.agg(F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("n"))).alias("median"))
    one = chunks.agg(
        F.count("*").alias("chunks"), F.count_if(F.trim("text") == "").alias("empty"), F.count_if(F.trim(F.coalesce("gen", F.lit(""))) == "").alias("empty_gen"), F.count_if(marked).alias("marked"), F.countDistinct("doc_id").alias("documents"),
        F.floor(F.avg(n)).alias("mean"), F.max(n).alias("longest"), F.round(F.count_if(n > size) / F.count("*"), 6).alias("over"),
    )
    return one.crossJoin(median).withColumn("per_document", F.round(F.col("chunks") / F.col("documents"), 6))  # one row each


def contents_entries(docs: DataFrame, head: int = 6000, least: int = 3) -> DataFrame:
    """doc_id, title, page: what the table of contents says, read in the first `head` characters, where it stands; the first page of a title counts, pages are 1
    to 499, and a document with fewer than `least` entries has none."""
    text = F.substring("text", 1, head)
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(TOC_LINE), 1).alias("t"), F.regexp_extract_all(text, F.lit(TOC_LINE), 2).alias("p"))
    each = docs.select("doc_id", F.posexplode(pairs).alias("n", "x")).select("doc_id", "n", F.regexp_replace("x.t", r"^[ .·…\t]+|[ .·…\t]+$", "").alias("title"), F.col("x.p").cast("int").alias("page"))
    first = each.filter((F.length("title") >= 2) & F.col("page").between(1, 499)).groupBy("doc_id", "title").agg(F.min_by("page", "n").alias("page"))
    return first.withColumn("c", F.count("*").over(Window.partitionBy("doc_id"))).filter(F.col("c") >= least).drop("c")


def pages_at(docs: DataFrame, entries: DataFrame, offsets: DataFrame, skip: int = 2000, last: int = 10) -> DataFrame:
    """item_id, page, next_page of offsets(item_id, doc_id, pos): the entries' titles are found after the first `skip` characters, where the table itself is,
    and a position is in the last range that begins before it. The last range takes `last` pages; positions before all have none."""
    at = entries.join(docs.select("doc_id", "text"), "doc_id").withColumn("start", F.expr(f"locate(title, text, {skip + 1}) - 1")).filter("start > 0").select("doc_id", "start", "page")
    by = Window.partitionBy("doc_id").orderBy("start", "page")
    ranges = at.select("doc_id", "start", F.lead("start").over(by).alias("stop"), "page", F.coalesce(F.lead("page").over(by), F.col("page") + last).alias("next_page"))
    met = offsets.join(ranges, "doc_id").filter((F.col("pos") >= F.col("start")) & (F.col("stop").isNull() | (F.col("pos") < F.col("stop"))))
    found = met.groupBy("item_id").agg(F.min(F.struct("start", "page", "next_page")).alias("r")).select("item_id", "r.page", "r.next_page")
    return offsets.select("item_id").join(found, "item_id", "left")


def located(paths: DataFrame, pages: DataFrame) -> DataFrame:
    """One row of paths(item_id, doc_id, depth: of the heading path, 0 without) and pages(item_id, page): items, shares with one level and with two, with a
    page, and documents of which at least four fifths, at most a fifth or something between of the items have a path."""
    met = paths.join(pages.select("item_id", "page"), "item_id", "left")
    one = met.agg(F.count("*").alias("items"), F.round(F.count_if(F.col("depth") >= 1) / F.count("*"), 6).alias("one"), F.round(F.count_if(F.col("depth") >= 2) / F.count("*"), 6).alias("two"), F.round(F.count("page") / F.count("*"), 6).alias("paged"))
    share = met.groupBy("doc_id").agg((F.count_if(F.col("depth") >= 1) / F.count("*")).alias("s"))
    return one.crossJoin(share.agg(F.count_if(F.col("s") >= 0.8).alias("good"), F.count_if(F.col("s") <= 0.2).alias("poor"), F.count_if((F.col("s") > 0.2) & (F.col("s") < 0.8)).alias("mixed")))  # one row each


def revisions(docs: DataFrame) -> DataFrame:
    """notice_no, revisions, first, last, same, similarity of families of docs(notice_no, revision, text) with several revisions: the first body against the
    last; similarity is an upper bound by shared characters, whatever their order."""

    @F.pandas_udf("double")
    def quick(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y, autojunk=False).quick_ratio() for x, y in zip(a, b)])

    families = docs.groupBy("notice_no").agg(F.count("*").alias("revisions"), F.min("revision").alias("first"), F.max("revision").alias("last"), F.min_by("text", "revision").alias("old"), F.max_by("text", "revision").alias("new")).filter("revisions > 1")
    return families.select("notice_no", "revisions", "first", "last", (F.col("old") == F.col("new")).alias("same"), F.round(quick("old", "new"), 6).alias("similarity"))


def starved(hits: DataFrame, families: DataFrame) -> DataFrame:
    """query_id, doc_id, hits of every revision of the family that a question asks in: 0 where one is starved. families(query_id, doc_id)."""
    return families.join(hits.groupBy("query_id", "doc_id").agg(F.count("*").alias("hits")), ["query_id", "doc_id"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def gold_rows(gold: DataFrame, texts: DataFrame) -> DataFrame:
    """item_id, verdict of gold(item_id, file_name, row: array of values): together in one line, anywhere in the text, missing, or no document."""
    values = F.filter(F.transform("row", lambda v: F.trim(F.coalesce(v, F.lit("")))), lambda v: v != "")
    met = gold.withColumn("values", values).join(texts.select("file_name", "text"), "file_name", "left")
    inside = lambda where: F.forall("values", lambda v: F.contains(where, v))
    together = F.exists(F.split("text", "\n", -1), inside)
    return met.select("item_id", F.when(F.col("text").isNull(), "no document").when(together, "together").when(inside(F.col("text")), "anywhere").otherwise("missing").alias("verdict"))


def against_baseline(now: DataFrame, before: DataFrame, column: str, eps: float = 0.002) -> DataFrame:
    """up, down, same, mean_change of a measure of the documents that both have; within eps nothing changed."""
    gap = F.round(F.col("after") - F.col("before"), 4)
    met = now.select("file_name", F.col(column).alias("after")).join(before.select("file_name", F.col(column).alias("before")), "file_name").withColumn("gap", gap)
    return met.agg(F.count_if(F.col("gap") > eps).alias("up"), F.count_if(F.col("gap") < -eps).alias("down"), F.count_if(F.abs("gap") <= eps).alias("same"), F.round(F.avg("gap"), 4).alias("mean_change"))


def titled(chunks: DataFrame, least: float = 0.9) -> DataFrame:
    """chunks, titled, share, warned of chunks(title): under `least` the metadata were not merged."""
    share = F.count_if(F.trim(F.coalesce("title", F.lit(""))) != "") / F.count("*")
    return chunks.agg(F.count("*").alias("chunks"), F.count_if(F.trim(F.coalesce("title", F.lit(""))) != "").alias("titled"), F.round(share, 6).alias("share"), (share < least).alias("warned"))


def newer_sources(files: DataFrame, made_at) -> DataFrame:
    """How many of files(path, modificationTime) came after what was made of them."""
    return files.agg(F.count_if(F.col("modificationTime") > F.lit(made_at)).alias("newer"))


def described(df: DataFrame, column: str, *by: str) -> DataFrame:
    """count, mean, stddev, least, the exact quartiles and most of a numeric column."""
    c = F.col(column)
    q = lambda p, n: F.round(F.percentile(c, F.lit(p)), 6).alias(n)
    return df.groupBy(*by).agg(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev(c), 6).alias("stddev"), F.min(c).alias("least"), q(0.25, "q1"), q(0.5, "median"), q(0.75, "q3"), F.max(c).alias("most"))


def longest(docs: DataFrame, n: int = 10) -> DataFrame:
    """The n longest documents (a top-k report)."""
    return docs.select("doc_id", F.length("text").cast("long").alias("chars")).orderBy(F.col("chars").desc(), "doc_id").limit(n)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """rows, distinct, surplus: rows that are equal in all columns; told apart by 128 bits of hash, so no row is shuffled whole."""
    keyed = df.select(F.xxhash64(*df.columns).alias("h1"), F.xxhash64(F.lit(1), *df.columns).alias("h2"))
    counted = keyed.groupBy("h1", "h2").agg(F.count("*").alias("n"))
    return counted.agg(F.sum("n").alias("rows"), F.count("*").alias("distinct"), (F.sum("n") - F.count("*")).alias("surplus"))


def incomplete_rows(df: DataFrame) -> DataFrame:
    """Rows with a null in any column."""
    some = F.lit(False)
    for c in df.columns:
        some = some | F.col(f"`{c}`").isNull()
    return df.filter(some)


def extensions(files: DataFrame, name: str = "file_name") -> DataFrame:
    """extension, n of file names, lower-cased; without one the empty string."""
    return files.groupBy(F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1)).alias("extension")).agg(F.count("*").alias("n"))


def stage_times(timings: DataFrame) -> DataFrame:
    """stage, runs, median, least, most of timings(stage, seconds)."""
    return timings.groupBy("stage").agg(F.count("*").alias("runs"), F.round(F.percentile("seconds", F.lit(0.5)), 6).alias("median"), F.min("seconds").alias("least"), F.max("seconds").alias("most"))


def structure(docs: DataFrame, markers: dict[str, str]) -> DataFrame:
    """marker, n: how often each of the patterns occurs in all texts."""
    one = docs.agg(*[F.coalesce(F.sum(F.regexp_count("text", F.lit(p))), F.lit(0)).alias(name) for name, p in markers.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("marker"), F.col(name).alias("n")) for name in markers])).alias("x")).select("x.*")


def variants(docs: DataFrame, pattern: str) -> DataFrame:
    """variant, n: the ways in which a label is written, without white space."""
    found = docs.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("x"))
    return found.groupBy(F.regexp_replace("x", r"\s+", "").alias("variant")).agg(F.count("*").alias("n"))
