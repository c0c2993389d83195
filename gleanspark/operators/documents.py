"""Operators over documents and their chunks: revisions, fingerprints, incremental sync, profiles, headings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_doc_id


def windows(docs: DataFrame, size: int = 2500, most: int | None = None) -> DataFrame:
    """Chunks of fixed windows: chunk_id, doc_id, order, text; `most`: the first of each document."""
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length("text") - 1) / size), F.lit(0)).cast("int")), lambda i: F.substr(F.col("text"), i * size + 1, F.lit(size)))
    rows = docs.filter(F.length("text") > 0).select("doc_id", F.posexplode(cut if most is None else F.slice(cut, 1, most)).alias("order", "text"))
    return rows.select(F.format_string("%s::%04d", F.col("doc_id").cast("string"), "order").alias("chunk_id"), "doc_id", "order", "text")


def with_header(title: Column, section: Column, text: Column) -> Column:
    return F.concat(F.lit("["), title, F.lit("]"), F.coalesce(F.concat(F.lit(" ["), section, F.lit("]")), F.lit("")), F.lit("\n"), text)


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Count, mean, upper median, shortest, longest, how many under 50 characters, and the sum. The median is exact and needs no list of lengths."""
    n = F.length("text").cast("long")
    counted = chunks.select(n.alias("n")).groupBy("n").count()
    order = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)  # over distinct lengths
    running = counted.withColumn("upto", F.sum("count").over(order)).withColumn("total", F.sum("count").over(Window.partitionBy()))
    return running.agg(
        F.sum("count").alias("chunks"), F.floor(F.sum(F.col("n") * F.col("count")) / F.sum("count")).alias("mean"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("n"))).alias("median"),
        F.min("n").alias("least"), F.max("n").alias("most"), F.coalesce(F.sum(F.when(F.col("n") < 50, F.col("count"))), F.lit(0)).alias("short"), F.sum(F.col("n") * F.col("count")).alias("chars"),
    )


def joined_in_order(value: str, order: str, between: str = "\0") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), between)


def stale_revisions(chunks: DataFrame) -> DataFrame:
    """(notice_no, revision) of older revisions whose ordered body equals the newest's. chunks(notice_no, revision, order, text)."""
    bodies = chunks.filter("revision is not null").groupBy("notice_no", "revision").agg(F.sha1(joined_in_order("text", "order").cast("binary")).alias("digest"))
    newest = Window.partitionBy("notice_no").orderBy(F.col("revision").desc())
    return bodies.withColumn("last", F.first("digest").over(newest)).withColumn("n", F.row_number().over(newest)).filter("n > 1 and digest = last").select("notice_no", "revision")


def drop_stale_revisions(chunks: DataFrame) -> DataFrame:
    return chunks.join(stale_revisions(chunks), ["notice_no", "revision"], "left_anti")


def serving(chunks: DataFrame, replaced: DataFrame | None = None) -> DataFrame:
    """What searches, lists and evaluations read of chunks(chunk_id, doc_id, order, text, ...): without revisions whose body is that of their notice's last one, and without the
    documents that replaced(doc_id) lists. Notice and revision are read from doc_id."""
    notice, revision = split_doc_id(F.col("doc_id"))
    named = chunks.withColumns({"__notice": notice, "__revision": revision})
    stale = stale_revisions(named.select(F.col("__notice").alias("notice_no"), F.col("__revision").alias("revision"), "order", "text"))
    kept = named.join(stale.select(F.col("notice_no").alias("__notice"), F.col("revision").alias("__revision")), ["__notice", "__revision"], "left_anti").select(*chunks.columns)
    return kept if replaced is None else kept.join(replaced.select("doc_id"), "doc_id", "left_anti").select(*chunks.columns)


def doc_hashes(chunks: DataFrame) -> DataFrame:
    """doc_id, digest: of the texts whatever their order."""
    return chunks.groupBy("doc_id").agg(F.substring(F.md5(F.array_join(F.sort_array(F.collect_list("text")), "\0").cast("binary")), 1, 12).alias("digest"))


def corpus_signature(chunks: DataFrame) -> DataFrame:
    """One row that changes with any text, id or order, by sums and exclusive ors of hashes: no global order is needed."""
    h = F.xxhash64("chunk_id", "text")
    return chunks.agg(F.bit_xor(h).alias("mixed"), F.count("*").alias("chunks"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, status: added, gone, changed or kept, by fingerprints (doc_id, digest)."""
    both = old.select("doc_id", F.col("digest").alias("was")).join(new.select("doc_id", F.col("digest").alias("now")), "doc_id", "full_outer")
    return both.select("doc_id", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "gone").when(F.col("was") != F.col("now"), "changed").otherwise("kept").alias("status"))


def synced(table: DataFrame, new: DataFrame, status: DataFrame) -> DataFrame:
    """The table's next version: what is kept of the old and the new rows of added and changed documents."""
    kept = table.join(status.filter("status = 'kept'"), "doc_id", "left_semi")
    return kept.unionByName(new.join(status.filter("status in ('added', 'changed')"), "doc_id", "left_semi"))


def heading_path(marks: DataFrame, depths: int = 3) -> DataFrame:
    """As-of path: at each mark (doc_id, pos, depth, title; depth null for text) the latest heading of each depth, unless a shallower one came after it."""
    until = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = marks
    for d in range(1, depths + 1):
        out = out.withColumns({f"__t{d}": F.last(F.when(F.col("depth") == d, F.col("title")), ignorenulls=True).over(until), f"__p{d}": F.last(F.when(F.col("depth") == d, F.col("pos")), ignorenulls=True).over(until), f"__s{d}": F.max(F.when(F.col("depth") < d, F.col("pos"))).over(until)})
    parts = [F.when(F.col(f"__s{d}").isNull() | (F.col(f"__p{d}") > F.col(f"__s{d}")), F.col(f"__t{d}")) for d in range(1, depths + 1)]
    return out.select("doc_id", "pos", F.concat_ws(" > ", *parts).alias("path"))


def page_ranges(anchors: DataFrame, last: int = 10) -> DataFrame:
    """Half-open ranges [start, stop) of positions with their page, from (doc_id, pos, page); the last page runs `last` pages."""
    by = Window.partitionBy("doc_id").orderBy("pos")
    return anchors.select("doc_id", F.col("pos").alias("start"), F.lead("pos").over(by).alias("stop"), "page", F.coalesce(F.lead("page").over(by), F.col("page") + last).alias("next_page"))


def notices(chunks: DataFrame) -> DataFrame:
    """One row of each document: first chunk's text, chunk count and its revision family in order. chunks(doc_id, notice_no, revision, order, text)."""
    docs = chunks.groupBy("doc_id", "notice_no", "revision").agg(F.count("*").alias("n_chunks"), F.substring(F.min_by("text", "order"), 1, 400).alias("excerpt"))
    family = docs.groupBy("notice_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("revision", "doc_id"))), lambda x: x["doc_id"]), ",").alias("siblings"))
    return docs.join(family, "notice_no")


def profile(df: DataFrame) -> DataFrame:
    """name, nulls, distinct, shortest and longest text form of every column, in one pass."""
    one = df.agg(*[F.struct(F.count(F.when(F.col(c).isNull(), 1)).alias("nulls"), F.countDistinct(F.col(c)).alias("distinct"), F.min(F.length(F.col(c).cast("string"))).cast("long").alias("shortest"), F.max(F.length(F.col(c).cast("string"))).cast("long").alias("longest")).alias(c) for c in df.columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("s")) for c in df.columns])).alias("x")).select("x.name", "x.s.nulls", "x.s.distinct", "x.s.shortest", "x.s.longest")


def document_frequency(chunks: DataFrame, token: Column) -> DataFrame:
    """term, df, n, idf with one added inside the logarithm."""
    words = chunks.select("chunk_id", F.explode(F.array_distinct(token)).alias("term"))
    n = chunks.agg(F.count("*").alias("n"))
    return words.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).withColumn("idf", F.round(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 6))


def verdicts(frequency: DataFrame, dead_share: float = 0.3, least: int = 5) -> DataFrame:
    return frequency.withColumn("verdict", F.when(F.col("df") / F.col("n") > dead_share, "dead").when(F.col("df") < least, "risky").otherwise("useful"))


def quota(df: DataFrame, kind: str, key: str, quotas: dict[str, int], seed: int = 42) -> DataFrame:
    """At most quotas[kind] rows of each kind, chosen by a hash of seed and key."""
    allowed = F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(kind))
    order = Window.partitionBy(kind).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")))
    return df.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= F.coalesce(allowed, F.lit(0))).drop("__n")


def processed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with gen (cleaned), text (without table markup), fields (labelled values) and warnings of what the clean-up removed."""
    from ..functions import cleaning
    from . import markup

    rows = cleaning.cleaned(docs)
    notes = [F.when(F.col(c) > 0, F.concat(F.lit(f"{c} "), F.col(c).cast("string"))) for c in cleaning.NOTES]
    rows = rows.withColumns({"warnings": F.filter(F.array(*notes), lambda x: x.isNotNull()), "gen": F.col("text")}).drop(*cleaning.NOTES)
    return rows.withColumns({"text": markup.without_table_markup(F.col("gen")), "fields": markup.labelled_values(F.col("gen"))})


def incremental(files: DataFrame, before: DataFrame, process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What was made before of the files that are still there, and what `process` makes of new and changed ones. Both carry path and modified; before also what
    process adds."""
    known = before.join(files.select("path", "modified"), ["path", "modified"], "left_semi")
    fresh = process(files.join(before.select("path", "modified"), ["path", "modified"], "left_anti"))
    return known.unionByName(fresh, allowMissingColumns=True)


def cached_rows(made: DataFrame, merged: list[str]) -> DataFrame:
    """Documents that were made before, by file, without the columns that metadata add, so that these are not merged twice."""
    return made.drop(*[c for c in merged if c in made.columns])
