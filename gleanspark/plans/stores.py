"""Registered queries of sources, sinks, stores and streams: each writes files to the shared folder and reads them back by the operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import models
from ..functions import text as T
from ..operators import documents as D
from ..operators import evalsets, indexes
from ..operators import retrieval as R
from ..operators import search as S
from ..sources import listings, store, tables
from ..streaming import events as E
from .catalog import BM25, TOK, C, chunks, questions, register, table

NAMES = {v: k for k, v in tables.FIELDS.items()}


def metadata(spark, sf_dir):
    """Orders as rows of the metadata file, by its own headers."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        F.when(k % 5 != 0, F.concat(F.lit("N"), k.cast("string"))).alias(NAMES["notice_no"]), F.when(k % 3 != 0, F.concat((k % 3).cast("string"), F.lit(".0"))).alias(NAMES["notice_seq"]), F.col("o_orderpriority").alias(NAMES["title"]),
        F.when(k % 4 != 0, (k * 10).cast("string")).otherwise("nan").alias(NAMES["budget"]), F.when(k % 2 == 0, "2024-03-01 10:00:00").otherwise("bad").alias(NAMES["published_at"]), F.concat(F.lit("f"), k.cast("string"), F.lit(".hwp")).alias(NAMES["file_name"]),
    )


META_ID = "CASE WHEN o_orderkey % 5 = 0 THEN 'nofile-' || substr(sha1('f' || CAST(o_orderkey AS VARCHAR) || '.hwp'), 1, 12) WHEN o_orderkey % 3 = 0 THEN 'N' || CAST(o_orderkey AS VARCHAR) ELSE 'N' || CAST(o_orderkey AS VARCHAR) || '-' || CAST(o_orderkey % 3 AS VARCHAR) END"


def csv_of(spark, sf_dir) -> str:
    path = tables.scratch(spark, "metadata")
    metadata(spark, sf_dir).write.csv(path, header=True)
    return tables.until_exit(spark, path)


@register(f"SELECT {META_ID} AS doc_id, o_orderpriority AS title, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey * 10 AS DOUBLE) END AS budget, CASE WHEN o_orderkey % 2 = 0 THEN '2024-03-01' END AS published_at FROM orders")
def s05_s06_s31_metadata_file(spark, sf_dir):
    """A metadata file with its own headers, some columns missing, dates and numbers that cannot be read."""
    return tables.read_metadata(spark, csv_of(spark, sf_dir)).select("doc_id", "title", "budget", "published_at")


@register(f"SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 <> 0 THEN {META_ID} END AS doc_id, CASE WHEN o_orderkey % 7 <> 0 THEN 'exact' END AS match FROM orders")
def j01_merge_metadata(spark, sf_dir):
    """Files by normalised names; a seventh of them has other names."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    files = o.select(k.alias("k"), F.when(k % 7 == 0, F.concat(F.lit("none"), k.cast("string"))).otherwise(F.concat(F.lit(" f"), k.cast("string"), F.lit(".PDF "))).alias("file_name"))
    return tables.merge_metadata(files, tables.read_metadata(spark, csv_of(spark, sf_dir)), matched=0.5).select("k", "doc_id", "match")


@register("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'meta ' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') || ' x' END AS name FROM customer")
def j02_assigned_names(spark, sf_dir):
    """Cut names against whole ones: each takes the longest common beginning."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    stem = F.concat(F.lit("meta "), F.lpad(k.cast("string"), 12, "0"))
    files = c.filter(k % 2 == 0).select(k.alias("k"), stem.alias("key"))
    found = tables.assigned(files.select("key"), c.filter(k % 2 == 0).select(F.concat(stem, F.lit(" x")).alias("name")))
    return c.select(k.alias("k")).join(files.join(found, "key"), "k", "left").select("k", "name")


@register(f"WITH {C} SELECT CASE WHEN doc_id % 2 = 0 THEN chunk_id ELSE 'N' || CAST(doc_id AS VARCHAR) || '-2::' || lpad(CAST(\"order\" AS VARCHAR), 4, '0') END AS chunk_id, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'N' || CAST(doc_id AS VARCHAR) || '-2' END AS doc_id, CAST(\"order\" AS INTEGER) AS \"order\", md5(text) AS digest FROM c")
def s01_s02_s03_k02_chunk_lines(spark, sf_dir):
    """Chunk lines of both shapes in one file: native, and that of the pipeline with its own field names."""
    c, d = chunks(spark, sf_dir), F.col("doc_id")
    text = lambda x: x.cast("string")
    native = F.create_map(F.lit("doc_id"), text(d), F.lit("order"), text(F.col("order")), F.lit("chunk_id"), F.col("chunk_id"))
    foreign = F.create_map(F.lit(NAMES["notice_no"]), F.concat(F.lit("N"), text(d)), F.lit(NAMES["notice_seq"]), F.lit("2.0"), F.lit("chunk_index"), text(F.col("order")))
    rows = c.select(F.when(d % 2 == 0, F.col("text")).alias("text"), F.when(d % 2 == 0, native).alias("meta"), F.when(d % 2 == 1, F.col("text")).alias("page_content"), F.when(d % 2 == 1, foreign).alias("metadata"))
    path = tables.scratch(spark, "chunk-lines")
    tables.write_lines(rows, path)
    return tables.read_chunks(spark, tables.until_exit(spark, path)).select("chunk_id", "doc_id", "order", F.md5(F.col("text").cast("binary")).alias("digest"))


@register("SELECT CAST(doc_id AS VARCHAR) AS doc_id, length(text) AS chars FROM documents WHERE doc_id % 4 <> 0")
def s04_k01_document_lines(spark, sf_dir):
    """Document lines, those with a stand-in for a text left out."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string")).alias("meta"), "text", F.length("text").alias("chars"), F.when(F.col("doc_id") % 4 == 0, "csv-fallback").otherwise("hwp").alias("extractor"), F.array().cast("array<string>").alias("warnings"))
    path = tables.scratch(spark, "document-lines")
    tables.write_lines(rows, path)
    return tables.read_documents(spark, tables.until_exit(spark, path), only_real=True).select(F.col("meta")["doc_id"].alias("doc_id"), F.col("chars").cast("long").alias("chars"))


@register("SELECT text AS question, CAST(item_id AS VARCHAR) AS doc_id, item_id % 2 = 0 AS answerable FROM benchmark")
def s07_k10_evaluation_set(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    rows = b.select(F.col("text").alias("question"), F.array("text").alias("keywords"), F.col("item_id").cast("string").alias("doc_id"), F.lit("t").alias("type"), (F.col("item_id") % 2 == 0).alias("answerable"))
    path = tables.scratch(spark, "evalset")
    tables.write_lines(rows, path)
    return tables.read_evalset(spark, tables.until_exit(spark, path)).select("question", "doc_id", "answerable")


@register("SELECT o_orderkey, '' AS kind FROM orders")
def k04_upgraded_header(spark, sf_dir):
    """Rows under a header that has grown."""
    return tables.upgraded(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey", "kind"])


def stored(spark, sf_dir):
    """A store that was built, added to, deleted from and brought to a changed corpus."""
    path = tables.until_exit(spark, tables.scratch(spark, "stores"))
    all_ = chunks(spark, sf_dir).select("chunk_id", "doc_id", "order", "text")
    s = store.Stores(spark, path, "hashed trigrams", lambda df: df.withColumn("v", models.embed(F.col("text"))))
    s.build("main", all_.filter("doc_id % 3 = 0"))
    s.add("main", all_.filter("doc_id % 3 = 1"))
    s.delete("main", [0, 1, None])
    changed = all_.filter("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 6 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    counts = s.sync("main", changed)
    tables.until_exit(spark, path)
    return s, counts, changed


@register(f"WITH {C} SELECT chunk_id, md5(CASE WHEN doc_id % 6 = 1 THEN text || '!' ELSE text END) AS digest, CAST(256 AS INTEGER) AS dims FROM c WHERE doc_id % 3 <> 0")
def k05_k09_s29_store(spark, sf_dir):
    s, _, changed = stored(spark, sf_dir)
    return s.read("main", changed).select("chunk_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.size("v").alias("dims"))


@register("""WITH d AS (SELECT doc_id FROM documents WHERE length(text) > 0), o AS (SELECT doc_id FROM d WHERE doc_id % 3 <> 2 AND doc_id NOT IN (0, 1))
SELECT (SELECT count(*) FROM d WHERE doc_id % 3 = 2 OR doc_id = 1) + (SELECT count(*) FROM o WHERE doc_id % 6 = 1) AS added, (SELECT count(*) FROM o WHERE doc_id % 3 = 0 OR doc_id % 6 = 1) AS gone, (SELECT count(*) FROM o WHERE doc_id % 3 = 1 AND doc_id % 6 <> 1) AS kept, 'main' AS names""")
def j05_k07_s30_sync_counts(spark, sf_dir):
    """Documents added, gone and kept; a changed one is both of the first."""
    s, (added, gone, kept), _ = stored(spark, sf_dir)
    return spark.createDataFrame([(added, gone, kept, ",".join(s.names()))], "added long, gone long, kept long, names string")


@register(f"WITH {C}, h AS (SELECT chunk_id, text FROM c) SELECT count(*) AS chunks, true AS same, false AS changed FROM h")
def a12_corpus_signature(spark, sf_dir):
    """The signature of the chunks in another order is the same, and another with one letter more, or with rows doubled."""
    c = chunks(spark, sf_dir).select("chunk_id", "text")
    a, b = D.corpus_signature(c), D.corpus_signature(c.repartition(7, "text"))
    other = D.corpus_signature(c.withColumn("text", F.when(F.col("chunk_id").endswith("::0000"), F.concat("text", F.lit("x"))).otherwise(F.col("text"))))
    one = a.select("chunks", F.col("mixed").alias("m1")).crossJoin(b.select(F.col("mixed").alias("m2"))).crossJoin(other.select(F.col("mixed").alias("m3")))  # one row each
    return one.select("chunks", (F.col("m1") == F.col("m2")).alias("same"), (F.col("m1") == F.col("m3")).alias("changed"))


# Streams


@register("""WITH w AS (SELECT event_type, time_bucket(INTERVAL '1 hour', ts) - to_hours(h) AS start, ts FROM events, range(6) r(h)) SELECT event_type, start, count(*) AS n FROM w WHERE start + INTERVAL '6 hours' <= (SELECT max(ts) - INTERVAL '2 days' FROM events) GROUP BY ALL""".replace("to_hours(h)", "to_hours(CAST(h AS INTEGER))"))
def s_sliding_counts(spark, sf_dir):
    """An extension: windows that the watermark has passed."""
    return E.sliding(spark, f"{sf_dir}/events.parquet")


@register("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g),
x AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM s GROUP BY user_id, s.n)
SELECT * FROM x WHERE "end" <= (SELECT max(ts) - INTERVAL '2 days' FROM events)""")
def s_sessions(spark, sf_dir):
    """An extension: sessions that the watermark has passed."""
    return E.sessions(spark, f"{sf_dir}/events.parquet")


@register("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def s_overlapping_polls(spark, sf_dir):
    """Every event once, with state that the watermark bounds."""
    return E.polled(spark, f"{sf_dir}/events.parquet").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@register("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def s_latest_by_key(spark, sf_dir):
    """The latest row of each key, by micro-batches."""
    return E.upserted(spark, f"{sf_dir}/events.parquet", "user_id", "event_id").select("user_id", "event_id")


@register("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'N' || CAST(o_orderkey AS VARCHAR) || '-0' WHEN o_orderkey % 4 = 1 THEN 'N' || CAST(o_orderkey AS VARCHAR) || '-0' ELSE 'x' || CAST(o_orderkey AS VARCHAR) END AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN '없음' ELSE '의역' END AS kind, o_orderkey % 3 <> 0 AS answerable, CASE WHEN o_orderkey % 4 = 0 THEN 'matched' WHEN o_orderkey % 4 = 1 THEN 'converted' ELSE 'unknown' END AS match FROM orders")
def j10_e09_normalized_set(spark, sf_dir):
    """A foreign set with its own field names, ids, file names and names of nothing."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    number = F.concat(F.lit("N"), k.cast("string"))
    corpus = o.filter(k % 4 < 2).select(F.concat(number, F.lit("-0")).alias("doc_id"), F.concat(F.lit("file "), k.cast("string"), F.lit(".hwp")).alias("file_name"))
    name = F.when(k % 4 == 0, F.concat(number, F.lit("-0"))).when(k % 4 == 1, F.concat(F.lit("file "), k.cast("string"), F.lit(".PDF"))).otherwise(F.concat(F.lit("x"), k.cast("string")))
    rows = o.select(k.cast("string").alias("question"), name.alias("doc_id"), F.when(k % 3 == 0, "없음").otherwise("의역").alias("question_type"), F.lit("evidence").alias("evidence_text"))
    return evalsets.normalized(rows, corpus).select(F.col("question").cast("long").alias("k"), "doc_id", "kind", "answerable", "match")


@register("SELECT 'N' || CAST(p_partkey AS VARCHAR) || '-' || CASE WHEN p_partkey % 2 = 0 THEN '1' ELSE '0' END AS doc_id, CASE WHEN p_partkey % 3 = 0 THEN 'a' || CAST(p_partkey AS VARCHAR) || '.hwp' ELSE p_brand || '.hwp' END AS name FROM part WHERE p_partkey % 5 <> 0")
def p09_stored_files(spark, sf_dir):
    """Names to hand out; those that lead out of the folder are left out."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    stored = F.concat(F.when(k % 5 == 0, "../").otherwise(""), F.lit("a"), k.cast("string"), F.lit(".hwp"))
    rows = p.select(F.concat(F.lit("N"), k.cast("string")).alias("notice_no"), F.when(k % 2 == 0, "1.0").alias("notice_seq"), stored.alias("file_name"), F.when(k % 3 != 0, F.concat(F.lit("/:"), "p_brand", F.lit("?"))).alias("title"))
    return listings.stored_files(rows).select("doc_id", "name")


@register("SELECT 'N' || CAST(o_orderkey AS VARCHAR) || '-' || CAST(o_orderkey % 3 AS VARCHAR) AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS budget, CAST(length(o_orderpriority) AS INTEGER) AS chars FROM orders")
def p10_k12_document_records(spark, sf_dir):
    """Nested records with metadata; NaN is nothing."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.select(F.concat(F.lit("N"), k.cast("string")).alias("notice_no"), (k % 3).cast("string").alias("notice_seq"), F.when(k % 2 == 0, F.col("o_totalprice")).otherwise(float("nan")).alias("budget"), F.lit("f").alias("file_name"), F.col("o_orderpriority").alias("text"), F.lit("hwp").alias("extractor"), F.lit(None).cast("array<string>").alias("warnings"))
    return tables.document_records(rows).select("meta.doc_id", "meta.budget", "chars")


@register("SELECT text AS question, CASE WHEN item_id % 2 = 0 THEN 'a' ELSE 'b' END AS source FROM benchmark")
def s32_tagged_rows(spark, sf_dir):
    """Rows of two folders of lines, each tagged with its file; the parts' names stand for the files'."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    path = tables.until_exit(spark, tables.scratch(spark, "tagged"))
    for n, name in enumerate("ab"):
        tables.write_lines(b.filter(F.col("item_id") % 2 == n).select("question", F.lit(name).alias("own")), f"{path}/{name}")
    tables.until_exit(spark, path)
    rows = tables.read_rows(spark, "question string, own string", f"{path}/a", f"{path}/b")
    return rows.filter(F.col("source").startswith("part-")).select("question", F.col("own").alias("source"))


@register("SELECT CAST(p_partkey AS VARCHAR) AS number, CASE WHEN p_partkey % 4 = 0 THEN 'P' || CAST(p_partkey - 1 AS VARCHAR) END AS superseded FROM part")
def f08_superseded(spark, sf_dir):
    """The earlier notice that a notice replaces; words for nothing are nothing."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    before = F.when(k % 4 == 0, F.concat(F.lit(" P"), (k - 1).cast("string"))).when(k % 4 == 1, "null").when(k % 4 == 2, " ")
    return p.select(k.cast("string").alias("number"), before.alias("befBidBbancNo")).select("number", listings.superseded().alias("superseded"))


@register("SELECT doc_id, 'N' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '.5' END AS tidy FROM documents")
def p12_tidy_doc_id(spark, sf_dir):
    raw = F.concat(F.lit("N"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".0").otherwise(".5"))
    return table(spark, sf_dir, "documents").select("doc_id", T.tidy_doc_id(raw).alias("tidy"))


@register("SELECT doc_id AS path, CASE WHEN doc_id % 4 = 0 OR doc_id % 5 = 0 THEN 'made now' ELSE 'made before' END AS made FROM documents")
def c10_s08_incremental(spark, sf_dir):
    """Files that are new or have changed are processed, the others' rows are taken from before; what is gone is gone."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("modified"))
    before = d.filter("path % 4 <> 0").select("path", F.when(F.col("path") % 5 == 0, F.col("modified") + 1).otherwise(F.col("modified")).alias("modified"), F.lit("made before").alias("made"), F.lit("csv").alias("title"))
    gone = before.select((-1 - F.col("path")).alias("path"), "modified", "made", "title")
    return D.incremental(d, D.cached_rows(before.unionByName(gone), ["title"]), lambda f: f.withColumn("made", F.lit("made now"))).select("path", "made")


@register("""WITH r AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN NULL ELSE item_id % 4 * 3 END AS rank, item_id % 2 = 0 AS named FROM benchmark)
SELECT named, round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0.0 END), 3) AS mrr, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 3) AS top1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 3) AS top5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 3) AS topn, count(*) AS questions FROM r GROUP BY named""")
def a06_notice_metrics(spark, sf_dir):
    """Ranks of the wanted notices, by whether the question names its notice."""
    b, i = table(spark, sf_dir, "benchmark"), F.col("item_id")
    ranks = b.select(F.when(i % 4 != 0, i % 4 * 3).alias("rank"), (i % 2 == 0).alias("named"))
    return S.notice_metrics(ranks, "named")


@register(rf"""WITH {C}, t AS (SELECT chunk_id, term, CAST(count(*) AS DOUBLE) * length(term) AS w FROM (SELECT chunk_id, unnest({TOK}) AS term FROM c) GROUP BY chunk_id, term),
p AS (SELECT chunk_id, term, w FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY w DESC, term) AS r FROM t) WHERE r <= 256),
q AS (SELECT query_id, term, CAST(count(*) AS DOUBLE) AS w FROM (SELECT item_id AS query_id, unnest({TOK}) AS term FROM benchmark) GROUP BY query_id, term),
m AS (SELECT query_id, chunk_id, round(sum(q.w * p.w), 6) AS score FROM q JOIN p ON q.term = p.term GROUP BY query_id, chunk_id)
SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM m WHERE score > 0) WHERE rank <= 5""")
def r04_stored_index(spark, sf_dir):
    """Vectors of the heaviest 256 terms of each chunk, by how often and how long they are, in an inverted index that is made once and found again by its signature."""
    c, path = chunks(spark, sf_dir), tables.until_exit(spark, tables.scratch(spark, "sparse"))
    words = lambda df, key: df.select(key, T.tokens(F.col("text")).alias("words"))
    signature = store.signature_of(c)
    indexes.SparseIndex.of(path, signature, lambda: indexes.vectors(words(c, "chunk_id"), "chunk_id", F.length), spark)
    index = indexes.SparseIndex.open(spark, path, signature)
    return index.search(indexes.weighted(words(questions(spark, sf_dir), "query_id"), "query_id", F.lit(1.0)), 5).withColumn("rank", F.col("rank").cast("long"))


@register(f"WITH {BM25} SELECT query_id, chunk_id, score, rank FROM h WHERE rank <= 5")
def t23_r01_cached_words(spark, sf_dir):
    """BM25 over a corpus of which every third chunk was cut into words before."""
    c = chunks(spark, sf_dir)
    cache = indexes.WordCache(spark, tables.until_exit(spark, tables.scratch(spark, "words")))
    cache.words(c.filter(F.col("doc_id") % 3 == 0))
    return R.bm25(R.Bm25Index(c, cache=cache), questions(spark, sf_dir), 5).withColumn("rank", F.col("rank").cast("long"))


@register("SELECT item_id, text AS question, CASE WHEN item_id % 2 = 0 THEN 'even.jsonl' ELSE 'odd.jsonl' END AS source FROM benchmark")
def s32_file_tags(spark, sf_dir):
    """Rows of two files, each with the name of its own."""
    path = tables.until_exit(spark, tables.scratch(spark, "files"))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for n, name in enumerate(("even", "odd")):
        b = table(spark, sf_dir, "benchmark").filter(F.col("item_id") % 2 == n).select("item_id", F.col("text").alias("question"))
        tables.write_lines(b.coalesce(1), f"{path}/{name}")
        (part,) = [s.getPath() for s in fs.listStatus(hadoop.Path(f"{path}/{name}")) if s.getPath().getName().startswith("part-")]
        fs.rename(part, hadoop.Path(f"{path}/{name}.jsonl"))
    return tables.read_rows(spark, "item_id long, question string", f"{path}/even.jsonl", f"{path}/odd.jsonl")


@register(f"""WITH {C}, s AS (SELECT x.doc_id FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1 AND y.text = x.text WHERE x.doc_id % 2 = 0)
SELECT chunk_id, 'N' || CAST(doc_id // 2 AS VARCHAR) || '-' || CAST(doc_id % 2 AS VARCHAR) AS doc_id, "order" FROM c WHERE doc_id NOT IN (SELECT doc_id FROM s) AND doc_id % 10 <> 7""")
def s01_serving_chunks(spark, sf_dir):
    """Chunk lines read back, two documents of a notice as its revisions: bodies that their last revision repeats go, and every tenth document is on the list of those replaced."""
    d = F.col("doc_id")
    own = F.concat(F.lit("N"), F.floor(d / 2).cast("string"), F.lit("-"), (d % 2).cast("string"))
    c = chunks(spark, sf_dir)
    rows = c.select("text", F.create_map(F.lit("doc_id"), own, F.lit("order"), F.col("order").cast("string"), F.lit("chunk_id"), F.col("chunk_id")).alias("meta"))
    path = tables.until_exit(spark, tables.scratch(spark, "serving"))
    tables.write_lines(rows, path)
    replaced = table(spark, sf_dir, "documents").filter(d % 10 == 7).select(own.alias("doc_id"))
    return D.serving(tables.read_chunks(spark, path), replaced).select("chunk_id", "doc_id", F.col("order").cast("long").alias("order"))
