"""Registered queries of composed searches, contexts and notices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import models
from ..operators import documents as D
from ..operators import filters
from ..operators import retrieval as R
from ..operators import search as S
from .catalog import C, TOK, chunks, questions, register, table

SYNONYMS = {"then": ["after", "later"], "was": ["past"]}
POOL, TOP = 10, 5

VARIANTS = """q0 AS (SELECT item_id AS query_id, text FROM benchmark),
va AS (SELECT query_id, v AS variant, CASE WHEN v = 0 THEN text ELSE concat_ws(' ', text, concat_ws(' ', CASE WHEN contains(text, 'then') THEN 'after later' END, CASE WHEN contains(text, 'was') THEN 'past' END)) END AS text FROM (SELECT query_id, text, unnest(CASE WHEN contains(text, 'then') OR contains(text, 'was') THEN [0, 1] ELSE [0] END) AS v FROM q0)),
vq AS (SELECT CAST(query_id AS VARCHAR) || '#' || CAST(variant AS VARCHAR) AS query_id, text FROM va)"""


def bm25_sql(source: str, out: str, k: int) -> str:
    """CTEs of the BM25 hits of source(query_id, text) over the chunks c, as `out`."""
    n = out
    return f"""t_{n} AS (SELECT chunk_id, {TOK} AS w FROM c), p_{n} AS (SELECT chunk_id, term, count(*) AS tf, first(dl) AS dl FROM (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM t_{n}) GROUP BY chunk_id, term),
s_{n} AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t_{n}), r_{n} AS (SELECT term, n, avgdl, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p_{n}, s_{n} GROUP BY term, n, avgdl),
i_{n} AS (SELECT term, avgdl, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r_{n}) ELSE raw END AS idf FROM r_{n}),
a_{n} AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOK}) AS term FROM {source}) GROUP BY query_id, term),
m_{n} AS (SELECT a.query_id, p.chunk_id, round(sum(a.qtf * i.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / i.avgdl))), 6) AS score FROM a_{n} a JOIN i_{n} i ON a.term = i.term JOIN p_{n} p ON a.term = p.term GROUP BY a.query_id, p.chunk_id),
{n} AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM m_{n} WHERE score > 0) WHERE rank <= {k})"""


def vectors_sql(source: str, key: str, out: str) -> str:
    """CTE of trigram vectors, one row for each slot: the first byte of a trigram's MD5."""
    grams = f"SELECT {key}, unnest(list_transform(range(1, greatest(length(text) - 1, 1)), lambda i: substr(lower(text), i, 3))) AS g FROM {source}"
    return f"""g_{out} AS (SELECT {key}, g, count(*) AS n FROM ({grams}) GROUP BY {key}, g), u_{out} AS (SELECT {key}, substr(md5(g), 1, 2) AS slot, CAST(sum(n) AS DOUBLE) AS n FROM g_{out} GROUP BY {key}, substr(md5(g), 1, 2)),
{out} AS (SELECT {key}, slot, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS w FROM u_{out})"""


def dense_sql(source: str, out: str, k: int) -> str:
    """CTEs of the nearest chunks of source(query_id, text) by squared distance of unit vectors."""
    return f"""{vectors_sql(source, "query_id", "vq_" + out)}, {vectors_sql("c", "chunk_id", "vc_" + out)},
e_{out} AS (SELECT q.query_id, v.chunk_id, sum(q.w * v.w) AS dot FROM vq_{out} q JOIN vc_{out} v ON q.slot = v.slot GROUP BY q.query_id, v.chunk_id),
k_{out} AS (SELECT s.query_id, c.chunk_id, round(-(2 - 2 * coalesce(e.dot, 0)), 6) + 0.0 AS score FROM (SELECT DISTINCT query_id FROM {source}) s CROSS JOIN (SELECT chunk_id FROM c WHERE length(text) > 2) c LEFT JOIN e_{out} e ON e.query_id = s.query_id AND e.chunk_id = c.chunk_id),
{out} AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM k_{out}) WHERE rank <= {k})"""


def fused_sql(lists: list[tuple[str, float]], out: str, k: int) -> str:
    parts = " UNION ALL ".join(f"SELECT query_id, chunk_id, {w} / (60 + rank) AS part, {n} AS li, rank FROM {h}" for n, (h, w) in enumerate(lists))
    return f"""f_{out} AS (SELECT query_id, chunk_id, sum(part) AS raw, min(li * 100000 + rank) AS seen FROM ({parts}) GROUP BY query_id, chunk_id),
{out} AS (SELECT query_id, chunk_id, round(raw, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, seen, chunk_id) AS rank FROM f_{out}) WHERE rank <= {k})"""


def together_sql(hits: str, out: str) -> str:
    """CTE of the hits of all variants of a question, each chunk where it comes first."""
    return f"""{out} AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY place, chunk_id) AS rank FROM (SELECT CAST(split_part(query_id, '#', 1) AS BIGINT) AS query_id, chunk_id,
min(CAST(split_part(query_id, '#', 2) AS BIGINT) * 100000 + rank) AS place, arg_min(score, CAST(split_part(query_id, '#', 2) AS BIGINT) * 100000 + rank) AS score FROM {hits} GROUP BY 1, 2))"""


def reranked_sql(hits: str, out: str, k: int) -> str:
    return f"""o_{out} AS (SELECT h.query_id, h.chunk_id, h.rank AS before, list_distinct(string_split(q0.text, '')) AS x, list_distinct(string_split(c.text, '')) AS y FROM {hits} h JOIN q0 ON h.query_id = q0.query_id JOIN c ON h.chunk_id = c.chunk_id),
x_{out} AS (SELECT query_id, chunk_id, before, round(CAST(len(list_intersect(x, y)) AS DOUBLE) / (len(x) + 1), 6) AS score FROM o_{out}),
{out} AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM x_{out}) WHERE rank <= {k})"""


def attributes_sql() -> str:
    """CTE of chunks with a notice's columns."""
    return """n0 AS (SELECT chunk_id, c.doc_id, "order", text, '' AS gen, 'n' || CAST(c.doc_id // 3 AS VARCHAR) AS notice_no, CASE WHEN c.doc_id % 5 <> 0 THEN CAST(c.doc_id % 3 AS INTEGER) END AS revision, 'title ' || CAST(c.doc_id AS VARCHAR) AS title,
CASE WHEN c.doc_id % 4 <> 0 THEN s.source END AS agency, CASE WHEN c.doc_id % 7 <> 0 THEN CAST(c.doc_id * 1000000 AS DOUBLE) END AS budget, CASE WHEN c.doc_id % 6 <> 0 THEN '2024-0' || CAST(1 + c.doc_id % 9 AS VARCHAR) || '-01 10:00' ELSE '' END AS bid_close_at, CASE WHEN c.doc_id % 2 = 0 THEN '배정예산' ELSE '' END AS budget_kind
FROM c JOIN (SELECT doc_id, source FROM documents) s ON c.doc_id = s.doc_id)"""


def attributed(spark, sf_dir):
    """Chunks with a notice's columns, some of them unknown."""
    d = F.col("doc_id")
    sources = table(spark, sf_dir, "documents").select("doc_id", "source")
    return chunks(spark, sf_dir).join(sources, "doc_id").select(
        "chunk_id", "doc_id", "order", "text", F.lit("").alias("gen"), F.concat(F.lit("n"), F.floor(d / 3).cast("string")).alias("notice_no"), F.when(d % 5 != 0, (d % 3).cast("int")).alias("revision"), F.concat(F.lit("title "), d.cast("string")).alias("title"),
        F.when(d % 4 != 0, F.col("source")).alias("agency"), F.when(d % 7 != 0, (d * 1_000_000).cast("double")).alias("budget"), F.when(d % 6 != 0, F.concat(F.lit("2024-0"), (1 + d % 9).cast("string"), F.lit("-01 10:00"))).otherwise("").alias("bid_close_at"), F.when(d % 2 == 0, "배정예산").otherwise("").alias("budget_kind"),
    )


def vectors(spark, sf_dir):
    return chunks(spark, sf_dir).filter(F.length("text") > 2).select("chunk_id", models.embed_exactly(F.col("text")).alias("v"))


def longs(df, *names):
    return df.withColumns({n: F.col(n).cast("long") for n in names})


@register(f"WITH {C}, {VARIANTS}, {bm25_sql('vq', 'h', POOL)}, {together_sql('h', 'z')} SELECT query_id, chunk_id, score, rank FROM z")
def r08_run_search(spark, sf_dir):
    """Every variant is searched; the hits come one variant after the other, each chunk once."""
    return longs(S.run_search(S.bm25(chunks(spark, sf_dir)), R.add_keywords(questions(spark, sf_dir), SYNONYMS), POOL), "rank")


@register(f"WITH {C}, {VARIANTS}, {bm25_sql('vq', 'h', POOL)}, {dense_sql('vq', 'd', POOL)}, {fused_sql([('d', 0.5), ('h', 0.5)], 'f', POOL)}, {together_sql('f', 'z')}, {reranked_sql('z', 'r', TOP)} SELECT query_id, chunk_id, score, rank FROM r")
def r12_retrieve(spark, sf_dir):
    """Dictionary words, dense and lexical search fused, candidates of all variants scored anew."""
    c = chunks(spark, sf_dir)
    both = S.hybrid([S.dense(vectors(spark, sf_dir), models.embed_exactly), S.bm25(c)], pool=POOL)
    return longs(S.retrieve(questions(spark, sf_dir), c, both, SYNONYMS, TOP, POOL), "rank")


@register(f"WITH {C}, q0 AS (SELECT item_id AS query_id, text FROM benchmark), {dense_sql('q0', 'd', TOP)} SELECT query_id, chunk_id, score, rank FROM d")
def r02_dense_texts(spark, sf_dir):
    """Nearest chunks of embedded questions."""
    return longs(S.dense(vectors(spark, sf_dir), models.embed_exactly)(questions(spark, sf_dir), TOP), "rank")


@register(f"""WITH {C}, q0 AS (SELECT item_id AS query_id, text FROM benchmark), s AS (SELECT query_id, chunk_id FROM q0, c WHERE c.doc_id % 40 = q0.query_id % 40), {bm25_sql('q0', 'h', 1000000)},
k AS (SELECT h.query_id, h.chunk_id, h.score FROM h JOIN s ON h.query_id = s.query_id AND h.chunk_id = s.chunk_id)
SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM k) WHERE rank <= 5""")
def r17_scoped_bm25(spark, sf_dir):
    """Each question is limited to documents of its own before ranking."""
    c, q = chunks(spark, sf_dir), questions(spark, sf_dir)
    scope = q.select("query_id", (F.col("query_id") % 40).alias("own")).join(c.select("chunk_id", (F.col("doc_id") % 40).alias("own")), "own").select("query_id", "chunk_id")
    return longs(S.bm25(c, scope)(q, TOP), "rank")


@register("SELECT item_id AS query_id, CAST(0 AS INTEGER) AS variant, text FROM benchmark")
def r10_query_rewrite(spark, sf_dir):
    """The stand-in model answers nothing after the last mark, so questions stay."""
    return S.rewritten(questions(spark, sf_dir))


@register("SELECT item_id AS query_id, CAST(v AS INTEGER) AS variant, CASE WHEN v = 0 THEN text ELSE '검색용 질문 3개:' END AS text FROM benchmark, (SELECT unnest([0, 1]) AS v)")
def r11_multi_query(spark, sf_dir):
    """The stand-in model's only line, which it repeats of the prompt, is the one paraphrase."""
    return S.multiplied(questions(spark, sf_dir))


CONTEXT = """b AS (SELECT h.query_id, h.rank, n0.doc_id, n0.text, '[' || CAST(h.rank AS VARCHAR) || '] ' || concat_ws(' · ', title, agency, notice_no, CAST(revision AS VARCHAR) || '차 공고', CASE WHEN bid_close_at <> '' THEN '마감 ' || substr(bid_close_at, 1, 10) END,
CASE WHEN budget IS NOT NULL THEN CASE WHEN budget_kind <> '' THEN budget_kind ELSE '공고 금액' END || ' ' || CASE WHEN n0.doc_id = 0 THEN '0원' ELSE concat_ws(' ', CASE WHEN n0.doc_id >= 100 THEN CAST(n0.doc_id // 100 AS VARCHAR) || '억' END, CASE WHEN n0.doc_id % 100 > 0 THEN format('{:,}', n0.doc_id % 100 * 100) || '만' END) || '원' END END) || chr(10) || text AS block
FROM h JOIN n0 ON h.chunk_id = n0.chunk_id),
w AS (SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank) AS bodies, sum(length(block) + 7) OVER (PARTITION BY query_id ORDER BY rank) - 7 AS whole FROM b),
x AS (SELECT query_id, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n_chunks, bool_or(doc_id % 40 = query_id % 40) AS own, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS docs FROM w WHERE rank = 1 OR (bodies <= 6000 AND whole <= 6000) GROUP BY query_id)"""


def found(spark, sf_dir):
    a = attributed(spark, sf_dir)
    return S.contexts(R.bm25(chunks(spark, sf_dir), questions(spark, sf_dir), POOL).join(a, "chunk_id"))


@register(f"WITH {C}, q0 AS (SELECT item_id AS query_id, text FROM benchmark), {attributes_sql()}, {bm25_sql('q0', 'h', POOL)}, {CONTEXT} SELECT query_id, md5(context) AS digest, n_chunks, CAST(length(context) AS BIGINT) AS chars, docs FROM x")
def r15_context_with_headers(spark, sf_dir):
    """Blocks under headers of the notices, within the budget with headers and rules counted."""
    docs = F.array_join(F.transform("sources", lambda s: s["doc_id"].cast("string")), ",")
    return longs(found(spark, sf_dir).select("query_id", F.md5(F.col("context").cast("binary")).alias("digest"), "n_chunks", "chars", docs.alias("docs")), "n_chunks", "chars")


@register(f"""WITH {C}, q0 AS (SELECT item_id AS query_id, text FROM benchmark), {attributes_sql()}, {bm25_sql('q0', 'h', POOL)}, {CONTEXT}
SELECT printf('%s-%03d', CASE WHEN q0.query_id % 3 = 0 THEN 'q' ELSE 'kind' END, row_number() OVER (ORDER BY q0.query_id)) AS qid, q0.text AS question, md5(coalesce(context, '')) AS digest, coalesce(position(',' || CAST(q0.query_id AS VARCHAR) || ',' IN ',' || docs || ','), 0) > 0 AS found_doc, CAST(coalesce(n_chunks, 0) AS BIGINT) AS n_chunks FROM q0 LEFT JOIN x ON q0.query_id = x.query_id""")
def k11_export_contexts(spark, sf_dir):
    """One row for each question, not scoped: whether its document was found is told."""
    q = questions(spark, sf_dir)
    pairs = q.select("query_id", F.col("text").alias("question"), F.when(F.col("query_id") % 3 != 0, "kind").alias("kind"), F.lit(None).cast("boolean").alias("answerable"), F.col("query_id").alias("doc_id"), F.array().cast("array<string>").alias("keywords"))
    out = S.exported(pairs, found(spark, sf_dir), scoped=False)
    return longs(out.select("qid", "question", F.md5(F.col("context").cast("binary")).alias("digest"), "found_doc", "n_chunks"), "n_chunks")


@register(f"""WITH {C}, q0 AS (SELECT item_id AS query_id, text FROM benchmark), {attributes_sql()}, {bm25_sql('q0', 'h', POOL)}, {dense_sql('q0', 'd', POOL)}, {fused_sql([('d', 0.5), ('h', 0.5)], 'f', POOL)},
g AS (SELECT f.query_id, n0.doc_id, first(notice_no) AS notice_no, first(revision) AS revision, sum(1 / CAST(60 + rank AS DOUBLE)) AS raw, count(*) AS n_chunks, min(rank) AS fr, first(title) AS title, first(agency) AS agency, first(budget) AS budget, first(bid_close_at) AS bid_close_at,
arg_min(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 200), rank) AS excerpt FROM f JOIN n0 ON f.chunk_id = n0.chunk_id GROUP BY f.query_id, n0.doc_id),
p AS (SELECT * FROM g WHERE budget IS NOT NULL AND budget >= 5000000 AND agency IS NOT NULL AND contains(agency, 's') AND bid_close_at <> '' AND bid_close_at >= '2024-03'),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, CASE WHEN revision IS NULL THEN '-' || CAST(doc_id AS VARCHAR) ELSE notice_no END ORDER BY raw DESC, fr) AS k FROM p) WHERE k = 1),
y AS (SELECT notice_no, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY revision, doc_id) AS siblings FROM (SELECT DISTINCT doc_id, notice_no, revision FROM n0 WHERE revision IS NOT NULL) GROUP BY notice_no)
SELECT query_id, doc_id, b.notice_no, round(raw, 6) AS score, n_chunks, title, excerpt, coalesce(siblings, '') AS siblings, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, fr) AS rank FROM b LEFT JOIN y ON b.notice_no = y.notice_no AND b.revision IS NOT NULL QUALIFY rank <= 10""")
def r13_search_notices_filtered(spark, sf_dir):
    """Dense and lexical candidates folded to notices, filtered by budget, agency and closing date, with their families."""
    c, a, q = chunks(spark, sf_dir), attributed(spark, sf_dir), questions(spark, sf_dir)
    hits = S.hybrid([S.dense(vectors(spark, sf_dir), models.embed_exactly), S.bm25(c)], pool=POOL)(q, POOL)
    family = D.notices(a.filter("revision is not null")).select("doc_id", "siblings")
    out = S.notices_found(hits, a, filters.passes(min_budget=5_000_000, agency="s", closes_after="2024-03"), family)
    return longs(out.select("query_id", "doc_id", "notice_no", "score", "n_chunks", "title", "excerpt", F.coalesce("siblings", F.lit("")).alias("siblings"), "rank"), "rank")


@register(f"""WITH {C}, {attributes_sql()} SELECT chunk_id FROM n0 WHERE (budget IS NOT NULL AND budget BETWEEN 5000000 AND 500000000) AND contains(coalesce(agency, ''), '1') AND bid_close_at <> '' AND bid_close_at >= '2024-02' AND bid_close_at <= '2024-08'""")
def f01_filter_chunks(spark, sf_dir):
    return attributed(spark, sf_dir).filter(filters.filter_by("1", 5_000_000, 500_000_000, "2024-02", "2024-08")).select("chunk_id")


@register(f"""WITH {C}, {attributes_sql()} SELECT DISTINCT doc_id FROM n0 WHERE budget IS NOT NULL AND budget <= 300000000 AND bid_close_at >= '2024-05'""")
def f02_passing_notices(spark, sf_dir):
    return attributed(spark, sf_dir).filter(filters.passes(max_budget=300_000_000, closes_after="2024-05")).select("doc_id").distinct()


@register("SELECT chunk_id FROM (WITH " + C + " SELECT chunk_id, doc_id FROM c) WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def f03_keep_doc_chunks(spark, sf_dir):
    return filters.keep_docs(chunks(spark, sf_dir), table(spark, sf_dir, "labels").filter("quality = 1")).select("chunk_id")


@register(r"""WITH w AS (SELECT d.doc_id, text, list_distinct(list_filter(regexp_split_to_array(left(text, 40) || ' ' || source, '[^가-힣A-Za-z0-9]+'), lambda w: length(w) >= 2)) AS w FROM documents d)
SELECT b.item_id, w.doc_id, len(list_filter(w, lambda x: contains(b.text, x))) >= 2 AS named FROM benchmark b JOIN w ON b.item_id = w.doc_id""")
def f10_names_notice(spark, sf_dir):
    """Questions against the title (the beginning of a text) and agency of the notice of the same number."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 40).alias("title"), F.col("source").alias("agency"))
    met = table(spark, sf_dir, "benchmark").join(d, F.col("item_id") == F.col("doc_id"))
    return met.select("item_id", "doc_id", filters.names_notice(F.col("text"), F.col("title"), F.col("agency")).alias("named"))


@register(f"""WITH {C}, q0 AS (SELECT item_id AS query_id, text FROM benchmark), {bm25_sql('q0', 'h', 10)}, {dense_sql('q0', 'd', 10)}, {bm25_sql('q0', 'h2', 30)}, {dense_sql('q0', 'd2', 30)}, {fused_sql([('d2', 0.5), ('h2', 0.5)], 'f', 10)},
g AS (SELECT b.item_id AS query_id, c.chunk_id FROM benchmark b JOIN c ON contains(c.text, b.text)), z AS (SELECT DISTINCT query_id FROM g),
r AS (SELECT 'BM25' AS name, query_id, chunk_id, rank FROM h UNION ALL SELECT 'Dense', query_id, chunk_id, rank FROM d UNION ALL SELECT 'Hybrid', query_id, chunk_id, rank FROM f),
k AS (SELECT n.name, z.query_id, min(r.rank) AS rank FROM z CROSS JOIN (SELECT unnest(['BM25', 'Dense', 'Hybrid']) AS name) n LEFT JOIN (SELECT r.* FROM r JOIN g ON r.query_id = g.query_id AND r.chunk_id = g.chunk_id) r ON r.query_id = z.query_id AND r.name = n.name GROUP BY n.name, z.query_id)
SELECT name, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 3) AS hit_rate, round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0.0 END), 3) AS mrr, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 3) AS top1, count(*) AS questions FROM k GROUP BY name ORDER BY hit_rate DESC, mrr DESC, name""")
def a05_r18_compare_setups(spark, sf_dir):
    """Three configurations over the same questions; what is gold contains the question."""
    c, q = chunks(spark, sf_dir), questions(spark, sf_dir)
    all_ = S.setups(c, vectors(spark, sf_dir), models.embed_exactly)
    return S.compared({k: all_[k] for k in ("BM25", "Dense", "Hybrid")}, q, R.holding(c, q))
