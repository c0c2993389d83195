"""Registered queries of listings, evaluation sets, dictionaries and text clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import models
from ..functions import text as T
from ..operators import chunking, documents, markup, mining, splitting
from ..operators import retrieval as R
from ..operators.search import body
from ..sources import listings
from ..sources.tables import spread
from .catalog import BM25, TOK, C, chunks, questions, register, table

SYNONYMS = {"ort": ["the", "model"], "data": ["data", "table"], "zeit": ["time", "year"]}
PATTERNS = ((1, "^[A-Z].{1,40}[.]$"), (2, r"^\d{1,2}[.)] .{1,40}$"))
LEVEL = r"CASE WHEN regexp_matches(trim(line), '^[A-Z].{1,40}[.]$') THEN 1 WHEN regexp_matches(trim(line), '^\d{1,2}[.)] .{1,40}$') THEN 2 END"
HEADS = rf"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
p AS (SELECT doc_id, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM l),
hd AS (SELECT doc_id, pos, {LEVEL} AS level, trim(line) AS title FROM p WHERE {LEVEL} IS NOT NULL)"""


def items(spark, sf_dir):
    """Listing items from parts: every field that the listing operators read."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    other = ["cntrctCnclsMthdNm", "ntceInsttNm", "rgstDt", "bidBeginDt", "befBidBbancNo", *[f"ntceSpec{k}{n}" for k in ("FileNm", "DocUrl") for n in range(3, 11)]]
    return p.select(
        key.cast("string").alias("bidNtceNo"), F.when(key % 3 == 0, "001").when(key % 3 == 1, "null").otherwise("2.0").alias("bidNtceOrd"), F.when(key % 4 == 0, F.concat("p_name", F.lit(" 시스템"))).otherwise(F.col("p_name")).alias("bidNtceNm"),
        F.when(key % 5 == 0, "협상(SW사업)").when(key % 5 == 1, "협상에의한계약").alias("sucsfbidMthdNm"), F.when(key % 7 == 0, "취소공고").alias("ntceKindNm"), F.when(key % 2 == 0, F.col("p_size").cast("string")).alias("asignBdgtAmt"),
        F.when(key % 3 == 0, "None").otherwise(F.col("p_size").cast("string")).alias("presmptPrce"), F.col("p_brand").alias("dminsttNm"), F.lit("d").alias("bidNtceDt"), F.lit("e").alias("bidClseDt"),
        F.when(key % 6 != 0, "공고문.HWP").alias("ntceSpecFileNm1"), F.lit("http://a /1").alias("ntceSpecDocUrl1"), F.when(key % 11 != 0, "제안요청서.pdf").otherwise("그림.png").alias("ntceSpecFileNm2"), F.lit("http://a/2").alias("ntceSpecDocUrl2"), *[F.lit(None).cast("string").alias(c) for c in other],
    )


@register(r"""WITH i AS (SELECT p_partkey AS k, p_name, p_size, p_brand, CASE WHEN p_partkey % 11 <> 0 THEN 2 WHEN p_partkey % 6 <> 0 THEN 1 END AS slot, p_partkey % 4 = 0 OR regexp_matches(p_name, '시스템|정보화|소프트웨어|솔루션|플랫폼|포털|홈페이지|웹사이트|전산|데이터베이스|빅데이터|ISMP|ISP|BPR|EA|LMS|ERP|GIS|DW|CDW') AS it FROM part)
SELECT CAST(k AS VARCHAR) || CASE k % 3 WHEN 0 THEN '-1' WHEN 1 THEN '-0' ELSE '-2' END AS doc_id, it OR k % 5 = 0 AS wanted, k % 5 IN (0, 1) AS negotiated, k % 7 = 0 AS cancelled, CASE slot WHEN 1 THEN 'http://a/1' WHEN 2 THEN 'http://a/2' END AS url,
CASE WHEN k % 2 = 0 OR k % 3 <> 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS budget, CASE WHEN k % 2 = 0 THEN '배정예산' WHEN k % 3 <> 0 THEN '추정가격' ELSE '' END AS budget_kind, p_brand AS agency FROM i""")
def f05_f08_t24_k03_listings(spark, sf_dir):
    i = items(spark, sf_dir).withColumns({"file_name": F.lit("a.PDF"), "found": listings.attachment()})
    flags = i.select(listings.doc_id().alias("doc_id"), listings.wanted().alias("wanted"), listings.negotiated().alias("negotiated"), listings.cancelled().alias("cancelled"), F.col("found.url").alias("url"))
    return flags.join(listings.metadata_rows(i).select("doc_id", "budget", "budget_kind", "agency"), "doc_id")


@register(r"""WITH i AS (SELECT p_partkey AS k, p_partkey % 7 <> 0 AS live, p_partkey % 11 <> 0 OR p_partkey % 6 <> 0 AS att, p_partkey % 4 = 0 OR regexp_matches(p_name, '시스템|정보화|소프트웨어|솔루션|플랫폼|포털|홈페이지|웹사이트|전산|데이터베이스|빅데이터|ISMP|ISP|BPR|EA|LMS|ERP|GIS|DW|CDW') AS it FROM part)
SELECT count(*) AS items, count(*) FILTER (WHERE live) AS live, count(*) FILTER (WHERE live AND att) AS attached, count(*) FILTER (WHERE live AND att AND it) AS it, count(*) FILTER (WHERE live AND att AND k % 5 IN (0, 1)) AS negotiated, count(*) FILTER (WHERE live AND att AND it AND k % 5 IN (0, 1)) AS both FROM i""")
def a13_sampled_listings(spark, sf_dir):
    return listings.sampled(items(spark, sf_dir))


@register(r"""SELECT CAST(p_partkey AS VARCHAR) || CASE p_partkey % 3 WHEN 0 THEN '-1' WHEN 1 THEN '-0' ELSE '-2' END AS doc_id FROM part WHERE p_partkey % 7 <> 0 AND (p_partkey % 11 <> 0 OR p_partkey % 6 <> 0) AND p_partkey % 10 <> 0
AND (p_partkey % 5 = 0 OR p_partkey % 4 = 0 OR regexp_matches(p_name, '시스템|정보화|소프트웨어|솔루션|플랫폼|포털|홈페이지|웹사이트|전산|데이터베이스|빅데이터|ISMP|ISP|BPR|EA|LMS|ERP|GIS|DW|CDW'))""")
def s10_s11_arrivals(spark, sf_dir):
    i = items(spark, sf_dir)
    known = i.filter(F.col("bidNtceNo").cast("long") % 10 == 0).select(listings.doc_id().alias("doc_id"))
    return listings.arrivals(i, known).select("doc_id")


@register(r"""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) * 1000 AS VARCHAR) WHEN 2 THEN 'x' ELSE '500' END AS stated, '예산 ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '천원 및 12,000원' AS text FROM orders),
a AS (SELECT *, list_sort(list_distinct(list_transform(list_zip(regexp_extract_all(text, '(\d[\d,]{2,})\s*(원|천원|백만원|억원)', 1), regexp_extract_all(text, '(\d[\d,]{2,})\s*(원|천원|백만원|억원)', 2)), lambda x: CAST(replace(x[1], ',', '') AS BIGINT) * CASE x[2] WHEN '원' THEN 1 WHEN '천원' THEN 1000 WHEN '백만원' THEN 1000000 ELSE 100000000 END))) AS found FROM t)
SELECT o_orderkey, array_to_string(found, ',') AS found, CASE WHEN stated IS NULL THEN 'no stated' WHEN TRY_CAST(stated AS DOUBLE) IS NULL THEN 'bad stated' WHEN len(found) = 0 THEN 'none' WHEN list_contains(found, CAST(TRY_CAST(stated AS DOUBLE) AS BIGINT)) THEN 'match' ELSE 'mismatch' END AS verdict FROM a""")
def a17_amounts(spark, sf_dir):
    key, won = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    stated = F.when(key % 4 == 0, None).when(key % 4 == 1, (won * 1000).cast("string")).when(key % 4 == 2, "x").otherwise("500")
    t = table(spark, sf_dir, "orders").select("o_orderkey", stated.alias("stated"), F.concat(F.lit("예산 "), won.cast("string"), F.lit("천원 및 12,000원")).alias("text"))
    return t.select("o_orderkey", F.array_join(T.amounts(F.col("text")).cast("array<string>"), ",").alias("found"), T.amount_verdict(F.col("text"), F.col("stated")).alias("verdict"))


@register(r"""WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l, text FROM (SELECT doc_id, text || chr(10) || 'a line with a mark [' || CAST(doc_id % 9 AS VARCHAR) || ']' AS text FROM documents)),
y AS (SELECT doc_id, list_filter(l, lambda s: length(trim(s)) > 15) AS l FROM x)
SELECT doc_id, CAST(len(list_filter(l, lambda s: regexp_matches(s, '\[\d+\]'))) AS DOUBLE) / len(l) AS cited, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 9 = 7 THEN 1.0 ELSE 0.0 END ELSE 1.0 END AS numbers FROM y""")
def e14_e15_answers(spark, sf_dir):
    mark = (F.col("doc_id") % 9).cast("string")
    tail = F.concat(F.lit("\na line with a mark ["), mark, F.lit("]"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", tail).alias("answer"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("7"))).otherwise(F.array(F.lit("with a mark"))).alias("keywords"), tail.alias("end"))
    return d.select("doc_id", T.cite_rate(F.col("answer")).alias("cited"), T.number_match(F.col("end"), F.col("keywords")).alias("numbers"))


@register(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Z]{2,4}-\d{2,4}|요구사항|기능|규격|명칭|기능명|SFR|과업|내역|항목') THEN '요구사항' WHEN regexp_matches(text, '배점|점수|정성|정량|평가|몇\s*점|비율|가산점|가점|한도|기준|%') OR regexp_matches(text || ' ' || source, '\d+점|\d+%') THEN '배점' ELSE '의역' END AS kind FROM documents""")
def e03_question_type(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.question_type(F.col("text"), F.col("source")).alias("kind"))


@register(r"""WITH t AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'budget : ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '원.' ELSE 'nothing' END AS a, 'term: ' || o_orderpriority AS b FROM orders)
SELECT doc_id, 'budget' AS field, substr(a, 10, length(a) - 10) AS answer FROM t WHERE a <> 'nothing' UNION ALL SELECT doc_id, f, trim(regexp_extract(b, 'term: (.*)', 1)) FROM t, (SELECT unnest(['term', 'more']) AS f) WHERE f = 'term' OR a = 'nothing'""")
def e01_field_pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("budget : "), F.floor("o_totalprice").cast("long").cast("string"), F.lit("원."))).otherwise("nothing")
    docs = o.select(F.col("o_orderkey").alias("doc_id"), F.concat(a, F.lit("\nterm: "), "o_orderpriority").alias("text"))
    return mining.field_pairs(docs, [("budget", "budget", r"[\d,]+\s*(?:천원|백만원|억원|원)"), ("term", "term", r"[^\n]{4,60}"), ("more", "term", r"[^\n]{4,60}")])


@register(r"SELECT p_partkey, trim(CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || '.x' END) AS key FROM part")
def p14_file_key(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.file_key(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), "p_name", F.lit(".HWPX "))).otherwise(F.concat("p_name", F.lit(".x")))).alias("key"))


@register(f"""WITH {C}, n AS (SELECT count(*) AS n FROM c), t AS (SELECT text, list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: length(w) > 1)) AS w FROM c),
s AS (SELECT key, seed FROM (VALUES ('ort', 'the'), ('ort', 'model'), ('data', 'data'), ('data', 'table'), ('zeit', 'time'), ('zeit', 'year')) v(key, seed)),
sd AS (SELECT key, seed FROM s, n WHERE (SELECT count(*) FROM c WHERE contains(text, seed)) / CAST(n AS DOUBLE) <= 0.25),
sl AS (SELECT DISTINCT key, chunk_id FROM sd JOIN c ON contains(c.text, seed)),
sz AS (SELECT key, size FROM (SELECT key, count(*) AS size FROM sl GROUP BY key), n WHERE size >= 5 AND size / CAST(n AS DOUBLE) <= 0.35),
w AS (SELECT chunk_id, unnest(list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: length(w) > 1))) AS term FROM c),
f AS (SELECT term, df FROM (SELECT term, count(*) AS df FROM w GROUP BY term), n WHERE df / CAST(n AS DOUBLE) BETWEEN 0.002 AND 0.25),
i AS (SELECT key, term, count(*) AS df_in FROM sl JOIN w USING (chunk_id) GROUP BY key, term HAVING count(*) >= 5),
m AS (SELECT key, term, df_in, round(df_in * n / CAST(size * df AS DOUBLE), 6) AS lift FROM i JOIN sz USING (key) JOIN f USING (term), n)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lift DESC, df_in DESC, term DESC) AS rank FROM m) WHERE rank <= 5""")
def a22_mined_keywords(spark, sf_dir):
    return mining.mined_keywords(chunks(spark, sf_dir), SYNONYMS, T.tokens(F.col("text")), least=5)


@register("SELECT k AS key, count(*) FILTER (WHERE contains(text, k)) AS fired, round(count(*) FILTER (WHERE contains(text, k)) / CAST(count(*) AS DOUBLE), 4) AS share FROM benchmark, (SELECT unnest(['ort', 'data', 'zeit']) AS k) GROUP BY k")
def a20_fire_rate(spark, sf_dir):
    return mining.fire_rate(questions(spark, sf_dir), SYNONYMS)


@register("""WITH k AS (SELECT c_name AS key, c_custkey AS doc_id FROM customer), a AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN c_name || '.pdf' WHEN c_custkey % 3 = 1 THEN left(c_name, 17) || '.hwp' ELSE 'none' || CAST(c_custkey AS VARCHAR) END AS name FROM customer),
s AS (SELECT name, CASE WHEN strpos(name, '.') > 1 THEN left(name, strpos(name, '.') - 1) ELSE name END AS stem FROM a),
p AS (SELECT name, min(CASE WHEN key = stem OR key = name THEN doc_id END) AS exact, min(CASE WHEN starts_with(key, stem) THEN doc_id END) AS lo, max(CASE WHEN starts_with(key, stem) THEN doc_id END) AS hi FROM s, k GROUP BY name)
SELECT name, CASE WHEN exact IS NOT NULL THEN exact WHEN lo = hi THEN lo ELSE -1 END AS doc_id, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN lo = hi THEN 'prefix' WHEN lo IS NOT NULL THEN 'ambiguous' ELSE 'none' END AS reason FROM p""")
def j03_j10_resolved(spark, sf_dir):
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    name = F.when(key % 3 == 0, F.concat("c_name", F.lit(".pdf"))).when(key % 3 == 1, F.concat(F.substring("c_name", 1, 17), F.lit(".hwp"))).otherwise(F.concat(F.lit("none"), key.cast("string")))
    return mining.resolved(c.select(name.alias("name")), c.select(F.col("c_name").alias("key"), key.alias("doc_id"))).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))


@register("""WITH a AS (SELECT item_id, text AS keyword, row_number() OVER (PARTITION BY left(text, 20) ORDER BY item_id) AS n FROM benchmark), f AS (SELECT item_id, count(DISTINCT doc_id) AS owners FROM a JOIN documents d ON contains(d.text, keyword) GROUP BY item_id)
SELECT item_id, coalesce(owners, 0) AS owners, CASE WHEN n > 1 THEN 'duplicate' WHEN owners IS NULL THEN 'not in corpus' WHEN owners > 1 THEN 'ambiguous' ELSE 'kept' END AS verdict FROM a LEFT JOIN f USING (item_id)""")
def j06_j12_owners(spark, sf_dir):
    return mining.owners(table(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, 20).alias("question"), F.col("text").alias("keyword")), table(spark, sf_dir, "documents"))


@register(f"""WITH {C}, a AS (SELECT lang AS kind, doc_id, regexp_replace(right(text, 12), '\\s+', '', 'g') AS keyword FROM documents), p AS (SELECT doc_id, regexp_replace(string_agg(text, '' ORDER BY "order"), '\\s+', '', 'g') AS body FROM c WHERE NOT (doc_id % 4 = 0 AND "order" = 0) GROUP BY doc_id)
SELECT kind, count(*) AS asked, count(*) FILTER (WHERE contains(coalesce(body, ''), keyword)) AS survived FROM a LEFT JOIN p ON a.doc_id = p.doc_id WHERE length(keyword) > 0 GROUP BY kind""")
def j07_survival(spark, sf_dir):
    """Ends of all documents in all their chunks, of which a splitter lost the first of every fourth document."""
    pairs = table(spark, sf_dir, "documents").select(F.col("lang").alias("kind"), "doc_id", F.expr("right(text, 12)").alias("keyword"))
    return mining.survival(pairs, chunks(spark, sf_dir).filter(~((F.col("doc_id") % 4 == 0) & (F.col("order") == 0))))


@register("""WITH a AS (SELECT DISTINCT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents), b AS (SELECT DISTINCT doc_id, trim(unnest(string_split(replace(text, ' the ', ' a '), chr(10)))) AS line FROM documents)
SELECT a.doc_id, count(*) AS lines, count(b.line) AS kept, round(count(b.line) / CAST(count(*) AS DOUBLE), 6) AS rate FROM a LEFT JOIN b ON a.doc_id = b.doc_id AND a.line = b.line WHERE length(a.line) >= 10 GROUP BY a.doc_id""")
def a24_line_keep_rate(spark, sf_dir):
    """Whole texts against another extraction that changes a word."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mining.line_keep_rate(d, d.withColumn("text", F.replace("text", F.lit(" the "), F.lit(" a "))))


@register(f"""WITH {BM25}, g AS (SELECT b.item_id AS query_id, c.chunk_id FROM benchmark b JOIN c ON contains(c.text, b.text)),
x AS (SELECT h.*, sum(length(c.text)) OVER (PARTITION BY query_id ORDER BY rank) AS run FROM h JOIN c USING (chunk_id)),
k AS (SELECT b.item_id, EXISTS (SELECT 1 FROM g WHERE g.query_id = b.item_id) AS has, EXISTS (SELECT 1 FROM g JOIN x USING (query_id, chunk_id) WHERE query_id = b.item_id) AS ranked, EXISTS (SELECT 1 FROM g JOIN x USING (query_id, chunk_id) WHERE query_id = b.item_id AND (run <= 6000 OR rank = 1)) AS shown FROM benchmark b)
SELECT CASE WHEN shown THEN 'hit' WHEN NOT has THEN 'no gold in corpus' WHEN ranked THEN 'over budget' ELSE 'outside candidates' END AS kind, count(*) AS n FROM k GROUP BY 1""")
def a16_failures(spark, sf_dir):
    c, q = chunks(spark, sf_dir), questions(spark, sf_dir)
    hits = R.bm25(c, q, 10)
    return mining.failures(R.holding(c, q), hits, R.fit_context(hits.join(c.select("chunk_id", "text"), "chunk_id")), q)


@register("""SELECT lang AS kind, count(*) AS n, round(avg(length(text)), 3) AS mean_a, round(avg(length(replace(text, 'en ', ''))), 3) AS mean_b, count(*) FILTER (WHERE a) AS hits_a, count(*) FILTER (WHERE b) AS hits_b, count(*) FILTER (WHERE a AND NOT b) AS lost, count(*) FILTER (WHERE NOT a AND b) AS gained
FROM (SELECT *, contains(text, 'een ') AS a, contains(CASE WHEN doc_id % 3 = 0 THEN text || 'een ' ELSE replace(text, 'en ', '') END, 'een ') AS b, CASE WHEN doc_id % 3 = 0 THEN text || 'een ' ELSE replace(text, 'en ', '') END AS tb FROM documents) GROUP BY lang""".replace("length(replace(text, 'en ', ''))", "length(tb)"))
def a14_paired(spark, sf_dir):
    """Whole texts against those that lost a word, or gained one."""
    d = table(spark, sf_dir, "documents")
    side = lambda e: d.select(F.col("doc_id").alias("query_id"), F.col("lang").alias("kind"), e.alias("context"))
    other = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("een "))).otherwise(F.replace("text", F.lit("en "), F.lit("")))
    return mining.paired(side(F.col("text")), side(other), F.lit("een "))


@register("""SELECT source AS extractor, count(*) AS docs, min(length(text)) AS shortest, max(length(text)) AS longest, round(avg(length(text)), 3) AS mean_chars, count(*) FILTER (WHERE length(text) < 1000) AS weak, round(avg(least(length(text) / CAST(length(CASE WHEN doc_id % 2 = 0 THEN text || text ELSE lang END) AS DOUBLE), 1.0)), 4) AS ratio FROM documents GROUP BY source""")
def a32_extraction_report(spark, sf_dir):
    """Lengths of whole texts against what is stated of them."""
    stated = F.when(F.col("doc_id") % 2 == 0, F.concat("text", "text")).otherwise(F.col("lang"))
    return mining.extraction_report(table(spark, sf_dir, "documents").select(F.col("source").alias("extractor"), "text", stated.alias("stated")))


@register(r"""SELECT doc_id, CAST(len(list_filter(l, lambda x: regexp_matches(x, '^\d+[.)]'))) AS INTEGER) AS numbered, CAST(len(list_filter(l, lambda x: NOT regexp_matches(x, '^\d+[.)]') AND regexp_matches(x, '^[-*]'))) AS INTEGER) AS bulleted FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def a27_header_counts(spark, sf_dir):
    counts = T.header_counts(F.col("text"), {"numbered": r"^\d+[.)]", "bulleted": "^[-*]"})
    return table(spark, sf_dir, "documents").select("doc_id", counts.alias("m")).select("doc_id", F.col("m")["numbered"].alias("numbered"), F.col("m")["bulleted"].alias("bulleted"))


@register(f"WITH {HEADS} SELECT doc_id, pos, CAST(level AS INTEGER) AS level, title FROM hd")
def t20_headings(spark, sf_dir):
    return mining.headings(table(spark, sf_dir, "documents"), PATTERNS)


@register(f"""WITH {HEADS}, st AS (SELECT doc_id, pos, title FROM hd UNION ALL SELECT doc_id, 0, 'body' FROM documents),
ct AS (SELECT *, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos, title <> 'body') AS stop FROM st),
bd AS (SELECT ct.doc_id, pos, title, trim(substr(text, pos + 1, coalesce(stop, length(text)) - pos)) AS text FROM ct JOIN documents d ON ct.doc_id = d.doc_id WHERE stop IS NULL OR stop > pos)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS "order", title AS section, md5(text) AS digest FROM bd WHERE length(text) >= 30""")
def c02_sections(spark, sf_dir):
    s = mining.sections(table(spark, sf_dir, "documents"), PATTERNS, first="body")
    return s.select("doc_id", "order", "section", F.md5(F.col("text").cast("binary")).alias("digest"))


@register("""WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS chunk_id, d.label, round(-list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)))), 6) + 0.0 AS score FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM s)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM g WHERE r <= 50 AND label < 3 QUALIFY rank <= 5""")
def r02_dense_scoped(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    hits = R.dense(e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v")), e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 50)
    scope = e.filter("label < 3").select(F.col("vec_id").alias("chunk_id"))
    return R.top_k(hits.join(scope, "chunk_id", "left_semi").drop("rank"), 5).withColumn("rank", F.col("rank").cast("long"))


@register()
def r02_dense_diverse(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    v, q = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v")), e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return markup.diverse(R.dense(v, q, 30).join(v, "chunk_id").join(q, "query_id").select("query_id", "chunk_id", "v", "q"))


def filled_sql(source: str, size: int, overlap: int, separators) -> str:
    """CTEs that end in fo(doc_id, ps): the pieces of source(doc_id, text) by `splitting.filled_pieces`, each level a fold over strings."""
    none = "CAST([] AS VARCHAR[])"
    out = [f"f0 AS (SELECT doc_id, CASE WHEN length(text) > {size} OR regexp_replace(text, '\\s', '', 'g') <> '' THEN [text] ELSE {none} END AS ps FROM {source})"]
    for n, sep in enumerate(separators, 1):
        mark = f"'{sep}'" if "\n" not in sep else "||".join("chr(10)" for _ in sep)
        joined = f"CASE WHEN a.held = '' THEN p.held ELSE a.held || {mark} || p.held END"
        flush = f"CASE WHEN a.held = '' THEN {none} ELSE [a.held] END"
        step = f"CASE WHEN length({joined}) <= {size} THEN {{'out': a.out, 'held': {joined}}} WHEN length(p.held) > {size} THEN {{'out': a.out || {flush} || [p.held], 'held': ''}} ELSE {{'out': a.out || {flush}, 'held': p.held}} END"
        fold = f"list_reduce([{{'out': {none}, 'held': ''}}] || list_transform(string_split(t, {mark}), lambda x: {{'out': {none}, 'held': x}}), lambda a, p: {step})"
        cut = f"list_transform([{fold}], lambda r: r.out || CASE WHEN r.held <> '' THEN [r.held] ELSE {none} END)[1]" if sep else f"list_transform(range(0, length(t), {size}), lambda i: substr(t, i + 1, {size}))"
        out.append(f"f{n} AS (SELECT doc_id, flatten(list_transform(ps, lambda t: CASE WHEN length(t) > {size} THEN {cut} ELSE [t] END)) AS ps FROM f{n - 1})")
    carried = f"list_reduce([{{'out': {none}, 'held': ''}}] || list_transform(ps, lambda x: {{'out': {none}, 'held': x}}), lambda a, p: {{'out': a.out || [a.held || p.held], 'held': right(a.held || p.held, {overlap})}})"
    return ", ".join([*out, f"fo AS (SELECT doc_id, ({carried}).out AS ps FROM f{len(separators)})"])


def slid_sql(source: str, key: str, size: int, overlap: int, separators) -> str:
    """CTEs that end in so(key, ps): the pieces of source(key, text) by `splitting.sliding_pieces`."""
    none = "CAST([] AS VARCHAR[])"
    out = [f"s0 AS (SELECT {key}, [{{'t': text, 'long': length(text) > {size}}}] AS ps FROM {source})"]
    for n, sep in enumerate(separators, 1):
        mark = f"'{sep}'" if "\n" not in sep else "||".join("chr(10)" for _ in sep)
        parts = f"list_filter(list_transform(string_split(m.t, {mark}), lambda x, k: CASE WHEN k = 1 THEN x ELSE {mark} || x END), lambda x: x <> '')"
        held = "CASE WHEN len(a.cur) > 0 THEN [array_to_string(a.cur, '')] ELSE CAST([] AS VARCHAR[]) END"
        rest = f"list_filter(a.cur, lambda c, k: list_sum(list_transform(a.cur[k:], lambda z: length(z))) <= least({overlap}, {size} - length(p.x)))"
        step = f"CASE WHEN length(p.x) >= {size} THEN {{'out': a.out || {held} || [p.x], 'cur': {none}, 'x': ''}} WHEN length(array_to_string(a.cur, '')) + length(p.x) > {size} THEN {{'out': a.out || {held}, 'cur': {rest} || [p.x], 'x': ''}} ELSE {{'out': a.out, 'cur': a.cur || [p.x], 'x': ''}} END"
        fold = f"list_reduce([{{'out': {none}, 'cur': {none}, 'x': ''}}] || list_transform({parts}, lambda x: {{'out': {none}, 'cur': {none}, 'x': x}}), lambda a, p: {step})"
        cut = f"list_transform([{fold}], lambda a: a.out || {held})[1]"
        windows = f"list_transform(range(0, greatest(1, CAST(ceil((length(m.t) - {overlap}) / {float(size - overlap)}) AS BIGINT))), lambda i: {{'t': substr(m.t, CAST(i * {size - overlap} + 1 AS BIGINT), {size}), 'long': false}})"
        made = f"CASE WHEN m.long AND contains(m.t, {mark}) THEN list_transform({cut}, lambda v: {{'t': v, 'long': length(v) >= {size}}}) ELSE [m] END" if sep else f"CASE WHEN m.long THEN {windows} ELSE [m] END"
        out.append(f"s{n} AS (SELECT {key}, flatten(list_transform(ps, lambda m: {made})) AS ps FROM s{n - 1})")
    return ", ".join([*out, f"so AS (SELECT {key}, list_filter(list_transform(ps, lambda m: regexp_replace(m.t, '^\\s+|\\s+$', '', 'g')), lambda t: t <> '') AS ps FROM s{len(separators)})"])


PIECES = """SELECT printf('%s::%04d', CAST(doc_id AS VARCHAR), o) AS chunk_id, doc_id, CAST(o AS INTEGER) AS "order", text FROM (SELECT doc_id, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS o FROM {0})"""


@register(f"WITH {filled_sql('documents', 800, 120, splitting.COARSE)} {PIECES.format('fo')}")
def c01_c04_recursive_chunks(spark, sf_dir):
    """Parts joined up to a size, with what comes before (C04)."""
    return splitting.pieces_of(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), splitting.filled_pieces(F.col("text")))


@register(f"WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), {slid_sql('d', 'doc_id', 1200, 200, splitting.SENTENCES)} {PIECES.format('so')}")
def c01_sliding_chunks(spark, sf_dir):
    """Whole parts up to a size, the last ones again at the beginning of the next piece (C01)."""
    return splitting.pieces_of(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), splitting.sliding_pieces(F.col("text")))


@register(f"""WITH {HEADS}, st AS (SELECT doc_id, pos, title FROM hd UNION ALL SELECT doc_id, 0, 'body' FROM documents),
ct AS (SELECT *, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos, title <> 'body') AS stop FROM st),
bd AS (SELECT {{'doc_id': ct.doc_id, 'pos': pos, 'title': title}} AS k, trim(substr(text, pos + 1, coalesce(stop, length(text)) - pos)) AS text FROM ct JOIN documents d ON ct.doc_id = d.doc_id WHERE stop IS NULL OR stop > pos),
b AS (SELECT * FROM bd WHERE length(text) >= 30), lg AS (SELECT * FROM b WHERE length(text) > 300), {slid_sql('lg', 'k', 300, 60, splitting.SENTENCES)},
al AS (SELECT k, ps FROM so UNION ALL SELECT k, [text] FROM b WHERE length(text) <= 300), ex AS (SELECT k, unnest(ps) AS text, generate_subscripts(ps, 1) AS piece FROM al)
SELECT k.doc_id AS doc_id, row_number() OVER (PARTITION BY k.doc_id ORDER BY k.pos, piece) - 1 AS "order", k.title AS section, text FROM ex""")
def c02_cut_sections(spark, sf_dir):
    """Sections, those of over 300 characters cut again."""
    return mining.sections(table(spark, sf_dir, "documents"), PATTERNS, first="body", size=300, overlap=60)


@register()
def c05_c07_table_chunks(spark, sf_dir):
    return chunking.chunked(table(spark, sf_dir, "documents").select("doc_id", "text"), chunking.split_with_tables)


@register()
def c03_semantic_chunks(spark, sf_dir):
    return chunking.chunked(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), lambda t: markup.split_by_meaning(t, models.hashed_trigrams))


@register()
def t09_t11_clean_documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", markup.without_toc(F.col("text")).alias("text")).select("doc_id", markup.without_table_markup(F.col("text")).alias("text"))


@register()
def t17_labelled_values(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", markup.labelled_values(F.col("text")).alias("fields"))


@register()
def c05_chunk_pairs(spark, sf_dir):
    """Search and generation texts; greedy, so small cases and the recursion's parts test it."""
    return chunking.chunked_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register(f"WITH {C} SELECT chunk_id, CASE WHEN \"order\" % 2 = 0 THEN text || '!' ELSE text END AS body FROM c")
def p04_generation_body(spark, sf_dir):
    """Chunks with and without a generation text."""
    return chunks(spark, sf_dir).withColumn("gen", F.when(F.col("order") % 2 == 0, F.concat("text", F.lit("!"))).otherwise("")).select("chunk_id", body(True).alias("body"))


@register("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'period' END AS period FROM documents""")
def c09_processed_documents(spark, sf_dir):
    """Extracted texts cleaned, stripped of markup, with their fields: whether the label's value was found."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.regexp_replace("text", "[□■○◦※]", ""), F.when(F.col("doc_id") % 2 == 0, F.lit("\n□ 사업기간 : period\n")).otherwise("")).alias("text"))
    return documents.processed(docs).select("doc_id", F.col("fields")["사업기간"].alias("period"))


#: A dictionary that fires on these texts.
FIRING = {"the": ["and", "model"], "tion": ["ing", "table"], "ver": ["und", "and"]}
USE = """p AS (SELECT b.item_id, b.text, d.lang AS kind, coalesce(d.text, '') AS gold, contains(b.text, 'the') AS k1, contains(b.text, 'tion') AS k2, contains(b.text, 'ver') AS k3 FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id)"""


def gold_pairs(spark, sf_dir):
    """Items as questions, and the documents of their numbers as gold texts."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("lang").alias("kind"), F.col("text").alias("gold"))
    return questions(spark, sf_dir).join(d, "query_id", "left")


@register(f"WITH {USE} SELECT kind, count(*) AS asked, count(*) FILTER (WHERE k1 OR k2 OR k3) AS fired, round(count(*) FILTER (WHERE k1 OR k2 OR k3) / CAST(count(*) AS DOUBLE), 4) AS share FROM p GROUP BY GROUPING SETS ((kind), ())")
def a20_fired_by_kind(spark, sf_dir):
    return mining.dictionary_use(gold_pairs(spark, sf_dir), FIRING)[0]


@register(f"""WITH {USE}, w AS (SELECT item_id, gold, unnest(list_distinct(list_concat(CASE WHEN k1 THEN ['and', 'model'] ELSE [] END, CASE WHEN k2 THEN ['ing', 'table'] ELSE [] END, CASE WHEN k3 THEN ['und', 'and'] ELSE [] END))) AS word FROM p)
SELECT word, count(*) FILTER (WHERE contains(gold, word)) AS useful, count(*) FILTER (WHERE NOT contains(gold, word)) AS wasted, round(count(*) FILTER (WHERE contains(gold, word)) / CAST(count(*) AS DOUBLE), 4) AS share FROM w GROUP BY word""")
def a20_useful_words(spark, sf_dir):
    return mining.dictionary_use(gold_pairs(spark, sf_dir), FIRING)[1]


@register(rf"""WITH {C}, t AS (SELECT chunk_id, unnest(list_distinct({TOK})) AS term FROM c), f AS (SELECT term, count(*) AS df FROM t GROUP BY term), n AS (SELECT count(*) AS n FROM c),
e AS (SELECT lang, unnest({TOK}) AS word, generate_subscripts({TOK}, 1) AS place FROM (SELECT p.p_brand AS lang, d.text FROM documents d JOIN part p ON p.p_partkey = d.doc_id)),
o AS (SELECT lang, word, min(place) AS place, coalesce(df, 0) / CAST(n AS DOUBLE) AS share FROM e LEFT JOIN f ON word = term, n GROUP BY lang, word, df, n)
SELECT lang AS key, array_to_string(list(word ORDER BY place, word) FILTER (WHERE share > 0 AND share <= 0.02), ' ') AS words, count(*) FILTER (WHERE NOT (share > 0 AND share <= 0.02)) AS gone FROM o GROUP BY lang HAVING count(*) FILTER (WHERE share > 0 AND share <= 0.02) > 0""")
def a21_pruned_dictionary(spark, sf_dir):
    """The words of documents as a dictionary by brand: those that over a fiftieth of all chunks have go."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("key"))
    words = table(spark, sf_dir, "documents").join(p, "doc_id").select("key", F.posexplode(T.tokens(F.col("text"))).alias("place", "word"))
    found = mining.pruned(words, documents.document_frequency(chunks(spark, sf_dir), T.tokens(F.col("text"))), 0.02)
    return found.select("key", F.array_join("words", " ").alias("words"), F.size("gone").cast("long").alias("gone"))
