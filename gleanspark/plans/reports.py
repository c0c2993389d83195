"""Registered queries of answers, evaluation sets and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers, evalsets, grounding, markup, quality, reports
from ..operators import retrieval as R
from ..operators import documents as D
from .catalog import BM25, C, chunks, questions, register, table
from .evaluation import PATTERNS
from .search import attributed, attributes_sql

ANSWERS = """a AS (SELECT doc_id AS qid, lang AS kind, CASE WHEN doc_id % 5 = 0 THEN '정보가 없습니다' WHEN doc_id % 5 = 1 THEN substr(text, 1, 40) || ' 1,234 [1] [' || CAST(doc_id % 4 AS VARCHAR) || '] 99' WHEN doc_id % 5 = 2 THEN '명시되어 있지 않음 [2]' ELSE 'ab 77 cd' END AS answer,
'[1] head 1234' || chr(10) || '[2] 77 and 5' AS context, CASE WHEN doc_id % 3 = 0 THEN []::VARCHAR[] WHEN doc_id % 3 = 1 THEN ['가. 항목 : ' || substr(text, 1, 6), ''] ELSE ['a b 7 7'] END AS keywords FROM documents)"""
ANSWER_MEASURES = r"""u AS (SELECT *, list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: CAST(x AS INTEGER)) AS used, list_distinct(list_transform(list_filter(regexp_extract_all(answer, '[\d,]+'), lambda x: length(x) > 1), lambda x: replace(x, ',', ''))) AS nums FROM a),
v AS (SELECT *, list_filter(nums, lambda n: NOT list_contains(list_transform(used, lambda x: CAST(x AS VARCHAR)), n)) AS own FROM u),
m AS (SELECT qid, kind, CASE WHEN len(used) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cited, CASE WHEN len(used) > 0 THEN CAST(len(list_filter(used, lambda x: x IN (1, 2))) AS DOUBLE) / len(used) END AS precise,
CASE WHEN len(own) > 0 THEN CAST(len(list_filter(own, lambda x: x IN ('1', '1234', '2', '77', '5'))) AS DOUBLE) / len(own) END AS grounded, CASE WHEN regexp_matches(answer, '확인되지\s*않|찾을\s*수\s*없|명시되어\s*있지\s*않|정보가\s*없') AND len(used) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS refused,
CASE WHEN len(keywords) > 0 THEN CASE WHEN len(list_filter(keywords, lambda k: k <> '' AND regexp_replace(regexp_replace(k, '^[\s\-•*○◦□ㅁ]*(?:[가-힣0-9]{1,2}[.)]\s*)?(?:[^:\n]{1,14}\s*:\s*)?', ''), '\s+', '', 'g') <> '' AND contains(regexp_replace(answer, '\s+', '', 'g'), regexp_replace(regexp_replace(k, '^[\s\-•*○◦□ㅁ]*(?:[가-힣0-9]{1,2}[.)]\s*)?(?:[^:\n]{1,14}\s*:\s*)?', ''), '\s+', '', 'g')))) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS gold FROM v)"""


def answered(spark, sf_dir):
    d = F.col("doc_id")
    answer = F.when(d % 5 == 0, "정보가 없습니다").when(d % 5 == 1, F.concat(F.substring("text", 1, 40), F.lit(" 1,234 [1] ["), (d % 4).cast("string"), F.lit("] 99"))).when(d % 5 == 2, "명시되어 있지 않음 [2]").otherwise("ab 77 cd")
    keywords = F.when(d % 3 == 0, F.array().cast("array<string>")).when(d % 3 == 1, F.array(F.concat(F.lit("가. 항목 : "), F.substring("text", 1, 6)), F.lit(""))).otherwise(F.array(F.lit("a b 7 7")))
    return table(spark, sf_dir, "documents").select(d.alias("qid"), F.col("lang").alias("kind"), answer.alias("answer"), F.lit("[1] head 1234\n[2] 77 and 5").alias("context"), keywords.alias("keywords"))


@register(f"WITH {ANSWERS}, {ANSWER_MEASURES} SELECT qid, cited, precise, grounded, refused, gold FROM m")
def e12_e13_answer_scores(spark, sf_dir):
    return answers.scored(answered(spark, sf_dir)).select("qid", *answers.NAMES)


@register(f"""WITH {ANSWERS}, {ANSWER_MEASURES} SELECT coalesce(kind, '전체') AS kind, count(*) AS questions, round(avg(cited), 3) AS cited, round(avg(precise), 3) AS precise, round(avg(grounded), 3) AS grounded, round(avg(refused), 3) AS refused, round(avg(gold), 3) AS gold FROM m GROUP BY GROUPING SETS ((kind), ())""")
def a07_answer_report(spark, sf_dir):
    return answers.by_kind(answers.scored(answered(spark, sf_dir)))


@register(f"WITH {ANSWERS} SELECT qid, CASE WHEN contains(upper(string_split(answer, chr(10))[-1]), 'NO') THEN false END AS faithful FROM (SELECT qid, CASE WHEN qid % 7 = 0 THEN 'no, ' || answer ELSE answer END AS answer FROM a) WHERE NOT contains(upper(answer), 'YES')")
def e16_judged(spark, sf_dir):
    """The stand-in judge repeats the answer."""
    rows = answered(spark, sf_dir).withColumn("answer", F.when(F.col("qid") % 7 == 0, F.concat(F.lit("no, "), "answer")).otherwise(F.col("answer")))
    return rows.filter(~F.contains(F.upper("answer"), F.lit("YES"))).select("qid", answers.judged(F.lit("?"), F.col("context"), F.col("answer")).alias("faithful"))


@register("SELECT item_id AS qid, string_split(trim(text), chr(10))[-1] AS answer, true AS ok FROM benchmark WHERE item_id % 3 <> 0")
def e18_e19_resumed_answers(spark, sf_dir):
    """Questions that have no answer yet; the stand-in model repeats the question."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.lit("context").alias("context"))
    return answers.resumed(b, b.filter("qid % 3 = 0")).select("qid", F.col("answer").alias("answer"), "ok")


@register(f"WITH {ANSWERS} SELECT count(*) AS rows, count(*) FILTER (WHERE qid % 4 = 0) AS empty, count(*) FILTER (WHERE qid % 4 = 1) AS new_headers FROM a")
def a34_run_check(spark, sf_dir):
    context = F.when(F.col("qid") % 4 == 0, " ").when(F.col("qid") % 4 == 1, F.concat(F.lit("[1] 마감 2024\n"), "context")).otherwise(F.col("context"))
    return answers.run_check(answered(spark, sf_dir).withColumn("context", context))


@register("""WITH s AS (SELECT event_type AS setup, CAST(user_id % 5 AS VARCHAR) AS kind, round(avg(CASE WHEN event_id % 2 = 0 THEN value END), 3) AS a, round(avg(CASE WHEN event_id % 2 = 1 THEN value END), 3) AS b, count(CASE WHEN event_id % 2 = 0 THEN 1 END) AS q FROM events GROUP BY ALL),
t AS (SELECT count(*) FILTER (WHERE a > b) AS wins, count(*) FILTER (WHERE a = b) AS ties, count(*) FILTER (WHERE a < b) AS losses, round(sum(a * q) / sum(q), 3) AS mean_a, round(sum(b * q) / sum(q), 3) AS mean_b FROM s WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT *, CASE WHEN wins >= 0.8 * (wins + losses) THEN 'a' WHEN losses >= 0.8 * (wins + losses) THEN 'b' ELSE 'neither' END AS verdict FROM t""")
def a15_compared_runs(spark, sf_dir):
    """Two runs' scores by setup and kind: cells won, and means weighted by questions."""
    e = table(spark, sf_dir, "events")
    run = F.when(F.col("event_id") % 2 == 0, "a").otherwise("b")
    scores = e.groupBy(run.alias("run"), F.col("event_type").alias("setup"), (F.col("user_id") % 5).cast("string").alias("kind")).agg(F.round(F.avg("value"), 3).alias("mrr"), F.count("*").alias("questions"))
    return answers.compared_setups(scores, "a", "b")


# Evaluation sets

HARD = """h AS (SELECT o_orderkey AS doc_id, 'T' || CAST(o_orderkey AS VARCHAR) AS title, CASE WHEN o_orderkey % 4 = 0 THEN '요구사항 고유번호 SFR-' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 3, '0') || chr(10) || '요구사항 명칭 ' || o_orderpriority || chr(10) ELSE '' END || CASE WHEN o_orderkey % 4 = 1 THEN '기술능력 평가 (' || CAST(o_orderkey % 50 AS VARCHAR) || '점)' || chr(10) ELSE '' END || CASE WHEN o_orderkey % 4 = 2 THEN '□ 계약방법 : ' || o_orderpriority || ' 일반.' ELSE 'x' END AS text FROM orders)"""


@register(f"""WITH {HARD}, r AS (SELECT '요구사항' AS kind, doc_id, '「' || title || '」의 SFR-' || lpad(CAST(doc_id % 100 AS VARCHAR), 3, '0') || ' 요구사항 명칭은 무엇인가?' AS question, trim(regexp_extract(text, '명칭 ([^\\n]{{3,40}})', 1)) AS answer FROM h WHERE doc_id % 4 = 0 ORDER BY doc_id LIMIT 40),
s AS (SELECT '배점' AS kind, doc_id, '「' || title || '」 평가에서 ''기술능력 평가'' 의 배점은 몇 점인가?' AS question, '기술능력 평가 (' || CAST(doc_id % 50 AS VARCHAR) || '점' AS answer FROM h WHERE doc_id % 4 = 1 ORDER BY doc_id LIMIT 40),
p AS (SELECT '의역' AS kind, doc_id, '「' || title || '」 사업은 업체를 어떻게 고르나?' AS question, regexp_extract(text, '계약방법 : ([^\\n]*)[.]', 1) AS answer FROM h WHERE doc_id % 4 = 2 ORDER BY doc_id LIMIT 40),
n AS (SELECT doc_id, title, row_number() OVER (ORDER BY doc_id) - 1 AS i, greatest(count(*) OVER () // 15, 1) AS step FROM h),
u AS (SELECT '없음' AS kind, doc_id, replace(['「@」 사업의 작년 낙찰 업체는 어디인가?', '「@」 사업 담당자의 휴대폰 번호는?', '「@」 사업에 몇 개 업체가 입찰했나?', '「@」 사업의 실제 계약 체결일은 언제인가?', '「@」 사업을 수주한 업체의 매출액은?'][i // step % 5 + 1], '@', title) AS question, NULL AS answer FROM n WHERE i % step = 0 AND i // step < 13)
SELECT kind, doc_id, question, coalesce(answer, '') AS answer, answer IS NOT NULL AS answerable FROM (SELECT * FROM r UNION ALL SELECT * FROM s UNION ALL SELECT * FROM p UNION ALL SELECT * FROM u)""")
def e02_hard_pairs(spark, sf_dir):
    """Forty of each kind is the operator's limit."""
    k = F.col("o_orderkey")
    a = F.when(k % 4 == 0, F.concat(F.lit("요구사항 고유번호 SFR-"), F.lpad((k % 100).cast("string"), 3, "0"), F.lit("\n요구사항 명칭 "), "o_orderpriority", F.lit("\n"))).otherwise("")
    b = F.when(k % 4 == 1, F.concat(F.lit("기술능력 평가 ("), (k % 50).cast("string"), F.lit("점)\n"))).otherwise("")
    c = F.when(k % 4 == 2, F.concat(F.lit("□ 계약방법 : "), "o_orderpriority", F.lit(" 일반."))).otherwise("x")
    docs = table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.concat(F.lit("T"), k.cast("string")).alias("title"), F.concat(a, b, c).alias("text"))
    return evalsets.hard_pairs(docs).select("kind", "doc_id", "question", F.coalesce(F.get("keywords", 0), F.lit("")).alias("answer"), "answerable")


@register(f"WITH {C} SELECT doc_id, md5(string_agg(text, '' ORDER BY \"order\")) AS digest FROM c GROUP BY doc_id")
def j13_corpus_bodies(spark, sf_dir):
    return evalsets.corpus_bodies(chunks(spark, sf_dir)).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@register("SELECT text AS question, item_id AS doc_id, item_id % 2 = 0 AS answerable, CAST(CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n FROM benchmark WHERE item_id % 2 = 0 OR item_id % 3 = 0")
def e10_handoff(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("text").alias("question"), F.col("item_id").alias("doc_id"), F.lit("의역").alias("kind"), F.array("text").alias("keywords"), F.when(F.col("item_id") % 3 == 0, "코퍼스에없음").otherwise("빈키워드").alias("defect"))
    return evalsets.handed_off(b.filter("doc_id % 2 = 0"), b.filter("doc_id % 2 = 1")).select("question", "doc_id", "answerable", F.size("keywords").cast("int").alias("n"))


@register()
def e11_contexts_from_evidence(spark, sf_dir):
    """Which others come and in which order hangs on this engine's hash; the tests hold the rest."""
    return evalsets.contexts_from_evidence(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("evidence")))


#: Runs of six characters or more of pairs e(item_id, doc_id, text) and d(doc_id, text), along diagonals.
RUNS = """eg AS (SELECT item_id, doc_id, p, substr(text, p + 1, 6) AS g FROM (SELECT item_id, doc_id, text, unnest(range(0, length(text) - 5)) AS p FROM e)),
dg AS (SELECT doc_id, p, substr(text, p + 1, 6) AS g FROM (SELECT doc_id, text, unnest(range(0, length(text) - 5)) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM e))),
mt AS (SELECT item_id, eg.doc_id, eg.p AS ep, dg.p AS tp FROM eg JOIN dg ON eg.doc_id = dg.doc_id AND eg.g = dg.g),
ch AS (SELECT *, ep - row_number() OVER (PARTITION BY item_id, doc_id, tp - ep ORDER BY ep) AS chain FROM mt),
rn AS (SELECT item_id, doc_id, min(ep) AS ep, min(tp) AS tp, count(*) + 5 AS length FROM ch GROUP BY item_id, doc_id, tp - ep, chain)"""


@register(rf"""WITH e AS (SELECT item_id, item_id AS doc_id, text FROM benchmark), d AS (SELECT doc_id, text FROM documents), {RUNS},
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length DESC, ep, tp) AS r FROM rn) WHERE r = 1)
SELECT item_id, b.doc_id, regexp_replace(substr(e.text, b.ep + 1, b.length), '^\s+|\s+$', '', 'g') AS run FROM b JOIN e USING (item_id) WHERE trim(substr(e.text, b.ep + 1, b.length)) <> ''""")
def e06_longest_runs(spark, sf_dir):
    """Each item's longest run in the document of its number."""
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    return grounding.longest(b.select("item_id", F.col("item_id").alias("doc_id")), b.select("item_id", F.col("text").alias("evidence")), d.select("doc_id", "text"), noise=None)


@register("SELECT item_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text) WHERE length(benchmark.text) >= 6")
def j12_holders(spark, sf_dir):
    """The documents that hold an item, met by its rarest seed."""
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    return grounding.holders(b.filter("length(text) >= 6").select("item_id", F.col("text").alias("needle")), d.select("doc_id", "text"))


@register(r"""WITH o AS (SELECT item_id, min(doc_id) AS doc_id, any_value(benchmark.text) AS own FROM benchmark JOIN documents ON contains(documents.text, benchmark.text) GROUP BY item_id),
f AS (SELECT item_id, doc_id, regexp_replace(own, '\s+', '', 'g') AS own FROM o), h AS (SELECT *, CAST(length(own) // 2 AS BIGINT) AS half FROM f),
e AS (SELECT item_id, doc_id, substr(own, half + 1) || '##' || substr(own, 1, half) AS text, substr(own, 1, 30) AS answer FROM h), d AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS text FROM documents), """ + RUNS + r""",
t AS (SELECT rn.*, substr(text, ep + 1, length) AS run, list_transform(range(0, greatest(length(answer) - 8, 1), 4), lambda i: substr(answer, i + 1, 8)) AS pieces FROM rn JOIN e USING (item_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length < 20, CASE WHEN length >= 20 THEN -len(list_filter(pieces, lambda p: contains(run, p))) ELSE 0 END, -length, ep, tp) AS r FROM t)
SELECT item_id, run AS span FROM b WHERE r = 1""")
def e06_best_spans(spark, sf_dir):
    """Evidence is an item that some document holds, its halves changed, and the answer its beginning: the half with the answer, not the longest, is the span."""
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id", "text")
    own, half = F.regexp_replace("text", r"\s+", ""), F.floor(F.length("own") / 2).cast("int")
    held = grounding.holders(b.select("item_id", F.col("text").alias("needle")), d).groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
    pairs = b.withColumn("own", own).join(held, "item_id").select("item_id", "doc_id", F.concat(F.substr("own", half + 1), F.lit("##"), F.substr("own", F.lit(1), half)).alias("evidence"), F.substring("own", 1, 30).alias("answer"))
    return evalsets.spans(pairs, d).select("item_id", F.regexp_replace("span", r"\s+", "").alias("span"))


@register()
def e04_e06_j12_routed(spark, sf_dir):
    """Questions with evidence of their own document, of another, of none, repeated and empty; longest common runs have no SQL."""
    d = table(spark, sf_dir, "documents").filter("length(text) > 0")
    b = table(spark, sf_dir, "benchmark").withColumn("doc_id", F.col("item_id"))
    evidence = F.when(F.col("item_id") % 5 == 0, "").when(F.col("item_id") % 5 == 1, "ㄱㄴㄷㄹㅁㅂㅅ").otherwise(F.col("text"))
    made = b.select("item_id", F.concat(F.lit("q "), F.floor(F.col("item_id") / 2).cast("string")).alias("question"), F.lit("3점").alias("answer"), "doc_id", evidence.alias("evidence"), (F.col("item_id") % 7 == 0).alias("unanswerable"))
    return evalsets.routed(made, d.select("doc_id", "text"))


# Reports


@register("""SELECT count(*) AS documents, round(count(*) FILTER (WHERE length(text) > 0) / CAST(count(*) AS DOUBLE), 6) AS extracted, round(avg(CASE WHEN lang IN ('de', 'fr') THEN CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END END), 6) AS tables_restored, CAST(sum(doc_id % 2) AS BIGINT) AS tables_partial, count(*) FILTER (WHERE text IS NULL OR text = '') AS failed,
count(*) FILTER (WHERE doc_id % 9 = 0) AS errors, round(count(*) FILTER (WHERE doc_id % 4 <> 0) / CAST(count(*) AS DOUBLE), 6) AS has_period FROM documents""")
def a02_corpus_report(spark, sf_dir):
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("text", F.when(F.col("lang") == "de", "hwp_raw").when(F.col("lang") == "fr", "pdfplumber").otherwise("other").alias("extractor"), (d % 3 == 0).alias("table_ok"), (d % 2).alias("tables_partial"), F.when(d % 9 == 0, "e").alias("error"), F.when(d % 4 != 0, "p").alias("period"))
    return reports.corpus_report(docs, ["period"])


@register("SELECT lang AS value, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, value")
def a02_value_counts(spark, sf_dir):
    return reports.value_counts(table(spark, sf_dir, "documents"), "lang")


@register(rf"""WITH {C}, n AS (SELECT length(text) AS n, row_number() OVER (ORDER BY length(text)) - 1 AS i, count(*) OVER () AS t, doc_id, text FROM c)
SELECT count(*) AS chunks, count(*) FILTER (WHERE trim(text) = '') AS empty, count(*) AS empty_gen, count(*) FILTER (WHERE regexp_matches(text, '\|') OR regexp_matches(text, '<br>') OR regexp_matches(text, '(?m)^\s*\|?\s*:?-{{2,}}') OR regexp_matches(text, '\[표 (?:복원 실패|부분 복원)') OR regexp_matches(text, '\[행 \d+\]')) AS marked, count(DISTINCT doc_id) AS documents,
CAST(floor(avg(n)) AS BIGINT) AS mean, max(n) AS longest, round(count(*) FILTER (WHERE n > 1500) / CAST(count(*) AS DOUBLE), 6) AS "over", max(CASE WHEN i = t // 2 THEN n END) AS median, round(count(*) / CAST(count(DISTINCT doc_id) AS DOUBLE), 6) AS per_document FROM n""")
def a18_chunk_checks(spark, sf_dir):
    return reports.chunk_checks(chunks(spark, sf_dir).withColumn("gen", F.lit(None).cast("string"))).withColumns({"longest": F.col("longest").cast("long"), "median": F.col("median").cast("long")})


TOC_SQL = reports.TOC_LINE
HEADED = """x AS (SELECT doc_id, 'Title one .... 3' || chr(10) || 'second part .... 24' || chr(10) || 'third part' || chr(9) || chr(9) || '78' || chr(10) || 'Title one .... 9' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE repeat('z', 2100) || chr(10) || 'Title one' || chr(10) || 'abc' || chr(10) || 'third part' || chr(10) END || 'tail' AS text FROM documents)"""


def headed(spark, sf_dir):
    body = F.when(F.col("doc_id") % 3 == 0, "").otherwise("z" * 2100 + "\nTitle one\nabc\nthird part\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Title one .... 3\nsecond part .... 24\nthird part\t\t78\nTitle one .... 9\n"), body, F.lit("tail")).alias("text"))


@register("SELECT doc_id, title, CAST(page AS INTEGER) AS page FROM documents, (VALUES ('Title one', 3), ('second part', 24), ('third part', 78)) v(title, page)")
def t21_contents_entries(spark, sf_dir):
    return reports.contents_entries(headed(spark, sf_dir))


@register(f"""WITH {HEADED}, e AS (SELECT doc_id, t AS title, p AS page, strpos(substr(text, 2001), t) AS found FROM x, (VALUES ('Title one', 3), ('second part', 24), ('third part', 78)) v(t, p)),
m AS (SELECT doc_id, page, found + 1999 AS start FROM e WHERE found > 0), r AS (SELECT doc_id, page, start, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS stop, coalesce(lead(page) OVER (PARTITION BY doc_id ORDER BY start), page + 10) AS next_page FROM m)
SELECT d.doc_id AS item_id, CAST(coalesce(r.page, -1) AS INTEGER) AS page, CAST(coalesce(r.next_page, -1) AS INTEGER) AS next_page FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND d.doc_id % 60 + 2150 >= r.start AND (r.stop IS NULL OR d.doc_id % 60 + 2150 < r.stop)""")
def j09_t21_pages_at(spark, sf_dir):
    docs = headed(spark, sf_dir)
    found = reports.pages_at(docs, reports.contents_entries(docs), docs.select(F.col("doc_id").alias("item_id"), "doc_id", (F.col("doc_id") % 60 + 2150).alias("pos")))
    return found.select("item_id", F.coalesce("page", F.lit(-1)).alias("page"), F.coalesce("next_page", F.lit(-1)).alias("next_page"))


@register("SELECT count(*) AS items, round(avg(CASE WHEN doc_id % 4 >= 1 THEN 1.0 ELSE 0.0 END), 6) AS one, round(avg(CASE WHEN doc_id % 4 >= 2 THEN 1.0 ELSE 0.0 END), 6) AS two, round(avg(CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END), 6) AS paged, (SELECT count(*) FILTER (WHERE s >= 0.8) FROM (SELECT avg(CASE WHEN doc_id % 4 >= 1 THEN 1.0 ELSE 0.0 END) AS s FROM documents GROUP BY source)) AS good, (SELECT count(*) FILTER (WHERE s <= 0.2) FROM (SELECT avg(CASE WHEN doc_id % 4 >= 1 THEN 1.0 ELSE 0.0 END) AS s FROM documents GROUP BY source)) AS poor, (SELECT count(*) FILTER (WHERE s > 0.2 AND s < 0.8) FROM (SELECT avg(CASE WHEN doc_id % 4 >= 1 THEN 1.0 ELSE 0.0 END) AS s FROM documents GROUP BY source)) AS mixed FROM documents")
def a19_located(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    paths = d.select(F.col("doc_id").alias("item_id"), F.col("source").alias("doc_id"), (F.col("doc_id") % 4).alias("depth"))
    return reports.located(paths, d.select(F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 2 == 0, 1).alias("page")))


@register(f"WITH {C}, {attributes_sql()}, b AS (SELECT notice_no, revision, string_agg(text, '' ORDER BY \"order\") AS text FROM n0 WHERE revision IS NOT NULL GROUP BY notice_no, revision, doc_id) SELECT notice_no, count(*) AS revisions, min(revision) AS first, max(revision) AS last, arg_min(text, revision) = arg_max(text, revision) AS same FROM b GROUP BY notice_no HAVING count(*) > 1")
def a23_revisions(spark, sf_dir):
    """Similarities come from a Python library and are left to the tests."""
    bodies = attributed(spark, sf_dir).filter("revision is not null").groupBy("doc_id", "notice_no", "revision").agg(D.joined_in_order("text", "order", "").alias("text"))
    return reports.revisions(bodies).drop("similarity")


@register("SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'no document' WHEN 1 THEN 'together' WHEN 2 THEN 'anywhere' ELSE 'missing' END AS verdict FROM benchmark")
def a25_gold_rows(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    gold = b.select("item_id", F.concat(F.lit("f"), i.cast("string")).alias("file_name"), F.when(i % 4 == 3, F.array(F.lit("no such value"), F.lit(""))).otherwise(F.array(F.lit(" alpha "), F.lit("beta"), F.lit(None))).alias("row"))
    texts = b.filter(i % 4 != 0).select(F.concat(F.lit("f"), i.cast("string")).alias("file_name"), F.when(i % 4 == 1, F.concat(F.lit("x\nbeta and alpha\n"), "text")).otherwise(F.concat(F.lit("alpha\nbeta\n"), "text")).alias("text"))
    return reports.gold_rows(gold, texts)


@register("WITH g AS (SELECT round(l_discount - l_tax, 4) AS gap FROM lineitem WHERE l_linenumber = 1) SELECT count(*) FILTER (WHERE gap > 0.002) AS up, count(*) FILTER (WHERE gap < -0.002) AS down, count(*) FILTER (WHERE abs(gap) <= 0.002) AS same, round(avg(gap), 4) AS mean_change FROM g".replace("FROM lineitem WHERE l_linenumber = 1", "FROM (SELECT l_orderkey, min(l_discount) AS l_discount, min(l_tax) AS l_tax FROM lineitem GROUP BY l_orderkey)"))
def a25_against_baseline(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file_name")).agg(F.min("l_discount").alias("after"), F.min("l_tax").alias("before"))
    return reports.against_baseline(per.select("file_name", F.col("after").alias("rate")), per.select("file_name", F.col("before").alias("rate")), "rate")


@register(f"WITH {C}, {attributes_sql()} SELECT count(*) AS chunks, count(agency) AS titled, round(count(agency) / CAST(count(*) AS DOUBLE), 6) AS share, count(agency) / CAST(count(*) AS DOUBLE) < 0.9 AS warned FROM n0")
def a26_titled(spark, sf_dir):
    return reports.titled(attributed(spark, sf_dir).select(F.col("agency").alias("title")))


@register("SELECT lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev(n_chars), 6) AS stddev, min(n_chars) AS least, round(quantile_cont(n_chars, 0.25), 6) AS q1, round(quantile_cont(n_chars, 0.5), 6) AS median, round(quantile_cont(n_chars, 0.75), 6) AS q3, max(n_chars) AS most FROM documents GROUP BY lang")
def a29_described(spark, sf_dir):
    return reports.described(table(spark, sf_dir, "documents"), "n_chars", "lang")


@register("SELECT doc_id, length(text) AS chars FROM documents ORDER BY chars DESC, doc_id LIMIT 10")
def a29_longest(spark, sf_dir):
    """The ten longest are the report."""
    return reports.longest(table(spark, sf_dir, "documents"))


@register("SELECT count(*) AS rows, count(DISTINCT lang || '/' || text) AS \"distinct\", count(*) - count(DISTINCT lang || '/' || text) AS surplus FROM documents")
def a30_duplicate_rows(spark, sf_dir):
    return reports.duplicate_rows(table(spark, sf_dir, "documents").select("lang", "text"))


@register("SELECT doc_id FROM documents WHERE doc_id % 4 = 0 OR doc_id % 6 = 0")
def a30_incomplete_rows(spark, sf_dir):
    d = F.col("doc_id")
    return reports.incomplete_rows(table(spark, sf_dir, "documents").select("doc_id", F.when(d % 4 != 0, 1).alias("a"), F.when(d % 6 != 0, "x").alias("b.c"))).select("doc_id")


@register("SELECT CASE p_partkey % 3 WHEN 0 THEN '.hwp' WHEN 1 THEN '.pdf' ELSE '' END AS extension, count(*) AS n FROM part GROUP BY 1")
def a30_extensions(spark, sf_dir):
    k = F.col("p_partkey")
    return reports.extensions(table(spark, sf_dir, "part").select(F.concat(F.lit("a."), k.cast("string"), F.when(k % 3 == 0, ".HWP").when(k % 3 == 1, ".pdf").otherwise("/x")).alias("file_name")))


@register("SELECT event_type AS stage, count(*) AS runs, round(quantile_cont(value, 0.5), 6) AS median, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def a33_stage_times(spark, sf_dir):
    return reports.stage_times(table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds")))


@register(r"SELECT 'pipes' AS marker, CAST(sum(len(regexp_extract_all(text, '\|'))) AS BIGINT) AS n FROM documents UNION ALL SELECT 'stops', CAST(sum(len(regexp_extract_all(text, '[.] '))) AS BIGINT) FROM documents")
def a27_structure(spark, sf_dir):
    return reports.structure(table(spark, sf_dir, "documents"), {"pipes": r"\|", "stops": "[.] "})


@register(r"SELECT regexp_replace(x, '\s+', '', 'g') AS variant, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, 't\s?h\s?e')) AS x FROM documents) GROUP BY 1")
def a27_variants(spark, sf_dir):
    return reports.variants(table(spark, sf_dir, "documents"), r"t\s?h\s?e")


@register("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id")
def sorted_documents(spark, sf_dir):
    """A global order: ranges, each sorted."""
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.col("n_chars").desc(), "doc_id")


@register(r"""SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 2 AND length(x) <= 60 AND NOT contains(x, ':') AND NOT contains(x, '：') AND NOT (suffix(x, '다.') OR suffix(x, '함') OR suffix(x, '음') OR suffix(x, '임') OR suffix(x, '됨') OR suffix(x, '다')) AND regexp_matches(x, '^(?:[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩIVX]+\s*[.．]|제?\s*\d+\s*[장절]|\d{1,2}\s*[.．]|[가-하]\s*[.．]|\[?\s*별\s*첨\s*\]?)\s*\S'))) AS entries
FROM (SELECT doc_id, text || chr(10) || '1. Overview' || chr(10) || '가. 목적: 값' || chr(10) || 'Ⅱ. 끝났다' AS text FROM documents)""")
def f14_contents_entries(spark, sf_dir):
    t = F.concat("text", F.lit("\n1. Overview\n가. 목적: 값\nⅡ. 끝났다"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(F.split(t, "\n", -1), markup.is_entry)).cast("long").alias("entries"))


@register("SELECT doc_id, length(text) AS chars, source, pos FROM (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents)")
def p01_p11_flat_documents(spark, sf_dir):
    """Nested records flattened to a table, with their number in the source."""
    nested = table(spark, sf_dir, "documents").select(F.struct("doc_id", "source").alias("meta"), "text", F.length("text").cast("long").alias("chars"))
    pos = F.row_number().over(Window.partitionBy("meta.source").orderBy("meta.doc_id")).cast("long")
    return nested.select("meta.doc_id", "chars", "meta.source", pos.alias("pos"))


@register(r"SELECT doc_id, CASE WHEN strpos(text, 'zzz') > 0 THEN '' ELSE substr(text, 1, 220) END AS seen FROM documents WHERE strpos(text, 'zzz') = 0")
def p08_preview(spark, sf_dir):
    """A question of which no word occurs shows the beginning: the window is the operator's."""
    return table(spark, sf_dir, "documents").filter(F.instr("text", "zzz") == 0).select("doc_id", T.preview(F.col("text"), F.lit("zzzz zzz")).alias("seen"))


#: Every second line with three words or more as a row of a table with pipes, whose third cell is empty in every fourth line and missing in every tenth.
TABLED = r"""w AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
tb AS (SELECT doc_id, source, text AS plain, array_to_string(list_transform(ls, lambda l, i: CASE WHEN i % 6 IN (2, 3, 4) AND len(string_split(l, ' ')) >= 3 THEN '| ' || replace(string_split(l, ' ')[1], '|', '') || ' | ' || replace(string_split(l, ' ')[2], '|', '') || ' |' || CASE WHEN i % 10 = 0 THEN '' WHEN i % 4 = 0 THEN '  |' ELSE ' ' || replace(string_split(l, ' ')[3], '|', '') || ' |' END ELSE replace(l, '|', '') END), chr(10)) AS text FROM w)"""


def tabled(spark, sf_dir):
    lines = F.split("text", "\n", -1)

    def row(line, i):
        cell = lambda k: F.replace(F.element_at(F.split(line, " ", -1), k), F.lit("|"), F.lit(""))
        n = i + 1
        third = F.when(n % 10 == 0, "").when(n % 4 == 0, "  |").otherwise(F.concat(F.lit(" "), cell(3), F.lit(" |")))
        made = F.concat(F.lit("| "), cell(1), F.lit(" | "), cell(2), F.lit(" |"), third)
        return F.when((n % 6).isin(2, 3, 4) & (F.size(F.split(line, " ", -1)) >= 3), made).otherwise(F.replace(line, F.lit("|"), F.lit("")))

    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("plain"), F.array_join(F.transform(lines, row), "\n").alias("text"))


@register(rf"""WITH {TABLED}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM tb),
r AS (SELECT doc_id, line, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM l WHERE regexp_matches(line, '^\s*\|.*\|\s*$')),
c AS (SELECT doc_id, run, list_transform(string_split(regexp_replace(trim(line), '^\||\|$', '', 'g'), '|'), lambda x: trim(x)) AS cells FROM r WHERE NOT regexp_matches(line, '^\s*\|?[\s:|-]*-{{3,}}[\s:|-]*\|?\s*$')),
t AS (SELECT doc_id, run, count(*) AS rows, max(len(cells)) AS widest, sum(len(cells)) AS cells, sum(len(list_filter(cells, lambda x: x <> ''))) AS filled, min(len(cells)) = max(len(cells)) AS whole FROM c GROUP BY doc_id, run),
g AS (SELECT doc_id, count(*) AS tables, CAST(sum(cells) AS BIGINT) AS cells, count(*) FILTER (WHERE whole) AS nw, sum(filled) AS nf, sum(rows * widest) AS slots, count(*) FILTER (WHERE filled = 0) AS empty FROM t GROUP BY doc_id),
k AS (SELECT doc_id, plain, text, list_filter(list_distinct(list_transform(string_split(plain, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))), lambda x: length(x) >= 1) AS ls FROM tb)
SELECT k.doc_id, coalesce(tables, 0) AS tables, coalesce(cells, 0) AS cells, coalesce(empty, 0) AS empty, round(nw / CAST(tables AS DOUBLE), 3) AS whole, round(CAST(nf AS DOUBLE) / CAST(slots AS DOUBLE), 3) AS fill, round(1 - CAST(nf AS DOUBLE) / CAST(cells AS DOUBLE), 3) AS blank,
CASE WHEN length(plain) > 0 AND NOT contains(text, plain) THEN 1 ELSE 0 END AS lost, CASE WHEN length(plain) > 0 AND NOT contains(text, plain) THEN length(plain) ELSE 0 END AS lost_chars,
CASE WHEN len(list_filter(ls, lambda x: length(x) >= 10)) > 0 THEN round(len(list_filter(ls, lambda x: length(x) >= 10 AND contains(text, x))) / CAST(len(list_filter(ls, lambda x: length(x) >= 10)) AS DOUBLE), 3) END AS lines,
CASE WHEN len(ls) > 0 THEN round(len(list_filter(ls, lambda x: contains(text, x))) / CAST(len(ls) AS DOUBLE), 3) END AS short_lines, length(text) AS chars, length(plain) AS plain_chars FROM k LEFT JOIN g USING (doc_id)""")
def a24_table_quality(spark, sf_dir):
    """Texts with lines made into tables, against the plain ones; the plain text stands for a table that was rendered, so it is lost wherever a line changed."""
    t = tabled(spark, sf_dir)
    return quality.table_quality(t, t.select("doc_id", F.col("plain").alias("table")))


@register(f"WITH {C}, {attributes_sql()}, b AS (SELECT notice_no, revision, string_agg(text, '' ORDER BY \"order\") AS text FROM n0 WHERE revision IS NOT NULL GROUP BY notice_no, revision, doc_id), "
"f AS (SELECT notice_no, count(*) AS revisions, min(revision) AS first, max(revision) AS last, arg_min(text, revision) AS old, arg_max(text, revision) AS new FROM b GROUP BY notice_no HAVING count(*) > 1), "
"ch AS (SELECT notice_no, unnest(string_split(old, '')) AS c, 1 AS a, 0 AS b FROM f UNION ALL SELECT notice_no, unnest(string_split(new, '')), 0, 1 FROM f), cn AS (SELECT notice_no, c, sum(a) AS a, sum(b) AS b FROM ch GROUP BY notice_no, c), "
"sm AS (SELECT notice_no, round(2 * CAST(sum(least(a, b)) AS DOUBLE) / CAST(sum(a + b) AS DOUBLE), 6) AS similarity FROM cn GROUP BY notice_no) SELECT f.notice_no, revisions, first, last, old = new AS same, similarity FROM f JOIN sm USING (notice_no)")
def a23_families(spark, sf_dir):
    """Families of revisions with the similarity of the first body and the last."""
    bodies = attributed(spark, sf_dir).filter("revision is not null").groupBy("doc_id", "notice_no", "revision").agg(D.joined_in_order("text", "order", "").alias("text"))
    return quality.families(bodies)


@register(f"""WITH {BM25}, {attributes_sql()}, n1 AS (SELECT chunk_id, notice_no, revision FROM n0 WHERE revision IS NOT NULL), hk AS (SELECT * FROM h WHERE rank <= 10), aq AS (SELECT DISTINCT query_id, notice_no FROM hk JOIN n1 USING (chunk_id)),
fd AS (SELECT query_id, notice_no, revision, count(*) AS hits FROM hk JOIN n1 USING (chunk_id) GROUP BY ALL), ev AS (SELECT aq.query_id, r.notice_no, r.revision, coalesce(hits, 0) AS hits FROM aq JOIN (SELECT DISTINCT notice_no, revision FROM n1) r USING (notice_no) LEFT JOIN fd USING (query_id, notice_no, revision))
SELECT query_id, notice_no, revision, hits, hits = 0 AND sum(hits) OVER (PARTITION BY query_id, notice_no) > 0 AS starved FROM ev""")
def a23_starvation(spark, sf_dir):
    """Revisions that a question finds nothing of, in the families that it finds."""
    a, q = attributed(spark, sf_dir), questions(spark, sf_dir)
    hits = R.bm25(chunks(spark, sf_dir), q, 10)
    known = a.filter("revision is not null")
    asked = hits.join(known.select("chunk_id", "notice_no"), "chunk_id").select("query_id", "notice_no")
    return quality.starvation(hits, known, asked)


@register(f"""WITH {BM25} SELECT 'tokenise' AS stage, count(*) AS rows, CAST(sum(octet_length(encode(array_to_string(w, ' ')))) AS BIGINT) AS bytes FROM t
UNION ALL SELECT 'index', count(*), CAST(sum(octet_length(encode(term))) AS BIGINT) FROM r UNION ALL SELECT 'search', count(*), CAST(sum(octet_length(encode(chunk_id))) AS BIGINT) FROM h WHERE rank <= 5""")
def a33_search_costs(spark, sf_dir):
    """Rows and bytes of a search's stages as they were seen in its own run; tasks and seconds, which no SQL knows, are told beside them by the operator."""
    return quality.search_costs(chunks(spark, sf_dir), questions(spark, sf_dir), 5).select("stage", "rows", "bytes")


@register(r"""WITH p AS (SELECT doc_id, text, list_sort(list_filter(regexp_split_to_array(text, '\s+'), lambda w: length(w) >= 2)) AS ws FROM documents), q AS (SELECT doc_id, text, ws[len(ws)] AS word FROM p)
SELECT doc_id, CASE WHEN word IS NULL THEN substr(text, 1, 220) ELSE substr(text, CAST(greatest(strpos(text, word) - 73, 1) AS BIGINT), 220) END AS seen FROM q""")
def p08_windows(spark, sf_dir):
    """The window around the last of each text's words in their order; texts without one show their beginning."""
    d = table(spark, sf_dir, "documents").withColumn("word", F.try_element_at(F.array_sort(F.filter(F.split("text", r"\s+", -1), lambda w: F.length(w) >= 2)), F.lit(-1)))
    return d.select("doc_id", T.preview(F.col("text"), F.coalesce("word", F.lit(""))).alias("seen"))


@register(r"""SELECT doc_id AS qid, CASE WHEN doc_id % 3 = 0 THEN true WHEN doc_id % 3 = 1 THEN false END AS faithful FROM documents""")
def e16_all_verdicts(spark, sf_dir):
    """A judge that says yes, no, or neither, in its last line, after the whole text."""
    verdict = F.when(F.col("doc_id") % 3 == 0, "YES").when(F.col("doc_id") % 3 == 1, "No.").otherwise("...")
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("qid"), answers.judged(F.lit("?"), F.lit("context"), F.concat(F.translate(F.coalesce("text", F.lit("")), "\n", " "), F.lit("\n"), verdict)).alias("faithful"))
