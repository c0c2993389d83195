"""Registered queries of the clean-up of extracted texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import text as T
from ..operators.filters import drop_contents
from ..sources.tables import spread
from .catalog import C as CHUNKS
from .catalog import chunks, register, table


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: What a document gets around it, so that every rule of the clean-up has something to do.
BEFORE = "(단위 : 천원)\n- 12 -\n제 안 요 청 서\n<표> ㅇㅇㅇ ( ) 株式會社 (株式會社) x\x01y < • >\n"
AFTER = "\n 20 년   월 일 \n      wide       gap\n\n\n\n\nend ȃ (ȃ)  \n"
NOISY = "replace({before}, '@', chr(1)) || text || {after}".format(before=quoted(BEFORE.replace("\x01", "@")), after=quoted(AFTER))
KNOWN = "[" + ", ".join(map(quoted, C.BOILERPLATE)) + "]"
LINES = f"""d AS (SELECT doc_id, string_split({NOISY}, chr(10)) AS l FROM documents),
f AS (SELECT doc_id, list_transform(l, lambda x: {{'line': x, 'flat': regexp_replace(trim(x, chr(32) || chr(9)), '\\s+', ' ', 'g')}}) AS l FROM d),
k AS (SELECT doc_id, len(list_filter(l, lambda x: regexp_matches(x.flat, '^- *\\d+ *-$'))) AS page_lines, len(list_filter(l, lambda x: list_contains({KNOWN}, x.flat))) AS boilerplate_lines,
array_to_string(list_transform(list_filter(l, lambda x: NOT regexp_matches(x.flat, '^- *\\d+ *-$') AND NOT list_contains({KNOWN}, x.flat)), lambda x: x.line), chr(10)) AS t FROM f)"""
FOREIGN = f"[{C.FOREIGN}]+"
STRIP = r"'^\s+|\s+$'"


@register(
    f"""WITH {LINES}, a AS (SELECT *, len(regexp_extract_all(t, '<(표|그림)>')) AS tags, regexp_replace(t, '<(표|그림)>', '', 'g') AS t1 FROM k),
b AS (SELECT *, len(regexp_extract_all(t1, '[ㅇ○△]{{2,}}')) AS placeholders, regexp_replace(t1, '[ㅇ○△]{{2,}}', '', 'g') AS t2 FROM a),
c AS (SELECT *, len(regexp_extract_all(t2, '\\(\\s*\\)')) AS empty_parens, regexp_replace(t2, '\\(\\s*\\)', '', 'g') AS t3 FROM b),
e AS (SELECT *, len(regexp_extract_all(t3, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')) AS controls, regexp_replace(t3, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS t4 FROM c),
g AS (SELECT *, len(regexp_extract_all(regexp_replace(t4, '\\({FOREIGN}\\)', '()', 'g'), '{FOREIGN}')) AS foreign_runs, regexp_replace(t4, '(\\({FOREIGN}\\))|{FOREIGN}', '\\1', 'g') AS t5 FROM e)
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t5, '[ \\t]{{5,}}', ' ', 'g'), '\\n{{4,}}', chr(10) || chr(10), 'g'), {STRIP}, '', 'g')) AS digest, CAST(page_lines AS INTEGER) AS page_lines, CAST(boilerplate_lines AS INTEGER) AS boilerplate_lines,
CAST(tags AS INTEGER) AS tags, CAST(placeholders AS INTEGER) AS placeholders, CAST(empty_parens AS INTEGER) AS empty_parens, CAST(controls AS INTEGER) AS controls, CAST(foreign_runs AS INTEGER) AS foreign_runs FROM g"""
)
def t01_t02_t03_clean_text(spark, sf_dir):
    got = C.cleaned(spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.concat(F.lit(BEFORE), F.col("text"), F.lit(AFTER)).alias("text")))
    return got.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), *[F.col(c).cast("int").alias(c) for c in C.NOTES[:7]])


#: A decomposed letter, private letters, a leader, a broken field and lines that repeat.
PLAIN_AFTER = "\ne\u0301a \ue001\x02b\r\n1. x ....... 12\n개요說ȃ1 y\n- 7 -\n~~~~\n   a \t\t b\n" + "head line\n" * 5
REPEATED = """k AS (SELECT doc_id, t, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM n),
w AS (SELECT *, count(*) OVER (PARTITION BY doc_id, trim(line)) AS c FROM k),
r AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT (c >= 5 AND length(trim(line)) BETWEEN 1 AND 60 AND NOT (suffix(trim(line), '다.') OR suffix(trim(line), '함') OR suffix(trim(line), '음')))), '') AS t FROM w GROUP BY doc_id)"""


@register(
    f"""WITH s AS (SELECT doc_id, nfc_normalize(text || replace(replace({quoted(PLAIN_AFTER.replace(chr(2), "@2").replace(chr(13), "@3"))}, '@2', chr(2)), '@3', chr(13))) AS t FROM documents),
n AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '{C.PRIVATE}', '', 'g'), '\\r\\n|\\r', chr(10), 'g'), '{C.DOT_LEADER}', ' ', 'g'), '{C.BROKEN_FIELD}', ' ', 'g') AS t FROM s),
{REPEATED},
l AS (SELECT doc_id, list_transform(string_split(t, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \\t　]{{2,}}', ' ', 'g'), {STRIP}, '', 'g')) AS l FROM r)
SELECT doc_id, md5(regexp_replace(regexp_replace(array_to_string(list_transform(l, lambda x: CASE WHEN regexp_matches(x, '{C.PAGE_ONLY}') OR regexp_matches(x, '{C.RULE_ONLY}') THEN '' ELSE x END), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), {STRIP}, '', 'g')) AS digest FROM l"""
)
def t04_t08_clean_document(spark, sf_dir):
    """The whole chain: composed, leaders, repeated lines, white space."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.concat("text", F.lit(PLAIN_AFTER)).alias("text"))
    return C.clean_documents(docs).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


REFS = C.PAGE_REF.replace(r"(?=\s|$)", r"(?:\s|$)")
CONTENTS = "목 차\n1. 사업일반\t1\n나. 추진 방향 .......... 12\nⅠ. 개요 Ⅱ. 내용 Ⅲ. 입찰\n본문은 그대로 둔다 49,500천원\n"
TOC_FLAG = f"regexp_matches(s, '{C.TOC_DOTS}') OR len(regexp_extract_all(s, '{REFS}')) >= 3 OR (len(regexp_extract_all(s, '{REFS}')) >= 1 AND length(s) <= 80) OR len(regexp_extract_all(s, '{C.SECTION_RUN}')) >= 3"


@register(
    f"""WITH {CHUNKS}, x AS (SELECT chunk_id, CASE doc_id % 3 WHEN 0 THEN {quoted(CONTENTS)} || text WHEN 1 THEN 'ȃȃȃȃȃ' || chr(10) || text ELSE text END AS t FROM c),
l AS (SELECT chunk_id, t, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM x),
m AS (SELECT *, regexp_replace(line, {STRIP}, '', 'g') AS s FROM l), f AS (SELECT *, {TOC_FLAG} AS flag FROM m),
g AS (SELECT chunk_id, first(t) AS t, regexp_matches(first(t), '{C.TOC_MARK}') AND (bool_or(regexp_matches(line, '{C.TOC_DOTS}')) OR bool_or(len(regexp_extract_all(line, '{C.SECTION_RUN}')) >= 3) OR sum(CASE WHEN flag THEN len(regexp_extract_all(line, '{REFS}')) ELSE 0 END) >= 4) AS by_page, sum(len(regexp_extract_all(line, '[ƀ-ɏ]'))) AS leaders FROM f GROUP BY chunk_id),
k AS (SELECT f.chunk_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT (flag AND by_page) AND len(regexp_extract_all(line, '[ƀ-ɏ]')) = 0) AS kept FROM f JOIN g ON f.chunk_id = g.chunk_id GROUP BY f.chunk_id),
z AS (SELECT g.chunk_id, by_page, CAST(leaders AS INTEGER) AS leaders, CASE WHEN by_page OR leaders >= 5 THEN regexp_replace(coalesce(kept, ''), {STRIP}, '', 'g') ELSE t END AS text, by_page OR leaders >= 5 AS touched FROM g JOIN k ON g.chunk_id = k.chunk_id)
SELECT chunk_id, by_page, leaders, md5(text) AS digest FROM z WHERE NOT touched OR length(text) >= 80"""
)
def f11_f12_f13_t10_drop_contents(spark, sf_dir):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(CONTENTS), "text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("ȃȃȃȃȃ\n"), "text")).otherwise(F.col("text"))
    return drop_contents(chunks(spark, sf_dir).withColumn("text", t)).select("chunk_id", "by_page", F.col("leaders").cast("int").alias("leaders"), F.md5(F.col("text").cast("binary")).alias("digest"))


@register(r"""WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '| a<br> | [행 1] |' || chr(10) || '|---|' ELSE '' END AS t FROM documents),
n AS (SELECT doc_id, CAST(len(regexp_extract_all(t, '\|')) AS INTEGER) AS pipes, CAST(len(regexp_extract_all(t, '<br>')) AS INTEGER) AS breaks, CAST(len(regexp_extract_all(t, '(?m)^\s*\|?\s*:?-{2,}')) AS INTEGER) AS rules, CAST(len(regexp_extract_all(t, '\[표 (?:복원 실패|부분 복원)')) AS INTEGER) AS failed, CAST(len(regexp_extract_all(t, '\[행 \d+\]')) AS INTEGER) AS row_tags FROM t)
SELECT * FROM n WHERE pipes + breaks + rules + failed + row_tags > 0""")
def t13_table_residue(spark, sf_dir):
    t = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("\n| a<br> | [행 1] |\n|---|"))).otherwise(F.col("text"))
    counted = table(spark, sf_dir, "documents").select("doc_id", *[c.cast("int").alias(n) for n, c in C.table_residue(t).items()])
    return counted.filter(sum(F.col(n) for n in C.TABLE_RESIDUE) > 0)


@register(r"""WITH t AS (SELECT doc_id, text || chr(10) || '사업기간 : ' || source || ' 까지□ (과업 범위)' || chr(10) || '1. head ' || lang || chr(10) || 'Ⅰ 개요' AS t, source FROM documents)
SELECT doc_id, source || ' 까지' AS period, NULL::VARCHAR AS budget, list_transform(regexp_extract_all(t, '□\s*\(\s*([^)]+?)\s*\)', 1), lambda x: regexp_replace(x, '\s+', '', 'g'))[1] AS item,
CAST(len(list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '^\s+|\s+$', '', 'g')) <= 100 AND regexp_matches(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^(?:[ⅠⅡⅢⅣⅤⅥ]|\d+[.)]|[가-힣][.)]|[□■○◦])'))) AS INTEGER) AS headings FROM t""")
def t18_t19_fields_and_items(spark, sf_dir):
    t = F.concat("text", F.lit("\n사업기간 : "), "source", F.lit(" 까지□ (과업 범위)\n1. head "), "lang", F.lit("\nⅠ 개요"))
    return table(spark, sf_dir, "documents").select("doc_id", C.field_after(t, "사업기간").alias("period"), C.field_after(t, "사업예산").alias("budget"), F.get(C.square_items(t), 0).alias("item"), F.size(C.heading_candidates(t)).cast("int").alias("headings"))


@register("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || ' | ' || o_orderstatus || chr(10) ELSE '' END || 'a b | ' AS text FROM orders""")
def t16_table_rows(spark, sf_dir):
    first = F.when(F.col("o_orderkey") % 2 == 0, F.array("o_orderpriority", "o_orderstatus")).otherwise(F.array(F.lit(" "), F.lit(None)))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.table_rows(F.array(first, F.array(F.lit("a\nb "), F.lit(None).cast("string")))).alias("text"))


@register("SELECT doc_id, nfc_normalize('e' || chr(769) || lang) AS composed, CAST(instr('가나', '나') AS INTEGER) AS found FROM documents")
def nfc_composition(spark, sf_dir):
    """Unicode composition, the one scalar that has no built-in function."""
    return table(spark, sf_dir, "documents").select("doc_id", C.composed(F.concat(F.lit("é"), "lang")).alias("composed"), F.instr(F.lit("가나"), F.lit("나")).cast("int").alias("found"))


@register("SELECT doc_id, CAST(len(regexp_extract_all(substr(text, 1, 5000), '[가-힣]')) AS DOUBLE) / length(substr(text, 1, 5000)) AS ratio, instr(text, 'the ') > 0 AS informed FROM (SELECT doc_id, '한글 ' || text AS text FROM documents)")
def f09_f17_text_checks(spark, sf_dir):
    """The head of 5,000 characters is the check's own."""
    t = F.concat(F.lit("한글 "), "text")
    return table(spark, sf_dir, "documents").select("doc_id", T.hangul_ratio(t).alias("ratio"), T.no_info(F.when(F.instr(t, "the ") > 0, "정보가 없").otherwise("")).alias("informed"))
