"""Evaluation sets: questions taken from documents by pattern, evidence found again in documents, and what is made of foreign sets."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import question_type, squeeze
from ..sources.tables import numbered
from .grounding import best_spans, grounded

# Patterns and questions by kind. Fixed values.
REQUIREMENT = r"요\s*구\s*사\s*항\s*고\s*유\s*번\s*호[\s\n]*([A-Z]{2,4}-\d{2,4})[\s\n]+(?:요\s*구\s*사\s*항\s*분\s*류[\s\n]*[^\n]{2,20}[\s\n]+)?요\s*구\s*사\s*항\s*명\s*칭[\s\n]*([^\n]{3,40})"
SCORE = r"([가-힣][가-힣A-Za-z ]{3,20}?)\s*(?:[(（]|[:：]\s*)\s*(\d{1,3})\s*점"
SCORE_SKIP = ("총", "합", "만", "이상", "미만", "를", "을", "이", "가", "의", "에", "로", "와", "과", "은", "는", "및", "또", "해", "여")
LINE, MONEY = r"[^\n]{4,60}", r"[\d,]+\s*(?:천원|백만원|억원|원)"
FIELD = r"[□■○◦oㅇ*\-\s]*%s\s*[:：]\s*(%s)"
PARAPHRASES = (
    (r"과\s*업\s*기\s*간", "「{title}」 사업은 며칠 안에 끝내야 하나?", LINE),
    (r"계\s*약\s*기\s*간", "「{title}」 사업은 얼마 동안 하나?", LINE),
    (r"사\s*업\s*(?:규모|예산|금액)", "「{title}」 사업에 돈이 얼마나 드나?", MONEY),
    (r"배\s*정\s*예\s*산", "「{title}」 사업에 쓸 수 있는 돈은?", MONEY),
    (r"계\s*약\s*(?:방법|방식)", "「{title}」 사업은 업체를 어떻게 고르나?", LINE),
    (r"낙\s*찰\s*방\s*식", "「{title}」 사업은 누가 따내나?", LINE),
    (r"입\s*찰\s*참\s*가\s*자\s*격", "「{title}」 사업에 아무나 들어갈 수 있나?", LINE),
)
UNANSWERABLE = (
    "「{title}」 사업의 작년 낙찰 업체는 어디인가?",
    "「{title}」 사업 담당자의 휴대폰 번호는?",
    "「{title}」 사업에 몇 개 업체가 입찰했나?",
    "「{title}」 사업의 실제 계약 체결일은 언제인가?",
    "「{title}」 사업을 수주한 업체의 매출액은?",
)


def _asked(template: str) -> Column:
    return F.replace(F.lit(template), F.lit("{title}"), F.substring("title", 1, 40))


def hard_pairs(docs: DataFrame, per_kind: int = 40, per_doc: int = 1) -> DataFrame:
    """kind, doc_id, question, keywords, answerable from docs(doc_id, title, text) in the order of their ids: requirements by their number, items of a score,
    fields asked in other words, and questions that no document answers (of documents spread evenly). At most per_doc of a kind of a document and
    per_kind (a third of it for the last kind) in all."""
    numbers, names = F.regexp_extract_all("text", F.lit(REQUIREMENT), 1), F.transform(F.regexp_extract_all("text", F.lit(REQUIREMENT), 2), F.trim)
    requirement = F.transform(F.slice(F.arrays_zip(numbers.alias("id"), names.alias("name")), 1, per_doc), lambda x: F.struct(F.concat(_asked("「{title}」의 "), x["id"], F.lit(" 요구사항 명칭은 무엇인가?")).alias("question"), x["name"].alias("answer")))
    whole, items = F.regexp_extract_all("text", F.lit(SCORE), 0), F.regexp_extract_all("text", F.lit(SCORE), 1)
    usable = lambda x: (F.length(F.trim(x["item"])) >= 4) & ~F.trim(x["item"]).rlike("^(?:" + "|".join(SCORE_SKIP) + ")")
    score = F.transform(F.slice(F.filter(F.arrays_zip(items.alias("item"), whole.alias("whole")), usable), 1, per_doc), lambda x: F.struct(F.concat(_asked("「{title}」 평가에서 '"), F.trim(x["item"]), F.lit("' 의 배점은 몇 점인가?")).alias("question"), F.trim(F.regexp_replace(x["whole"], r"\s+", " ")).alias("answer")))
    found = [F.struct(_asked(q).alias("question"), F.regexp_replace(F.trim(F.regexp_extract("text", FIELD % (key, value), 1)), r"[.,]+$", "").alias("answer")) for key, q, value in PARAPHRASES]
    paraphrase = F.slice(F.filter(F.array(*found), lambda x: F.length(x["answer"]) >= 3), 1, per_doc)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("at"), v.alias("made")) for n, (k, v) in enumerate((("요구사항", requirement), ("배점", score), ("의역", paraphrase)))])
    each = docs.select("doc_id", F.explode(kinds).alias("k")).select("doc_id", "k.kind", F.posexplode("k.made").alias("n", "x")).filter(F.length("x.answer") >= 3)
    order = Window.partitionBy("kind").orderBy("doc_id", "n")
    made = each.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_kind).select("kind", "doc_id", F.col("x.question").alias("question"), F.array("x.answer").alias("keywords"), F.lit(True).alias("answerable"))
    # Ids and titles alone are numbered over all documents; texts stay where they are.
    listed = numbered(docs.select("doc_id", "title"), "i", "doc_id")
    step = max(listed.count() // (3 * len(UNANSWERABLE)), 1)
    spread = listed.filter((F.col("i") % step == 0) & (F.col("i") / step < per_kind // 3)).withColumn("k", (F.col("i") / step).cast("int") % len(UNANSWERABLE))
    question = F.element_at(F.array(*map(_asked, UNANSWERABLE)), F.col("k") + 1)
    none = spread.select(F.lit("없음").alias("kind"), "doc_id", question.alias("question"), F.array().cast("array<string>").alias("keywords"), F.lit(False).alias("answerable"))
    return made.unionByName(none)


# Evidence


def spans(pairs: DataFrame, docs: DataFrame, least: int = 20) -> DataFrame:
    """item_id, span of pairs(item_id, doc_id, evidence, answer) in their own document of docs(doc_id, text); empty where nothing is shared."""
    return pairs.select("item_id").join(best_spans(pairs, docs, least), "item_id", "left").select("item_id", F.coalesce("span", F.lit("")).alias("span"))


def routed(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, question, doc_id, keywords, kind, answerable, defect (null: kept) of candidates(item_id, question, answer, doc_id, evidence, unanswerable) in
    the order of their ids: questions that are equal without white space count once, unanswerable ones pass, evidence must be found in the own document alone."""
    flat = squeeze(F.col("question"))
    first = F.row_number().over(Window.partitionBy("flat").orderBy("item_id"))
    marked = candidates.withColumn("flat", flat).withColumn("again", (first > 1) & (F.col("flat") != ""))
    state = F.when(F.col("again"), "중복질문").when(F.col("unanswerable"), "passes").when(F.trim(F.coalesce("evidence", F.lit(""))) == "", "빈키워드").otherwise("asks")
    marked = marked.withColumn("state", state)
    found = grounded(marked.filter("state = 'asks'").select("item_id", "doc_id", "evidence"), docs)
    out = marked.join(found, "item_id", "left")
    kept = F.col("state") == "passes"
    return out.select(
        "item_id", "question", "doc_id", F.when(kept, F.array().cast("array<string>")).otherwise(F.array(F.coalesce("keyword", F.lit("")))).alias("keywords"), F.when(kept, "없음").otherwise(question_type(F.col("question"), F.col("answer"))).alias("kind"), (~kept).alias("answerable"),
        F.when(F.col("state").isin("중복질문", "빈키워드"), F.col("state")).otherwise(F.col("defect")).alias("defect"),
    )


def handed_off(kept: DataFrame, rejected: DataFrame) -> DataFrame:
    """question, doc_id, kind, keywords, answerable: what is kept can be answered; what was rejected as 코퍼스에없음 cannot, and has no keywords."""
    base = kept.select("question", "doc_id", "kind", "keywords", F.lit(True).alias("answerable"))
    return base.unionByName(rejected.filter("defect = '코퍼스에없음'").select("question", "doc_id", "kind", F.array().cast("array<string>").alias("keywords"), F.lit(False).alias("answerable")))


def contexts_from_evidence(pairs: DataFrame, excerpts: int = 3, seed: int = 0) -> DataFrame:
    """item_id, context, gold_at, n_chunks: each question's evidence among excerpts - 1 of others, numbered in a shuffled order. Others and order are chosen by a
    hash of seed and ids. Evidence is spread over a ring by that hash and each takes its successors, so no question meets all others."""
    h = lambda *c: F.xxhash64(F.lit(seed), *c)
    told = pairs.filter(F.trim(F.coalesce("evidence", F.lit(""))) != "").select("item_id", F.trim("evidence").alias("evidence"))
    distinct = told.groupBy("evidence").agg(F.min("item_id").alias("item_id"))
    ring = numbered(distinct.withColumn("__hash", h("item_id")), "place", "__hash", "item_id").drop("__hash")
    placed = told.join(ring.select("evidence", "place"), "evidence").withColumn("n", F.lit(ring.count()))
    wanted = placed.select("item_id", "evidence", F.explode(F.sequence(F.lit(0), F.least(F.lit(excerpts), F.col("n").cast("int")) - 1)).alias("k"), ((F.col("place") + F.col("k")) % F.col("n")).alias("at"))
    each = wanted.join(ring.select(F.col("place").alias("at"), F.col("evidence").alias("text")), "at")
    order = F.row_number().over(Window.partitionBy("item_id").orderBy(h("item_id", "text")))
    rows = each.withColumn("n", order).withColumn("block", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("]\n"), "text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n\n---\n\n")
    return rows.groupBy("item_id").agg(joined.alias("context"), F.min(F.when(F.col("text") == F.col("evidence"), F.col("n"))).alias("gold_at"), F.count("*").alias("n_chunks"))


def corpus_bodies(chunks: DataFrame) -> DataFrame:
    """doc_id, text: a document's chunks in order."""
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "text"))), lambda x: x["text"]), "").alias("text"))


def adapted(foreign: DataFrame, known: DataFrame, bodies: DataFrame, least: int = 20) -> DataFrame:
    """item_id, doc_id, keyword, reason of foreign(item_id, name, evidence, answer, ready): names resolved to documents, evidence found in their
    bodies; rows that are ready keep their keyword (evidence) and only change their name for an id."""
    from .mining import resolved

    ids = resolved(foreign.select("name"), known)
    met = foreign.join(ids, "name", "left")
    found = spans(met.filter(~F.col("ready") & F.col("doc_id").isNotNull()).select("item_id", "doc_id", "evidence", "answer"), bodies, least)
    return met.join(found, "item_id", "left").select("item_id", "doc_id", F.when(F.col("ready"), F.col("evidence")).otherwise(F.coalesce("span", F.lit(""))).alias("keyword"), "reason")


# Candidates by a model


def parsed(answers: Column) -> Column:
    """Rows (question, answer, evidence) of the JSON array in a model's answer, fenced or bare; null where there is none that can be read."""
    inner = F.coalesce(F.nullif(F.regexp_extract(answers, r"```(?:json)?\s*([\s\S]*?)```", 1), F.lit("")), F.regexp_extract(answers, r"(\[[\s\S]*\])", 1))
    return F.from_json(inner, "array<struct<question:string,answer:string,evidence:string>>")


def proposed(windows: DataFrame, model, per_window: int = 2) -> DataFrame:
    """item_id, question, answer, doc_id, evidence of windows(chunk_id, doc_id, text): what a model asks of each. Answers that cannot be read give no rows."""
    from ..functions.models import ask

    prompt = F.concat(F.lit(f'다음 글에서 질문과 답과 근거를 {per_window}개 만들어 [{{"question": "", "answer": "", "evidence": ""}}] 로만 쓰시오.\n'), "text")
    rows = windows.select("chunk_id", "doc_id", F.posexplode(F.slice(parsed(ask(prompt, model)), 1, per_window)).alias("n", "x"))
    return rows.select(F.concat_ws("#", F.col("chunk_id").cast("string"), F.col("n").cast("string")).alias("item_id"), "x.question", "x.answer", "doc_id", "x.evidence")


def stamp(pairs: DataFrame, signature: str, kept: int, dropped: int) -> str:
    """What is written beside an evaluation set: the signature of the chunks that it was made from, and counts."""
    return json.dumps({"chunks": signature, "kept": kept, "dropped": dropped, "columns": pairs.columns}, sort_keys=True)


def ensured(spark, folder: str, name: str, corpus: str, chunks: DataFrame, build) -> bool:
    """Makes an evaluation set anew if its chunks have changed, and tells whether it did. The set's stamp beside it, name.meta.json, has the signatures of the chunks that it was made
    of by the names of their corpora: a set without a stamp is not managed and stays, and so does one that was made of several corpora of which this is one, unchanged.
    build(chunks) gives the pairs, which are written as lines to the folder name.jsonl, and then the stamp: a crash between leaves the old stamp, so the set is made again."""
    from ..sources.store import signature_of

    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{folder}/{name}.meta.json")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return False
    was = json.loads(spark.read.text(path.toString(), wholetext=True).first().value).get("chunks") or {}
    now = signature_of(chunks)
    if was.get(corpus) == now:
        return False
    pairs = build(chunks)
    pairs.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{name}.jsonl")
    out = fs.create(path, True)
    out.write(bytearray(json.dumps({"chunks": {corpus: now}, "columns": pairs.columns}, sort_keys=True).encode()))
    out.close()
    return True


def is_current(stamped: str | None, signature: str) -> bool:
    """Whether a set need not be made anew: one without a stamp is not managed and stays."""
    return stamped is None or json.loads(stamped).get("chunks") == signature


def normalized(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """Rows of a foreign set in our fields: kind from type or question_type, keywords or else the evidence, answerable false where the kind is 없음, and doc_id found by
    file name where it is none of the corpus(doc_id, file_name). match: matched, converted or unknown; null without a doc_id."""
    from ..functions.text import file_key

    column = lambda *names: F.coalesce(*[F.col(n) for n in names if n in rows.columns], F.lit(None).cast("string"))
    kind = column("type", "question_type")
    evidence = F.when(column("evidence_text") != "", F.array(column("evidence_text")))
    keywords = F.coalesce(F.col("keywords"), evidence) if "keywords" in rows.columns else evidence
    answerable = F.coalesce(F.col("answerable"), kind != "없음", F.lit(True)) if "answerable" in rows.columns else F.coalesce(kind != "없음", F.lit(True))
    known = corpus.select(F.col("doc_id").alias("own")).distinct()
    by_name = corpus.filter(F.col("file_name") != "").groupBy(file_key(F.col("file_name")).alias("key")).agg(F.min("doc_id").alias("named"))
    met = rows.join(known, F.col("doc_id") == F.col("own"), "left").join(by_name, file_key(F.col("doc_id")) == F.col("key"), "left")
    state = F.when(F.coalesce("doc_id", F.lit("")) == "", None).when(F.col("own").isNotNull(), "matched").when(F.col("named").isNotNull(), "converted").otherwise("unknown")
    return met.select("question", F.coalesce("own", "named", "doc_id").alias("doc_id"), kind.alias("kind"), keywords.alias("keywords"), answerable.alias("answerable"), state.alias("match"))
