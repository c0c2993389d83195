"""Answers of language models: making them once each, judging them, and what can be measured without a model."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cite_marks, no_info, squeeze

#: What may stand before an answer that was cut from a document: bullets, a number, a label. Fixed value.
GOLD_PREFIX = r"^[\s\-•*○◦□ㅁ]*(?:[가-힣0-9]{1,2}[.)]\s*)?(?:[^:\n]{1,14}\s*:\s*)?"
MOST_CONTEXT = 6000
Model = Callable[[list[str]], list[str]]


def gold_in(answer: Column, keywords: Column) -> Column:
    """1 where a keyword, without what stands before it and without white space, is in the answer, else 0; null without keywords."""
    bare = F.transform(F.filter(keywords, lambda k: F.coalesce(k, F.lit("")) != ""), lambda k: squeeze(F.regexp_replace(k, GOLD_PREFIX, "")))
    found = F.exists(bare, lambda k: (k != "") & F.contains(squeeze(answer), k))
    return F.when(F.size(keywords) > 0, F.when(found, 1.0).otherwise(0.0))


def _plain_numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"[\d,]+"), 0), lambda n: F.regexp_replace(n, ",", ""))


def measures(answer: Column, context: Column, keywords: Column) -> dict[str, Column]:
    """cited: any citation; precise: share of citations that the context has; grounded: share of the answer's numbers of two characters or more, citations
    aside, that the context has; refused: says that it does not know, and cites nothing; gold: `gold_in`. Null where there is nothing to measure."""
    answer, context = F.coalesce(answer, F.lit("")), F.coalesce(context, F.lit(""))
    used, given = cite_marks(answer), cite_marks(context)
    told = F.filter(F.regexp_extract_all(answer, F.lit(r"[\d,]+"), 0), lambda n: F.length(n) > 1)
    numbers = F.array_except(F.array_distinct(F.transform(told, lambda n: F.regexp_replace(n, ",", ""))), F.transform(used, lambda n: n.cast("string")))
    return {
        "cited": F.when(F.size(used) > 0, 1.0).otherwise(0.0),
        "precise": F.when(F.size(used) > 0, F.size(F.filter(used, lambda n: F.array_contains(given, n))) / F.size(used)),
        "grounded": F.when(F.size(numbers) > 0, F.size(F.array_intersect(numbers, _plain_numbers(context))) / F.size(numbers)),
        "refused": F.when(no_info(answer) & (F.size(used) == 0), 1.0).otherwise(0.0),
        "gold": gold_in(answer, keywords),
    }


NAMES = ("cited", "precise", "grounded", "refused", "gold")


def scored(rows: DataFrame) -> DataFrame:
    """rows(qid, kind, answer, context, keywords) with their measures."""
    return rows.withColumns(measures(F.col("answer"), F.col("context"), F.col("keywords")))


def by_kind(rows: DataFrame, *names: str) -> DataFrame:
    """kind, questions and the mean of each measure by kind and over all (전체); what is null does not count."""
    means = [F.round(F.avg(n), 3).alias(n) for n in names or NAMES]
    return rows.rollup("kind").agg(F.grouping("kind").alias("total"), F.count("*").alias("questions"), *means).withColumn("kind", F.when(F.col("total") == 1, "전체").otherwise(F.coalesce("kind", F.lit("?")))).drop("total")


def judged(question: Column, context: Column, answer: Column, model: Model | None = None) -> Column:
    """Whether a model finds the answer in the context: true if it says YES, else false if it says NO, else null. The stand-in repeats the answer's last line."""
    from ..functions.models import ask

    prompt = F.concat(F.lit("답변의 내용이 모두 문서에 있으면 YES, 아니면 NO 한 낱말만 쓰시오.\n[문서]\n"), context, F.lit("\n\n[질문]\n"), question, F.lit("\n\n[답변]\n"), answer)
    verdict = F.upper(F.trim(ask(prompt, model)))
    return F.when(F.contains(verdict, F.lit("YES")), True).when(F.contains(verdict, F.lit("NO")), False)


def generated(rows: DataFrame, model: Model | None = None, most: int = MOST_CONTEXT) -> DataFrame:
    """rows(qid, question, context, ...) with answer, ok and error: a call that fails is told in its row and stops no other. Contexts are cut at `most`
    characters, which is what the model takes."""
    asked = model or (lambda prompts: [p.strip().rpartition("\n")[2] for p in prompts])

    @F.pandas_udf("answer string, ok boolean, error string")
    def run(prompts: pd.Series) -> pd.DataFrame:
        out = []
        for p in prompts:
            try:
                out.append((asked([p])[0], True, None))
            except Exception as e:  # one call must not end the batch
                out.append((None, False, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["answer", "ok", "error"])

    prompt = F.concat_ws("\n", F.substring(F.coalesce("context", F.lit("")), 1, most), "question")
    return rows.withColumn("made", run(prompt)).select(*rows.columns, "made.*")


def resumed(rows: DataFrame, done: DataFrame, model: Model | None = None) -> DataFrame:
    """Answers of the rows whose qid is not among those done."""
    return generated(rows.join(done.select("qid"), "qid", "left_anti"), model)


def run_check(rows: DataFrame) -> DataFrame:
    """rows, empty (contexts without text), new_headers (whose first line tells closing date, amount or budget) of a run's contexts."""
    head = F.substring_index("context", "\n", 1)
    return rows.agg(F.count("*").alias("rows"), F.count_if(F.trim(F.coalesce("context", F.lit(""))) == "").alias("empty"), F.count_if(head.rlike("마감|금액|예산")).alias("new_headers"))


def compared_setups(scores: DataFrame, a: str, b: str) -> DataFrame:
    """wins, ties, losses of run a against run b over cells (setup, kind, mrr, run), and the mean of each weighted by questions, and whether one wins at
    least four fifths of the cells that differ. scores(run, setup, kind, mrr, questions)."""
    cells = scores.groupBy("setup", "kind").pivot("run", [a, b]).agg(F.first("mrr")).join(scores.filter(F.col("run") == a).select("setup", "kind", "questions"), ["setup", "kind"])
    x, y, w = F.col(a), F.col(b), F.col("questions")
    wins, losses = F.count_if(x > y), F.count_if(x < y)
    return cells.filter(x.isNotNull() & y.isNotNull()).agg(
        wins.alias("wins"), F.count_if(x == y).alias("ties"), losses.alias("losses"), F.round(F.sum(x * w) / F.sum(w), 3).alias("mean_a"), F.round(F.sum(y * w) / F.sum(w), 3).alias("mean_b"),
        F.when(wins >= 0.8 * (wins + losses), "a").when(losses >= 0.8 * (wins + losses), "b").otherwise("neither").alias("verdict"),
    )
