"""Clean-up by lines as column expressions: rendered tables to plain rows, tables of contents, labelled values; and cuts by meaning, diversity."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import LINE_END, strip

# Marks of rendered tables, tables of contents and labelled fields. Fixed values.
FAILED_TABLE = r"\[표 (?:복원 실패|부분 복원)[^\]]{0,200}\]"
TABLE_ROW = r"^\s*\|.*\|\s*$"
RULE_ROW = r"^\s*\|(\s*:?-{2,}:?\s*\|)+\s*$"
ROW_TAG = r"\[행 \d+\]\s*"
LABEL_COLON = r"(?<!\d):|:(?!\d)"
TOC_TITLE = r"(?i)^\s*[-–—<\[]*\s*(?:목\s*차|차\s*례|CONTENTS?)\s*[-–—>\]]*\s*$"
TOC_NUMBER = r"^\s*(?:[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩIVX]+\s*[.．]|제?\s*\d+\s*[장절]|\d{1,2}\s*[.．]|[가-하]\s*[.．]|\[?\s*별\s*첨\s*\]?)\s*\S"
TOC_NOT_ENDS = r"(?:다\.|함|음|임|됨|다)$"
ALIASES = {
    "사업기간": ["사업기간", "용역기간", "수행기간", "계약기간"],
    "참가자격": ["참가자격", "입찰참가자격"],
    "계약방식": ["계약방식", "계약방법"],
    "평가방식": ["평가방법", "평가기준"],
    "보안특약": ["보안특약"],
    "하자보수기간": ["하자보수"],
}
FIELD_MARKS, NEXT_CLAUSE = "□■○◦※", r"^(?:\d+\.|[가-힣]\.)\s"
LONGEST_VALUE = 200


def cells(row: Column) -> Column:
    """Cells between unescaped bars, escapes undone, line breaks as spaces."""
    inner = F.regexp_replace(F.regexp_replace(strip(row), r"^\|", ""), r"(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|", -1), lambda c: strip(F.replace(F.regexp_replace(c, r"\\([|-])", "$1"), F.lit("<br>"), F.lit(" "))))


def without_table_markup(text: Column) -> Column:
    """Tables with bars as one line of `header value` pairs for each row under the first, a lone header as its cells; row tags and the colons of their labels
    go, other line breaks become lines. Blocks are found from the places where they begin: no line is read with a state."""
    lines = F.split(F.regexp_replace(text, FAILED_TABLE, ""), "\n", -1)

    def row(x: Column, i: Column) -> Column:
        table = x.rlike(TABLE_ROW)
        filled = F.when(table & ~x.rlike(RULE_ROW), cells(x))
        return F.struct(x.alias("line"), table.alias("table"), F.when(F.exists(filled, lambda c: c != ""), filled).alias("cells"), i.alias("at"))

    rows = F.transform(lines, row)
    first = F.transform(F.filter(rows, lambda r: r["table"] & ~F.coalesce(F.get(rows, r["at"] - 1)["table"], F.lit(False))), lambda r: r["at"])
    full = F.transform(F.filter(rows, lambda r: r["cells"].isNotNull()), lambda r: r["at"])

    def made(r: Column, starts: Column, filled: Column, all_rows: Column) -> Column:
        begin = F.array_max(F.filter(starts, lambda s: s <= r["at"]))
        after = F.array_min(F.filter(starts, lambda s: s > r["at"]))
        own = F.filter(filled, lambda k: (k >= begin) & (after.isNull() | (k < after)))
        names = F.get(all_rows, F.get(own, 0))["cells"]
        pair = lambda v, i: F.when(v != "", F.concat_ws(" ", F.nullif(F.get(names, i), F.lit("")), v))
        pairs = F.array_join(F.filter(F.transform(r["cells"], pair), lambda v: v.isNotNull()), " ")
        lone = F.array_join(F.filter(r["cells"], lambda v: v != ""), " ")
        return F.when(r["cells"].isNotNull(), F.when(r["at"] != F.get(own, 0), pairs).when(F.size(own) == 1, lone))

    def other(x: Column) -> Column:
        untagged = F.regexp_replace(F.regexp_replace(x, ROW_TAG, ""), LABEL_COLON, "")
        return F.when(x.rlike(ROW_TAG), strip(F.regexp_replace(untagged, r"[ \t]{2,}", " "))).otherwise(F.replace(x, F.lit("<br>"), F.lit("\n")))

    # The arrays are made once, as fields of a struct in an array of one.
    bound = F.transform(F.array(F.struct(rows.alias("rows"), first.alias("starts"), full.alias("filled"))), lambda s: F.transform(s["rows"], lambda r: F.when(r["table"], made(r, s["starts"], s["filled"], s["rows"])).otherwise(other(r["line"]))))
    out = F.array_join(F.filter(F.get(bound, 0), lambda x: x.isNotNull()), "\n")
    return strip(F.regexp_replace(F.regexp_replace(out, r"(?m)^[ \t]*$", ""), r"\n{3,}", "\n\n"))


def is_entry(line: Column) -> Column:
    """Whether a line reads like an entry of a table of contents: short, numbered, no colon, no end of a sentence."""
    x = strip(line)
    return F.length(x).between(3, 60) & ~x.rlike("[:：]") & ~x.rlike(TOC_NOT_ENDS) & x.rlike(TOC_NUMBER)


def _with(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) where x is made once, however often f names it."""
    return F.get(F.transform(F.array(x), f), 0)


def toc_span(text: Column, least: int = 8, head: int = 8000, stray: int = 2) -> Column:
    """(first, last) line of the table of contents, which begins in the first `head` characters and ends where an entry comes again or more than
    `stray` other lines follow; null under `least` entries. The state is held over those characters alone."""
    upto = F.regexp_count(F.substring(text, 1, head), F.lit("\n")) + 1  # lines that begin in the head
    rows = F.transform(F.slice(F.split(text, "\n", -1), 1, upto), lambda x, i: F.struct(x.alias("line"), i.alias("at"), is_entry(x).alias("entry"), F.regexp_replace(x, r"(?U)\s+", "").alias("key")))
    empty = F.struct(F.array().cast("array<string>").alias("known"), F.lit(-1).alias("last"), F.lit(0).alias("missed"), F.lit(False).alias("done"))

    def step(s: Column, r: Column) -> Column:
        again = r["entry"] & F.array_contains(s["known"], r["key"])
        missed = F.when(r["entry"], 0).otherwise(s["missed"] + 1)
        stop = s["done"] | again | (missed > stray)
        took = ~stop & r["entry"]
        return F.struct(F.when(took, F.concat(s["known"], F.array(r["key"]))).otherwise(s["known"]).alias("known"), F.when(took, r["at"]).otherwise(s["last"]).alias("last"), missed.alias("missed"), stop.alias("done"))

    def span(lines: Column) -> Column:
        title = F.get(F.filter(lines, lambda r: r["line"].rlike(TOC_TITLE)), 0)["at"]
        first = F.get(F.filter(lines, lambda r: r["entry"]), 0)["at"]

        def scan(begun: Column) -> Column:
            begin = F.coalesce(begun["title"] + 1, begun["first"])
            end = F.aggregate(F.filter(lines, lambda r: (r["at"] >= begin) & (r["key"] != "")), empty, step)
            return _with(end, lambda e: F.when(F.size(e["known"]) >= least, F.struct(F.coalesce(begun["title"], begin).alias("first"), e["last"].alias("last"))))

        return _with(F.struct(title.alias("title"), first.alias("first")), lambda b: F.when(F.coalesce(b["title"], b["first"]).isNotNull(), scan(b)))

    return _with(rows, span)


def without_toc(text: Column) -> Column:
    cut = lambda s: F.when(s.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: (i < s["first"]) | (i > s["last"])), "\n"))
    return _with(toc_span(text), cut)


def _values(text: Column, alias: str) -> Column:
    """What stands after each occurrence of a label, those with a colon first; up to the next mark of a field, or LONGEST_VALUE characters without one."""
    label = rf"(?:[{FIELD_MARKS}]\s*\(\s*{alias}\s*\)|{alias})\s*([:：])?\s*(?=([^{FIELD_MARKS}]*)([{FIELD_MARKS}]?))"
    group = lambda n: F.regexp_extract_all(text, F.lit(label), n)
    found = F.arrays_zip(group(1).alias("colon"), group(2).alias("tail"), group(3).alias("mark"))
    ordered = lambda rows: F.concat(F.filter(rows, lambda x: x["colon"] != ""), F.filter(rows, lambda x: x["colon"] == ""))
    more = lambda y: (y != "") & ~y.rlike(NEXT_CLAUSE)

    def told(lines: Column) -> Column:
        one, two, three = (F.coalesce(F.get(lines, i), F.lit("")) for i in range(3))
        whole = F.when(one == "", "").when(~more(two), one).when(~more(three), F.concat_ws(" ", one, two)).otherwise(F.concat_ws(" ", one, two, three))
        return F.regexp_replace(whole, r"^[ :：\t]+|[ :：\t]+$", "")

    def value(x: Column) -> Column:
        cut = F.when(x["mark"] == "", F.substring(x["tail"], 1, LONGEST_VALUE)).otherwise(x["tail"])
        return _with(F.transform(F.slice(F.split(cut, LINE_END, 4), 1, 3), strip), told)

    return F.when(F.contains(text, F.lit(alias)), F.get(F.filter(F.transform(_with(found, ordered), value), lambda v: v != ""), 0))


def labelled_values(text: Column, aliases: dict[str, list[str]] = ALIASES) -> Column:
    """Map of each field to its value, null where none is found: the first alias that has one, of three lines at most, up to a blank or numbered one."""
    values = [F.coalesce(*[_values(text, a) for a in names]) for names in aliases.values()]
    return F.map_from_arrays(F.array(*map(F.lit, aliases)), F.array(*values))


def split_by_meaning(text: str, embed: Callable[[list[str]], list[np.ndarray]], percentile: float = 95) -> list[str]:
    """Sentences joined until the distance to the next one exceeds the percentile of all distances of the text."""
    sentences = [s for s in re.split(r"(?<=[.?!])\s+", text.strip()) if s]
    if len(sentences) < 3:
        return [" ".join(sentences)] if sentences else []
    v = np.array(embed(sentences), dtype=np.float64)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    gap = 1 - (v[1:] * v[:-1]).sum(axis=1)
    cuts = np.nonzero(gap > np.percentile(gap, percentile))[0] + 1
    return [" ".join(sentences[a:b]) for a, b in zip([0, *cuts], [*cuts, len(sentences)])]


def diverse(candidates: DataFrame, k: int = 5, weight: float = 0.5) -> DataFrame:
    """Maximal marginal relevance over the candidates of each query (query_id, chunk_id, v, q): the k that are near the query and far from what
    was taken before. A query has few candidates (the pool it was searched with), so each is one group."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk_id")
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
        v, q = unit(np.stack(rows["v"]).astype(np.float64)), unit(np.asarray(rows["q"].iloc[0], dtype=np.float64))
        near, worst, taken = v @ q, np.zeros(len(v)), []
        for _ in range(min(k, len(v))):
            score = weight * near - (1 - weight) * worst
            score[taken] = -np.inf
            best = int(np.argmax(score))
            worst = v @ v[best] if not taken else np.maximum(worst, v @ v[best])
            taken.append(best)
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "chunk_id": rows["chunk_id"].to_numpy()[taken], "rank": range(1, len(taken) + 1)})

    schema = f"query_id {candidates.schema['query_id'].dataType.simpleString()}, chunk_id {candidates.schema['chunk_id'].dataType.simpleString()}, rank long"
    return candidates.groupBy("query_id").applyInPandas(pick, schema)
