"""Scalar text functions as column expressions; Spark runs them in generated code, but for the counts of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import small_batches

#: Ends of sentences that keep a repeated line. Fixed values.
SENTENCE_ENDS = ("다.", "함", "음")
IMAGE_MARKS = r"<(?:표|그림)>"
TOC_LEADERS = r"[.·…‥]{4,}"


def squeeze(text: Column) -> Column:
    """All white space removed."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def single_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def blank_if_null_word(value: Column) -> Column:
    """Null and the words null, none and nan as the empty string."""
    return F.when(value.isNull() | F.lower(F.trim(value)).isin("null", "none", "nan"), "").otherwise(value)


def scrub_nan(value: Column) -> Column:
    return F.when(F.isnan(value), None).otherwise(value)


def split_doc_id(doc_id: Column) -> tuple[Column, Column]:
    """(notice number, revision): revision null where the tail is no number."""
    tail = F.regexp_extract(doc_id, r"^(.+)-([0-9]+)$", 2)
    return F.when(tail == "", doc_id).otherwise(F.regexp_extract(doc_id, r"^(.+)-([0-9]+)$", 1)), F.when(tail != "", tail.cast("int"))


def make_doc_id(notice_no: Column, seq: Column, file_name: Column) -> Column:
    """notice-seq; without seq the notice alone; without notice nofile- and a digest of the file's name."""
    return F.when(notice_no.isNull(), F.concat(F.lit("nofile-"), F.substring(F.sha1(file_name.cast("binary")), 1, 12))).when(seq.isNull(), notice_no).otherwise(F.concat(notice_no, F.lit("-"), seq.cast("int").cast("string")))


def tidy_doc_id(doc_id: Column) -> Column:
    return F.regexp_replace(doc_id, r"\.0$", "")


def chunk_id(doc_id: Column, order: Column) -> Column:
    return F.format_string("%s::%04d", doc_id, order)


def money(value: Column) -> Column:
    """Won as 억 and 만원; below 10,000 plain won; what is no number stays."""
    won = F.floor(value.try_cast("double"))
    high, low = F.floor(won / 100_000_000), F.floor(F.pmod(won, F.lit(100_000_000)) / 10_000)
    parts = F.concat_ws(" ", F.when(high > 0, F.concat(high.cast("string"), F.lit("억"))), F.when(low > 0, F.concat(F.format_number(low, 0), F.lit("만"))))
    return F.when(won.isNull(), value).when((high == 0) & (low == 0), F.concat(F.format_number(won, 0), F.lit("원"))).otherwise(F.concat(parts, F.lit("원")))


def contains_any(text: Column, words: Column) -> Column:
    """Whether any of the words occurs, white space aside; blank words never do."""
    return F.exists(words, lambda w: (F.length(squeeze(w)) > 0) & (F.instr(squeeze(text), squeeze(w)) > 0))


def tokens(text: Column) -> Column:
    """White-space tokens of more than one character: what is taken where no analyser of morphemes is there."""
    return F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 1)


def hangul_ratio(text: Column, sample: int = 5000) -> Column:
    head = F.substring(text, 1, sample)
    return F.when(F.length(head) > 0, F.regexp_count(head, F.lit("[가-힣]")) / F.length(head)).otherwise(0.0)


def leader_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[ƀ-ɏ]"))


def strip_toc_leaders(text: Column) -> Column:
    return F.regexp_replace(text, TOC_LEADERS, " ")


def page_refs(line: Column) -> Column:
    """Numbers of one to three digits at the end of a line or before more space: what a table of contents points to."""
    return F.regexp_count(line, F.lit(r"(?:^|\s)\d{1,3}(?=\s|$)"))


def toc_lines(text: Column, min_refs: int = 1, max_chars: int = 80, many_refs: int = 3) -> Column:
    """For each line whether it reads like a line of a table of contents."""
    return F.transform(F.split(text, "\n", -1), lambda x: x.rlike(TOC_LEADERS) | (page_refs(x) >= many_refs) | ((page_refs(x) >= min_refs) & (F.length(x) <= max_chars)))


def once(x: Column, f) -> Column:
    """f(x) where x is made once, however often f and the functions within it name it."""
    return F.get(F.transform(F.array(x), f), 0)


def word_counts(words: Column) -> Column:
    """Array of (term, n): each distinct word of an array and how often it is there. Words of a batch are numbered, so that rows are counted at once."""
    small_batches()

    @F.arrow_udf("array<struct<term: string, n: int>>")
    def run(rows: pa.Array) -> pa.Array:
        found = rows.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(rows)), pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False))
        n = max(1, len(found.dictionary))
        pair, count = np.unique(row * n + found.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
        ends = np.searchsorted(pair, np.arange(len(rows) + 1) * n)
        entries = pa.StructArray.from_arrays([found.dictionary.take(pa.array(pair % n)).cast(pa.string()), pa.array(count.astype(np.int32))], names=["term", "n"])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), entries)

    return run(words)


def drop_repeated_lines(text: Column, min_repeat: int = 5, max_len: int = 60) -> Column:
    """Lines of at most max_len characters that occur min_repeat times in the text go, unless they end a sentence. Equal lines meet by sorting."""
    ends = lambda x: F.endswith(x, F.lit(SENTENCE_ENDS[0])) | F.endswith(x, F.lit(SENTENCE_ENDS[1])) | F.endswith(x, F.lit(SENTENCE_ENDS[2]))

    def kept(lines: Column) -> Column:
        short = F.filter(F.transform(lines, F.trim), lambda x: (F.length(x) > 0) & (F.length(x) <= max_len))

        def cut(ordered: Column) -> Column:
            later = F.slice(ordered, min_repeat, F.greatest(F.size(ordered), F.lit(1)))
            repeated = F.array_distinct(F.filter(F.zip_with(ordered, later, lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull()))
            return once(repeated, lambda r: F.array_join(F.filter(lines, lambda x: ~(F.array_contains(r, F.trim(x)) & ~ends(F.trim(x)))), "\n"))

        return once(F.array_sort(short), cut)

    return once(F.split(text, "\n", -1), kept)


def tidy_whitespace(text: Column) -> Column:
    """Runs of blanks to one, lines of a page number or a rule emptied, three line ends or more to two."""
    out = F.regexp_replace(text, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"(?m)^ ?-? ?\d{1,4} ?-? ?$", "")
    out = F.regexp_replace(out, r"(?m)^[ \-=_]{3,}$", "")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def remove_marks(text: Column) -> Column:
    """Placeholders of tables and pictures, empty parentheses and control characters removed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, IMAGE_MARKS, ""), r"\(\s*\)", ""), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def preview(text: Column, query: Column, width: int = 220) -> Column:
    """The query's longest word that occurs, with a third of the width before it; the text's beginning where none does."""
    words = F.array_sort(F.filter(F.split(query, r"\s+"), lambda w: F.length(w) >= 2), lambda a, b: F.length(b) - F.length(a))
    found = F.get(F.filter(words, lambda w: F.instr(text, w) > 0), 0)
    start = F.greatest(F.instr(text, F.coalesce(found, F.lit(""))) - F.lit(width // 3), F.lit(1))
    return F.when(found.isNull(), F.substring(text, 1, width)).otherwise(F.substr(text, start, F.lit(width)))


def no_info(answer: Column) -> Column:
    """Whether an answer says that the documents do not tell. The phrasings are fixed values."""
    return answer.rlike(r"확인되지\s*않|찾을\s*수\s*없|명시되어\s*있지\s*않|정보가\s*없")


def cite_marks(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("int"))


def numbers(text: Column) -> Column:
    """Distinct numbers of two characters or more, commas removed."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\d[\d,]*"), 0), lambda x: F.regexp_replace(x, ",", "")), lambda x: F.length(x) > 1))


def cite_rate(answer: Column) -> Column:
    """Share of lines of over 15 characters that carry a citation; 0 without such lines."""
    long = F.filter(F.split(answer, "\n", -1), lambda x: F.length(F.trim(x)) > 15)
    return F.when(F.size(long) > 0, F.size(F.filter(long, lambda x: x.rlike(r"\[\d+\]"))) / F.size(long)).otherwise(0.0)


def number_match(answer: Column, keywords: Column) -> Column:
    """Share of the keywords' numbers that the answer has, commas aside; without numbers whether any keyword is in it."""
    found = lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"[\d,]+"), 0), lambda n: F.regexp_replace(n, ",", ""))
    gold = F.array_distinct(found(F.array_join(keywords, "\n")))
    return F.when(F.size(gold) > 0, F.size(F.array_intersect(gold, found(answer))) / F.size(gold)).otherwise(contains_any(answer, keywords).cast("double"))


#: Units of amounts in won. Fixed values.
UNITS = {"원": 1, "천원": 1_000, "백만원": 1_000_000, "억원": 100_000_000}
AMOUNT = r"(\d[\d,]{2,})\s*(원|천원|백만원|억원)"


def amounts(text: Column) -> Column:
    """Distinct amounts of the text in won, ascending."""
    scale = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    number, unit = F.regexp_extract_all(text, F.lit(AMOUNT), 1), F.regexp_extract_all(text, F.lit(AMOUNT), 2)
    return F.array_sort(F.array_distinct(F.zip_with(number, unit, lambda n, u: F.regexp_replace(n, ",", "").cast("long") * F.element_at(scale, u))))


def amount_verdict(text: Column, stated: Column) -> Column:
    """How a text's amounts meet the stated one: no stated, bad stated, none, match or mismatch."""
    value, found = F.floor(stated.try_cast("double")), amounts(text)
    return F.when(stated.isNull() | (F.trim(stated) == ""), "no stated").when(value.isNull(), "bad stated").when(F.size(found) == 0, "none").when(F.array_contains(found, value), "match").otherwise("mismatch")


#: Words that make a question one of requirements or of scoring. Fixed values.
ABOUT_REQUIREMENTS = r"[A-Z]{2,4}-\d{2,4}|요구사항|기능|규격|명칭|기능명|SFR|과업|내역|항목"
ABOUT_SCORES = r"배점|점수|정성|정량|평가|몇\s*점|비율|가산점|가점|한도|기준|%"


def question_type(question: Column, answer: Column) -> Column:
    return F.when(question.rlike(ABOUT_REQUIREMENTS), "요구사항").when(question.rlike(ABOUT_SCORES) | F.concat_ws(" ", question, answer).rlike(r"\d+점|\d+%"), "배점").otherwise("의역")


def file_key(name: Column) -> Column:
    """A file's name, composed (NFC), without its extension hwp, hwpx or pdf, whatever the case, and without white space around it."""
    from .cleaning import composed

    return F.trim(F.regexp_replace(F.trim(composed(name)), r"(?i)\.(hwpx?|pdf)$", ""))


#: Levels of headings, the first that fits. Fixed values.
HEADINGS = (
    (1, r"^\s*([ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+)\s*[.．]\s*(.{1,40})$"),
    (1, r"^\s*(제\s*\d+\s*[장절])\s*[.．]?\s*(.{0,40})$"),
    (2, r"^\s*(\d{1,2})\s*[.．]\s*(.{1,40})$"),
    (3, r"^\s*([□■◇◆])\s*(.{1,50})$"),
)


def heading_level(line: Column, patterns=HEADINGS) -> Column:
    """Level of a heading line, null for others."""
    return F.coalesce(*[F.when(F.trim(line).rlike(p), level) for level, p in patterns])


def header_counts(text: Column, classes: dict[str, str]) -> Column:
    """Map of class to the number of lines whose first fitting class it is."""
    kind = lambda x: F.coalesce(*[F.when(x.rlike(p), name) for name, p in classes.items()], F.lit(""))
    kinds = F.transform(F.split(text, "\n", -1), kind)
    count = lambda name: F.size(F.filter(kinds, lambda x: x == F.lit(name)))
    return F.map_from_arrays(F.array(*map(F.lit, classes)), F.array(*map(count, classes)))
