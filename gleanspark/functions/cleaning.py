"""Clean-up of extracted texts as column expressions; only Unicode composition needs a vectorised Python function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import small_batches
from .text import drop_repeated_lines, leader_count, once

# Fixed values of the clean-up of rendered documents.
PAGE_LINE = r"^\s*-\s*\d+\s*-\s*$"
TAG_RESIDUE = "<(표|그림)>"
PLACEHOLDER = "[ㅇ○△]{2,}"
EMPTY_PAREN = r"\(\s*\)"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
FOREIGN = "一-鿿㐀-䶿Ā-ɏͰ-Ͽ"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
CATEGORY_HEADERS = (
    "□ 플랫폼 및 기반구조 분야",
    "□ 요소기술 분야",
    "□ 인터페이스 및 통합 분야",
    "□ 법률 및 고시",
    "□ 서비스 접근 및 전달 분야",
)
BOILERPLATE = (
    "보안 위약금 부과 기준",
    "사업자 보안위규 처리기준",
    "2. 보안 위약금은 다른 요인에 의해 상쇄, 삭감이 되지 않도록 부과",
    "(단위 : 천원)",
    "1. 위규 수준별로 A~D 등급으로 차등 부과",
    "누출금지 대상정보",
    "일반현황 및 연혁",
    "20 년 월 일",
    "1. 개인정보의 처리 현황",
    "제 안 요 청 서",
    "2. 계약금액 :",
    "3. 개인정보 접근 또는 접속 대상자",
    "2. 주사무소소재지 :",
    "3. 대 표 자 성 명 :",
    "1. 계약건명 :",
    "1. 발주기관과의 계약내용 변경에 따라 계약금액이 증감되었을 경우",
    "* 보안사고는 1회의 사고만으로도 그 파급력이 큰 것을 감안하여 타 항목과 별도 부과",
    "대 표 자 : (인)",
    "1. 발주자 및 구성원 전원이 동의하는 경우",
    "3. 발주자명 :",
    "2. 개인정보의 접근 또는 접속현황",
    "②이 협정서에 규정되지 아니한 사항은 운영위원회에서 정한다.",
    "공동수급체 구성원",
    "6. 국가용 보안시스템 및 정보보호시스템 도입 현황",
    "20 . . .",
    "1. 제안서의 효력",
    "공동수급체 대표자",
    "2. 세부 정보시스템 구성현황 및 정보통신망 구성도",
    "제2조(공동수급체) 공동수급체의 명칭, 사업소의 소재지, 대표자는 다음과 같다.",
    "제3조(공동수급체의 구성원) ①공동수급체의 구성원은 다음과 같다.",
    "2024년 월 일",
    "1. ㅇㅇㅇ회사(공동수급체대표자) : ㅇㅇ은행, 계좌번호 ㅇㅇㅇ, 예금주 ㅇㅇㅇ",
    "위와 같이 공동수급협정을 체결하고 그 증거로서 협정서 ㅇ통을 작성하여 각 통에 공동수급체 구성원이 기명날인하여 각자 보관한다.",
    "2. ㅇㅇㅇ회사 : ㅇㅇ은행, 계좌번호 ㅇㅇㅇ, 예금주 ㅇㅇㅇ",
    "1. 명 칭 : ㅇㅇㅇ",
    "제7조(하도급) 공동수급체 구성원 중 일부 구성원이 단독으로 하도급계약을 체결하고자 하는 경우에는 다른 구성원의 동의를 받아야 한다.",
    "3. 사용자계정ㆍ비밀번호 등 정보시스템 접근권한 정보",
    "주사무소 소재지",
    "4. 정보통신망 취약점 분석·평가 결과물",
    "2. 추진배경 및 필요성",
    "* 등급별 평점이 소수점 이하의 숫자가 있는 경우 소수점 다섯째자리에서 반올림 함",
    "5. 용역사업 결과물 및 프로그램 소스코드",
    "제4조 (위탁업무 기간) 이 계약서에 의한 개인정보 처리업무의 기간은 다음과 같다.",
    "②공동수급체의 대표자는 ㅇㅇㅇ로 한다.",
)
# Fixed values of the clean-up of plain extractions.
DOT_LEADER = "[.·․‥…_∙•]{4,}\\s*\\d*"
BROKEN_FIELD = "[⺀-鿿]?[ƀ-ʯ]+\\s*\\d*"
PRIVATE = "[-￰-￿]"
PAGE_ONLY = r"^\s*[-–—]?\s*\d{1,4}\s*[-–—]?\s*$"
RULE_ONLY = r"^[\s\-–—=_~*]{3,}$"
# Fixed values of tables of contents.
TOC_MARK = r"목\s*차|\[(별지|붙임|첨부)|[·.…⋯]{4,}"
TOC_DOTS = "[·.…⋯]{4,}"
PAGE_REF = r"[가-힣A-Za-z\)\]][^\n]{0,60}?[\s\t]+(\d{1,3})(?=\s|$)"
#: PAGE_REF with no other letter between its letter and the number: as many matches, since a number that any letter before it reaches is reached by the last.
NEAR_REF = PAGE_REF.replace(r"[^\n]", r"[^\n가-힣A-Za-z\)\]]")
SECTION_RUN = r"[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]\s*[.=]"
#: What rendered tables may leave behind, by name. Fixed values.
TABLE_RESIDUE = {"pipes": r"\|", "breaks": "<br>", "rules": r"(?m)^\s*\|?\s*:?-{2,}", "failed": r"\[표 (?:복원 실패|부분 복원)", "row_tags": r"\[행 \d+\]"}


def strip(text: Column) -> Column:
    """White space of every kind removed from both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_foreign_runs(text: Column) -> Column:
    """Runs of Chinese, Greek and extended Latin letters go, as encodings leave them, unless parentheses stand directly around a whole run."""
    return F.regexp_replace(text, rf"(\([{FOREIGN}]+\))|[{FOREIGN}]+", "$1")


def foreign_runs(text: Column) -> Column:
    """How many runs `without_foreign_runs` removes."""
    return F.regexp_count(F.regexp_replace(text, rf"\([{FOREIGN}]+\)", "()"), F.lit(f"[{FOREIGN}]+"))


NOTES = ("page_lines", "boilerplate_lines", "tags", "placeholders", "empty_parens", "controls", "foreign_runs", "angles", "bullets")


def cleaned(docs: DataFrame, angles: bool = False, bullets: bool = False, boilerplate: tuple[str, ...] = BOILERPLATE) -> DataFrame:
    """docs(text, ...) with page lines, boilerplate lines, tags, placeholders, empty parentheses, control characters and foreign runs removed and long gaps closed, and how
    often each was (NOTES). Every step is a projection of its own, so that no step is computed again for the counts of the next."""
    lines = F.transform(F.split("text", LINE_END, -1), lambda x: F.struct(x.alias("line"), F.regexp_replace(strip(x), r"(?U)\s+", " ").alias("flat")))
    known = F.array(*map(F.lit, boilerplate)) if boilerplate else F.array().cast("array<string>")
    kind = lambda x: F.when(x["flat"].rlike(PAGE_LINE), 1).when(F.array_contains(known, x["flat"]), 2).otherwise(0)
    rows = docs.withColumn("_lines", F.transform(lines, lambda x: F.struct(x["line"].alias("line"), kind(x).alias("kind"))))
    of = lambda k: F.size(F.filter("_lines", lambda x: x["kind"] == k))
    own = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    kept = F.array_join(F.transform(F.filter("_lines", lambda x: x["kind"] == 0), lambda x: x["line"]), "\n")
    out = rows.select(*own, kept.alias("text"), of(1).alias("page_lines"), of(2).alias("boilerplate_lines"))
    count = lambda p: F.regexp_count("text", F.lit(p))
    for name, pattern in (("tags", TAG_RESIDUE), ("placeholders", PLACEHOLDER), ("empty_parens", EMPTY_PAREN), ("controls", CONTROL)):
        out = out.withColumns({name: count(pattern), "text": F.regexp_replace("text", pattern, "")})
    out = out.withColumns({"foreign_runs": foreign_runs(F.col("text")), "text": without_foreign_runs(F.col("text"))})
    for name, pattern, on in (("angles", "[<>]", angles), ("bullets", "•", bullets)):
        out = out.withColumns({name: count(pattern), "text": F.regexp_replace("text", pattern, "")}) if on else out.withColumn(name, F.lit(0))
    return out.withColumn("text", strip(F.regexp_replace(F.regexp_replace("text", r"[ \t]{5,}", " "), r"\n{4,}", "\n\n"))).select(*docs.columns, *NOTES)


def boilerplate_lines(with_headers: bool = False) -> tuple[str, ...]:
    return BOILERPLATE + (CATEGORY_HEADERS if with_headers else ())


def composed(text: Column) -> Column:
    """Unicode composition (NFC)."""
    small_batches()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return run(text)


def normalized(text: Column) -> Column:
    """Of a composed text: without control characters and private letters, line ends as \\n."""
    out = F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), PRIVATE, "")
    return F.regexp_replace(out, "\r\n|\r", "\n")


def without_leaders(text: Column) -> Column:
    """Dot leaders and broken page fields of tables of contents as a space."""
    return F.regexp_replace(F.regexp_replace(text, DOT_LEADER, " "), BROKEN_FIELD, " ")


def tidied(text: Column) -> Column:
    """Lines stripped and single-spaced; lines of a page number or a rule emptied; blank lines at most one in a row."""
    line = lambda x: strip(F.regexp_replace(x, "[ \t　]{2,}", " "))
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.when(line(x).rlike(PAGE_ONLY) | line(x).rlike(RULE_ONLY), "").otherwise(line(x)))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def clean_documents(docs: DataFrame, aggressive: bool = True) -> DataFrame:
    """docs(text, ...) with the whole chain over plain extractions; aggressive: lines that a document repeats go too. Texts are composed first, since
    no Python function can stand within the functions over lines."""
    rows = docs.withColumn("text", composed(F.col("text"))).withColumn("text", without_leaders(normalized(F.col("text"))))
    return rows.withColumn("text", tidied(drop_repeated_lines(F.col("text")) if aggressive else F.col("text")))


def _page_refs(line: Column) -> Column:
    """How often PAGE_REF matches: a match may as well begin at the last letter before the number, from where each letter is tried once."""
    return F.regexp_count(line, F.lit(NEAR_REF))


def _section_runs(line: Column) -> Column:
    return F.regexp_count(line, F.lit(SECTION_RUN))


def _told_lines(text: Column, min_refs: int = 1, max_chars: int = 80, many_refs: int = 3) -> Column:
    """For each line (line, flag, refs, strong): whether it is one of a table of contents, the page references of such a line, and whether it has dot leaders or section
    marks in a row. Each is made once."""

    def told(x: Column, own: Column) -> Column:
        strong = own["dots"] | (own["sections"] >= 3)
        flag = strong | (own["refs"] >= many_refs) | ((own["refs"] >= min_refs) & (own["length"] <= max_chars))
        return once(F.struct(flag.alias("flag"), strong.alias("strong")), lambda f: F.struct(x.alias("line"), f["flag"].alias("flag"), F.when(f["flag"], _page_refs(x)).otherwise(0).alias("refs"), f["strong"].alias("strong")))

    def line(x: Column) -> Column:
        own = lambda s: F.struct(s.rlike(TOC_DOTS).alias("dots"), _section_runs(s).alias("sections"), _page_refs(s).alias("refs"), F.length(s).alias("length"))
        return once(strip(x), lambda s: once(own(s), lambda o: told(x, o)))

    return F.transform(F.split(text, "\n", -1), line)


def contents_lines(text: Column, min_refs: int = 1, max_chars: int = 80, many_refs: int = 3) -> Column:
    """For each line whether it is one of a table of contents: dot leaders, many page references, few in a short line, or section marks in a row."""
    return F.transform(_told_lines(text, min_refs, max_chars, many_refs), lambda x: x["flag"])


def _by_page(lines: Column, min_refs: int = 4) -> Column:
    refs = F.aggregate(lines, F.lit(0), lambda a, x: a + x["refs"])
    return F.exists(lines, lambda x: x["strong"]) | (refs >= min_refs)


def has_contents(text: Column, min_refs: int = 4) -> Column:
    """Whether a text holds a table of contents: a mark of one, and dot leaders, section marks in a row or enough page references on such lines."""
    return text.rlike(TOC_MARK) & once(_told_lines(text), lambda lines: _by_page(lines, min_refs))


def contents_told(text: Column, min_leaders: int = 5) -> Column:
    """(by_page, leaders, kept): whether a text holds a table of contents, how many leaders it has, and `without_contents`. Lines are told only where a mark is, each once."""

    def made(known: Column) -> Column:
        """known: lines, null without a mark."""
        both = F.struct(F.coalesce(_by_page(known["lines"]), F.lit(False)).alias("by_page"), leader_count(text).alias("leaders"))
        return once(both, lambda b: F.struct(b["by_page"].alias("by_page"), b["leaders"].alias("leaders"), kept(known["lines"], b).alias("kept")))

    def kept(lines: Column, b: Column) -> Column:
        plain = F.filter(F.split(text, "\n", -1), lambda x: leader_count(x) == 0)
        own = F.transform(F.filter(lines, lambda x: ~x["flag"] & (leader_count(x["line"]) == 0)), lambda x: x["line"])
        return F.when(b["by_page"], strip(F.array_join(own, "\n"))).when(b["leaders"] >= min_leaders, strip(F.array_join(plain, "\n"))).otherwise(text)

    return once(F.struct(F.when(text.rlike(TOC_MARK), _told_lines(text)).alias("lines")), made)


def without_contents(text: Column, min_leaders: int = 5) -> Column:
    """The text of a chunk without lines of a table of contents; chunks without one stay as they are."""
    return contents_told(text, min_leaders)["kept"]


def table_residue(text: Column) -> dict[str, Column]:
    """How often each mark of a rendered table is left in a text."""
    return {name: F.regexp_count(text, F.lit(p)) for name, p in TABLE_RESIDUE.items()}


def field_after(text: Column, pattern: str, window: int = 100) -> Column:
    """What follows the first match of a pattern within `window` characters, up to a box mark or the line's end; null where that is nothing."""
    after = F.regexp_replace(F.regexp_extract(text, rf"(?:{pattern})([\s\S]{{0,{window}}})", 1), r"^[\s:\)]*", "")
    return F.nullif(strip(F.regexp_extract(after, r"^[^□\n]*", 0)), F.lit(""))


def square_items(text: Column) -> Column:
    """Labels in parentheses after a box mark, without white space, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"□\s*\(\s*([^)]+?)\s*\)"), 1), lambda x: F.regexp_replace(x, r"(?U)\s+", ""))


def heading_candidates(text: Column, longest: int = 100) -> Column:
    """Lines of at most `longest` characters that begin with a mark of numbering or of a list."""
    marked = lambda x: (F.length(x) <= longest) & x.rlike(r"^(?:[ⅠⅡⅢⅣⅤⅥ]|\d+[.)]|[가-힣][.)]|[□■○◦])")
    return F.filter(F.transform(F.split(text, LINE_END, -1), strip), marked)


def table_rows(rows: Column) -> Column:
    """A table of array<array<string>> as lines of cells between bars, empty rows left out."""
    flat = F.transform(rows, lambda r: F.transform(r, lambda c: strip(F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " "))))
    return F.array_join(F.transform(F.filter(flat, lambda r: F.exists(r, lambda c: c != "")), lambda r: F.array_join(r, " | ")), "\n")
