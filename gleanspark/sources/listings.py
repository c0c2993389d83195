"""Listings of a procurement service: paged scans, which items to take, and the metadata row of each. Items are rows of string columns."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_if_null_word

#: Words, extensions and field names of the service. Fixed values.
IT_WORDS = ("시스템", "정보화", "소프트웨어", "솔루션", "플랫폼", "포털", "홈페이지", "웹사이트", "전산", "데이터베이스", "빅데이터", "ISMP", "ISP", "BPR", "EA", "LMS", "ERP", "GIS", "DW", "CDW")
NEGOTIATED = ("협상", "경쟁적 대화", "경쟁적대화", "규격가격", "제안적격자")
ATTACHMENT_WORDS = ("제안요청서", "제안 요청서", "과업내용서", "과업 내용서", "과업지시서", "제안요청", "입찰설명서", "용역설명서")
EXTENSIONS = (".hwp", ".hwpx", ".pdf")
SOFTWARE, CANCELLED, SLOTS = "SW사업", "취소", 10


def value(name: str) -> Column:
    return F.coalesce(F.trim(blank_if_null_word(F.col(name))), F.lit(""))


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def looks_like_it() -> Column:
    return has_any(value("bidNtceNm"), IT_WORDS)


def wanted() -> Column:
    return looks_like_it() | F.contains(value("sucsfbidMthdNm"), F.lit(SOFTWARE))


def negotiated() -> Column:
    return has_any(F.concat_ws(" ", value("sucsfbidMthdNm"), value("cntrctCnclsMthdNm"), value("bidNtceNm")), NEGOTIATED)


def cancelled() -> Column:
    return F.contains(value("ntceKindNm"), F.lit(CANCELLED))


def superseded() -> Column:
    """The earlier notice that this one replaces, null if none."""
    return F.nullif(value("befBidBbancNo"), F.lit(""))


def doc_id() -> Column:
    """notice-order, the order as a whole number, 0 where it is none."""
    order = F.coalesce(value("bidNtceOrd").try_cast("double").cast("int"), F.lit(0))
    return F.concat(value("bidNtceNo"), F.lit("-"), order.cast("string"))


def attachment(slots: int = SLOTS) -> Column:
    """(rank, slot, url, name) of the likeliest document among the slots, null if none: first word in order, then first slot."""
    found = []
    for n in range(1, slots + 1):
        name, url = F.trim(F.coalesce(F.col(f"ntceSpecFileNm{n}"), F.lit(""))), F.regexp_replace(F.coalesce(F.col(f"ntceSpecDocUrl{n}"), F.lit("")), r"\s+", "")
        rank = F.coalesce(*[F.when(F.contains(name, F.lit(w)), i) for i, w in enumerate(ATTACHMENT_WORDS)], F.lit(len(ATTACHMENT_WORDS)))
        usable = (url != "") & F.lower(name).rlike("(" + "|".join(e.replace(".", r"\.") for e in EXTENSIONS) + ")$")
        found.append(F.when(usable, F.struct(rank.alias("rank"), F.lit(n).alias("slot"), url.alias("url"), name.alias("name"))))
    return F.array_min(F.filter(F.array(*found), lambda x: x.isNotNull()))


def metadata_rows(items: DataFrame, file_name: str = "file_name") -> DataFrame:
    """The metadata columns of items: the allotted budget or else the estimate, with its kind; the demanding agency or else the posting one."""
    allotted, estimate = value("asignBdgtAmt"), value("presmptPrce")
    first = lambda a, b: F.when(value(a) != "", value(a)).otherwise(value(b))
    return items.select(
        doc_id().alias("doc_id"), value("bidNtceNo").alias("notice_no"), value("bidNtceOrd").alias("revision"), value("bidNtceNm").alias("title"),
        F.when(allotted != "", allotted).otherwise(estimate).alias("budget"), F.when(allotted != "", "배정예산").when(estimate != "", "추정가격").otherwise("").alias("budget_kind"),
        first("dminsttNm", "ntceInsttNm").alias("agency"), first("bidNtceDt", "rgstDt").alias("published_at"), value("bidBeginDt").alias("bid_begin_at"), value("bidClseDt").alias("bid_close_at"),
        F.lower(F.regexp_extract(F.col(file_name), r"\.([^.]+)$", 1)).alias("file_type"), F.col(file_name).alias("file_name"),
    )


def paged(spark: SparkSession, fetch: Callable[[int], list[dict]], total: int, rows: int = 100) -> DataFrame:
    """(page, item as JSON) of every page; the pages are fetched by the executors, so `fetch` must be picklable. A failed task is fetched again."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for page in part["id"]:
                items = fetch(int(page))
                items = [items] if isinstance(items, dict) else items
                yield pd.DataFrame({"page": page, "item": [json.dumps(i, ensure_ascii=False) for i in items]}, columns=["page", "item"])

    pages = -(-total // rows)
    return spark.range(1, pages + 1, 1, max(1, min(pages, spark.sparkContext.defaultParallelism))).mapInPandas(run, "page long, item string")


def arrivals(items: DataFrame, known: DataFrame) -> DataFrame:
    """Items to take: wanted, not cancelled, with an attachment, of no known doc_id, one of each."""
    fresh = items.withColumns({"doc_id": doc_id(), "attachment": attachment()}).filter(wanted() & ~cancelled() & F.col("attachment").isNotNull())
    return fresh.join(known.select("doc_id"), "doc_id", "left_anti").dropDuplicates(["doc_id"])


def sampled(items: DataFrame) -> DataFrame:
    """Counts of what a period brings: live, with attachment, by title, negotiated and both."""
    live = ~cancelled()
    attached = live & attachment().isNotNull()
    one = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return items.agg(F.count("*").alias("items"), one(live, "live"), one(attached, "attached"), one(attached & looks_like_it(), "it"), one(attached & negotiated(), "negotiated"), one(attached & looks_like_it() & negotiated(), "both"))


class ServiceError(RuntimeError):
    """An answer of the service that is not JSON or does not say that all went well."""


def page_of(answer: str) -> tuple[list[dict], int]:
    """(items, how many there are in all) of one answer: a lone item comes as an object, none as nothing. Result codes 0 and 00 are good."""
    try:
        response = json.loads(answer)["response"]
    except (ValueError, KeyError, TypeError) as e:
        raise ServiceError(f"not an answer of the service: {answer[:400]}") from e
    head = response.get("header") or {}
    if head.get("resultCode") not in ("0", "00"):
        raise ServiceError(f"{head.get('resultCode')}: {head.get('resultMsg')}")
    body = response.get("body") or {}
    items = body.get("items") or []
    return [items] if isinstance(items, dict) else items, int(body.get("totalCount") or 0)


def crawled(spark: SparkSession, ask: Callable[[int], str], known: DataFrame, columns: list[str], rows: int = 100, limit: int | None = None, take_all: bool = False) -> DataFrame:
    """New items of a period: the first page tells how many there are, the executors ask for all pages, and what is known, not wanted (unless take_all), cancelled or
    without an attachment is left out. ask: page to the service's answer. limit: of new items, in the order of their ids."""
    _, total = page_of(ask(1))
    pages = paged(spark, lambda page: page_of(ask(page))[0], total, rows)
    schema = ", ".join(f"`{c}` string" for c in columns)
    items = pages.select(F.from_json("item", schema).alias("x")).select("x.*")
    if take_all:
        fresh = items.withColumns({"doc_id": doc_id(), "attachment": attachment()}).filter(~cancelled() & F.col("attachment").isNotNull())
        out = fresh.join(known.select("doc_id"), "doc_id", "left_anti").dropDuplicates(["doc_id"])
    else:
        out = arrivals(items, known)
    return out if limit is None else out.orderBy("doc_id").limit(limit)


def downloaded(items: DataFrame, fetch: Callable[[str], bytes], folder: str) -> DataFrame:
    """doc_id, path, bytes, error of items(doc_id, attachment): each file is fetched by an executor into `folder`, which all of them share, under a name of its own and
    renamed when it is whole, so a broken transfer leaves no file. A failed one is told in its row."""
    from pathlib import Path

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, url, name in zip(batch["doc_id"], batch["url"], batch["name"]):
                path = Path(folder) / f"{key}{Path(name).suffix.lower()}"
                part = path.with_name(f"{path.name}.{uuid.uuid4().hex}.part")
                try:
                    part.write_bytes(fetch(url))
                    part.replace(path)
                    out.append((key, str(path), path.stat().st_size, None))
                except Exception as e:  # the next ones go on
                    part.unlink(missing_ok=True)
                    out.append((key, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "path", "bytes", "error"]).astype({"bytes": "Int64"})

    return items.select("doc_id", F.col("attachment.url").alias("url"), F.col("attachment.name").alias("name")).mapInPandas(run, "doc_id string, path string, bytes long, error string")


def stored_files(metadata: DataFrame) -> DataFrame:
    """doc_id, stored, name of metadata(notice_no, notice_seq, file_name, title): the file as it is kept, and a name to hand out, made of the title without what no file
    name may have. Names that lead out of their folder are left out."""
    order = F.coalesce(F.col("notice_seq").try_cast("double").cast("int"), F.lit(0)).cast("string")
    number = F.regexp_replace(F.trim("notice_no"), r"\.0$", "")
    stored = F.trim("file_name")
    stem, suffix = F.regexp_extract(stored, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(stored, r"(\.[^.]*)$", 1)
    safe = F.trim(F.translate(F.coalesce("title", F.lit("")), '/\\:*?"<>|', ""))
    rows = metadata.filter((number != "") & (stored != "") & ~stored.rlike(r"(^|[/\\])\.\.([/\\]|$)|^[/\\]"))
    return rows.select(F.concat_ws("-", number, order).alias("doc_id"), stored.alias("stored"), F.concat(F.when(safe != "", safe).otherwise(stem), suffix).alias("name"))
