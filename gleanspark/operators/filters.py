"""Filters over chunks, notices and questions. A condition that is not asked for is null and drops nothing; one that is asked for drops rows without a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions.text import leader_count

#: Words that name no notice. Fixed values.
COMMON_WORDS = ("사업", "용역", "구축", "시스템", "관련", "위한", "대한", "및", "등")


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def filter_by(agency_has: str | None = None, budget_min: float | None = None, budget_max: float | None = None, close_after: str | None = None, close_before: str | None = None, doc_ids: list[str] | None = None) -> Column:
    """A condition on columns doc_id, agency, budget and bid_close_at, bounds included. Closing dates are compared as text; an empty list of
    ids and an empty name ask for nothing."""
    asked = [
        F.col("doc_id").isin(doc_ids) if doc_ids else None,
        F.contains(F.coalesce("agency", F.lit("")), F.lit(agency_has)) if agency_has else None,
        F.nanvl("budget", F.lit(None).cast("double")) >= budget_min if budget_min is not None else None,
        F.nanvl("budget", F.lit(None).cast("double")) <= budget_max if budget_max is not None else None,
        F.col("bid_close_at") != "" if close_after or close_before else None,
        F.col("bid_close_at") >= close_after if close_after else None,
        F.col("bid_close_at") <= close_before if close_before else None,
    ]
    return _all([c for c in asked if c is not None])


def passes(min_budget: float | None = None, max_budget: float | None = None, agency: str | None = None, closes_after: str | None = None) -> Column:
    """The same for notices: what is not known of a budget, an agency or a closing date fails where it is asked for."""
    return filter_by(agency, min_budget, max_budget, closes_after)


def keep_docs(chunks: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """Chunks of the wanted documents; none named (null) is no filter. wanted(doc_id)."""
    return chunks if wanted is None else chunks.join(wanted.select("doc_id"), "doc_id", "left_semi")


def names_notice(question: Column, title: Column, agency: Column, least: int = 2) -> Column:
    """Whether a question has at least two distinct words of a notice's title and agency, common ones aside."""
    words = F.array_distinct(F.split(F.concat_ws(" ", title, agency), "[^가-힣A-Za-z0-9]+"))
    told = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*COMMON_WORDS) & (F.instr(question, w) > 0))
    return F.size(told) >= least


def drop_contents(chunks: DataFrame, min_leaders: int = 5, min_chars: int = 80) -> DataFrame:
    """Chunks without their lines of tables of contents; those of which under `min_chars` characters are left go. Adds by_page and leaders."""
    told = F.transform(F.array(C.contents_told(F.col("text"), min_leaders)), lambda r: F.struct(r["by_page"].alias("by_page"), r["leaders"].alias("leaders"), r["kept"].alias("text")))
    stays = lambda r: ~(r["by_page"] | (r["leaders"] >= min_leaders)) | (F.length(r["text"]) >= min_chars)
    # A filter after a projection would have the texts told again, below it.
    rows = chunks.select(*[F.col(f"`{c}`") for c in chunks.columns if c != "text"], F.inline(F.filter(told, stays)))
    return rows.select(*[F.col(f"`{c}`") for c in chunks.columns], "by_page", "leaders")
