"""Searches composed of pieces: variants of questions, searchers that take all of them at once, fusion, reranking, contexts, notices.

A searcher is a function of (queries, k) to hits, where queries has query_id and text and hits are (query_id, chunk_id, score, rank).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import models
from ..functions.text import money, single_spaced
from ..sources.tables import numbered, saved
from . import retrieval as R

Searcher = Callable[[DataFrame, int], DataFrame]
Piece = Callable[[DataFrame], DataFrame]


class Pipeline:
    """Pieces by name, run in order; every change makes another pipeline. timings: of the last run, by piece (plans are made then, not run)."""

    def __init__(self, pieces: list[tuple[str, Piece]]):
        self.pieces, self.timings = list(pieces), []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.timings = []
        for name, piece in self.pieces:
            start = time.perf_counter()
            df = piece(df)
            self.timings.append((name, time.perf_counter() - start))
        return df

    def without(self, name: str) -> Pipeline:
        return Pipeline([p for p in self.pieces if p[0] != name])

    def replace(self, name: str, piece: Piece) -> Pipeline:
        return Pipeline([(n, piece if n == name else p) for n, p in self.pieces])

    def insert(self, at: int, name: str, piece: Piece) -> Pipeline:
        return Pipeline([*self.pieces[:at], (name, piece), *self.pieces[at:]])

    def add(self, name: str, piece: Piece) -> Pipeline:
        return Pipeline([*self.pieces, (name, piece)])

    def __getitem__(self, at):
        return Pipeline(self.pieces[at]) if isinstance(at, slice) else self.pieces[at]

    def __len__(self) -> int:
        return len(self.pieces)


# Variants of questions


def rewritten(queries: DataFrame, model: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """query_id, variant, text: each question as a model rewrites it (what follows the last `질문:`, its first line); the question where that is nothing."""
    prompt = F.concat(F.lit("입찰 문서에서 찾기 좋은 한 문장으로 고쳐 쓰고 그 문장만 답하시오.\n원래 질문: "), "text", F.lit("\n고친 질문:"))
    answer = models.ask(prompt, model)
    line = F.substring_index(F.trim(F.regexp_replace(F.substring_index(answer, "질문:", -1), r"^\s+", "")), "\n", 1)
    return queries.select("query_id", F.lit(0).alias("variant"), F.coalesce(F.nullif(F.trim(line), F.lit("")), F.col("text")).alias("text"))


def multiplied(queries: DataFrame, model: Callable[[list[str]], list[str]] | None = None, n: int = 3, keep_original: bool = True) -> DataFrame:
    """query_id, variant, text: the question and up to `n` of a model's paraphrases, without bullets, of over four characters, each once."""
    prompt = F.concat(F.lit(f"뜻은 같고 낱말은 다른 검색용 질문 {n}개를 한 줄에 하나씩 쓰시오.\n질문: "), "text", F.lit(f"\n\n검색용 질문 {n}개:"))
    lines = F.transform(F.split(models.ask(prompt, model), "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"^[ \-*0-9.)]+", "")))
    made = F.slice(F.filter(lines, lambda x: F.length(x) > 4), 1, n)
    own = F.concat(F.array("text"), made) if keep_original else made
    return queries.select("query_id", F.posexplode(F.array_distinct(F.filter(own, lambda x: x != ""))).alias("variant", "text"))


def run_search(search: Searcher, variants: DataFrame, k: int) -> DataFrame:
    """Hits of all variants (query_id, variant, text) of a question, one after the other, each chunk where it comes first."""
    kind = variants.schema["query_id"].dataType
    asked = variants.select(F.concat_ws("#", F.col("query_id").cast("string"), F.col("variant").cast("string")).alias("query_id"), "text")
    hits = search(asked, k)
    told = hits.select(F.substring_index("query_id", "#", 1).cast(kind).alias("query_id"), F.substring_index("query_id", "#", -1).cast("int").alias("variant"), "chunk_id", "score", "rank")
    place = F.struct("variant", "rank")
    once = told.groupBy("query_id", "chunk_id").agg(F.min(place).alias("place"), F.min_by("score", place).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("place", "chunk_id"))
    return once.select("query_id", "chunk_id", "score", rank.alias("rank"))


# Searchers


def bm25(chunks: DataFrame | R.Bm25Index, scope: DataFrame | None = None, token: R.Tokenizer = R.tokens) -> Searcher:
    """scope(query_id, chunk_id): what a question may find. The index is built once for all searches."""
    index = chunks if isinstance(chunks, R.Bm25Index) else R.Bm25Index(chunks, token)
    return lambda queries, k: R.bm25(index, queries, k, _scoped(scope, queries))


def _scoped(scope: DataFrame | None, queries: DataFrame) -> DataFrame | None:
    """A scope by question, for its variants as well."""
    if scope is None:
        return None
    asked = queries.select("query_id", F.substring_index(F.col("query_id").cast("string"), "#", 1).alias("base"))
    return scope.select(F.col("query_id").cast("string").alias("base"), "chunk_id").join(asked, "base").select("query_id", "chunk_id")


def dense(vectors: DataFrame, embed: Callable[[Column], Column], scope: DataFrame | None = None, fetch: int = 10) -> Searcher:
    """vectors(chunk_id, v). With a scope, `fetch` times as many are found over all chunks and those in scope kept, so fewer than k may stay.
    Vectors that a model makes are made once, for all searches."""
    vectors = saved(vectors.select("chunk_id", "v"), "vectors")

    def search(queries: DataFrame, k: int) -> DataFrame:
        asked = queries.select("query_id", embed(F.col("text")).alias("q"))
        if scope is None:
            return R.dense(vectors, asked, k)
        hits = R.dense(vectors, asked, k * fetch).join(_scoped(scope, queries), ["query_id", "chunk_id"], "left_semi")
        return R.top_k(hits.drop("rank"), k)

    return search


def hybrid(searchers: list[Searcher], weights: list[float] | None = None, pool: int = 20) -> Searcher:
    """Ranks of several searchers fused; each is asked for `pool`, and equal weights unless told otherwise."""
    weights = weights or [1 / len(searchers)] * len(searchers)
    return lambda queries, k: R.fuse([(s(queries, pool), w) for s, w in zip(searchers, weights)], k)


def reranked(search: Searcher, chunks: DataFrame, pool: int = 30, score=R.overlap_score) -> Searcher:
    return lambda queries, k: R.rerank(search(queries, pool), chunks, queries, k, score)


def retrieve(queries: DataFrame, chunks: DataFrame, search: Searcher, synonyms: dict[str, list[str]], top_k: int = 8, pool: int = 30, score=R.overlap_score) -> DataFrame:
    """Evidence for each question: words of the dictionary added, a search of every variant, the candidates scored anew on the question itself."""
    found = run_search(search, R.add_keywords(queries, synonyms), pool)
    return R.rerank(found, chunks, queries, top_k, score)


def setups(chunks: DataFrame, vectors: DataFrame, embed: Callable[[Column], Column], pool: int = 30, score=R.overlap_score) -> dict[str, Searcher]:
    """The configurations that evaluations compare, by name."""
    lexical, semantic = bm25(chunks), dense(vectors, embed)
    both = hybrid([semantic, lexical], pool=pool)
    return {"BM25": lexical, "Dense": semantic, "Hybrid": both, "Hybrid 0.3": hybrid([semantic, lexical], [0.7, 0.3], pool), "BM25+Rerank": reranked(lexical, chunks, pool, score), "Hybrid+Rerank": reranked(both, chunks, pool, score)}


def compared(searches: dict[str, Searcher], queries: DataFrame, gold: DataFrame, k: int = 5, mrr_k: int = 10) -> DataFrame:
    """name and metrics of each configuration, the best hit rate first, then the best mean reciprocal rank. gold(query_id, chunk_id)."""
    rows = [R.metrics(R.ranks_of_gold(s(queries, max(k, mrr_k)), gold), k=k, mrr_k=mrr_k).withColumn("name", F.lit(name)) for name, s in searches.items()]
    return reduce(DataFrame.unionByName, rows).orderBy(F.col("hit_rate").desc(), F.col("mrr").desc(), "name")


# Contexts


def body(generation: bool = False) -> Column:
    """What a prompt shows of a chunk: its generation text if it has one, or its search text."""
    return F.coalesce(F.nullif("gen", F.lit("")), F.col("text")) if generation else F.col("text")


def header() -> Column:
    """title · agency · notice · revision · closing date · kind and budget, of columns of these names; what is not known is left out."""
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    close = F.nullif(F.substring(F.trim("bid_close_at"), 1, 10), F.lit(""))
    return F.concat_ws(" · ", text("title"), text("agency"), text("notice_no"), F.concat(F.col("revision").cast("string"), F.lit("차 공고")), F.concat(F.lit("마감 "), close), F.concat(F.coalesce(text("budget_kind"), F.lit("공고 금액")), F.lit(" "), money(text("budget"))))


def contexts(hits: DataFrame, budget: int = 6000, generation: bool = False, between: str = "\n\n---\n\n") -> DataFrame:
    """query_id, context, n_chunks, chars, sources of hits that carry their chunks' columns (rank, text, gen, doc_id and those of `header`): blocks
    numbered by rank. Bodies are taken until the first that exceeds the budget, then dropped from the end until headers and rules fit as well; the first stays."""
    block = F.concat(F.rtrim(F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), header())), F.lit("\n"), body(generation))
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = hits.withColumn("block", block)
    rows = rows.withColumn("bodies", F.sum(F.length(body(generation))).over(upto)).withColumn("whole", F.sum(F.length("block") + len(between)).over(upto) - len(between))
    kept = rows.filter((F.col("rank") == 1) | (F.col("bodies") <= budget) & (F.col("whole") <= budget))
    source = F.struct(F.col("rank").alias("n"), "doc_id", F.substring(single_spaced(F.col("text")), 1, 400).alias("excerpt"), "block")
    each = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(source)).alias("sources"))
    context = F.array_join(F.transform("sources", lambda x: x["block"]), between)
    return each.select("query_id", context.alias("context"), F.size("sources").alias("n_chunks"), F.length(context).alias("chars"), F.transform("sources", lambda x: x.dropFields("block")).alias("sources"))


def exported(pairs: DataFrame, found: DataFrame, scoped: bool = True) -> DataFrame:
    """One row for each question of an evaluation set (query_id, question, kind, answerable, doc_id, keywords), in their order, with its context; found_doc
    tells, where questions were not scoped to their document, whether it was found. Questions without hits have an empty context."""
    listed = numbered(pairs, "__n", "query_id")
    rows = listed.withColumn("qid", F.format_string("%s-%03d", F.coalesce("kind", F.lit("q")), F.col("__n") + 1)).join(found, "query_id", "left")
    seen = F.coalesce(F.exists("sources", lambda s: s["doc_id"] == F.col("doc_id")), F.lit(False))
    return rows.select(
        "qid", "question", "kind", F.coalesce("answerable", F.lit(True)).alias("answerable"), F.when(F.lit(scoped) & F.col("doc_id").isNotNull(), F.array("doc_id")).alias("doc_ids"), F.col("doc_id").alias("gold_doc"),
        F.when(~F.lit(scoped), seen).alias("found_doc"), "keywords", F.coalesce("context", F.lit("")).alias("context"), "sources", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("chars", F.lit(0)).alias("chars"),
    )


# Notices


def notices_found(hits: DataFrame, chunks: DataFrame, keep: Column | None = None, siblings: DataFrame | None = None, top_n: int = 10) -> DataFrame:
    """Documents from hits on chunks(chunk_id, doc_id, notice_no, revision, text, title, agency, budget, bid_close_at): score is the sum of 1 / (60 + rank),
    the attributes are the first hit's. `keep` applies after folding; of a notice's revisions the best stays, ids without a revision are never folded;
    siblings(doc_id, siblings) are added; top_n of each question."""
    attributes = ("title", "agency", "budget", "bid_close_at")
    met = hits.join(chunks, "chunk_id").groupBy("query_id", "doc_id", "notice_no", "revision").agg(
        F.sum(1 / (60 + F.col("rank"))).alias("raw"), F.count("*").alias("n_chunks"), F.min("rank").alias("first_rank"), *[F.min_by(c, "rank").alias(c) for c in attributes],
        F.min_by(F.substring(single_spaced(F.col("text")), 1, 200), "rank").alias("excerpt"),
    )
    met = met.filter(keep) if keep is not None else met
    family = F.when(F.col("revision").isNull(), F.concat(F.lit("-"), F.col("doc_id").cast("string"))).otherwise(F.col("notice_no"))
    best = met.withColumn("n", F.row_number().over(Window.partitionBy("query_id", family).orderBy(F.col("raw").desc(), "first_rank"))).filter("n = 1")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("raw").desc(), "first_rank"))).filter(F.col("rank") <= top_n)
    out = ranked.select("query_id", "rank", "doc_id", "notice_no", "revision", F.round("raw", 6).alias("score"), "n_chunks", *attributes, "excerpt")
    return out if siblings is None else out.join(siblings, "doc_id", "left")


def notice_metrics(ranks: DataFrame, *by: str, top_n: int = 10) -> DataFrame:
    """mrr, top1, top5, topn, questions of the ranks (null: not found) of the wanted notices."""
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 3)
    at = F.col("rank")
    return ranks.groupBy(*by).agg(F.round(F.avg(F.when(at <= top_n, 1 / at).otherwise(0.0)), 3).alias("mrr"), share(at == 1).alias("top1"), share(at <= 5).alias("top5"), share(at <= top_n).alias("topn"), F.count("*").alias("questions"))
