"""Ranking whole sets of queries at once: hits are rows (query_id, chunk_id, score, rank), smaller ranks first."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import tokens
from ..sources.tables import saved

K1, B, EPSILON = 1.5, 0.75, 0.25
BETWEEN = "\x01"  # no token holds it


def top_k(scored: DataFrame, k: int, *ties: str) -> DataFrame:
    """The k best of each query; equal scores go by `ties`. Spark cuts each partition to k before it shuffles."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *[F.col(c) for c in ties or ("chunk_id",)])
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


Tokenizer = Callable[[Column], Column]


class Bm25Index:
    """What a corpus of chunks(chunk_id, text) is searched by: words (chunk_id, words), raw (term, raw: its idf, negative in over half of the chunks), how many chunks,
    their mean length and the mean of all idf. Texts are cut into words once; both tables lie in the shared folder until the driver ends. Build it once
    for many searches. token: column of texts to column of arrays of words; cache: an `indexes.WordCache`, which cuts only texts that it doesn't have."""

    def __init__(self, chunks: DataFrame, token: Tokenizer = tokens, cache=None):
        self.token = cache.token if cache else token
        self.words = saved(cache.words(chunks) if cache else chunks.select("chunk_id", token(F.col("text")).alias("words")), "bm25-words")
        self.n, mean = self.words.agg(F.count("*"), F.avg(F.size("words"))).first()
        self.avgdl = mean or 1.0
        df = self.words.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        self.raw = saved(df.select("term", (F.log(F.lit(self.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")), "bm25-idf")
        self.mean_idf = self.raw.agg(F.avg("raw")).first()[0] or 0.0

    def idf(self) -> Column:
        return F.when(F.col("raw") < 0, EPSILON * self.mean_idf).otherwise(F.col("raw"))

    def asked(self, queries: DataFrame) -> DataFrame:
        """query_id, term, qtf, idf of the words that the corpus has."""
        each = queries.select("query_id", F.explode(self.token(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        return each.join(self.raw, "term").select("query_id", "term", "qtf", self.idf().alias("idf"))


def bm25(chunks: DataFrame | Bm25Index, queries: DataFrame, k: int = 5, scope: DataFrame | None = None, block: int | None = None, token: Tokenizer = tokens) -> DataFrame:
    """Okapi BM25; queries(query_id, text). Terms in over half of the chunks get a quarter of the mean idf. Only positive scores.
    All chunks are scored against all queries, in tiles (`tiled`) by blocks of `block` queries, which give each query's best of a tile alone.
    scope(query_id, chunk_id): what a query may find, applied in the tiles before ranking."""
    index = chunks if isinstance(chunks, Bm25Index) else Bm25Index(chunks, token)
    return _bm25_blocks(index, index.asked(queries), k, queries.count(), block, scope)


#: Rows of the corpus and queries that one task scores against each other at most, but for chance: both are dealt by hash.
PER_TILE, PER_BLOCK = 1 << 12, 1 << 12


def tiled(corpus: DataFrame, n: int, queries: DataFrame, n_queries: int, score: Callable[[pa.Table, pa.Table], pa.Table], schema: StructType, block: int | None = None, scope: DataFrame | None = None) -> DataFrame:
    """What `score` makes of every tile of corpus(chunk_id, ...) with every block of queries(query_id, ...): tiles and blocks are the groups of a cogroup, so neither the
    driver nor the plan holds any, and a task has one tile and one block. Corpus rows are shuffled once for each block of PER_BLOCK queries, or `block`. n and n_queries may be
    rough. score gives partial hits (query_id, chunk_id, score). scope(query_id, chunk_id): goes to the tiles too, as rows of the corpus with a chunk's queries of a block in
    `allowed`, which is null in the others, so the corpus is not joined with it."""
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    tiles = max(1, -(-n // min(PER_TILE, max(256, -(-n // cores)))))
    blocks = max(1, -(-n_queries // (block or PER_BLOCK)))
    part = lambda key, of: F.pmod(F.xxhash64(key), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = corpus.select("*", part("chunk_id", tiles).alias("tile"), every(blocks).alias("block"))
    if scope is not None:
        kind = lambda df, c: F.col(c).cast(df.schema[c].dataType).alias(c)
        own = scope.select(kind(corpus, "chunk_id"), kind(queries, "query_id")).withColumn("block", part("query_id", blocks))
        allowed = own.groupBy("chunk_id", "block").agg(F.collect_set("query_id").alias("allowed"))
        left = left.unionByName(allowed.withColumn("tile", part("chunk_id", tiles)), allowMissingColumns=True)
    left = left.groupBy("tile", "block")
    right = queries.select("*", every(tiles).alias("tile"), part("query_id", blocks).alias("block")).groupBy("tile", "block")
    return left.cogroup(right).applyInArrow(score, schema)


def _hits(schema: StructType, ids: pa.Array, chunks: pa.Array, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    """Partial hits from (places of queries, places of chunks, scores)."""
    q, c, s = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(3))
    return pa.Table.from_arrays([ids.take(pa.array(q)), chunks.take(pa.array(c)), pa.array(s.astype(float))], names=schema.names)


class _Best:
    """Passes on, block of rows after block of rows, what may be among each query's k best: the k-th best so far, less what rounding may make equal."""

    def __init__(self, n: int, k: int, above: float = -np.inf):
        self.k, self.above, self.kept = k, above, np.full((n, k), -np.inf)

    def __call__(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """scores: rows by queries; the places of those to pass on."""
        top = scores.T if len(scores) <= self.k else np.partition(scores, -self.k, axis=0)[-self.k :].T
        self.kept = np.sort(np.concatenate([self.kept, top], axis=1), axis=1)[:, -self.k :]
        return np.nonzero((scores >= self.kept[:, 0] - 1e-6) & (scores > self.above))


def _bm25_blocks(index: Bm25Index, asked: DataFrame, k: int, n_queries: int, block: int | None, scope: DataFrame | None) -> DataFrame:
    words = index.words.filter("size(words) > 0").select("chunk_id", F.size("words").alias("dl"), "words")
    schema = StructType([asked.schema["query_id"], words.schema["chunk_id"], StructField("score", DoubleType())])
    weighed = asked.select("query_id", "term", (F.col("qtf") * F.col("idf") * (K1 + 1)).alias("weight"))
    avgdl = index.avgdl

    def value(tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf / (tf + K1 * (1 - B + B * dl / avgdl))

    best = tiled(words, index.n, weighed, n_queries, _scorer(k, schema, value), schema, block, scope)
    return top_k(best.withColumn("score", F.round("score", 6)).filter("score > 0"), k)


def _scorer(k: int, schema: StructType, value: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, rows: int = 512, queries: int = 256) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The words of a tile are looked up once among those that the block asks for; queries go in parts of `queries` against rows in parts of `rows`, each with a matrix of
    the terms that both have. What a term adds is its weight in the query times value(how often it is in the chunk, dl), or without that the sum of its `weights`."""

    def run(tile: pa.Table, block: pa.Table) -> pa.Table:
        scoped = "allowed" in tile.column_names
        told = tile.filter(pc.is_valid(tile.column("allowed"))).select(["chunk_id", "allowed"]) if scoped else None
        tile = tile.filter(pc.is_in(tile.column("chunk_id"), told.column("chunk_id").combine_chunks())).filter(pc.field("allowed").is_null()) if scoped else tile
        if not tile.num_rows or not block.num_rows:
            return _hits(schema, pa.array([], block.schema.field("query_id").type), pa.array([], tile.schema.field("chunk_id").type), [])
        chunks, terms = tile.column("chunk_id").combine_chunks(), block.column("term").combine_chunks().dictionary_encode()
        ids = block.column("query_id").combine_chunks().dictionary_encode()
        q, t, w = (np.asarray(x) for x in (ids.indices, terms.indices, block.column("weight")))
        by_query = np.argsort(q, kind="stable")
        q, t, w = q[by_query], t[by_query], w[by_query]
        n_terms = len(terms.dictionary)
        row, term, met = _met(tile.column("words").combine_chunks(), terms.dictionary)
        pair, at_pair, tf = np.unique(row * n_terms + term, return_inverse=True, return_counts=True)
        row, term = pair // n_terms, pair % n_terms
        if value:
            size = tile.column("dl").to_numpy()
            amount = value(tf, size[row])
        else:
            amount = np.bincount(at_pair, weights=tile.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)[met], minlength=len(pair))
        if scoped:
            own_row, own_query = _allowed(told, chunks, ids.dictionary)
        out = []
        for first in range(0, len(ids.dictionary), queries):
            n = min(queries, len(ids.dictionary) - first)
            own = slice(np.searchsorted(q, first), np.searchsorted(q, first + n))
            used, column = np.unique(t[own], return_inverse=True)
            weights = np.zeros((len(used), n))
            np.add.at(weights, (column, q[own] - first), w[own])
            best, local = _Best(n, k, 0.0), np.full(n_terms, -1)
            local[used] = np.arange(len(used))
            for at in range(0, len(chunks), rows):
                height = min(rows, len(chunks) - at)
                part = slice(np.searchsorted(row, at), np.searchsorted(row, at + height))
                column = local[term[part]]
                asked = column >= 0
                if asked.any():
                    present, at_column = np.unique(column[asked], return_inverse=True)
                    matrix = np.zeros((height, len(present)))
                    matrix[row[part][asked] - at, at_column] = amount[part][asked]
                    scores = matrix @ weights[present]
                    if scoped:
                        part = slice(np.searchsorted(own_row, at), np.searchsorted(own_row, at + height))
                        mine = (own_query[part] >= first) & (own_query[part] < first + n)
                        places = own_row[part][mine] - at, own_query[part][mine] - first
                        kept = np.full(scores.shape, -np.inf)
                        kept[places] = scores[places]
                        scores = kept
                    r, c = best(scores)
                    out.append((c + first, r + at, scores[r, c]))
        return _hits(schema, ids.dictionary, chunks, out)

    return run


def _met(lists: pa.ListArray, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place among known, place among all) of the entries of lists that are known."""
    found = pc.index_in(lists.flatten(), value_set=known).fill_null(-1).to_numpy()
    met = np.flatnonzero(found >= 0)
    row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    return row[met], found[met].astype(np.int64), met


def _allowed(told: pa.Table, chunks: pa.Array, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of the pairs in scope, by row."""
    at, query, _ = _met(told.column("allowed").combine_chunks(), ids)
    row = pc.index_in(told.column("chunk_id").combine_chunks(), value_set=chunks).fill_null(-1).to_numpy()[at]
    order = np.argsort(row, kind="stable")
    order = order[row[order] >= 0]
    return row[order], query[order]


def dense(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int | None = None) -> DataFrame:
    """Exact nearest by squared L2 distance; vectors(chunk_id, v), queries(query_id, q): a stated set of queries against all vectors, in tiles (`tiled`)."""
    asked = queries.filter(F.col("q").isNotNull()).select("query_id", F.col("q").cast("array<double>").alias("q"))
    rows = vectors.filter(F.col("v").isNotNull()).select("chunk_id", F.col("v").cast("array<double>").alias("v"))
    schema = StructType([asked.schema["query_id"], rows.schema["chunk_id"], StructField("score", DoubleType())])
    best = tiled(rows, rows.count(), asked, asked.count(), _nearest(k, schema), schema, block)
    return top_k(best.withColumn("score", F.round("score", 6) + F.lit(0.0)), k)


def _nearest(k: int, schema: StructType, rows: int = 2048, queries: int = 512) -> Callable[[pa.Table, pa.Table], pa.Table]:
    matrix = lambda column, n: column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)

    def run(tile: pa.Table, block: pa.Table) -> pa.Table:
        ids, chunks = block.column("query_id").combine_chunks(), tile.column("chunk_id").combine_chunks()
        if not tile.num_rows or not block.num_rows:
            return _hits(schema, ids, chunks, [])
        v, all_q, out = matrix(tile.column("v"), tile.num_rows), matrix(block.column("q"), block.num_rows), []
        sizes = (v * v).sum(axis=1)
        for first in range(0, len(all_q), queries):
            q = all_q[first : first + queries]
            best, own = _Best(len(q), k), (q * q).sum(axis=1)
            for at in range(0, len(v), rows):
                scores = 2 * (v[at : at + rows] @ q.T) - sizes[at : at + rows, None] - own[None, :]
                r, c = best(scores)
                out.append((c + first, r + at, scores[r, c]))
        return _hits(schema, ids, chunks, out)

    return run


def sparse(chunks: DataFrame, queries: DataFrame, k: int = 5, block: int | None = None) -> DataFrame:
    """Dot product of learned sparse vectors, queries as rows (query_id, term, w), chunks as rows (chunk_id, term, w) or whole, as (chunk_id, entries) with an array
    of (term, w); positive scores only. In tiles (`tiled`), so a frequent term makes no rows for each chunk and query that have it."""
    whole = chunks
    if "entries" not in chunks.columns:
        whole = saved(chunks.filter("term is not null").groupBy("chunk_id").agg(F.collect_list(F.struct("term", "w")).alias("entries")), "vectors")
    asked = queries.filter("term is not null").select("query_id", "term", F.col("w").cast("double").alias("weight"))
    corpus = whole.select("chunk_id", F.col("entries.term").alias("words"), F.col("entries.w").cast("array<double>").alias("weights"))
    schema = StructType([asked.schema["query_id"], corpus.schema["chunk_id"], StructField("score", DoubleType())])
    best = tiled(corpus, whole.count(), asked, asked.select("query_id").distinct().count(), _scorer(k, schema), schema, block)
    return top_k(best.withColumn("score", F.round("score", 6)).filter("score > 0"), k)


def fuse(lists: list[tuple[DataFrame, float]], k: int = 5, rrf_k: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion: the sum of weight / (60 + rank). Ties go by the list that has a chunk first, then its rank."""
    parts = [hits.select("query_id", "chunk_id", (F.lit(float(w)) / (rrf_k + F.col("rank"))).alias("part"), F.struct(F.lit(n).alias("list"), F.col("rank").alias("at")).alias("seen")) for n, (hits, w) in enumerate(lists)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    fused = both.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"), F.min("seen").alias("seen"))
    return top_k(fused, k, "seen", "chunk_id").select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def overlap_score(query: Column, text: Column) -> Column:
    """The stand-in for a cross-encoder: shared distinct characters over the query's and one."""
    a, b = F.array_distinct(F.split(query, "")), F.array_distinct(F.split(text, ""))
    return F.size(F.array_intersect(a, b)) / (F.size(a) + 1)


def rerank(hits: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = 5, score=overlap_score) -> DataFrame:
    """Hits scored anew on the original question; equal scores keep their order. score: a column function of (question, text)."""
    full = hits.select("query_id", "chunk_id", F.col("rank").alias("before")).join(queries.select("query_id", F.col("text").alias("question")), "query_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    return top_k(full.select("query_id", "chunk_id", "before", F.round(score(F.col("question"), F.col("text")), 6).alias("score")), k, "before").drop("before")


def first_of_each(hits: DataFrame, key: str, order: str, *within: str) -> DataFrame:
    """Keeps the first row of each key."""
    return hits.withColumn("__n", F.row_number().over(Window.partitionBy(*within, key).orderBy(order))).filter("__n = 1").drop("__n")


def widen(hits: DataFrame, chunks: DataFrame, before: int = 1, after: int = 1, most: int = 12) -> DataFrame:
    """Each hit with its neighbours in the document, in the hits' order, once each, at most `most` for a query. chunks(chunk_id, doc_id, order)."""
    placed = chunks.select("chunk_id", "doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("order")).alias("at"))
    at = hits.select("query_id", "rank", F.col("chunk_id").alias("hit")).join(placed.withColumnRenamed("chunk_id", "hit"), "hit")
    near = at.select("query_id", "rank", "doc_id", F.explode(F.sequence(F.col("at") - before, F.col("at") + after)).alias("at"))
    met = near.join(placed, ["doc_id", "at"])
    once = met.groupBy("query_id", "chunk_id").agg(F.min(F.struct("rank", "at")).alias("place"))
    return once.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "chunk_id"))).filter(F.col("position") <= most).select("query_id", "chunk_id", "position")


def add_keywords(queries: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """query_id, variant, text: the question, and where a key of the dictionary occurs in it, the question with its words."""
    extra = F.concat_ws(" ", *[F.when(F.instr("text", key) > 0, F.lit(" ".join(words))) for key, words in synonyms.items()])
    both = F.when(extra == "", F.array("text")).otherwise(F.array(F.col("text"), F.concat_ws(" ", "text", extra)))
    return queries.select("query_id", F.posexplode(both).alias("variant", "text"))


def fold_notices(hits: DataFrame, chunks: DataFrame, top_n: int = 10, keep: Column | None = None) -> DataFrame:
    """Documents from chunk hits: score is the sum of 1 / (60 + rank); `keep`, a condition on the documents' columns, applies after ranking
    and does not refill; one row of each notice (revision families by their best). chunks(chunk_id, doc_id, notice_no, ...)."""
    met = hits.join(chunks, "chunk_id").groupBy("query_id", "doc_id", "notice_no").agg(F.sum(1 / (60 + F.col("rank"))).alias("raw"), F.count("*").alias("n_chunks"), F.min("rank").alias("first_rank"))
    if keep is not None:
        met = met.filter(keep)
    best = met.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "notice_no").orderBy(F.col("raw").desc(), "first_rank"))).filter("__n = 1").drop("__n")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("raw").desc(), "first_rank"))).filter(F.col("rank") <= top_n)
    return ranked.select("query_id", "doc_id", "notice_no", F.round("raw", 6).alias("score"), "n_chunks", "rank")


def fit_context(hits: DataFrame, budget: int = 6000, separator: int = 0) -> DataFrame:
    """The longest prefix of each query's hits within `budget` characters of text; the first always stays. hits(query_id, rank, text)."""
    running = F.sum(F.length("text") + separator).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumn("running", running).filter((F.col("running") <= budget) | (F.col("rank") == 1))


def contexts(hits: DataFrame, budget: int = 6000) -> DataFrame:
    """query_id, context, chunks, chars: numbered blocks in the order of rank, separated by rules."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "header", F.lit("\n"), "text")
    fitted = fit_context(hits, budget).withColumn("block", block)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n---\n\n")
    return fitted.groupBy("query_id").agg(joined.alias("context"), F.count("*").alias("chunks")).withColumn("chars", F.length("context"))


def ranks_of_gold(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, rank: of the first hit that is gold; null where none is. gold(query_id, chunk_id)."""
    found = hits.join(gold, ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return gold.select("query_id").distinct().join(found, "query_id", "left")


def metrics(ranks: DataFrame, *by: str, k: int = 5, mrr_k: int = 10) -> DataFrame:
    """Hit rate at k, mean reciprocal rank at mrr_k, share of first places, questions. Every question counts."""
    at = F.col("rank")
    return ranks.groupBy(*by).agg(F.round(F.avg(F.when(at <= k, 1.0).otherwise(0.0)), 3).alias("hit_rate"), F.round(F.avg(F.when(at <= mrr_k, 1 / at).otherwise(0.0)), 3).alias("mrr"), F.round(F.avg(F.when(at == 1, 1.0).otherwise(0.0)), 3).alias("top1"), F.count("*").alias("questions"))


def holding(chunks: DataFrame, needles: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of the chunks(chunk_id, text) that contain a needle(query_id, text) literally. They meet by the needle's rarest whole word,
    one that white space or the needle's border does not cut, so no needle is held against every chunk; needles without one meet all by substring."""
    inner = lambda t: F.slice(F.split(t, r"\s+"), 2, F.greatest(F.size(F.split(t, r"\s+")) - 2, F.lit(0)))
    words = needles.select("query_id", F.explode(F.array_distinct(F.filter(inner(F.col("text")), lambda w: w != ""))).alias("term"))
    index = chunks.select("chunk_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("term")).join(words.select("term").distinct(), "term", "left_semi")
    frequency = index.groupBy("term").agg(F.count("*").alias("df"))
    rarest = words.join(frequency, "term", "left").groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    met = index.join(rarest, "term").join(needles.select("query_id", F.col("text").alias("needle")), "query_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    bare = needles.join(words, "query_id", "left_anti").filter(F.length("text") > 0).select("query_id", F.col("text").alias("needle"))
    rest = chunks.join(bare, F.expr("contains(text, needle)"))
    return met.filter(F.expr("contains(text, needle)")).select("query_id", "chunk_id").unionByName(rest.select("query_id", "chunk_id"))
