"""Operators that examine a corpus, its evaluation set and its dictionary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .retrieval import holding
from .splitting import sliding_pieces


def mined_keywords(chunks: DataFrame, synonyms: dict[str, list[str]], token: Column, top: int = 5, least: int = 20, low: float = 0.002, high: float = 0.25, seed_max: float = 0.25, slice_max: float = 0.35) -> DataFrame:
    """key, term, df_in, lift, rank: for each key, terms that stand out in the chunks that literally contain one of its seeds. Seeds in
    over seed_max of the chunks are not used; slices of under `least` chunks or over slice_max of them give nothing. The dictionary is
    the caller's and small; chunks are read three times (seeds, slices, frequencies) and only counts are shuffled."""
    pairs = [(k, w) for k, words in synonyms.items() for w in words]
    flags = chunks.agg(F.count("*").alias("n"), *[F.count(F.when(F.contains("text", F.lit(w)), 1)).alias(f"s{i}") for i, (_, w) in enumerate(pairs)]).first()
    n = max(flags["n"], 1)
    seeds: dict[str, list[str]] = {}
    for i, (k, w) in enumerate(pairs):
        if flags[f"s{i}"] / n <= seed_max:
            seeds.setdefault(k, []).append(w)
    keys = F.array(*[F.when(F.array(*map(F.lit, ws)).isNotNull() & F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(F.col("text"), w)), k) for k, ws in seeds.items()]) if seeds else F.array().cast("array<string>")
    sliced = chunks.select(F.filter(keys, lambda x: x.isNotNull()).alias("keys"), F.array_distinct(token).alias("terms"))
    sizes = sliced.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("size")).filter((F.col("size") >= least) & (F.col("size") / n <= slice_max))
    frequency = sliced.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).filter((F.col("df") / n >= low) & (F.col("df") / n <= high))
    inside = sliced.filter(F.size("keys") > 0).select("keys", F.explode("terms").alias("term")).select(F.explode("keys").alias("key"), "term").groupBy("key", "term").agg(F.count("*").alias("df_in")).filter(F.col("df_in") >= least)
    scored = inside.join(F.broadcast(sizes), "key").join(frequency, "term").withColumn("lift", F.round(F.col("df_in") * n / (F.col("size") * F.col("df")), 6))
    best = Window.partitionBy("key").orderBy(F.col("lift").desc(), F.col("df_in").desc(), F.col("term").desc())
    return scored.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= top).select("key", "term", "df_in", "lift", "rank")


def fire_rate(queries: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """key, fired, share: in how many queries each key of the dictionary occurs."""
    one = queries.agg(F.count("*").alias("n"), *[F.count(F.when(F.contains("text", F.lit(k)), 1)).alias(f"k{i}") for i, k in enumerate(synonyms)])
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"k{i}").alias("fired"), F.round(F.col(f"k{i}") / F.col("n"), 4).alias("share")) for i, k in enumerate(synonyms)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def dictionary_use(pairs: DataFrame, synonyms: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """What a dictionary does to questions, of pairs(query_id, text, kind, gold): (kind, asked, fired, share) and a row with the kind null for all, and (word, useful, wasted, share): in
    how many questions that a key fires in the word that it adds is in the gold text, and in how many not. A question adds a word once. Null kinds are the kind ''."""
    added = F.array_distinct(F.flatten(F.array(*[F.when(F.contains("text", F.lit(k)), F.array(*map(F.lit, words))).otherwise(F.array().cast("array<string>")) for k, words in synonyms.items()])))
    fired = F.coalesce(F.exists(F.array(*map(F.lit, synonyms)), lambda k: F.contains(F.col("text"), k)), F.lit(False))
    rows = pairs.select(F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("gold", F.lit("")).alias("gold"), fired.alias("fires"), F.coalesce(added, F.array().cast("array<string>")).alias("words"))
    share = lambda a, b: F.round(F.col(a) / b, 4).alias("share")
    by_kind = rows.rollup("kind").agg(F.count("*").alias("asked"), F.count_if("fires").alias("fired")).select("kind", "asked", "fired", share("fired", F.col("asked")))
    each = rows.select("gold", F.explode("words").alias("word")).groupBy("word").agg(F.count_if(F.contains("gold", F.col("word"))).alias("useful"), F.count("*").alias("n"))
    return by_kind, each.select("word", "useful", (F.col("n") - F.col("useful")).alias("wasted"), share("useful", F.col("n")))


def pruned(dictionary: DataFrame, frequency: DataFrame, dead_share: float = 0.3) -> DataFrame:
    """key, words, gone of dictionary(key, word, place) by frequency(term, df, n): words stay in their order if some chunk has them and at most dead_share of all do, each once;
    keys of which no word is left go."""
    met = dictionary.join(frequency.select(F.col("term").alias("word"), "df", "n"), "word", "left")
    once = met.withColumn("alive", F.coalesce((F.col("df") > 0) & (F.col("df") / F.col("n") <= dead_share), F.lit(False))).groupBy("key", "word", "alive").agg(F.min("place").alias("place"))
    listed = lambda on: F.transform(F.array_sort(F.collect_list(F.when(on, F.struct("place", "word")))), lambda x: x["word"])
    return once.groupBy("key").agg(listed(F.col("alive")).alias("words"), listed(~F.col("alive")).alias("gone")).filter(F.size("words") > 0)


#: So many ranges at most that names are sorted into, and so many keys for each that settle where ranges end.
RANGES, DRAWN = 1024, 16


def prefixed(stems: DataFrame, known: DataFrame) -> DataFrame:
    """stem, least, most: of distinct stems(stem) the smallest and largest doc_id of known(key, doc_id) whose key begins with it; none without such a key. Keys and stems are sorted
    together into ranges of about equal size, whatever they begin with, and each is read once: keys that begin with a stem follow it. A stem goes to every range that
    its keys may lie in; keys that several documents have are one row."""
    keys = known.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    n = min(RANGES, int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    drawn = sorted(r["key"] for r in keys.select("key").orderBy(F.xxhash64("key"), "key").limit(n * DRAWN).collect())  # RANGES * DRAWN at most
    ends = np.array(drawn[DRAWN::DRAWN], object)
    kind = known.schema["doc_id"].dataType.simpleString()

    @F.pandas_udf("int")
    def range_of(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, values.to_numpy(object), side="right").astype(np.int32))

    last = F.concat("stem", F.lit(chr(0x10FFFF)))
    asked = stems.filter("stem <> ''").select("stem", range_of("stem").alias("low"), range_of(last).alias("high")).select("stem", F.explode(F.sequence("low", "high")).alias("range"))
    null = F.lit(None).cast(kind)
    both = keys.select(range_of("key").alias("range"), F.col("key").alias("value"), F.lit(True).alias("key"), "least", "most").unionByName(asked.select("range", F.col("stem").alias("value"), F.lit(False).alias("key"), null.alias("least"), null.alias("most")))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A stack of stems, each beginning with the one below; what is learned of one goes to the one below when it ends."""
        stack, at = [], None

        def ended(out: list, upto) -> None:
            while stack and not upto(stack[-1][0]):
                stem, low, high = stack.pop()
                if low is not None:
                    out.append((stem, low, high))
                    if stack:
                        _widen(stack[-1], low, high)

        for b in batches:
            out = []
            for range_, value, is_key, low, high in b.itertuples(index=False):
                if range_ != at:
                    ended(out, lambda stem: False)
                    at = range_
                ended(out, value.startswith)
                if is_key:
                    if stack:
                        _widen(stack[-1], low, high)
                else:
                    stack.append([value, None, None])
            yield pd.DataFrame(out, columns=["stem", "least", "most"])
        out = []
        ended(out, lambda stem: False)
        yield pd.DataFrame(out, columns=["stem", "least", "most"])

    # At equal values the stem comes first. Batches hold no nulls of ids but in rows of stems, which none reads.
    dealt = both.repartition(n, "range").sortWithinPartitions("range", "value", "key").select("range", "value", "key", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("least", "most")])
    whole = kind in ("bigint", "int", "smallint", "tinyint")
    dealt = dealt.withColumns({c: F.when(F.col("key"), F.col(c).cast("long")).otherwise(0) for c in ("least", "most")}) if whole else dealt
    met = dealt.mapInPandas(walk, f"stem string, least {'long' if whole else 'string'}, most {'long' if whole else 'string'}")
    return met.groupBy("stem").agg(F.min("least").cast(kind).alias("least"), F.max("most").cast(kind).alias("most"))


def _widen(top: list, low, high) -> None:
    top[1] = low if top[1] is None else min(top[1], low)
    top[2] = high if top[2] is None else max(top[2], high)


def resolved(names: DataFrame, known: DataFrame) -> DataFrame:
    """name, doc_id, reason of names(name) against known(key, doc_id): exact, prefix (the only document whose key begins with it), ambiguous or none.
    Ids are whole numbers or strings."""
    stem = F.regexp_replace("name", r"(?<=.)\.[^.]*$", "")
    asked = names.select("name", stem.alias("stem")).distinct()
    exact = asked.select("name", F.explode(F.array_distinct(F.array("name", "stem"))).alias("key")).join(known, "key").groupBy("name").agg(F.min_by("doc_id", F.when(F.col("key") == F.col("name"), 0).otherwise(1)).alias("exact"))
    out = asked.join(exact, "name", "left").join(prefixed(asked.select("stem").distinct(), known), "stem", "left")
    one = F.col("least") == F.col("most")
    return out.select(
        "name", F.coalesce("exact", F.when(one, F.col("least"))).alias("doc_id"),
        F.when(F.col("exact").isNotNull(), "exact").when(one, "prefix").when(F.col("least").isNotNull(), "ambiguous").otherwise("none").alias("reason"),
    )


def owners(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, owners, verdict of pairs(item_id, question, keyword) over docs(doc_id, text): empty, duplicate, not in corpus, ambiguous (several
    documents) or kept. Keywords meet the documents that have their rarest word (`holding`)."""
    asked = pairs.withColumn("n", F.row_number().over(Window.partitionBy("question").orderBy("item_id")))
    needles = asked.filter(F.length(F.trim("keyword")) > 0).select(F.col("item_id").alias("query_id"), F.col("keyword").alias("text"))
    met = holding(docs.select(F.col("doc_id").alias("chunk_id"), "text"), needles)
    found = met.groupBy(F.col("query_id").alias("item_id")).agg(F.countDistinct("chunk_id").alias("owners"))
    out = asked.join(found, "item_id", "left").withColumn("owners", F.coalesce("owners", F.lit(0)))
    blank = F.coalesce(F.length(F.trim("keyword")), F.lit(0)) == 0
    return out.select("item_id", "owners", F.when(blank, "empty").when(F.col("n") > 1, "duplicate").when(F.col("owners") == 0, "not in corpus").when(F.col("owners") > 1, "ambiguous").otherwise("kept").alias("verdict"))


def survival(pairs: DataFrame, pieces: DataFrame) -> DataFrame:
    """kind, asked, survived: of pairs(kind, doc_id, keyword) whose keyword is, white space aside, in the pieces(doc_id, order, text) of their own document, joined in
    order. Blank keywords are not asked."""
    asked = pairs.filter(F.length(T.squeeze(F.col("keyword"))) > 0).select("kind", "doc_id", "keyword")
    wanted = pieces.join(asked.select("doc_id").distinct(), "doc_id", "left_semi")
    bodies = wanted.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "text"))), lambda x: x["text"]), "").alias("body"))
    hit = F.contains(T.squeeze(F.coalesce("body", F.lit(""))), T.squeeze(F.col("keyword")))
    return asked.join(bodies, "doc_id", "left").groupBy("kind").agg(F.count("*").alias("asked"), F.count_if(hit).alias("survived"))


def line_keep_rate(plain: DataFrame, other: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, lines, kept, rate: distinct trimmed lines of at least `least` characters that the other extraction has too."""
    lines = lambda df: df.select("doc_id", F.explode(F.array_distinct(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)))).alias("line")).filter(F.length("line") >= least)
    both = lines(plain).withColumn("a", F.lit(1)).join(lines(other).withColumn("b", F.lit(1)), ["doc_id", "line"], "left")
    return both.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count("b").alias("kept"), F.round(F.count("b") / F.count("*"), 6).alias("rate"))


def failures(gold: DataFrame, hits: DataFrame, budgeted: DataFrame, asked: DataFrame) -> DataFrame:
    """kind, n: hit, no gold in corpus, over budget (ranked but not in the context) or outside candidates, of asked(query_id)."""
    has = gold.select("query_id").distinct().withColumn("g", F.lit(1))
    ranked = hits.join(gold, ["query_id", "chunk_id"], "left_semi").select("query_id").distinct().withColumn("r", F.lit(1))
    shown = budgeted.join(gold, ["query_id", "chunk_id"], "left_semi").select("query_id").distinct().withColumn("s", F.lit(1))
    kinds = asked.select("query_id").join(has, "query_id", "left").join(ranked, "query_id", "left").join(shown, "query_id", "left")
    kind = F.when(F.col("s") == 1, "hit").when(F.col("g").isNull(), "no gold in corpus").when(F.col("r") == 1, "over budget").otherwise("outside candidates")
    return kinds.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def paired(a: DataFrame, b: DataFrame, keyword: Column) -> DataFrame:
    """kind, n, mean_a, mean_b, hits_a, hits_b, lost, gained of contexts a and b (query_id, kind, context) of the same questions."""
    both = a.select("query_id", "kind", F.col("context").alias("ca")).join(b.select("query_id", F.col("context").alias("cb")), "query_id")
    ha, hb = F.contains("ca", keyword), F.contains("cb", keyword)
    one = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg(F.length("ca")), 3).alias("mean_a"), F.round(F.avg(F.length("cb")), 3).alias("mean_b"), one(ha, "hits_a"), one(hb, "hits_b"), one(ha & ~hb, "lost"), one(~ha & hb, "gained"))


def extraction_report(docs: DataFrame, weak: int = 1000) -> DataFrame:
    """extractor, docs, shortest, longest, mean_chars, weak, ratio of docs(extractor, text, stated): length against the stated length, at most 1."""
    n, stated = F.length("text"), F.length("stated")
    ratio = F.least(F.when(stated > 0, n / stated), F.lit(1.0))
    return docs.groupBy("extractor").agg(F.count("*").alias("docs"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"), F.round(F.avg(n), 3).alias("mean_chars"), F.count(F.when(n < weak, 1)).alias("weak"), F.round(F.avg(ratio), 4).alias("ratio"))


def headings(docs: DataFrame, patterns=T.HEADINGS, max_level: int = 2) -> DataFrame:
    """doc_id, pos (characters before the line), level, title of heading lines."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    at = lines.withColumn("pos", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))
    kept = [(level, p) for level, p in patterns if level <= max_level]
    return at.withColumn("level", T.heading_level(F.col("line"), kept)).filter("level is not null").select("doc_id", "pos", "level", F.trim("line").alias("title"))


def sections(docs: DataFrame, patterns=T.HEADINGS, max_level: int = 2, least: int = 30, first: str = "본문", size: int | None = None, overlap: int = 150) -> DataFrame:
    """doc_id, order, section, text: documents cut at their headings; what comes before the first is `first`, bodies under `least` characters go. With a size, bodies
    beyond it are cut again (`splitting.sliding_pieces`); the order counts all pieces of a document."""
    starts = headings(docs, patterns, max_level).select("doc_id", "pos", "title").unionByName(docs.select("doc_id", F.lit(0).cast("long").alias("pos"), F.lit(first).alias("title")))
    by = Window.partitionBy("doc_id").orderBy("pos", F.col("title") != first)
    cut = starts.withColumn("stop", F.lead("pos").over(by)).filter("stop is null or stop > pos")
    body = cut.join(docs.select("doc_id", "text"), "doc_id").withColumn("text", F.trim(F.expr("substr(text, int(pos + 1), int(coalesce(stop, length(text)) - pos))"))).filter(F.length("text") >= least)
    if size is not None:
        pieces = F.when(F.length("text") > size, sliding_pieces(F.col("text"), size, overlap)).otherwise(F.array("text"))
        body = body.select("doc_id", "pos", "title", F.posexplode(pieces).alias("piece", "text"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", *(["piece"] if size is not None else []))) - 1
    return body.select("doc_id", order.cast("long").alias("order"), F.col("title").alias("section"), "text")


def field_pairs(docs: DataFrame, fields: list[tuple[str, str, str]], most: int = 2) -> DataFrame:
    """doc_id, field, answer: the first `most` fields in order of (name, label, value pattern) that docs(doc_id, text) state as `label: value`."""
    found = []
    for name, label, value in fields:
        answer = F.regexp_replace(F.trim(F.regexp_extract("text", rf"(?:{label})\s*[:：]\s*({value})", 1)), r"[.,]+$", "")
        found.append(F.when(F.length(answer) >= 2, F.struct(F.lit(name).alias("field"), answer.alias("answer"))))
    return docs.select("doc_id", F.explode(F.slice(F.filter(F.array(*found), lambda x: x.isNotNull()), 1, most)).alias("x")).select("doc_id", "x.field", "x.answer")
