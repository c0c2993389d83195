"""What a step reads, sends or holds must not grow faster than its input."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gleanspark.functions import cleaning, models, text
from gleanspark.operators import chunking, filters, grounding, indexes, retrieval, search


def test_contents_are_told_once(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choice("가b) \t.1234-!") for _ in range(rng.randrange(0, 130))) for _ in range(3000)] + ["a" + "-" * n + " 12" for n in (59, 60, 61)]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", cleaning._page_refs(F.col("line")).alias("n")).collect()
    pattern = re.compile(cleaning.PAGE_REF, re.ASCII)
    assert all(r.n == len(pattern.findall(r.line)) for r in got) and sum(r.n for r in got) > 1000
    rows = spark.createDataFrame([("a", "목 차\n1. x\t1\n" + "본문 " * 40)], "chunk_id string, text string")
    plan = filters.drop_contents(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\d{1,3}") <= 2


def test_sparse_vectors_meet_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PER_TILE", 64)
    rng = random.Random(5)
    rows = [(f"c{n:03}", " ".join(rng.choice(["the", "of", "aa", "bb", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(0, 30)))) for n in range(300)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string").select("chunk_id", text.tokens(F.col("text")).alias("words"))
    q = spark.createDataFrame([(k, w, float(k + 1)) for k in range(5) for w in ("the", "of", f"w{k}", None)], "query_id int, term string, w double")
    whole, apart = indexes.vectors(chunks, "chunk_id", F.length), indexes.weighted(chunks, "chunk_id", F.length("term"))
    hits = lambda df: sorted(map(tuple, df.collect()))
    found = retrieval.sparse(whole, q, 4)
    want = apart.join(q.withColumnRenamed("w", "qw"), "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("qw") * F.col("w")), 6).alias("score"))
    assert hits(found) == hits(retrieval.sparse(apart, q, 4)) == hits(retrieval.top_k(want, 4)) != []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate explode(entries" not in plan


def test_word_counts(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["가", "a"])], "id int, words array<string>").repartition(1)
    got = {r.id: sorted(map(tuple, r.n or [])) for r in rows.select("id", text.word_counts(F.col("words")).alias("n")).collect()}
    assert got == {1: [("a", 1), ("b", 2)], 2: [], 3: [], 4: [("a", 1), ("가", 1)]}


def test_scope_goes_to_the_tiles(spark):
    chunks = spark.createDataFrame([(f"c{n}", "one two " + "three " * n) for n in range(9)] + [(f"x{n}", "other words") for n in range(20)], "chunk_id string, text string")
    q = spark.createDataFrame([(1, "three"), (2, "three two"), (3, "nothing")], "query_id long, text string")
    scope = spark.createDataFrame([(1, "c2"), (1, "c3"), (1, "c3"), (2, "c8"), (2, "missing"), (3, "c1")], "query_id int, chunk_id string")
    found = retrieval.bm25(chunks, q, 5, scope)
    everything = retrieval.bm25(chunks, q, 100).drop("rank").join(scope.distinct(), ["query_id", "chunk_id"], "left_semi")
    assert sorted((r.query_id, r.chunk_id, r.score) for r in found.collect()) == sorted((r.query_id, r.chunk_id, r.score) for r in everything.collect()) != []
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroups")[0]


def test_whole_texts_go_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text")).coalesce(1)
    chunking.chunked(docs)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_vectors_of_a_model_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)
    count = F.udf(lambda t: made.add(1) or [float(len(t)), 1.0], "array<double>").asNondeterministic()
    rows = spark.createDataFrame([(f"c{n}", "x" * n) for n in range(40)], "chunk_id string, text string").select("chunk_id", count("text").alias("v"))
    plain = F.udf(lambda t: [float(len(t)), 1.0], "array<double>")
    found = search.dense(rows, plain)
    q = spark.createDataFrame([(1, "x" * 7)], "query_id long, text string")
    assert [r.chunk_id for r in found(q, 1).collect()] == [r.chunk_id for r in found(q, 1).collect()] == ["c7"]
    assert made.value == 40


def test_trigrams_are_those_of_a_plain_count():
    texts = ["", None, "ab", "Abcabc", "가나다라 ㄱ", "😀a😀b" * 3, "İstanbul", "x" * 300_000]
    for t, v in zip(texts, models.hashed_trigrams(texts, dtype=np.float64)):
        plain, low = np.zeros(models.DIM), (t or "").lower()
        for i in range(len(low) - 2):
            plain[int.from_bytes(hashlib.md5(low[i : i + 3].encode()).digest()[:4], "little") % models.DIM] += 1
        assert np.array_equal(v, plain / np.linalg.norm(plain) if plain.any() else plain)


def test_noise_is_that_of_the_pattern():
    rng, kinds = random.Random(1), grounding.kinds_of_noise()
    for _ in range(5000):
        t = "".join(rng.choice("ab p.P3٣𝟎4-_=| \n()쪽각é") for _ in range(rng.randrange(0, 60)))
        assert grounding.noise_in(t, np.frombuffer(t.encode("utf-32-le"), np.uint32), grounding.NOISE, kinds) == [m.span() for m in grounding.NOISE.finditer(t)]


def test_candidates_of_runs_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)
    count = F.udf(lambda k: made.add(1) or k, "long").asNondeterministic()
    candidates = spark.range(40).select(count("id").alias("item_id"), F.lit(1).cast("long").alias("doc_id"))
    evidence = spark.range(40).select(F.col("id").alias("item_id"), F.lit("some words of it").alias("evidence"))
    docs = spark.createDataFrame([(1, "here are some words of 3")], "doc_id long, text string")
    assert {r.run for r in grounding.longest(candidates, evidence, docs).collect()} == {"some words of"}
    assert made.value == 40


def test_documents_with_short_runs_are_not_searched_for_long_ones(spark, monkeypatch):
    rng = random.Random(2)
    evidence = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60))
    # Each seed's first document has a run of seven characters alone.
    texts = [(k, f"#{evidence[k : k + 7]}#") for k in range(54)] + [(60, evidence[:40]), (70, f"x {evidence} x"), (71, evidence), (80, evidence[20:-1]), (90, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sizes, plain = [], grounding.longest
    monkeypatch.setattr(grounding, "longest", lambda candidates, *a: sizes.append(candidates.count()) or plain(candidates, *a))
    found = grounding.best_elsewhere(spark.createDataFrame([(1, evidence)], "item_id long, evidence string"), docs)
    assert [tuple(r) for r in found.collect()] == [(1, 70, evidence)]
    assert sizes[-1] <= 4


def test_frequencies_of_seeds(spark, monkeypatch):
    monkeypatch.setattr(grounding, "MOST", 50)
    rng = random.Random(4)
    texts = {f"d{k}": "".join(rng.choice("ab c") for _ in range(rng.randrange(0, 80))) for k in range(60)} | {"n": None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string").coalesce(2)
    asked = grounding.seeds(docs.filter("doc_id < 'd3'"), ["doc_id"], "text", 4)
    got = {(r.a, r.b): (r.n, r.some_doc) for r in grounding.frequencies(asked, docs, 4).collect()}
    of = {d: {(a, b) for a, b in zip(*(x.tolist() for x in grounding.seeds_of(t or "", 4, None, False)[:2]))} for d, t in texts.items()}
    want = {s for d in texts if d < "d3" for s in of[d]}
    assert got == {s: (sum(s in v for v in of.values()), min(d for d, v in of.items() if s in v)) for s in want} != {}
    assert sum(len(x) for x in got) > 20


def test_counts_of_seeds_are_added_up_before_they_are_sent(spark, monkeypatch):
    docs, made = spark.createDataFrame([(k, "the same words") for k in range(3000)], "doc_id long, text string").coalesce(1), []
    asked, plain = grounding.seeds(docs.limit(1), ["doc_id"], "text"), type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: made.append(plain(self, f, schema)) or made[-1])
    found = {(r.n, r.some_doc) for r in grounding.frequencies(asked, docs, grounding.WIDTH).collect()}
    assert found == {(3000, 0)} and made[-1].count() == len("the same words") - 5


def test_seeds_are_sent_in_bounded_batches(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    monkeypatch.setattr(grounding, "MOST", 100)
    docs, made = spark.createDataFrame([(1, "abc def " * 200), (2, "abcdefgh")], "doc_id long, text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: made.append(f) or self)
    grounding.seeds(docs, ["doc_id"], "text")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    sent = list(made[0](iter([pa.record_batch([pa.array([1, 2]), pa.array(["abc def " * 200, "abcdefgh"])], names=["doc_id", "text"])])))
    assert sum(x.num_rows for x in sent) == 1595 + 3 and max(x.num_rows for x in sent) <= 200
