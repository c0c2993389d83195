"""Whitening, byte-level BPE and periodic runs against plain versions, and on awkward rows."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gleanspark.llm import bpe, periodic, whitening

SF = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
CLASHING = "key text ids n_tokens decoded runs best collapsed x node sums d group component n"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# op11


def plain_whitening(vectors):
    """n, sums, falling eigenvalues, vectors as columns, trace: of the distinct whole-number vectors, by LAPACK."""
    x = np.unique(vectors, axis=0)
    n, s = len(x), x.sum(axis=0)
    off = (x * n - s) / n
    values, columns = np.linalg.eigh(off.T @ off / n)
    return n, s, values[::-1], columns[:, ::-1], np.trace(off.T @ off / n)


def test_whitening_against_lapack(spark):
    e = table(spark, "embeddings").toPandas()
    x = np.stack([np.floor(64 * np.asarray(v, float)).astype(np.int64) + 1_000_000 for v in e.embedding])
    n, s, values, columns, trace = plain_whitening(x)
    got = entry.queries()["op11_whitening"](spark, SF).toPandas()
    assert list(got.columns[:7]) == "vec_id component n deviation whitened explained identity_error".split() and len(got) == 16 * len(e) and set(got.n) == {n}
    white = got.pivot(index="vec_id", columns="component", values="whitened").loc[e.vec_id].to_numpy()
    want = (x * n - s) / n @ columns[:, :16] / np.sqrt(values[:16])
    assert np.abs(white * np.sign((white * want).sum(axis=0)) - want).max() < 1e-9
    assert (got.groupby("vec_id").deviation.first().loc[e.vec_id].to_numpy() == ((x * n - s) ** 2).sum(axis=1)).all()
    assert np.allclose(got.groupby("component").explained.first(), values[:16] / trace, rtol=1e-12) and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1


@pytest.mark.parametrize("d", [1, 2, 3, 7, 40])
def test_qr_steps(d):
    r = np.random.default_rng(d)
    for a in (r.normal(size=(d, d)), np.diag(r.integers(0, 3, d)).astype(float), np.ones((d, d)), np.zeros((d, d))):
        a = a + a.T
        values, vectors = whitening.eigen(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * max(1, np.abs(a).max()) * d) and np.allclose(vectors @ vectors.T, np.eye(d), atol=1e-12) and np.allclose(vectors.T @ np.diag(values) @ vectors, a, atol=1e-11)


def test_welford_far_from_zero_and_merged():
    r = np.random.default_rng(1)
    x = r.integers(0, 50, (900, 5)) + 10**9
    parts = [whitening.welford(x[a:b], None) for a, b in ((0, 1), (1, 300), (300, 900))]
    m = parts[0].merged(parts[1]).merged(parts[2])
    off = (x * 900 - x.sum(axis=0)) / 900
    assert m.n == 900 and (m.sums == x.sum(axis=0)).all() and np.allclose(m.comoment, off.T @ off, rtol=1e-13)


def test_whitening_tree_of_many_partitions(spark):
    """More partitions than one merge takes; copies don't weigh; a third of all rows are one vector."""
    r = np.random.default_rng(2)
    v = r.normal(size=(300, 4)).astype(np.float32)
    rows = [(k, [float(c) for c in x]) for k, x in enumerate(v)] + [(1000 + k, [float(c) for c in v[0]]) for k in range(150)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(20)).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    x = np.floor(64 * np.asarray(v, float)).astype(np.int64) + 1_000_000
    n, s, values, columns, trace = plain_whitening(x)
    assert set(got.n) == {n} and len(got) == 450 * 4 and got.identity_error.max() < 1e-9
    one = got[got.vec_id == 7].sort_values("component").whitened.to_numpy()
    assert np.allclose(np.abs(one), np.abs((x[7] * n - s) / n @ columns / np.sqrt(values)), rtol=1e-9)


def test_whitening_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [3.0, -1.0]), (2, [3.0, -1.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, []), (8, [1.0]), (None, [0.5, 0.5]), (9, [1e300, 0.0])]
    frame = spark.createDataFrame([(*r, *[c for c in CLASHING.split()]) for r in rows], "vec_id long, embedding array<double>, " + ", ".join(f"{c} string" for c in CLASHING.split()))
    got = whitening.whitened(frame).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2)] and {r.n for r in got} == {3}
    assert whitening.whitened(frame.limit(0)).count() == 0 and whitening.whitened(frame.filter("vec_id = 1")).count() == 0
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 7.0]) for k in range(9)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whitened(line).collect()} == {1}  # one direction has variance


def test_deviations_beyond_a_long_are_null():
    w = whitening.Whitening(10**10, np.array([0, 0]), np.array([1.0]), np.array([[1.0, 0.0]]), 1.0)
    white, square = w.apply(np.array([[10**6, 0], [0, 0]]))
    assert square == [None, 0] and white[0, 0] == 10**6


# op12


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.build(bpe.load(FILE))


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load(FILE), special_tokens={})


def test_perfect_hash(codec):
    """Every token has a slot of its own, and strangers are told apart."""
    ranks = bpe.load(FILE)
    assert len(codec.keys) == len(codec.hashes) == len(ranks) and set(codec.keys) == set(ranks)
    assert codec.find_all(list(ranks)).tolist() == list(ranks.values()) and all(codec.find(t) == r for t, r in list(ranks.items())[::50])
    strangers = [t + b"~q" for t in list(ranks)[:5000]]
    assert all(x == ranks.get(s, -1) for x, s in zip(codec.find_all(strangers).tolist(), strangers)) and codec.find(b"never seen") == -1
    with pytest.raises(ValueError):
        bpe.Codec.build({b"a": 0})
    with pytest.raises(ValueError):
        bpe.Codec.build({bytes([b]): b % 255 for b in range(256)})


def test_heap_merges_as_the_rule_says(codec):
    """Against merging the lowest of all pairs again and again."""
    ranks, r, merger = bpe.load(FILE), random.Random(5), bpe.Merger(codec)
    for _ in range(400):
        piece = bytes(r.choice(b"aaathei nrsq\xc3\xa9\xff") for _ in range(r.randint(1, 40)))
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert merger.merged(piece) == [ranks[p] for p in parts]


def test_bpe_query_against_tiktoken(spark, plain):
    got = entry.queries()["op12_bpe"](spark, SF).toPandas().set_index("doc_id")
    docs = table(spark, "documents").toPandas()
    assert list(got.columns) == ["n_tokens", "ids_sha256", "decoded_sha256"] and len(got) == len(docs)
    for i, t in zip(docs.doc_id, docs.text):
        ids = plain.encode_ordinary(t or "")
        assert tuple(got.loc[i]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_bpe_odd(spark, codec, plain, monkeypatch):
    texts = [None, "", " ", "\n \t  x  y\x85z", "<|endoftext|>", "we'll I'D they've", "日本語 😀😀 ñandú ½ ٣", "a" * 3000, "the quick " * 20_000, "x" + " " * 500, "é‍\U0001f468‍\U0001f469", "\x00\x1c\x1f"]
    frame = spark.createDataFrame([(k, t, *CLASHING.split()[2:]) for k, t in enumerate(texts + texts)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING.split()[2:]))
    for long in (bpe.LONG, 10):
        monkeypatch.setattr(bpe, "LONG", long)
        made = bpe.decode(bpe.encode(frame, codec, public_tokenizers.PATTERN), codec).toPandas().set_index("doc_id")
        for k, t in enumerate(texts + texts):
            assert np.frombuffer(made.ids[k], "<u4").tolist() == plain.encode_ordinary(t or "") and made.decoded[k] == (t or "").encode() and made.n_tokens[k] == len(made.ids[k]) // 4
    assert bpe.round_trip(frame.limit(0), codec, public_tokenizers.PATTERN).count() == 0
    nothing = bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), codec).first()
    assert nothing.decoded is None
    with pytest.raises(Exception, match="no id"):
        bpe.decode(spark.createDataFrame([(1, (60_000).to_bytes(4, "little"))], "doc_id long, ids binary"), codec).collect()


def test_remembered_pieces_are_bounded(codec, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    merger = bpe.Merger(codec)
    first = [merger.ids(b"zq%dxj" % k) for k in range(10)]
    assert len(merger.known) <= 3 and first == [merger.merged(b"zq%dxj" % k) for k in range(10)]


# op13


def plain_runs(words, least=24, power=3):
    """All (start, length, period), by definition."""
    number = {}
    x = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    out = []
    for p in range(1, len(x) // power + 1):
        same = np.diff(np.concatenate([[0], (x[p:] == x[:-p]).astype(int), [0]]))
        for s, t in zip(np.flatnonzero(same == 1).tolist(), np.flatnonzero(same == -1).tolist()):
            part = x[s : t + p]
            if len(part) >= max(least, power * p) and not any((part[q:] == part[:-q]).all() for q in range(1, p)):
                out.append((s, t - s + p, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_definition():
    r = random.Random(1)
    for _ in range(300):
        least, power = r.choice([(1, 2), (4, 2), (6, 3), (24, 3)])
        docs = []
        for _ in range(r.randint(1, 5)):
            n, k = r.randint(0, 70), r.choice([1, 2, 3, 5])
            w = [r.randrange(k) for _ in range(n)]
            if n > 6 and r.random() < 0.5:
                a = r.randrange(n)
                p = 1 + (n - a) // 3
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(np.array(w, np.int64))
        of, *rest = periodic.runs(docs, least, power)
        got = [[] for _ in docs]
        for d, *run in zip(of.tolist(), *(x.tolist() for x in rest)):
            got[d].append(tuple(run))
        assert got == [plain_runs(d.tolist(), least, power) for d in docs]


def test_suffix_ranks_and_common_prefixes():
    r = np.random.default_rng(3)
    for n in (1, 2, 40, 200):
        x = np.append(r.integers(0, 2, n), 9)
        ext = periodic.Extensions(x)
        suffixes = [x[i:].tolist() for i in range(len(x))]
        assert sorted(range(len(x)), key=lambda i: suffixes[i]) == np.argsort(ext.rank).tolist()
        i, j = (a.reshape(-1) for a in np.meshgrid(np.arange(len(x)), np.arange(len(x))))
        i, j = i[i != j], j[i != j]
        share = lambda a, b: next((k for k, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
        assert ext.shared(i, j).tolist() == [share(suffixes[a], suffixes[b]) for a, b in zip(i, j)]


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, k, p in runs for i in range(s + p, s + k)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{k},{p}\n" for s, k, p in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_periodic_query_against_plain(spark):
    got = {r.doc_id: tuple(r)[1:] for r in entry.queries()["op13_periodic"](spark, SF).collect()}
    docs = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    assert len(got) == len(docs) and sum(r[0] > 0 for r in got.values()) > 10
    for i, t in docs:
        if len((t or "").split()) < 3000:
            assert got[i] == plain_row(i, t)


def test_periodic_odd(spark):
    texts = [None, "", " \n", "one", "a " * 24, "a " * 23, "x y z " * 8 + "x", "a b " * 6 + "q " + "a b " * 12, "la " * 50_000, "é é é é " * 20]
    rows = [(k, t, *CLASHING.split()[2:]) for k, t in enumerate(texts)] * 2 + [(None, "p q r s " * 9, *CLASHING.split()[2:])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING.split()[2:]))
    got = periodic.digests(frame.withColumn("text", periodic.planted(F.col("text"), F.col("doc_id")))).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "p q r s " * 9 if r.doc_id is None else texts[r.doc_id]
        if text and len(text) > 10_000:
            assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (1, 0, 50_000, 1, 50_000_000)
        else:
            assert tuple(r)[1:] == plain_row(r.doc_id, text)
    assert periodic.detect(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.detect(frame, power=1)
