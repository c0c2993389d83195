"""Every operator on awkward rows, and against brute force, round trips or held-out labels."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from gleanspark.llm import decontamination, html, lines, media, mixing, ppm, quality, queries, simhash, toxicity, warc
from gleanspark.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, copies string, pos int"
LONG = " ".join(f"word{i % 977} of{i}" for i in range(30_000))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 0.5, "x", 1) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing column names."""
    same = "One line here.\nAnother line there.\nA third line.\nAnd a fourth."
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, same, "a"), (4, same, "a"), (5, same, "b"), (None, same, "b"), (6, LONG, "b"), (7, LONG + " end", "c"), (8, "x", "c"), (None, None, None)]
    return docs(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    return {int(i): (t or "").encode() for i, t in zip(rows.doc_id, rows.text)}


def run(spark, name):
    return entry.queries()[name](spark, SF).toPandas()


# op1


def test_quality_labels(spark):
    docs_, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs_, quality.fit(docs_)).join(labels, "doc_id").toPandas()
    assert ((scored.keep == 1) == (scored.quality == 1)).mean() > 0.99
    assert scored.keep[scored.quality == 1].mean() > 0.995


def test_quality_em_recovers_accuracies():
    r = np.random.default_rng(3)
    truth, accuracy = r.random(20_000) < 0.8, np.array([0.95, 0.9, 0.8, 0.7] + [0.9] * 6)
    right = r.random((20_000, 10)) < accuracy
    votes = np.where(right == truth[:, None], quality.GOOD, quality.BAD)
    votes[r.random(votes.shape) < 0.2] = quality.ABSTAIN
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.expectation_maximisation(rows, counts.astype(float))
    assert np.abs(model.accuracy - accuracy).max() < 0.03 and abs(model.prior - 0.8) < 0.02
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.98


def test_quality_odd(odd, none):
    model = quality.fit(odd)
    rows = quality.score(odd, model).collect()
    assert len(rows) == 11 and all(r.score == 0 and r.keep == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert quality.score(none, quality.fit(none)).count() == 0 and quality.keep(none, model).columns == none.columns
    kept = quality.keep(odd, model)
    assert kept.schema == odd.schema and kept.count() == sum(r.keep for r in rows)


# op2


def water(sizes, weights=(5, 2, 1), cap=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    out, rest, free = {}, float(sum(sizes.values())), set(names)
    while free:
        share = rest / sum(w[s] for s in free)
        over = {s for s in free if w[s] * share > cap * sizes[s]}
        if not over:
            return out | {s: w[s] * share for s in free}
        out |= {s: cap * sizes[s] for s in over}
        rest -= sum(cap * sizes[s] for s in over)
        free -= over
    return out


def test_mixing(spark):
    got = run(spark, "op2_mixing")
    assert (got.taken <= 3 * got["size"]).all() and (got.taken == got["size"] * got.copies).all()
    want = water(got.groupby("source")["size"].sum().to_dict())
    for s, g in got.groupby("source"):
        assert abs(g.target.iloc[0] - want[s]) < 1e-6 * want[s] + 1e-6 and g.source_size.iloc[0] == g["size"].sum()
        assert abs(g.taken.sum() - want[s]) <= max(g["size"])
    again = run(spark, "op2_mixing")
    assert sorted(map(tuple, got[["doc_id", "taken"]].values)) == sorted(map(tuple, again[["doc_id", "taken"]].values))


def test_mixing_tree_and_skew(spark):
    n = 5000
    rows = docs(spark, [(i, " ".join(["w"] * (i % 17 + 1)), "hot" if i % 3 else f"s{i % 7}") for i in range(n)] + [(n, "lone word", None), (n + 1, None, "empty")])
    got = mixing.decisions(rows).toPandas()
    want = water(got.assign(w=got["size"] * got.n).groupby("source", dropna=False).w.sum().rename(lambda s: None if s != s else s).to_dict())
    for s, g in got.groupby("source", dropna=False):
        s = None if s != s else s
        assert abs(g.target.iloc[0] - want[s]) < 1e-6 and abs((g["size"] * g.copies * g.n).sum() - want[s]) <= g["size"].max()


def test_pivotal_keeps_words():
    r = np.random.default_rng(1)
    w, p = r.integers(1, 50, 400).astype(float), np.full(400, 0.37)
    after, at = mixing.settle(w, p, r.integers(0, 2**62, 400), 5)
    assert abs((w * after).sum() - (w * p).sum()) < 1e-6 and sum((x > 0) & (x < 1) for x in after) <= 1
    mean = np.mean([mixing.settle(w[:6], p[:6], r.integers(0, 2**62, 6), k)[0] for k in range(4000)], axis=0)
    assert np.abs(mean - 0.37).max() < 0.04


def test_mixing_odd(odd, none):
    rows = mixing.decisions(odd).collect()
    assert sum(r.n for r in rows) == 11 and all(r.copies == 0 for r in rows if r["size"] == 0)
    assert mixing.decisions(none).count() == 0
    mixed = mixing.mix(odd)
    assert mixed.columns == [*odd.columns, "mix_copies", "mix_target"] and mixed.count() == sum(r.n for r in rows if r.copies)


# op3


def plain_article(page):
    blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", page, re.S)[1])]
    return "\n\n".join(x for x in blocks if x)


def test_html_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas().set_index("page_id")
    got = run(spark, "op3_html").set_index("page_id")
    assert len(got) == len(pages) and all(got.text[i] == plain_article(pages.html[i]) for i in pages.index) and (got.n_chars == got.text.str.len()).all()


def test_html_held_out_pages():
    model = html.trained()
    for page, good in html.labelled_pages(60, 77):
        assert {x for x in html.extract(page, model).split("\n\n") if x} == good


def test_messages_are_exact():
    """Marginals and the partition sum against all states of a small tree."""
    model = html.trained()
    nodes = html.parse("<body><nav><a href=x>Go</a></nav><article><p>Some text.<p>More</article>")
    html.describe(nodes)
    n, total, content = len(nodes), 0.0, np.zeros(len(nodes))
    for state in range(1 << n):
        y = [state >> k & 1 for k in range(n)]
        s = sum(sum(model.unary.get(f, 0) for f in x.features) for x, on in zip(nodes, y) if on)
        s += sum(model.edges.get(html._edge(x), [0] * 4)[2 * y[x.parent] + y[k]] for k, x in enumerate(nodes) if k)
        total += np.exp(s)
        content += np.exp(s) * np.array(y)
    out, _, z = model.marginals(nodes)
    assert np.allclose(out, content / total) and np.isclose(z, np.log(total))


def test_html_odd(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>a &lt;b&gt; &eacute;&#33;<br>c</p><!-- open <p>x"), (3, "u", "<p>a &lt;b&gt; &eacute;&#33;<br>c</p><!-- open <p>x"), (4, "u", "<script>var x='</p><p>no'</script><p>yes  it\n is."), (5, "u", "<" * 50), (6, "u", "<p class="), (None, "u", "<article><p>" + "word " * 200_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in html.main_text(df).collect()]
    assert sorted(got, key=str)[:1] and {t for i, t in got if i in (1, 2)} == {""} and [t for i, t in got if i == 3] == ["a <b> é! c"] * 2
    assert dict(got)[4] == "yes it is." and len(dict(got)[None]) == 5 * 200_000 - 1
    assert html.main_text(df.limit(0)).count() == 0


def test_hidden_links_end_and_hidden_text_stays():
    for attr in ("hidden", 'aria-hidden="true"', 'style="display: none"'):
        nodes = html.parse(f"<body><h1>Title <a {attr}>#</a></h1><p>The text of the article, which is no link.</p></body>")
        blocks = [x for x in nodes if x.tag == "#block"]
        assert blocks[-1].text == "The text of the article, which is no link." and blocks[-1].linked == 0
    page = '<body><p aria-hidden="true">Readers see this.</p><p hidden>Folded text.</p><noscript><p>Text without scripts.</p></noscript><template>Not this.</template></body>'
    assert [x.text for x in html.parse(page) if x.tag == "#block"] == ["Readers see this.", "Folded text.", "Text without scripts."]


# op4


def test_loser_tree():
    r = np.random.default_rng(2)
    for k in range(9):
        runs = [sorted((int(x),) for x in r.integers(0, 30, r.integers(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for run in runs for x in run)


def test_warc_round_trip_and_order(spark):
    rows = [(i, f"http://www.h{i % 5}.org/p?b=2&a={i}", f"<p>{i % 4}</p>") for i in range(40)] + [(50, None, None), (51, "http://ü.de/ä%20b c", "é\r\n\r\nWARC/1.1\r\n"), (None, "x", "<p>0</p>"), (52, "x", ""), (3, "again", "<p>3</p>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = warc.round_trip(df)
    parts = [[(r.url_key is None, r.url_key or "", r.page_id or -1) for r in p] for p in got.rdd.glom().collect()]
    flat = [x for p in parts for x in p]
    assert [x[:2] for x in flat] == sorted(x[:2] for x in flat) and len(flat) == len(rows)
    by = defaultdict(list)
    for r in got.collect():
        by[r.page_id].append(r)
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", -1), i)
    for i, u, h in rows:
        kept = largest[h or ""]
        r = next(x for x in by[i] if x.url == u)
        assert (r.record_type, r.refers_to) == (("response", None) if i == kept else ("revisit", kept))
        assert r.payload_bytes == len((h or "").encode()) and r.payload_digest == warc.base32_sha1((h or "").encode()) and r.url == u
    assert warc.round_trip(df.limit(0)).count() == 0 and {r.record_type for r in warc.round_trip(df, least_bytes=1 << 20).collect()} == {"response"}


def test_warc_records_cut():
    data = warc.record(1, "u", b"abc") + warc.record(2, "v", b"")
    assert [h["warc-target-uri"] for _, h, _ in warc.records(data)] == ["u", "v"]
    with pytest.raises(ValueError):
        list(warc.records(data[:-3]))


# op5


def plain_ppm(train, text, order):
    """log10 probability of one text by definition, over dictionaries."""
    trie = [defaultdict(Counter) for _ in range(order + 1)]
    symbols = lambda t: [256] * order + list(b" ".join(t.lower().split())) + [256]
    for t in train:
        x = symbols(t)
        for i in range(order, len(x)):
            for k in range(order + 1):
                trie[k][tuple(x[i - k : i])][x[i]] += 1
    x, total = symbols(text), 0.0
    for i in range(order, len(x)):
        out: set = set()
        for k in range(order, -1, -1):
            seen = trie[k].get(tuple(x[i - k : i]))
            if not seen:
                continue
            left = {s: c for s, c in seen.items() if s not in out}
            n = 2 * sum(left.values())
            if x[i] in left:
                total += np.log10((2 * left[x[i]] - 1) / n)
                break
            if left:
                total += np.log10(len(left) / n)
            out |= set(seen)
        else:
            total -= np.log10(257 - len(out))
    return total


def test_ppm_against_dictionaries(spark, texts):
    got = run(spark, "op5_ppm").set_index("doc_id")
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    train = [t for i, t in texts.items() if not held[i]]
    count = Counter(w for t in train for w in t.lower().split())
    n, v, ends = sum(count.values()) + len(train), len(count) + 1, len(train)
    for i, t in texts.items():
        c = [count[w] for w in t.lower().split()] + [ends]
        r = got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(c), sum(x > 0 for x in c), n)
        assert np.isclose(r.base_score, sum(np.log10((x + 1) / (n + v + 1)) for x in c), rtol=1e-9)
    for i in sorted(texts, key=lambda i: (not held[i], len(texts[i])))[:12]:
        assert np.isclose(got.score[i], plain_ppm(train, texts[i], 5), rtol=1e-9)
    order = got.loc[[i for i in held if held[i]]]
    assert np.corrcoef(order.score, order.base_score)[0, 1] > 0.95


def test_ppm_beats_counts_on_held_out_texts(spark):
    got = entry.queries()["op5_ppm"](spark, "/root/testdata/sf0.1").filter("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum() and (got.score > got.base_score).mean() > 0.8


def test_ppm_odd(odd, none):
    rows = ppm.score(odd, F.col("doc_id") == 7, block_bytes=1000).collect()
    assert len(rows) == 11 and all(r.n_tokens == 1 for r in rows if r.doc_id in (1, 2, 3)) and sum(r.held_out for r in rows) == 1
    assert ppm.score(none, F.lit(False)).count() == 0
    all_out = ppm.score(odd, F.lit(True)).filter("doc_id = 8").first()
    assert np.isclose(all_out.score, -2 * np.log10(257)) and all_out.n_known == 0 and all_out.base_score == 0


# op6


def plain_fingerprint(text, width=3):
    w = text.lower().split()
    s = [b" ".join(w[i : i + width]) for i in range(max(len(w) - width, 0) + 1)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(prints, radius):
    ids = sorted(prints)
    f = np.array([prints[i] for i in ids], np.uint64)
    label = simhash.union(len(ids), *np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= radius))
    return {i: ids[label[k]] for k, i in enumerate(ids)}


def test_simhash_against_all_pairs(spark, texts):
    got = run(spark, "op6_simhash").set_index("doc_id")
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(prints, 2)
    assert len(got) == len(texts) and all(got.fingerprint[i] == f"{prints[i]:016x}" and got.component_id[i] == want[i] for i in texts)


def test_links_lose_nothing(spark, monkeypatch):
    """Random fingerprints with chains of near ones, also with blocks that must be dealt in parts."""
    monkeypatch.setattr(simhash, "BLOCK", 20)
    r = np.random.default_rng(4)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    f = base[r.integers(0, 40, 600)]
    for k in range(600):
        for b in r.integers(0, 64, r.integers(0, 4)):
            f[k] ^= np.uint64(1) << np.uint64(b)
    prints = spark.createDataFrame([(k, bytearray(int(x).to_bytes(8, "big"))) for k, x in enumerate(f)], "id long, node binary").withColumn("keys", F.array().cast("array<bigint>"))
    got = {bytes(r.node): r.component for r in simhash._classes(prints, 2).collect()}
    want = plain_components({k: int(x) for k, x in enumerate(f)}, 2)
    assert all(got[int(x).to_bytes(8, "big")] == want[k] for k, x in enumerate(f))


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 7, 26])
def test_bit_slices(radius):
    r = np.random.default_rng(radius)
    bits = r.integers(0, 2, (300, 128), dtype=np.uint8)
    bits[100:200] = bits[:100] ^ (r.random((100, 128)) < radius / 128)
    near = (bits[:, None, :] != bits[None, :, :]).sum(2) <= radius
    assert (simhash.bit_sliced(bits, np.full(300, 300), radius) == simhash.union(300, *np.nonzero(near))).all()


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}
    assert components(links.limit(0)).count() == 0


def test_simhash_odd(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 11 and {r.component_id for r in rows if r.fingerprint == "0" * 16} == {1} and {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.schema == odd.schema and sorted(r.doc_id for r in kept.collect()) in ([1, 4, 6, 8], [1, 4, 6, 7, 8])


def test_near_copies_at_five_words(spark):
    r = np.random.default_rng(8)
    rows, copies = [], {}
    for k in range(40):
        w = [f"w{x}" for x in r.integers(0, 5000, 150)]
        rows.append((k, " ".join(w), "a"))
        if k % 2:
            for at in r.integers(0, 150, 2):
                w[at] = "changed"
            rows.append((100 + k, " ".join(w), "a"))
            copies[100 + k] = k
    kept = {x.doc_id for x in simhash.one_of_each(docs(spark, rows)).collect()}
    assert set(range(40)) <= kept and len(kept & set(copies)) <= 1


def plain_one_of_each(rows):
    """Ids that stay: the smallest of each component of Jaccard 0.8 or more between sets of five-word shingles."""
    ids = sorted(i for i, _, _ in rows)
    sets = {i: set(decontamination.shingles(t.lower().encode().split(), 5)) for i, t, _ in rows}
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if len(sets[ids[a]] & sets[ids[b]]) >= 0.8 * len(sets[ids[a]] | sets[ids[b]]) - 1e-9]
    labels = simhash.union(len(ids), *np.array(pairs, np.int64).reshape(-1, 2).T)
    return {ids[k] for k in labels}


def test_near_copies_ignore_repeats(spark):
    """Equal sets of shingles whatever repeats in them; different sets whatever they share often."""
    r = np.random.default_rng(21)
    words = lambda n: [f"w{x}" for x in r.integers(0, 10**6, n)]
    rows = []
    for k in range(20):
        w, passage = words(180), words(20)
        rows.append((k, " ".join(w + passage), "a"))
        rows.append((100 + k, " ".join(w + passage * 10), "a"))
    often, shared = words(14), words(90)
    rows += [(200 + k, " ".join(words(60) + shared + often * 10), "a") for k in range(12)]
    kept = {x.doc_id for x in simhash.one_of_each(docs(spark, rows)).collect()}
    assert kept == plain_one_of_each(rows) == set(range(20)) | set(range(200, 212))


def test_near_copies_in_large_blocks(spark, monkeypatch):
    """One large group of near copies, with blocks dealt in parts, against all pairs."""
    monkeypatch.setattr(simhash, "BLOCK", 20)
    r = np.random.default_rng(22)
    w = [f"w{x}" for x in range(200)]
    rows = []
    for k in range(150):
        v = list(w)
        for at in r.integers(0, 200, r.integers(1, 8)):
            v[at] = f"c{r.integers(0, 10**6)}"
        rows.append((k, " ".join(v), "a"))
    kept = {x.doc_id for x in simhash.one_of_each(docs(spark, rows)).collect()}
    assert 1 < len(plain_one_of_each(rows)) < 150 and kept == plain_one_of_each(rows)


def test_near_copies_at_exactly_the_threshold(spark):
    """Short and middling texts on both sides of 0.8, against all pairs."""
    r = np.random.default_rng(23)
    words = lambda n: [f"w{x}" for x in r.integers(0, 10**6, n)]
    rows = []
    for k in range(60):
        eight, middle, cut = words(9), words(44), words(12)
        changed = middle[:22] + ["changed"] + middle[23:]
        pairs = [(eight[:8], eight), (eight[:8][::-1], eight[:8][::-1][:7] + ["last"]), (middle, changed), (cut, cut[:11] + ["last"]), (words(3), words(3))]
        for n, (a, b) in enumerate(pairs):
            rows += [(1000 * n + 2 * k, " ".join(a), "a"), (1000 * n + 2 * k + 1, " ".join(b), "a")]
    kept = {x.doc_id for x in simhash.one_of_each(docs(spark, rows)).collect()}
    want = plain_one_of_each(rows)
    assert kept == want and sum(i < 1000 for i in want) == 60 and sum(i >= 1000 for i in want) == 480


def test_the_radius_loses_nothing():
    """Chance that a bit differs, for sets of `c` common, `x` and `y` own hashes at 0.8 or more: 512 bits stay within the default radius by five spreads."""
    from inspect import signature
    from math import comb, sqrt

    least = lambda c, x, n: [sum(comb(x, e) for e in range(x + 1) if 2 * (k + e) > n) / 2**x for k in range(c + 1)]
    radius = signature(simhash.one_of_each).parameters["radius"].default
    bands = signature(simhash.one_of_each).parameters["bands"].default
    for c in range(1, 80):
        for x in range(c // 4 + 1):
            for y in range(x, c // 4 + 1 - x):
                p = sum(comb(c, k) / 2**c * (a * (1 - b) + b * (1 - a)) for k, (a, b) in enumerate(zip(least(c, x, c + x), least(c, y, c + y))))
                assert 512 * p + 5 * sqrt(512 * p * (1 - p)) <= radius
    assert (1 - 0.8**2) ** bands < 1e-5


# op7


def test_toxicity_held_out(spark):
    docs_, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = queries.remainder("doc_id", 4) == 2
    got = toxicity.score(docs_, toxicity.fit(docs_, labels, ~held), held).join(labels, "doc_id").filter("held_out").toPandas()
    assert got.predicted[got.toxic == 1].mean() > 0.88 and got.predicted[got.toxic == 0].mean() < 0.02


def test_counterfactual_pairs_shrink_the_gap():
    """Only one group is named in toxic rows; with the penalty its name alone weighs less."""
    r = np.random.default_rng(0)
    rows = []
    for k in range(600):
        words = [b"w%d" % x for x in r.integers(0, 40, 8)]
        bad = k % 4 == 0
        words += [b"vile"] * (bad and k % 8 > 0) + [b"muslim"] * (bad or k % 40 == 1) + [b"christian"] * (not bad and k % 5 == 0)
        rows.append((sorted(toxicity.slots(words)), None if toxicity.swapped(words) is None else sorted(toxicity.slots(toxicity.swapped(words))), int(bad)))
    features = np.array(sorted({x for a, b, _ in rows for x in a + (b or [])}))
    gap = lambda m: abs(m.score(b"the muslim neighbour") - m.score(b"the christian neighbour"))
    assert gap(toxicity.train(rows, features, fairness=5.0)) < 0.3 * gap(toxicity.train(rows, features, fairness=0.0))


def test_toxicity_odd(odd, none, spark):
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (8, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for frame, n in ((odd, 11), (none, 0)):
        rows = toxicity.score(frame, toxicity.fit(frame, labels, F.lit(True)), F.lit(False)).collect()
        assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


# op8


def test_tables_of_g711():
    assert media.MULAW_TABLE[[0, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0] and media.ALAW_TABLE[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    assert len(set(media.ALAW_TABLE.tolist())) == 256


def plain_adpcm(block):
    level, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [level]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEP_SIZES[index])
            d = step >> 3
            d += step if code & 4 else 0
            d += step >> 1 if code & 2 else 0
            d += step >> 2 if code & 1 else 0
            level = max(-32768, min(32767, level - d if code & 8 else level + d))
            index = max(0, min(88, index + int(media.INDEX_STEPS[code])))
            out.append(level)
    return out


def test_adpcm_blocks():
    r = np.random.default_rng(6)
    blocks = r.integers(0, 256, (50, 96), dtype=np.uint8)
    assert media.adpcm_blocks(blocks).tolist() == [plain_adpcm(b.tobytes()) for b in blocks]
    tone = (8000 * np.sin(np.arange(3000) / 9)).astype(np.int16)
    back, rate = media.expand(media.wave(media.encode_adpcm(tone), media.ADPCM, 8000, 256))
    assert rate == 8000 and np.abs(back[:3000].astype(int) - tone)[200:].mean() < 300


def test_resample():
    x = np.array([0, 100, -100, 32767, -32768], np.int16)
    assert media.resample(x, 8000, 16000).tolist() == [0, 50, 100, 0, -100, 16333, 32767, -1, -32768, -32768]
    assert len(media.resample(x, 8000, 11025)) == 6 and media.resample(x, 8000, 8000) is x


def test_media_round_trip(spark, odd, none):
    got = media.round_trip(odd).collect()
    want = {r.doc_id: media.payload((r.text or "").encode()) for r in odd.collect()}
    assert len(got) == 11 and media.round_trip(none).count() == 0
    for r in got:
        if r.doc_id is None:
            continue
        p = want[r.doc_id]
        assert len(p) % 192 == 0 and len(p) > 0 and (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        f = media.wave(p)
        assert (r.media_bytes, r.media_sha256) == (len(f), hashlib.sha256(f).hexdigest()) and media.read_wave(f)[3] == p
        alaw = int(np.abs(media.ALAW_TABLE[np.frombuffer(p, np.uint8)].astype(int)).sum())
        sound = int(np.abs(media.adpcm_blocks(np.frombuffer(p, np.uint8).reshape(-1, 96)).astype(int)).sum())
        assert r.feature.endswith(f"alaw={alaw};adpcm={sound}")
    pcm = {r.doc_id: r.pcm for r in media.decode(media.store(odd)).collect()}
    assert len(pcm[2]) == 192 * 2 * 2
    with pytest.raises(ValueError):
        media.read_wave(b"RIFF....WAVEdata\xff\xff\xff\xff")


# op9


def plain_lines(rows):
    """{(id, text): kept lines}, by definition."""
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        x = t.split("\n")
        gone = set()
        for k in range(len(x) - 2):
            w = tuple(x[k : k + 3])
            if any(s.strip() for s in w):
                gone |= {k, k + 1, k + 2} if w in seen else set()
                seen.add(w)
        out[i, t] = [s for k, s in enumerate(x) if k not in gone]
    return out


def test_lines_against_definition(spark):
    r = np.random.default_rng(12)
    rows = [(i, "\n".join(r.choice(list("abc") + ["", " "], r.integers(0, 12)))) for i in range(120)]
    got = {(x.doc_id): x for x in lines.line_windows_removed(docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    for (i, t), kept in plain_lines(rows).items():
        assert got[i].text == "\n".join(kept) and got[i].n_removed == len(t.split("\n")) - len(kept)


def test_lines_odd(odd, none):
    rows = lines.line_windows_removed(odd).collect()
    assert len(rows) == 11 and [r.text for r in rows if r.doc_id == 5] == [""] and len({r.text for r in rows if r.doc_id == 4}) == 1 and all(r.n_removed == 0 for r in rows if r.doc_id == 4)
    assert lines.line_windows_removed(none).count() == 0
    left = lines.without_repeats(odd)
    assert left.columns == odd.columns and left.count() == 9 and left.filter("doc_id = 6").first().text == LONG


def test_lines_stay_native(spark):
    plan = lines.line_windows_removed(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("ArrowEvalPython", "Python") if "ArrowEval" in plan else plan)


def test_lines_shuffle_texts_once(spark):
    """No exchange has more strings in a row than the table: a text isn't sent a second time as its lines."""

    def nodes(plan):
        yield plan
        for k in range(plan.children().size()):
            yield from nodes(plan.children().apply(k))

    frame, key = spark.read.parquet(f"{SF}/documents.parquet"), "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        for made, of in ((lines.line_windows_removed(frame), frame.select("doc_id", "text")), (lines.without_repeats(frame), frame)):
            sent = [x.schema().catalogString() for x in nodes(made._jdf.queryExecution().executedPlan().executedPlan()) if x.nodeName() == "Exchange"]
            assert max(x.count("string") for x in sent) == sum(t == "string" for _, t in of.dtypes)
    finally:
        spark.conf.set(key, was)


# op10


def test_containment_finds_all(spark):
    r = np.random.default_rng(9)
    word = lambda n: [f"t{x}" for x in r.integers(0, 300, n)]
    items = [(k, " ".join(word(int(r.integers(1, 60))))) for k in range(80)] + [(200, None), (201, " "), (None, "null id item with six words")]
    rows = []
    for k in range(150):
        w = word(int(r.integers(0, 400)))
        if k % 2:
            cut = items[k % 80][1].upper().split()
            if k % 4 == 1 and len(cut) > 30:
                cut[3] = "changed"
            w[5:5] = cut
        rows.append((k, " ".join(w), "a"))
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    sets = lambda t: set(decontamination.shingles((t or "").lower().encode().split(), 5))
    want = {(d, i) for d, t, _ in rows for i, b in items if sets(b) and len(sets(b) & sets(t)) >= 0.8 * len(sets(b)) - 1e-9}
    for block in (16 << 20, 500):
        got = decontamination.contained(docs(spark, rows), bench, block_bytes=block).collect()
        assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want) > 50
    clean = decontamination.uncontaminated(docs(spark, rows), bench)
    assert {x.doc_id for x in clean.collect()} == {d for d, _, _ in rows} - {d for d, _ in want}


def test_containment_odd(odd, none, spark):
    bench = spark.createDataFrame([(1, LONG[:3000]), (1, LONG[:3000]), (2, "x"), (3, None)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontamination.contained(odd, bench).collect()) == [(6, 1), (7, 1), (8, 2)]
    assert decontamination.contained(none, bench).count() == 0 and decontamination.contained(odd, bench.limit(0)).count() == 0
    assert decontamination.uncontaminated(odd, bench).schema == odd.schema


def test_short_items_inside_long_documents(spark, tmp_path):
    """Items of one to four words, through the query and the pipeline's stage; a run of other words or a part of a word is none."""
    bench = spark.createDataFrame([(1, "Alpha"), (2, "beta gamma"), (3, "one two three"), (4, "one two three four"), (5, "a b c d e"), (6, "gone")], "item_id long, text string")
    rows = [(1, "some words before alpha and some after it", "a"), (2, "x y z BETA\n gamma x y z", "a"), (3, "x one two three x one two", "a"), (4, "x x one two three four", "a"), (5, "x a b c d e x", "a"), (6, "alphabet beta x gamma one two x three", "a"), (7, "alpha", "a"), (8, "", "a")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = entry.queries()["op10_decontamination"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got) == [(1, 1, 1, 1), (2, 2, 1, 1), (3, 3, 1, 1), (4, 3, 1, 1), (4, 4, 1, 1), (5, 5, 1, 1), (7, 1, 1, 1)]
    assert sorted(r.doc_id for r in corpus_pipeline.decontamination_stage(spark, docs(spark, rows), str(tmp_path)).collect()) == [6, 8]


def test_query_and_sql_agree_on_items_of_all_sizes(spark, tmp_path):
    """Items of one to nine words, whole, cut, upper-cased and with other white space, in documents of one word and of many."""
    import duckdb

    r = np.random.default_rng(4)
    word = lambda n: [f"w{x}" for x in r.integers(0, 40, n)]
    items = [(10 * n + k, " ".join(word(n))) for n in range(1, 10) for k in range(4)] + [(200, None), (201, " "), (202, "w1"), (203, "W1")]
    rows = []
    for k in range(200):
        w = word(int(r.integers(0, 30)))
        cut = (items[k % 36][1]).upper().split()
        w[3:3] = cut[: len(cut) - k % 3 // 2]
        rows.append((k, "\n".join(w) if k % 2 else " \t".join(w), "a"))
    rows += [(300, "w1", "a"), (301, "w1w2", "a"), (302, None, "a"), (303, "", "a")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = sorted(tuple(x) for x in entry.queries()["op10_decontamination"](spark, str(tmp_path)).select("doc_id", "item_id", "n_item", "n_shared", "containment").collect())
    assert got == sorted(db.execute(f"SELECT doc_id, item_id, n_item, n_shared, containment FROM ({decontamination.SQL})").fetchall())
    assert {len((dict(items)[i] or "").split()) for _, i, *_ in got} == set(range(1, 10))


# the pipeline


def test_pipeline_against_its_parts(spark, texts):
    """run() against a plain version of the stages that have one, each on what the stage before it kept."""
    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    tables, before = {}, docs_
    for name, stage in corpus_pipeline.STAGES:
        tables[name] = before = stage(spark, before, SF).cache()
    rows = {k: {r.doc_id: r for r in t.collect()} for k, t in tables.items()}
    for name in list(tables)[:-1]:
        assert tables[name].columns == docs_.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum((i in rows["quality"]) == (q == 1) for i, q in labels.items()) > 0.9 * len(labels)
    kept = plain_lines([(i, r.text) for i, r in rows["quality"].items()])
    assert {i: "\n".join(x) for (i, _), x in kept.items() if x} == {i: r.text for i, r in rows["line dedup"].items()} and all(r.n_chars == len(r.text) for r in rows["line dedup"].values())
    shingle = {i: set(decontamination.shingles(r.text.lower().encode().split(), 5)) for i, r in rows["line dedup"].items()}
    ids = sorted(shingle)
    similar = lambda a, b: len(shingle[a] & shingle[b]) / max(len(shingle[a] | shingle[b]), 1)
    gone = set(ids) - set(rows["near-dedup"])
    assert all(any(similar(a, b) >= 0.6 for b in ids if b < a) for a in gone)
    assert not any(similar(a, b) >= 0.85 for a in rows["near-dedup"] for b in rows["near-dedup"] if a < b)
    bench = [set(decontamination.shingles(r.text.lower().encode().split(), 5)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {i for i in rows["near-dedup"] if not any(len(shingle[i] & b) >= 0.8 * len(b) for b in bench)} == set(rows["decontamination"])
    words = {i: len(r.text.split()) for i, r in rows["decontamination"].items()}
    by = Counter()
    for i, r in rows["decontamination"].items():
        by[r.source] += words[i]
    want, taken = water(dict(by)), Counter()
    for i, r in rows["mixing"].items():
        taken[r.source] += r.mix_copies * words[i]
    assert all(abs(taken[s] - want[s]) <= max(words.values()) for s in by)
    run_rows = {(r.doc_id, r.mix_copies) for r in corpus_pipeline.run(spark, SF).collect()}
    assert run_rows == {(i, r.mix_copies) for i, r in rows["mixing"].items()}
