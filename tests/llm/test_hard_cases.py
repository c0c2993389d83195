"""Names that clash, hot texts, misleading pages, blocks and runs in many parts, and plain versions of the queries that SQL cannot express."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from gleanspark.llm import _common, decontamination, html, lines, media, mixing, quality, queries, simhash, toxicity, warc
from gleanspark.llm.components import components

SF = "/root/testdata/sf0.001"
SAME = "One line here.\nAnother line there.\nA third line.\nAnd a fourth."


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Extra columns: every name that the operators use themselves.

NAMES = "row id text_ lines k1 k2 f1 f2 flags kept starts n h1 h2 place first other __k1 __k2 __d1 __d2 __n __id __hash __key __flags __kept __lines hash key copies target size source_size p open bucket buckets block name node root set best child mix_copies mix_target rank label".split()


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, SAME), (2, SAME + "\nOwn line."), (3, "Some other words of a text that stands alone, with a full stop at its end."), (3, "Some other words of a text that stands alone, with a full stop at its end."), (4, None), (5, ""), (None, SAME)]
    made = [(i, t, "en", s, len(t or ""), *[f"{c}{k}" for c in NAMES]) for k, ((i, t), s) in enumerate(zip(rows, ("a", "a", "b", "b", None, "b", "c")))]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in NAMES)).cache()


@pytest.mark.parametrize("name, f", [("lines", lines.without_repeats), ("simhash", simhash.one_of_each), ("mixing", mixing.mix), ("quality", lambda d: quality.keep(d, quality.fit(d))), ("decontamination", lambda d: decontamination.uncontaminated(d, d.select(F.lit(1).alias("item_id"), F.lit("Own line.").alias("text")).distinct(), short=True))])
def test_clashing_names_are_kept(clashing, name, f):
    out = f(clashing)
    own = [c for c in NAMES if name != "mixing" or c not in ("mix_copies", "mix_target")]
    before = {tuple(r[c] for c in own) for r in clashing.collect()}
    rows = out.collect()
    assert rows and len(set(out.columns)) == len(out.columns) and {tuple(r[c] for c in own) for r in rows} <= before
    if name == "lines":
        assert len(rows) == 7 - sum(1 for r in clashing.collect() if r.doc_id is None)  # the copy of null id loses all its lines
    if name == "mixing":
        assert {type(r.mix_copies) for r in rows} == {int} and set(out.columns) == set(clashing.columns)


def test_clashing_names_are_ignored(clashing, spark):
    for f in (lines.line_windows_removed, simhash.near_duplicates, mixing.decisions, media.round_trip, lambda d: quality.score(d, quality.fit(d)), lambda d: decontamination.contained(d, d.select(F.lit(1).alias("item_id"), F.lit("own line.").alias("text")), short=True)):
        assert f(clashing).count() > 0


# The stages on awkward rows

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    """Nulls in every column, empty and long texts, repeated rows, no rows: every stage but the last returns the columns of documents."""
    words = " ".join(f"word{i % 977} of{i}" for i in range(20_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, SAME, "en", "a", len(SAME)), (3, SAME, "en", "a", len(SAME)), (None, SAME, "en", "b", len(SAME)), (None, None, None, None, None), (4, words, "en", "b", len(words))]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    for frame, most in ((docs, 7), (docs.limit(0), 0)):
        out = stage(spark, frame, SF)
        assert out.columns[:5] == docs.columns and (name == "mixing" or len(out.columns) == 5) and out.count() <= most
    left = [r.doc_id for r in stage(spark, docs, SF).collect()]
    if name == "quality":
        assert 1 not in left and 2 not in left and left.count(3) in (0, 2)
    if name == "line dedup":
        assert left.count(3) == 2 and 1 in left and 2 in left and 4 in left
    if name == "near-dedup":
        assert left.count(3) == 1 and sum(x in (1, 2, None) for x in left) == 1 and 4 in left


# op1


def plain_quality(texts):
    """{text: (posterior, score)} by definition, over distinct texts."""
    stats = {t: quality.statistics(t) for t in set(texts) if t.split()}
    patterns = Counter(tuple(quality.votes(s.values)) for s in stats.values())
    q = {v: min(max(0.9 - 0.4 * v.count(quality.BAD), 0.05), 0.95) for v in patterns}
    for _ in range(100):
        right, cast = np.ones((2, 10)), np.full((2, 10), 2.0)
        good = sum(n * q[v] for v, n in patterns.items())
        for v, n in patterns.items():
            for j, x in enumerate(v):
                for y, p in ((0, 1 - q[v]), (1, q[v])):
                    cast[y, j] += n * p * (x != quality.ABSTAIN)
                    right[y, j] += n * p * (x == (quality.BAD, quality.GOOD)[y])
        accuracy = np.clip(right / cast, [[0.3], [0.99]], 0.999)
        prior = min(max(good / sum(patterns.values()), 0.02), 0.98)

        def posterior(v, accuracy=accuracy, prior=prior):
            odds = np.log(prior / (1 - prior))
            for j, x in enumerate(v):
                a, b = accuracy[:, j]
                odds += 0 if x == quality.ABSTAIN else np.log(b / (1 - a)) if x == quality.GOOD else np.log((1 - b) / a)
            return 1 / (1 + np.exp(-odds))

        new = {v: posterior(v) for v in patterns}
        moved, q = max(abs(new[v] - q[v]) for v in patterns), new
        if moved < 1e-7:
            break
    chosen = sorted(stats)
    made = [quality.features(stats[t]) for t in chosen]
    rows = np.repeat(np.arange(len(made)), [len(i) for i, _ in made])
    w = quality.fit_linear(np.concatenate([i for i, _ in made]), np.concatenate([np.float32(v) for _, v in made]).astype(float), rows, np.array([q[tuple(quality.votes(stats[t].values))] for t in chosen]))
    return {t: (q[tuple(quality.votes(s.values))], 1 / (1 + np.exp(-np.dot(w[made[k][0]], made[k][1])))) for k, t in enumerate(chosen) for s in [stats[t]]}


def test_quality_query_against_plain(spark):
    rows = table(spark, "documents").toPandas()
    want = plain_quality([(t or "").encode() for t in rows.text])
    got = entry.queries()["op1_quality"](spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(rows.doc_id, rows.text):
        p, s = want.get((t or "").encode(), (0.0, 0.0))
        assert abs(got.label_posterior[i] - p) < 1e-6 and abs(got.score[i] - s) < 1e-4 and got.keep[i] == int(s >= 0.5)


def test_copies_move_no_score(spark):
    """Ten thousand copies of the text of smallest hash, with a bounded sample: the scores of all texts are as before."""
    docs = table(spark, "documents", "/root/testdata/sf0.01").select("doc_id", "text")
    hot = docs.orderBy(F.xxhash64("text")).limit(1)
    more = docs.unionByName(hot.crossJoin(spark.range(10_000)).select((F.col("id") + 10**9).alias("doc_id"), "text"))
    before, after = (quality.score(docs, quality.fit(d, sample=400)).toPandas().set_index("doc_id").score for d in (docs, more))
    assert (before - after[before.index]).abs().max() < 1e-9
    labels = table(spark, "labels", "/root/testdata/sf0.01").toPandas().set_index("doc_id").quality
    assert ((after[labels.index] >= 0.5) == (labels == 1)).mean() > 0.99


# op3


def article(page):
    blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", page, re.S)[1])]
    return "\n\n".join(x for x in blocks if x)


@pytest.mark.parametrize("begin, end", [('<div class="content has-comments">', "</div>"), ('<article><div class="contact">', "</div></article>"), ('<div class="post type-post category-ads">', "</div>"), ('<div class="article-body social">', "</div>"), ('<div class="blog-post author-bio">', "</div>"), ('<section class="entry popular ads">', "</section>"), ("<div>", "</div>"), ('<div class="zq17">', "</div>")])
def test_names_on_the_article_mislead_nobody(spark, begin, end):
    model = html.trained()
    for page in table(spark, "pages", "/root/testdata/sf0.01").toPandas().html:
        assert html.extract(page.replace("<article>", begin).replace("</article>", end), model) == article(page)


PLAIN = "<p>The first plain paragraph tells something of note.</p><p>The second one goes on with it, in more words than before.</p><p>The third one ends it.</p>"
TOP, SIDE, END = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>', "<aside><h3>More</h3><p>Read some other thing of ours.</p></aside>", "<footer><p>All rights reserved by us here.</p></footer>"


@pytest.mark.parametrize("page", [
    '<body class="right-sidebar">{}', '<body class="home sidebar-left">{}', '<body><div class="header-sticky"><div class="container">{}</div></div>', '<body><div class="footer-fixed"><div class="wrap">{}</div></div>',
    '<body><div class="page-header-wrap">{}</div>', '<body><div class="blog"><div class="meta-content">{}</div></div>', '<body><div class="popular-science">{}</div>', '<body><div class="form-group">{}</div>',
    '<body><div class="two-col sidebar-right"><article>{}</article></div>', '<body><div class="two-col sidebar-right"><div class="entry">{}</div></div>', '<body class="right-sidebar"><article>{}</article>',
    '<body><form id="whole">{}</form>', '<body><div class="right-sidebar"><article>{}</article></div>', '<body><div class="sidebar">{}</div>',
])
def test_names_of_layouts_drop_no_article(page):
    assert html.extract(page.format(PLAIN), html.trained()) == "\n\n".join(re.findall("<p>(.*?)</p>", PLAIN))


@pytest.mark.parametrize("tail", "right sticky wrap science".split())
def test_names_with_words_that_training_never_saw(tail):
    """Names around layouts from the lexicon's words that labelled pages don't draw; menus, asides and footers still go."""
    model, want = html.trained(), "\n\n".join(re.findall("<p>(.*?)</p>", PLAIN))
    held_out = [w for k, ws in html.LEXICON.items() if k not in ("good", "comment") for w in ws.split() if w not in html.DRAWN]
    assert len(held_out) >= 35
    for w in held_out:
        for page in (f'<body><div class="{w}-{tail}">{{}}</div>', f'<body><div class="page {tail}-{w}-{tail}"><div class="wrap">{{}}</div></div>', f'<body class="{tail}-{w}">{TOP}{{}}{END}', f'<body><div class="{w}-{tail}">{TOP}<div>{{}}</div>{SIDE}</div>{END}'):
            assert html.extract(page.format(PLAIN), model) == want, page


def test_weak_names_of_small_boxes_still_tell_them_off():
    model = html.trained()
    box = "<p>Some words of ours that you may like to read.</p>"
    for name in ("sidebar-inner", "comment-list", "share-buttons", "cookie-bar", "ad-container", "related-posts", "footer-bottom", "newsletter-box"):
        assert html.extract(f'<body><div class="content">{PLAIN * 2}</div><div class="{name}">{box}</div></body>', model) == "\n\n".join(re.findall("<p>(.*?)</p>", PLAIN * 2)), name


def test_noisy_pages():
    model = html.trained()
    pages = html.labelled_pages(100, 79, 0.4)
    assert sum({x for x in html.extract(page, model).split("\n\n") if x} == good for page, good in pages) >= 85


def test_inline_elements_keep_their_text_in_place():
    page = "<article><h1>Head</h1><p>Some good text. <math><mi>x</mi></math> is here.</p><p>And <object>alt</object> more, <svg><title>no</title><text>label</text></svg> and <my-word>own</my-word> too.</p><ul><li><a href=/a>Linked item</a></li><li>Short</li></ul></article>"
    assert html.extract(page, html.trained()).split("\n\n") == ["Head", "Some good text. x is here.", "And alt more, label and own too.", "Linked item", "Short"]


def test_copyright_anywhere_in_a_block():
    nodes = html.parse(f"<body><p>{'word ' * 100}©</p></body>")
    html.describe(nodes)
    assert "copyright" in nodes[-1].features


def test_deep_pages_take_time_in_proportion():
    from time import perf_counter

    def seconds(n):
        start = perf_counter()
        for page in ("<div>" * n + "text" + "</div>" * n, "<b><div>" * n + "t" + "</span>" * n, "<p>" + "<center>" * n, "<body>" * n + "<li>" * n):
            html.parse(page)
        return perf_counter() - start

    assert seconds(40_000) < 20 * max(seconds(4_000), 0.05)


# op4


def test_external_merge_in_many_runs(spark):
    schema = _common.arrow_schema(spark, warc.CAPTURE)
    r = np.random.default_rng(2)
    rows = []
    for a in range(200):
        own = [{"url_key": None if x == 0 else f"k{x:03d}", "timestamp": "2024", "url": "u", "page_id": int(y), "payload_bytes": 1, "payload_digest": "d", "record_type": "response", "refers_to": None, "archive": f"a{a}", "place": k} for k, (x, y) in enumerate(r.integers(0, 200, (int(r.integers(0, 9)), 2)))]
        rows += sorted(own, key=warc._order)
    for fan in (2, 3, 64):
        assert list(warc.merged(iter(rows), schema, fan)) == sorted(rows, key=warc._order)
    assert list(warc.merged([], schema)) == []


def test_a_long_page_is_one_record(spark):
    pages = spark.createDataFrame([(1, "http://a/", "x" * 3_000_000), (2, "http://b/", "x" * 3_000_000)], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert got == {1: (3_000_000, "revisit", 2), 2: (3_000_000, "response", None)}


# op6


def test_wider_radii_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.near_duplicates(table(spark, "documents"), radius=3)


def test_hubs_of_links(spark, monkeypatch):
    """Stars whose hubs are among the most frequent nodes, and some that are not."""
    monkeypatch.setattr(_common, "HOT", 3)
    monkeypatch.setattr("gleanspark.llm.components.LEAST", 4)
    monkeypatch.setattr("gleanspark.llm.components.SKEW", 0)
    links = [(k, 10_000 + 50 * k + j) for k in range(8) for j in range(5 + 5 * k)] + [(10_000, 10_050)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {b: (0 if a < 2 else a) for a, b in links if a < 8} | {1: 0}


# op7


def plain_terms(known):
    """Pairs of words that rows (text, label) of the toxic label name more often by 1.1 to 2 times, most frequent first."""
    count = {0: Counter(), 1: Counter()}
    for t, y in known:
        count[y].update(w for w in toxicity.bare(t) if len(w) > 2)
    n = Counter(y for _, y in known)
    able = [w for w, c in count[1].items() if 3 <= c < count[0][w] and 1.1 < (c / n[1]) / (count[0][w] / n[0]) < 2]
    able = sorted(able, key=lambda w: (-count[0][w] - count[1][w], w))[: min(64, max(2, n[1] // 4))]
    return tuple(tuple(able[k : k + 2]) for k in range(0, len(able) - 1, 2))


def plain_toxicity(rows, held):
    """{id: score} from rows (id, text, label or None): all counts by dictionary."""
    known = [(t, y) for i, t, y in rows if y in (0, 1) and not held[i]]
    count = {0: Counter(), 1: Counter()}
    for t, y in known:
        count[y].update(toxicity.slots(toxicity.bare(t)))
    n = Counter(y for _, y in known)
    slots = sorted(count[0] | count[1])
    swap = toxicity.swaps(toxicity.IDENTITY + plain_terms(known))
    kept = toxicity.select(np.array(slots), np.array([count[1][x] for x in slots]), np.array([count[0][x] for x in slots]), n[1], n[0])
    kept = np.array(sorted(set(kept.tolist()) | toxicity.slots(sorted(swap)) & set(slots)))
    made = []
    for t, y in known:
        words = toxicity.bare(t)
        other = toxicity.swapped(words, swap)
        made.append((sorted(toxicity.slots(words) & set(kept.tolist())), None if other is None else sorted(toxicity.slots(other) & set(kept.tolist())), y))
    model = toxicity.train(made, kept)
    return {i: model.score(t) for i, t, _ in rows}


def test_toxicity_query_against_plain(spark):
    docs, labels = table(spark, "documents").toPandas(), table(spark, "labels").toPandas().set_index("doc_id").toxic
    rows = [(int(i), (t or "").encode(), labels.get(i)) for i, t in zip(docs.doc_id, docs.text)]
    want = plain_toxicity(rows, {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows})
    got = entry.queries()["op7_toxicity"](spark, SF).toPandas().set_index("doc_id")
    assert all(abs(got.score[i] - s) < 1e-6 and got.predicted[i] == int(got.score[i] >= 0.3) for i, s in want.items())


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_pairs_enter_the_fit_of_the_query_and_shrink_the_gap(spark, monkeypatch, sf):
    """On the given tables, with the query's own terms: swapped texts enter, and held-out texts change less by a swap than without the penalty."""
    docs, labels, held = table(spark, "documents", sf), table(spark, "labels", sf), queries.remainder("doc_id", 4) == 2
    terms = toxicity.IDENTITY + toxicity.found_terms(docs, labels, ~held)
    fair = toxicity.fit(docs, labels, ~held, terms=terms)
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda rows, features: train(rows, features, fairness=0.0))
    free = toxicity.fit(docs, labels, ~held, terms=terms)
    texts = [t.encode() for i, t in docs.select("doc_id", "text").toPandas().itertuples(index=False) if zlib.crc32(str(i).encode()) % 4 == 2]
    (n, with_penalty), (_, without) = toxicity.gap(texts, fair, terms), toxicity.gap(texts, free, terms)
    assert fair.pairs == free.pairs > 20 and n > 20 and with_penalty < 0.5 * without


def test_labels_beyond_the_bound_are_drawn_by_hash(spark, monkeypatch):
    """Up to LABELS all count; beyond, about so many, the same in each run; texts are never shuffled for them."""
    docs, labels = table(spark, "documents", "/root/testdata/sf0.01"), table(spark, "labels", "/root/testdata/sf0.01")
    whole = toxicity._labelled(docs, labels, F.lit(True))
    n = whole.count()
    assert n == labels.filter("toxic in (0, 1)").distinct().count() and "SortMergeJoin" not in whole._jdf.queryExecution().toString()
    monkeypatch.setattr(toxicity, "LABELS", n // 2)
    one, other = ({r.id for r in toxicity._labelled(docs, labels, F.lit(True)).collect()} for _ in range(2))
    assert one == other and 0.35 * n < len(one) < 0.6 * n


# op8


def test_media_features_against_plain(spark):
    """The whole feature, from the text by definition."""
    rows = [(1, "Some text of a few words."), (2, None), (3, "é" * 200), (3, "é" * 200)]
    got = media.round_trip(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        p = media.payload(text.encode())
        x = [int(v) for v in media.MULAW_TABLE[np.frombuffer(p, np.uint8)]]
        pcm = [v for a, b in zip(x, x[1:] + x[-1:]) for v in (a, a + (b - a) // 2)]
        rms = int(np.sqrt(sum(v * v for v in pcm) / len(pcm)))
        zero = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))
        crc = zlib.crc32(b"".join(v.to_bytes(2, "little", signed=True) for v in pcm))
        assert r.feature.startswith(f"n={2 * len(p)};rms={rms};peak={max(map(abs, pcm))};zero={zero};crc={crc:08x};alaw=") and r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.n_bytes == len(text.encode())


def test_pcm_is_stored(spark):
    docs = table(spark, "documents").limit(20)
    stored = _common.written(media.sound(media.store(docs)), "pcm", **media.DENSE)
    for r in stored.join(docs, "doc_id").collect():
        assert bytes(r.pcm) == media.resample(*media.expand(media.wave(media.payload((r.text or "").encode()))), 16000).astype("<i2").tobytes()
    _common.dropped(stored)


# op9


def test_hot_windows(spark, monkeypatch):
    """Windows that are among the most frequent, and others: the same lines go as by definition."""
    monkeypatch.setattr(_common, "HOT", 2)
    rows = [(i, "\n".join(["boiler", "plate", "text"] + [f"own {i}"] + (["rare", "window", "here"] if i % 10 == 0 else []) + ["boiler", "plate", "text"])) for i in range(200)]
    got = {r.doc_id: r.text for r in lines.line_windows_removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].split("\n") == ["boiler", "plate", "text", "own 0", "rare", "window", "here"] and got[7] == "own 7" and got[10] == "own 10"


# op10


def test_blocks_and_partitions_of_items(spark):
    """Items of many sizes in many blocks, for short and long documents, against sets."""
    r = np.random.default_rng(31)
    word = lambda n: [f"v{x}" for x in r.integers(0, 200, n)]
    items = [(k, " ".join(word(int(n)))) for k, n in enumerate(2 ** r.uniform(2.4, 9, 60))]
    docs = [(k, " ".join(word(3) + items[k % 60][1].split() + word(int(r.integers(0, 30))))) for k in range(60)] + [(100 + k, " ".join(items[k][1].split()[: 1 + k])) for k in range(60)] + [(200, None), (201, "")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    sets = lambda t: set(decontamination.shingles((t or "").lower().encode().split(), 5))
    want = {(d, i) for d, t in docs for i, b in items if len(sets(b) & sets(t)) >= 0.8 * len(sets(b)) - 1e-9}
    for block in (16 << 20, 3000):
        assert {(x.doc_id, x.item_id) for x in decontamination.contained(frame, bench, block_bytes=block).collect()} == want
        assert {x.doc_id for x in decontamination.uncontaminated(frame, bench, block_bytes=block).collect()} == {d for d, _ in docs} - {d for d, _ in want}


# the shared folder


def test_no_local_folder_on_a_cluster(spark):
    class Remote:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        _common.shared_dir(Remote)


def test_scratch_tables_can_be_dropped(spark, tmp_path):
    made = _common.written(spark.range(3), "test")
    assert made.count() == 3
    _common.dropped(made)
    assert spark._jvm.java.io.File(made.scratch.removeprefix("file:")).exists() is False


def test_mixing_keeps_chances(spark):
    """Pivotal rounding moves no document's chance: over many seeds each is taken as often as its share says."""
    docs = spark.createDataFrame([(k, " ".join(["w"] * (1 + 7 * k % 13)), "a" if k < 12 else "b") for k in range(24)], "doc_id long, text string, source string")
    taken = defaultdict(list)
    for seed in range(60):
        for r in mixing.decisions(docs, seed=seed).collect():
            taken[r.id].append((r.copies, r.target / r.source_size))
    assert all(abs(np.mean([c for c, _ in x]) - x[0][1]) < 0.25 for x in taken.values())
