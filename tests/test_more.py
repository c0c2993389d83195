"""Pieces, stores, containers, answers and clean-up by small cases."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gleanspark.functions import cleaning, models
from gleanspark.operators import answers, chunking, documents, evalsets, filters, markup, mining, reports, retrieval, search
from gleanspark.sources import files, hwp, listings, store, tables
from gleanspark.streaming import events


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


# Clean-up


def test_foreign_runs_in_parentheses_stay(spark):
    clean = lambda t: one(spark, cleaning.without_foreign_runs(F.col("v")), v=t)
    assert clean("주식회사(株式會社) 螨ȃ 끝") == "주식회사(株式會社)  끝" and clean("(株(式)x)") == "((式)x)" and clean("株)(式") == ")("


def test_cleaned_counts(spark):
    rows = spark.createDataFrame([("- 3 -\n(단위 :  천원)\n<그림>a < b • ( )ㅇㅇ\x07\n\n\n\n\nc",), ("",), (None,)], "text string")
    row = cleaning.cleaned(rows, angles=True, bullets=True).collect()
    assert row[0].text == "a  b\n\nc" or row[0].text.split() == ["a", "b", "c"]
    assert (row[0].page_lines, row[0].boilerplate_lines, row[0].tags, row[0].placeholders, row[0].empty_parens, row[0].controls, row[0].angles, row[0].bullets) == (1, 1, 1, 1, 1, 1, 1, 1)
    assert row[1].text == "" and row[2].text is None


def test_boilerplate_headers_are_asked_for():
    assert len(cleaning.boilerplate_lines()) == 44 and len(cleaning.boilerplate_lines(True)) == 49


def test_clean_document(spark):
    clean = lambda t: cleaning.clean_documents(spark.createDataFrame([(t,)], "text string")).first().text
    got = clean("가\r\n1. 개요 ........ 12\n개요說ȃ1 끝\n---\n- 4 -\n\n\n\n본문  둘" + "\n머리" * 5)
    assert clean(None) is None and clean("") == "" and got == "가\n1. 개요\n개요 끝\n\n본문 둘"


def test_contents_of_chunks(spark):
    toc = "목 차\n1. 사업일반\t1\n2. 추진\t2\n3. 방법\t3\n4. 기타\t4\n본문은 49,500천원 이며 계약일로부터 150일 입니다."
    assert one(spark, cleaning.without_contents(F.col("v")), v=toc) == "목 차\n본문은 49,500천원 이며 계약일로부터 150일 입니다."
    assert one(spark, cleaning.has_contents(F.col("v")), v="1 · 가천대학교 · 35 · 국립한국해양대학교 · 3 · 5") is False
    rows = spark.createDataFrame([("a", toc), ("b", "본문")], "chunk_id string, text string")
    assert [r.chunk_id for r in filters.drop_contents(rows).collect()] == ["b"]


def test_table_rows(spark):
    df = spark.createDataFrame([([["a\nb", None], [None, " "], ["c", "d"]],)], "r array<array<string>>")
    assert df.select(cleaning.table_rows(F.col("r")).alias("x")).first().x == "a b | \nc | d"


def test_fields_and_items(spark):
    assert one(spark, cleaning.field_after(F.col("v"), "기간"), v="x 기간) : 3개월 □ 다음") == "3개월" and one(spark, cleaning.field_after(F.col("v"), "기간"), v="기간\n□") is None
    assert one(spark, cleaning.square_items(F.col("v")), v="□ ( 사업 기간 ) a □(범위)") == ["사업기간", "범위"]


# Filters


def test_conditions_on_what_is_unknown(spark):
    rows = spark.createDataFrame([("a", 5.0, "조달청", "2024-03-01"), ("b", None, None, None), ("c", float("nan"), "", ""), ("d", 9.0, "서울시 조달", "2024-05-01")], "doc_id string, budget double, agency string, bid_close_at string")
    ids = lambda c: [r.doc_id for r in rows.filter(c).collect()]
    assert ids(filters.filter_by()) == ids(filters.filter_by(doc_ids=[], agency_has="")) == ["a", "b", "c", "d"]
    assert ids(filters.filter_by(budget_min=0)) == ["a", "d"] and ids(filters.filter_by(budget_max=5)) == ["a"] and ids(filters.filter_by(agency_has="조달")) == ["a", "d"]
    assert ids(filters.filter_by(close_before="2024-04")) == ["a"] and ids(filters.passes(closes_after="2024-04")) == ["d"] and ids(filters.filter_by(doc_ids=["b"])) == ["b"]
    assert filters.keep_docs(rows, None).count() == 4 and filters.keep_docs(rows, rows.filter("doc_id = 'a'")).count() == 1


def test_questions_that_name_a_notice(spark):
    q = lambda t: one(spark, filters.names_notice(F.col("q"), F.lit("국립 도서관 시스템 구축"), F.lit("문화부")), q=t)
    assert q("국립 도서관 사업의 예산은?") and q("도서관 문화부") and not q("시스템 구축 배점은?")


# Pieces


def test_pipeline_of_pieces(spark):
    add = lambda n: lambda df: df.withColumn("x", F.concat("x", F.lit(n)))
    p = search.Pipeline([("a", add("a")), ("b", add("b"))])
    out = lambda q: q(spark.createDataFrame([("",)], "x string")).first().x
    assert out(p) == "ab" and out(p.without("a")) == "b" and out(p.replace("b", add("c"))) == "ac" and out(p.insert(1, "z", add("z"))) == "azb" and out(p.add("d", add("d"))) == "abd" and out(p[1:]) == "b" and len(p) == 2
    assert [n for n, _ in p.timings] == ["a", "b"]


def test_variants_by_a_model(spark):
    q = spark.createDataFrame([(1, "언제까지 내요?")], "query_id int, text string")
    assert search.rewritten(q, lambda p: ["x 질문: 제출 마감일시\n둘째" for _ in p]).first().text == "제출 마감일시"
    got = search.multiplied(q, lambda p: ["1. 마감은 언제인가\n- 짧음\n* 제출 기한은 며칠\n마감은 언제인가\n넷째 줄도 있다" for _ in p]).orderBy("variant").collect()
    assert [r.text for r in got] == ["언제까지 내요?", "마감은 언제인가", "제출 기한은 며칠"]


def test_hits_of_variants_come_in_order(spark):
    variants = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "query_id long, variant int, text string")
    hits = {"a": ["x", "y"], "b": ["z", "x"]}
    found = lambda queries, k: spark.createDataFrame([(r.query_id, c, 1.0, n + 1) for r in queries.collect() for n, c in enumerate(hits[r.text])], "query_id string, chunk_id string, score double, rank int")
    got = search.run_search(found, variants, 2).orderBy("rank").collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [(1, "x"), (1, "y"), (1, "z")]


def test_context_headers_and_budget(spark):
    schema = "query_id int, rank int, doc_id string, text string, gen string, title string, agency string, notice_no string, revision int, bid_close_at string, budget double, budget_kind string"
    rows = [(1, 1, "N-1", "본문", "생성", "사업", "기관", "N", 1, "2024-04-01 10:00", 150000000.0, "배정예산"), (1, 2, "M", "둘째", "", None, "기관", "M", None, "", None, None), (1, 3, "K", "x" * 300, "", "t", None, None, None, None, None, None)]
    hits = spark.createDataFrame(rows, schema)
    got = search.contexts(hits, 200, generation=True).first()
    assert got.context == "[1] 사업 · 기관 · N · 1차 공고 · 마감 2024-04-01 · 배정예산 1억 5,000만원\n생성\n\n---\n\n[2] 기관 · M\n둘째" and got.n_chunks == 2 and got.chars == len(got.context)
    assert search.contexts(hits.filter("rank = 3").withColumn("rank", F.lit(1)), 10).first().n_chunks == 1
    tight = len(got.context) - 1
    assert search.contexts(hits, tight, generation=True).first().n_chunks == 1


def test_notices_are_folded(spark):
    chunks = spark.createDataFrame([(f"{d}{k}", d, n, r, "text", d, "a", 1.0, "2024") for d, n, r in (("A-0", "A", 0), ("A-1", "A", 1), ("B", "B", None), ("C", "B", None)) for k in "xy"], "chunk_id string, doc_id string, notice_no string, revision int, text string, title string, agency string, budget double, bid_close_at string")
    hits = spark.createDataFrame([(1, c, 1.0, n + 1) for n, c in enumerate(["A-0x", "A-1x", "A-1y", "Bx", "Cx"])], "query_id int, chunk_id string, score double, rank int")
    got = search.notices_found(hits, chunks).orderBy("rank").collect()
    assert [(r.doc_id, r.n_chunks) for r in got] == [("A-1", 2), ("B", 1), ("C", 1)]


def test_needles_meet_by_their_rarest_word(spark):
    chunks = spark.createDataFrame([("a", "one two three four"), ("b", "two three"), ("c", "xone two threex"), ("d", None)], "chunk_id string, text string")
    needles = spark.createDataFrame([(1, "one two three"), (2, "two"), (3, "no such words"), (4, ""), (5, "two three")], "query_id int, text string")
    got = {(r.query_id, r.chunk_id) for r in retrieval.holding(chunks, needles).collect()}
    assert got == {(1, "a"), (1, "c"), (2, "a"), (2, "b"), (2, "c"), (5, "a"), (5, "b"), (5, "c")}


# Chunks of two texts


def test_chunk_pairs(spark):
    table = "\n".join(["| 가 | 나 |", "|---|---|"] + [f"| {k} | {'v' * 30} |" for k in range(40)])
    text = "머리말 " * 100 + "\n" + table + "\n" + "맺음말 " * 100
    pairs = chunking.chunk_pairs(text, 300, 50)
    assert all("|" not in s for s, _ in pairs) and "".join(g for _, g in pairs).count("| 가 | 나 |") >= 2 and chunking.chunk_pairs("", 300) == [] == chunking.chunk_pairs(None)
    after = next(k for k, (_, g) in enumerate(pairs) if g.startswith("| 가"))
    assert not pairs[after + 1][1].startswith("v") and all(s == chunking.plain(g) for s, g in pairs)
    got = chunking.chunked_pairs(spark.createDataFrame([("d", text), ("e", None)], "doc_id string, text string"), 300, 50).collect()
    assert [(r.text, r.gen) for r in sorted(got, key=lambda r: r.order)] == pairs and {r.total for r in got} == {len(pairs)}


@pytest.mark.parametrize("text", ["", "a", "| a | b |\n|---|---|\n| 1 | 2\\|3 |\n끝<br>x", "| a |\n\n| b |\n| c |", "[행 1] 시각: 15:00 x: 1\n\n\n\n| | |\n| h |", "| h1 | h2 |\n| v |\n| a | b | c |\nx | y"])
def test_markup_by_column_and_by_text(spark, text):
    assert one(spark, markup.without_table_markup(F.col("v")), v=text) == chunking.plain(text)


# HWP5


def ole(streams: dict[str, bytes]) -> bytes:
    """A container of two levels with sectors of 512 bytes and no small streams (all are made large enough)."""
    folders = sorted({p.split("/")[0] for p in streams if "/" in p})
    entries = [("Root Entry", 5, 0, b"")] + [(f, 1, 0, b"") for f in folders] + [(p.rpartition("/")[2], 2, 0, d) for p, d in streams.items()]
    paths = ["", *folders, *streams]
    children = {f: [i for i, p in enumerate(paths) if i and p.rpartition("/")[0] == f and (p not in folders or f == "")] for f in ["", *folders]}
    n_dir = -(-len(entries) * 128 // 512)
    sectors, fat, starts = [], [], []
    at = 1 + n_dir
    for _, kind, _, data in entries:
        n = -(-len(data) // 512) if kind == 2 else 0
        starts.append(at if n else 0xFFFFFFFE)
        sectors += [data[i * 512 : (i + 1) * 512].ljust(512, b"\0") for i in range(n)]
        at += n
    fat = [0xFFFFFFFD] + [k + 1 for k in range(1, n_dir)] + [0xFFFFFFFE]
    for (_, kind, _, data), s in zip(entries, starts):
        n = -(-len(data) // 512) if kind == 2 else 0
        fat += [s + k + 1 for k in range(n - 1)] + [0xFFFFFFFE] * (n > 0)
    fat += [0xFFFFFFFF] * (128 - len(fat))
    assert len(fat) == 128
    directory = b""
    for i, (name, kind, _, data) in enumerate(entries):
        raw = name.encode("utf-16-le") + b"\0\0"
        own = children.get(paths[i] if kind != 5 else "", []) if kind != 2 else []
        family = next((c for c in children.values() if i in c), [])
        right = family[family.index(i) + 1] if i in family and family.index(i) + 1 < len(family) else 0xFFFFFFFF
        directory += raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, 0xFFFFFFFF, right, own[0] if own else 0xFFFFFFFF) + b"\0" * 36 + struct.pack("<III", starts[i] if kind == 2 else 0xFFFFFFFE, len(data), 0)
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIII", 0, 1, 1, 0, 16, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    head += struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return head.ljust(512, b"\0") + struct.pack("<128I", *fat) + directory.ljust(n_dir * 512, b"\0") + b"".join(sectors)


def record(tag: int, level: int, payload: bytes) -> bytes:
    return struct.pack("<I", tag | level << 10 | len(payload) << 20) + payload


def section() -> bytes:
    text = lambda t, level: record(67, level, t.encode("utf-16-le"))
    cell = lambda r, c, t: record(72, 2, b"\0" * 8 + struct.pack("<4H", c, r, 1, 1)) + record(66, 2, b"\0" * 4) + text(t, 3)
    table = record(71, 1, b" lbt") + record(77, 2, b"\0" * 4 + struct.pack("<HH", 2, 2)) + cell(0, 0, "이름") + cell(0, 1, "값") + cell(1, 0, "○ 예산") + cell(1, 1, "백만원")
    return record(66, 0, b"") + text("사업 개요입니다.", 1) + record(66, 0, b"") + table + record(66, 0, b"") + text("끝.", 1)


@pytest.mark.parametrize("packed", [0, 1])
def test_hwp_documents(spark, packed):
    data = section()
    data = zlib.compress(data)[2:-4] if packed else data
    box = ole({"FileHeader": (b"HWP Document File".ljust(36, b"\0") + struct.pack("<I", packed)).ljust(600, b"\0"), "BodyText/Section0": data, "PrvText": "미리 보기".encode("utf-16-le").ljust(600, b"\0")})
    text, counts = hwp.hwp(box)
    assert text == "사업 개요입니다.\n이름 값\n- 예산 백만원\n끝." and counts == {"tables": 1, "success": 1, "partial": 0, "failed": 0}
    assert hwp.hwp(box, True)[0] == "사업 개요입니다.\n이름: 값\n- 예산: 백만원\n끝." and hwp.preview(box).startswith("미리 보기")
    row = files.extract(spark.createDataFrame([("a.hwp", bytearray(box)), ("b.hwp", bytearray(b"none"))], "path string, content binary")).orderBy("path").collect()
    assert (row[0].extractor, row[0].tables_total, row[0].text) == ("hwp_raw", 1, text) and row[1].extractor == "failed" and "not an OLE container" in row[1].error


def test_hwp_chain_and_locks():
    locked = ole({"FileHeader": (b"HWP Document File".ljust(36, b"\0") + struct.pack("<I", 2)).ljust(600, b"\0"), "PrvText": "한글".encode("utf-16-le") * 200})
    name, text, _, failed = hwp.first_that_reads(locked)
    assert name == "prvtext" and text.startswith("한글") and len(failed) == 2 and "encrypted" in failed[0]
    assert hwp.first_that_reads(b"x", [("a", lambda c: ("latin only", {}))])[3] == ["a: few Hangul letters"]


def test_hwp_tables():
    cell = lambda r, c, t, rows=1, cols=1: hwp.Cell(r, c, rows, cols, [t])
    grid = [cell(0, 0, "h1"), cell(0, 1, "h|2"), cell(0, 2, "h3"), cell(1, 0, "a"), cell(1, 1, "b\nc"), cell(1, 2, "d")]
    assert hwp.rendered(2, 3, grid) == ("|h1|h\\|2|h3|\n|---|---|---|\n|a|b<br>c|d|", "success")
    assert hwp.rendered(2, 3, [cell(0, 0, "h", 1, 3), cell(1, 0, "a"), cell(1, 1, "b"), cell(1, 2, "c")]) == ("[행 1] h: a h: b h: c", "success")
    assert hwp.rendered(2, 3, grid[:5])[1] == "partial" and hwp.rendered(2, 3, grid[:2])[0].startswith("[표 복원 실패: 채움비율 33%]") and hwp.rendered(0, 0, [])[1] == "failed"
    assert hwp.told(2, 3, grid, "배점") == "[배점] h1 | h|2 | h3\n[배점] h1=a · h|2=b\nc · h3=d" and hwp.told(2, 1, [cell(0, 0, "x"), cell(1, 0, "x")]) == "x" and hwp.told(1, 1, []) == ""
    assert hwp.told(1, 1, [cell(4, 4, "x")]).endswith("격자복원실패]\n- x") and hwp.caption_of(["표 1 배점", "[x] a=b"]) == "표 1 배점" and hwp.caption_of([]) == "표"


def test_pages_of_words():
    assert hwp.inside_any((1, 1, 2, 2), [(0, 0, 3, 3)]) and not hwp.inside_any((1, 1, 4, 2), [(0, 0, 3, 3)])
    assert hwp.fuller([[["a", ""]]], [[["a", "b"]]]) == [[["a", "b"]]] and hwp.looks_scanned(["", "x" * 50]) and not hwp.looks_scanned(["x" * 90, "y"]) and hwp.looks_scanned([])


# Stores


def test_stores(spark, tmp_path):
    chunks = spark.createDataFrame([("a0", "A", 0, "x"), ("a1", "A", 1, "y"), ("b0", "B", 0, "z")], "chunk_id string, doc_id string, order int, text string")
    s = store.Stores(spark, f"file://{tmp_path}", "m1", lambda df: df.withColumn("v", F.length("text")))
    assert s.names() == [] and s.build("one", chunks).count() == 3 and s.names() == ["one"]
    held = s.read("one", chunks)
    changed = spark.createDataFrame([("a0", "A", 0, "x!"), ("b0", "B", 0, "z"), ("c0", "C", 0, "w")], chunks.schema)
    assert s.sync("one", changed) == (2, 1, 1) and s.sync("one", changed) == (0, 0, 3)
    assert held.count() == 3 and {r.text for r in s.read("one", changed).collect()} == {"x!", "z", "w"}  # an open reader keeps its version
    assert s.delete("one", ["C", "", None]) == (3, 2) and s.add("one", chunks.filter("doc_id = 'A'")).count() == 4
    with pytest.raises(store.StoreError):
        store.Stores(spark, f"file://{tmp_path}", "m2", None).read("one")
    with pytest.raises(store.StoreError):
        s.read("one", chunks)
    with pytest.raises(store.StoreError):
        s.read("two")
    (tmp_path / "one" / f"claim-{s.stamp('one')['version'] + 1}.json").write_text('{"owner": "x", "until": 1e12}')
    with pytest.raises(store.StoreError):
        s.add("one", chunks)
    s.drop("one")
    s.drop("one")
    assert s.names() == []


def rewritten(path, text):
    """A small file with other content, and without the checksum that Hadoop keeps beside it."""
    path.write_text(text)
    path.with_name(f".{path.name}.crc").unlink(missing_ok=True)


class Killed(BaseException):
    """A writer's end that no clean-up of its own follows."""


CHUNK = "chunk_id string, doc_id string, order int, text string"


@pytest.mark.parametrize("step", ["start", "claimed", "written", "stamped"])
def test_a_killed_writer_leaves_a_store(spark, tmp_path, monkeypatch, step):
    """Killed between any two steps: readers keep their table, a table is there at every moment, the next writer goes on, once the lease has run out if there is a claim."""
    one, two, three = (spark.createDataFrame([(f"{d}0", d, 0, f"text {d}")], CHUNK) for d in "ABC")
    embed = lambda df: df.withColumn("v", F.length("text"))
    s = store.Stores(spark, f"file://{tmp_path}", "m", embed)
    s.build("n", one)
    held = s.read("n")

    def kill(at):
        if at == step:
            raise Killed
        assert s.read("n").count() in (1, 2)  # at every step there is a version

    monkeypatch.setattr(s, "_step", kill)
    with pytest.raises(Killed):
        s.add("n", two)
    after = store.Stores(spark, f"file://{tmp_path}", "m", embed)
    done = step == "stamped"
    assert held.count() == 1 and after.read("n").count() == 1 + done
    if step in ("claimed", "written"):
        with pytest.raises(store.StoreError):
            after.add("n", three)
        (claim,) = (tmp_path / "n").glob("claim-*.json")
        rewritten(claim, '{"owner": "dead", "until": 0}')
    assert after.add("n", three).count() == 2 + done and held.count() == 1 and after.stamp("n")["signature"] == store.signature_of(after.read("n"))
    after.prune("n", 1)
    assert after.read("n").count() == 2 + done and len(list((tmp_path / "n").glob("part-*"))) == 2 + done and not list((tmp_path / "n").glob("expired-*"))


def test_stamps_that_are_not_whole(spark, tmp_path):
    """A stamp that its writer left empty or cut doesn't count, and its number isn't used again; a writer that lost its claim doesn't publish."""
    chunk = spark.createDataFrame([("A0", "A", 0, "t")], CHUNK)
    s = store.Stores(spark, f"file://{tmp_path}", "m", lambda df: df)
    s.build("n", chunk)
    (tmp_path / "n" / "stamp-2.json").write_text("")
    (tmp_path / "n" / "stamp-3.json").write_text('{"version": 3, "pa')
    assert s.stamp("n")["version"] == 1 and s.read("n").count() == 1
    assert s.add("n", chunk).count() == 2 and s.stamp("n")["version"] == 4

    def rob(step):
        if step == "written":
            rewritten(tmp_path / "n" / "claim-5.json", '{"owner": "other", "until": 1e12}')

    s._step = rob
    with pytest.raises(store.StoreError):
        s.add("n", chunk)
    assert s.stamp("n")["version"] == 4 and (tmp_path / "n" / "claim-5.json").exists()


def test_adding_writes_what_is_new(spark, tmp_path):
    s = store.Stores(spark, f"file://{tmp_path}", "m", lambda df: df.withColumn("v", F.length("text")))
    s.build("n", spark.createDataFrame([(f"c{k}", "A", k, "t") for k in range(50)], CHUNK))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "n").rglob("*.parquet")}
    s.add("n", spark.createDataFrame([("new", "B", 0, "u")], CHUNK))
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "n").rglob("*.parquet")}
    assert before.items() <= after.items() and sum(spark.read.parquet(str(p)).count() for p in after.keys() - before.keys()) == 1
    assert store.joined_signature("2--5", "3-7") == f"5-{-5 ^ 7}"


def test_numbers_over_ranges(spark):
    """The same numbers as one sorted list, with ties, nulls and no rows."""
    import random

    r = random.Random(1)
    rows = [(r.choice([None, *range(300)]), k) for k in range(1000)]
    df = spark.createDataFrame(rows, "a int, b int")
    got = sorted((x.n, x.a, x.b) for x in tables.numbered(df, "n", "a", F.col("b").desc()).collect())
    assert [(a, b) for _, a, b in got] == sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, -x[1])) and [n for n, *_ in got] == list(range(1000))
    assert tables.numbered(df.limit(0), "n", "a").columns == ["a", "b", "n"] and tables.numbered(df.limit(0), "n", "a").count() == 0
    assert "Window" not in tables.numbered(df, "n", "a")._jdf.queryExecution().toString()


def test_upserts_go_on_after_a_stop(spark, tmp_path):
    """Two batches, a stop, more files on a new call; a batch whose version was written but not committed; a checkpoint that is lost."""
    import shutil

    def feed(n, folder):
        spark.createDataFrame([(k % 4, 10 * n + k, f"{n}.{k}") for k in range(6)] + [(9, 1, f"tie{n}")], "k int, t int, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{folder}")

    once, parts = str(tmp_path / "once"), str(tmp_path / "parts")
    for n in range(5):
        feed(n, "all")
    whole = sorted(map(tuple, events.upserted(spark, f"{tmp_path}/all", "k", "t", once).collect()))
    for n in range(2):
        feed(n, "some")
    events.upserted(spark, f"{tmp_path}/some", "k", "t", parts, files_per_batch=1)
    assert events.versions(spark, parts) == [0, 1]
    feed(2, "some")
    first = sorted(map(tuple, events.upserted(spark, f"{tmp_path}/some", "k", "t", parts, files_per_batch=1).collect()))
    # As if the driver had died between the version and its commit: the batch is run again and makes the same table.
    for f in (tmp_path / "parts" / "state" / "commits").glob("*2*"):
        f.unlink()
    assert sorted(map(tuple, events.upserted(spark, f"{tmp_path}/some", "k", "t", parts, files_per_batch=1).collect())) == first
    feed(3, "some")
    feed(4, "some")
    last = sorted(map(tuple, events.upserted(spark, f"{tmp_path}/some", "k", "t", parts, files_per_batch=1).collect()))
    assert [r[:2] for r in last] == [r[:2] for r in whole] and [r for r in last if r[0] != 9] == [r for r in whole if r[0] != 9] and last[-1] == (9, 1, "tie4")
    assert len(events.versions(spark, parts)) == 2
    shutil.rmtree(tmp_path / "parts" / "state")
    with pytest.raises(RuntimeError):
        events.upserted(spark, f"{tmp_path}/some", "k", "t", parts)


# Answers and evaluation sets


def test_answer_measures(spark):
    rows = spark.createDataFrame([(1, "a", "90% [1] [3]", "[1] 90", ["마. 계약방법 : 90%"]), (2, "a", "정보가 없습니다", "[1]", None), (3, None, "정보가 없습니다 [1]", "[1]", ["x"])], "qid int, kind string, answer string, context string, keywords array<string>")
    got = {r.qid: tuple(r[n] for n in answers.NAMES) for r in answers.scored(rows).collect()}
    assert got == {1: (1.0, 0.5, 1.0, 0.0, 1.0), 2: (0.0, None, None, 1.0, None), 3: (1.0, 1.0, None, 0.0, 0.0)}
    kinds = {r.kind: (r.questions, r.gold) for r in answers.by_kind(answers.scored(rows)).collect()}
    assert kinds == {"a": (2, 1.0), "?": (1, 0.0), "전체": (3, 0.5)}


def test_calls_that_fail(spark):
    def model(prompts):
        if "bad" in prompts[0]:
            raise RuntimeError("no")
        return ["YES indeed"]

    rows = spark.createDataFrame([(1, "bad", "c"), (2, "good", None)], "qid int, question string, context string")
    got = {r.qid: (r.answer, r.ok, r.error) for r in answers.generated(rows, model).collect()}
    assert got == {1: (None, False, "RuntimeError: no"), 2: ("YES indeed", True, None)}
    assert one(spark, answers.judged(F.lit("q"), F.lit("c"), F.col("v"), lambda p: ["yes, no"] * len(p)), v="a") is True


def test_spans(spark):
    text = "앞말 사업비는 일억 오천만원 정도로 책정되어 있습니다. 사업 기간은 착수일로부터 육 개월 동안 진행됩니다. 끝"
    evidence = "사업비는 일억오천만원 정도로 책정되어 있습니다. 그리고 사업기간은 착수일로부터 육개월 동안 진행됩니다."
    rows = [(1, 1, evidence, "일억 오천만원 정도로 책정"), (2, 1, evidence, "육 개월 동안 진행됩니다"), (3, 1, "", "x"), (4, 2, evidence, None), (5, 1, "책정되어 zz", None), (6, 1, None, "a")]
    got = {r.item_id: r.span for r in evalsets.spans(spark.createDataFrame(rows, "item_id long, doc_id long, evidence string, answer string"), spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()}
    assert got[1].startswith("사업비는 일억 오천만원") and got[2].startswith("사업 기간은") and (got[3], got[4], got[6]) == ("", "", "") and got[5] == ""
    assert evalsets.spans(spark.createDataFrame([(1, 1, "정도로 책정되어 있", None)], "item_id long, doc_id long, evidence string, answer string"), spark.createDataFrame([(1, text)], "doc_id long, text string")).first().span == "정도로 책정되어 있"


def plain_run(evidence, text, least=6):
    """The longest common run by trying all, noise never matching."""
    from gleanspark.operators.grounding import NOISE

    e, t = NOISE.sub(lambda m: "\0" * len(m[0]), evidence), NOISE.sub(lambda m: "\1" * len(m[0]), text)
    best = (0, 0)
    for i in range(len(e)):
        for n in range(len(e) - i, max(least, -best[0] + 1) - 1, -1):
            if e[i : i + n] in t:
                best = min(best, (-n, i))
                break
    return evidence[best[1] : best[1] - best[0]].strip() if -best[0] >= least else ""


def plain_grounding(evidence, doc_id, texts, least=6, telling=8):
    own = plain_run(evidence or "", texts.get(doc_id) or "", least)
    if own:
        return own, "공고특정불가" if len(own) >= telling and sum(own in (t or "") for t in texts.values()) > 1 else None
    best = ""
    for d in sorted(texts):
        run = plain_run(evidence or "", texts[d] or "", least)
        best = run if len(run) > len(best) else best
    return best, "라벨불일치" if best else "코퍼스에없음"


@pytest.mark.parametrize("letters", ["ab c", "abcdefghij klmnop", "가나 다a"])
def test_grounding_against_all_pairs(spark, letters):
    """Own runs, runs of others, ties, noise, white space at the ends, nulls and evidence of nothing; texts of few letters make every seed frequent."""
    import random

    from gleanspark.operators import grounding

    r = random.Random(len(letters))
    made = lambda n: "".join(r.choice(letters) for _ in range(n))
    texts = {k: made(r.randint(0, 150)) for k in range(25)} | {30: None, 31: "", 32: "one page - 12 - of text p. 3 here", 33: "    " * 10}
    texts[3], texts[25] = made(60), made(40)
    texts[26] = texts[3] + made(5)
    rows = []
    for k in range(60):
        source = texts[r.randrange(27) if k % 3 else k % 25]
        a = r.randrange(max(1, len(source)))
        part = source[a : a + r.randint(0, 40)]
        rows.append((k, r.choice([k % 25, 31, 3]), "QWERT" * (k % 4 == 0) + part + r.choice(["", " - 12 -", "zz 3쪽 "]) + made(r.randint(0, 8))))
    rows += [(90, 1, None), (91, 2, ""), (92, 3, "short"), (93, 32, "one page - 12 - of text p. 3 here"), (94, 33, "       "), (95, 77, texts[3]), (96, 3, texts[3][2:40])]
    docs, pairs = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, doc_id long, evidence string")
    got = {x.item_id: (x.keyword, x.defect) for x in grounding.grounded(pairs, docs).collect()}
    assert got == {i: plain_grounding(e, d, texts) for i, d, e in rows} and {x[1] for x in got.values()} >= {None, "라벨불일치", "코퍼스에없음", "공고특정불가"}


def test_the_query_of_grounding_against_all_pairs(spark):
    """e04_e06_j12_routed over the whole smallest tables."""
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text}
    items = {r.item_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()}
    rows = {r.item_id: r for r in entry.queries()["e04_e06_j12_routed"](spark, "/root/testdata/sf0.001").collect()}
    asked = 0
    for i, r in rows.items():
        if r.answerable and r.defect not in ("중복질문", "빈키워드"):
            evidence = "ㄱㄴㄷㄹㅁㅂㅅ" if i % 5 == 1 else items[i]
            assert (r["keywords"][0], r.defect) == plain_grounding(evidence, i, texts)
            asked += 1
    assert asked > 10


def test_grounding_has_no_join_of_all_with_all(spark):
    """No pair of tables meets but on equal columns, and no table of questions is copied to every task by a hint."""
    from gleanspark.operators import grounding

    docs, pairs = spark.createDataFrame([(1, "some text of ten words")], "doc_id long, text string"), spark.createDataFrame([(1, 1, "text of ten")], "item_id long, doc_id long, evidence string")
    plan = grounding.grounded(pairs, docs)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_routing(spark):
    docs = spark.createDataFrame([(1, "the first body has words alpha beta"), (2, "the second body has words gamma delta"), (3, "alpha beta again in the third")], "doc_id long, text string")
    rows = [(1, "q1", "a", 1, "first body has", False), (2, "q 1", "a", 1, "x", False), (3, "q3", "a", 1, " ", False), (4, "q4", "a", 1, "second body has words gamma", False), (5, "q5", "a", 1, "words alpha beta", False), (6, "q6", "a", 1, "ㄱㄴㄷㄹㅁㅂㅅ", False), (7, "q7", "a", 9, None, True), (8, "q8", "a", 3, "alpha beta", False)]
    got = {r.item_id: (r.defect, r.answerable) for r in evalsets.routed(spark.createDataFrame(rows, "item_id long, question string, answer string, doc_id long, evidence string, unanswerable boolean"), docs).collect()}
    assert got[1] == (None, True) and got[2][0] == "중복질문" and got[3][0] == "빈키워드" and got[6][0] == "코퍼스에없음" and got[7] == (None, False) and got[8][0] == "공고특정불가"
    lost = evalsets.grounded(spark.createDataFrame([(4, 9, "second body has words gamma")], "item_id long, doc_id long, evidence string"), docs).first()
    assert (lost.defect, lost.keyword) == ("라벨불일치", "second body has words gamma")


def test_contexts_from_evidence(spark):
    pairs = spark.createDataFrame([(k, f"evidence {k}") for k in range(10)] + [(10, ""), (11, None)], "item_id long, evidence string")
    got = evalsets.contexts_from_evidence(pairs).collect()
    assert len(got) == 10 and all(r.n_chunks == 3 and f"[{r.gold_at}]\nevidence {r.item_id}" in r.context.split("\n\n---\n\n") for r in got)
    assert len({r.gold_at for r in got}) > 1 and got == evalsets.contexts_from_evidence(pairs).collect()
    assert evalsets.contexts_from_evidence(pairs.limit(1)).first().n_chunks == 1


def test_proposed_pairs(spark):
    windows = spark.createDataFrame([(1, "d", "text"), (2, "d", "other")], "chunk_id long, doc_id string, text string")
    model = lambda prompts: ['x ```json\n[{"question": "q", "answer": "a", "evidence": "e"}]\n``` y' if p.endswith("text") else "no json" for p in prompts]
    assert [tuple(r) for r in evalsets.proposed(windows, model).collect()] == [("1#0", "q", "a", "d", "e")]
    assert evalsets.is_current(None, "s") and evalsets.is_current(evalsets.stamp(windows, "s", 1, 0), "s") and not evalsets.is_current(evalsets.stamp(windows, "s", 1, 0), "t")


def test_adapted_rows(spark):
    foreign = spark.createDataFrame([(1, "사업 계획서.hwp", "예산은 일억 오천만원 정도로 책정되어 있음", "", False), (2, "사업 계획서", "그대로", "", True), (3, "없음", "x", "", False)], "item_id long, name string, evidence string, answer string, ready boolean")
    known = spark.createDataFrame([("사업 계획서", 7)], "key string, doc_id long")
    bodies = spark.createDataFrame([(7, "앞 예산은 일억 오천만원 정도로 책정되어 있음 뒤")], "doc_id long, text string")
    got = {r.item_id: (r.doc_id, r.keyword, r.reason) for r in evalsets.adapted(foreign, known, bodies).collect()}
    assert got == {1: (7, "예산은 일억 오천만원 정도로 책정되어 있음", "exact"), 2: (7, "그대로", "exact"), 3: (None, "", "none")}


# Reports


def test_revisions_and_similarity(spark):
    docs = spark.createDataFrame([("A", 0, "abcd"), ("A", 2, "abce"), ("B", 0, "x"), ("C", 0, "s"), ("C", 1, "s")], "notice_no string, revision int, text string")
    got = {r.notice_no: (r.first, r.last, r.same, r.similarity) for r in reports.revisions(docs).collect()}
    assert got == {"A": (0, 2, False, 0.75), "C": (0, 1, True, 1.0)}
    hits, families = spark.createDataFrame([(1, "A-0")], "query_id int, doc_id string"), spark.createDataFrame([(1, "A-0"), (1, "A-2")], "query_id int, doc_id string")
    assert {r.doc_id: r.hits for r in reports.starved(hits, families).collect()} == {"A-0": 1, "A-2": 0}


def test_newer_sources(spark):
    rows = spark.sql("select 'a' path, timestamp'2024-01-02' modificationTime union all select 'b', timestamp'2024-01-01'")
    assert reports.newer_sources(rows, __import__("datetime").datetime(2024, 1, 1, 12)).first().newer == 1


def test_greedy_names(spark):
    """A file whose best name is taken gets the next one."""
    stem = "a very long common beginning "
    left = spark.createDataFrame([(stem + "x",), (stem + "xy",), ("short",)], "key string")
    names = spark.createDataFrame([(stem + "xyz",), (stem + "q",)], "name string")
    assert {r.key: r.name for r in tables.assigned(left, names).collect()} == {stem + "x": stem + "xyz", stem + "xy": stem + "q"}
    files_ = spark.createDataFrame([("f1.hwp",), ("f2.hwp",)], "file_name string")
    with pytest.raises(ValueError):
        tables.merge_metadata(files_, spark.createDataFrame([("f1.hwp", "t")], "file_name string, title string"), matched=0.9)


def test_assignment_against_the_rule(spark):
    """All pairs, file after file, as the rule says; most names share their heads, several are equal, whole names are free once."""
    import os
    import random

    for seed in range(3):
        r = random.Random(seed)
        name = lambda: "head" * 3 + "".join(r.choice("ab") for _ in range(r.randint(0, 9)))
        keys, free = sorted({name() for _ in range(60)}), [name() for _ in range(50)] + [None, "x"]
        left, want = sorted(n for n in free if n and len(n) >= 13), {}
        for k in keys:
            best = max(left, key=lambda n: len(os.path.commonprefix([k, n])), default="")  # the first of several
            if len(os.path.commonprefix([k, best])) >= 13:
                want[k] = best
                left.remove(best)
        got = tables.assigned(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(n,) for n in free], "name string"), 13)
        assert {x.key: x.name for x in got.collect()} == want and len(want) > 20


@pytest.mark.parametrize("kind", ["long", "string"])
def test_prefixes_against_all_pairs(spark, monkeypatch, kind):
    """Names that all share a head, in many ranges; stems that reach over several, nested ones, keys of several documents, nulls and letters beyond the basic plane."""
    import random

    r = random.Random(7)
    name = lambda n: "Common#" + "".join(r.choice("ab가😀") for _ in range(n))
    known = [(name(r.randint(0, 7)), i if kind == "long" else f"d{i}") for i in range(400)] + [(None, known_id := 7 if kind == "long" else "d7"), ("", known_id)]
    names = sorted({name(r.randint(0, 6)) for _ in range(150)} | {"C", "Common#", "Common#a.b.pdf", ".hwp", "", "none", "Common#" + "a" * 9})
    monkeypatch.setattr(mining, "DRAWN", 2)
    got = {x.name: (x.doc_id, x.reason) for x in mining.resolved(spark.createDataFrame([(n,) for n in names + [None]], "name string"), spark.createDataFrame(known, f"key string, doc_id {kind}")).collect()}
    for n in names:
        stem = n.rpartition(".")[0] if "." in n[1:] else n
        exact = min((d for k, d in known if k == n), default=None) or min((d for k, d in known if k == stem), default=None)
        hits = {d for k, d in known if k is not None and k.startswith(stem)} if stem else set()
        if exact is not None:
            assert got[n][1] == "exact" and got[n][0] in {d for k, d in known if k in (n, stem)}
        else:
            assert got[n] == ((hits.pop(), "prefix") if len(hits) == 1 else (None, "ambiguous" if hits else "none")), n


def test_decomposed_file_names_match(spark):
    """A name in decomposed letters, with another extension, is the same file."""
    import unicodedata

    name = "제안요청서 각 ñ"
    meta = spark.createDataFrame([(name + ".hwp", "t")], "file_name string, title string")
    found = tables.merge_metadata(spark.createDataFrame([(unicodedata.normalize("NFD", name) + ".HWPX ",)], "file_name string"), meta, matched=0.9).first()
    assert (found.title, found.match) == ("t", "exact")


def test_incremental_processing(spark):
    now = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "path string, modified int")
    before = spark.createDataFrame([("a", 1, "old"), ("b", 1, "old"), ("gone", 1, "old")], "path string, modified int, text string")
    got = documents.incremental(now, before, lambda f: f.withColumn("text", F.lit("new")))
    assert sorted(map(tuple, got.collect())) == [("a", 1, "old"), ("b", 2, "new"), ("c", 1, "new")]
    assert documents.cached_rows(before, ["text", "other"]).columns == ["path", "modified"]


def test_survival_across_pieces(spark):
    pairs = spark.createDataFrame([("k", 1, "ab cd"), ("k", 1, "zz"), ("k", 2, "x")], "kind string, doc_id int, keyword string")
    pieces = spark.createDataFrame([(1, 0, "..ab "), (1, 1, "cd.."), (2, 0, "x")], "doc_id int, order int, text string")
    assert [tuple(r) for r in mining.survival(pairs, pieces).collect()] == [("k", 3, 2)]


def test_upserts_are_the_latest(spark, tmp_path):
    spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (2, 2, "b"), (1, 2, "x")], "k int, t int, v string").repartition(3).write.parquet(f"{tmp_path}/in")
    assert sorted((r.k, r.v) for r in events.upserted(spark, f"{tmp_path}/in", "k", "t").collect()) == [(1, "c"), (2, "b")]


def test_models_agree(spark):
    df = spark.createDataFrame([("Abc def",)], "t string")
    a, b = df.select(models.embed(F.col("t")).alias("a"), models.embed_exactly(F.col("t")).alias("b")).first()
    assert max(abs(x - y) for x, y in zip(a, b)) < 1e-6


# The listing service


def answer(items, total, code="00"):
    import json

    return json.dumps({"response": {"header": {"resultCode": code, "resultMsg": "m"}, "body": {"items": items, "totalCount": total}}})


def test_answers_of_the_service():
    assert listings.page_of(answer({"a": 1}, "3")) == ([{"a": 1}], 3) and listings.page_of(answer(None, None)) == ([], 0)
    for bad in (answer([], 0, "30"), "<xml/>", "{}", "[]"):
        with pytest.raises(listings.ServiceError):
            listings.page_of(bad)


def test_crawl_and_download(spark, tmp_path):
    columns = ["bidNtceNo", "bidNtceOrd", "bidNtceNm", "sucsfbidMthdNm", "ntceKindNm"] + [f"ntceSpec{k}{n}" for n in range(1, 11) for k in ("FileNm", "DocUrl")]
    item = lambda n, **more: {"bidNtceNo": f"N{n}", "bidNtceOrd": "000", "bidNtceNm": "포털 구축", "ntceSpecFileNm1": "a.HWP", "ntceSpecDocUrl1": f"http://x/{n}"} | more
    items = [item(1), item(2), item(3, bidNtceNm="청소"), item(4, ntceKindNm="취소공고"), item(5), item(2)]
    told = {page: answer(items[(page - 1) * 2 : page * 2], len(items)) for page in (1, 2, 3)}
    ask = lambda page: told[page]
    known = spark.createDataFrame([("N5-0",)], "doc_id string")
    got = listings.crawled(spark, ask, known, columns, rows=2)
    assert sorted(r.doc_id for r in got.collect()) == ["N1-0", "N2-0"]
    assert sorted(r.doc_id for r in listings.crawled(spark, ask, known, columns, rows=2, take_all=True).collect()) == ["N1-0", "N2-0", "N3-0"]
    assert [r.doc_id for r in listings.crawled(spark, ask, known, columns, rows=2, limit=1).collect()] == ["N1-0"]

    def fetch(url):
        if url.endswith("2"):
            raise OSError("gone")
        return b"file of " + url.encode()

    rows = {r.doc_id: (r.bytes, r.error) for r in listings.downloaded(got, fetch, str(tmp_path)).collect()}
    assert rows == {"N1-0": (18, None), "N2-0": (None, "OSError: gone")} and sorted(p.name for p in tmp_path.iterdir()) == ["N1-0.hwp"]


def test_bm25_takes_any_tokenizer(spark):
    chunks = spark.createDataFrame([("a", "Red-Apple"), ("b", "green apple pie"), ("c", "blue"), ("d", None), ("e", "")], "chunk_id string, text string")
    q = spark.createDataFrame([(1, "APPLE red"), (2, "none")], "query_id int, text string")
    letters = lambda t: F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), "[^a-z]+"), lambda w: w != "")
    index = retrieval.Bm25Index(chunks, letters)
    got = [(r.query_id, r.chunk_id) for r in retrieval.bm25(index, q).orderBy("rank").collect()]
    assert got == [(1, "a"), (1, "b")] and index.n == 5
    scope = spark.createDataFrame([(1, "b")], "query_id int, chunk_id string")
    assert [r.chunk_id for r in retrieval.bm25(index, q, scope=scope).collect()] == ["b"]
    whole = {(r.query_id, r.chunk_id): r.score for r in retrieval.bm25(index, q, block=1).collect()}
    assert whole == {(r.query_id, r.chunk_id): r.score for r in retrieval.bm25(index, q).collect()}
    assert retrieval.bm25(chunks.limit(0), q).count() == 0


# Tiles, indexes and caches


def hits_of(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())


def test_tiles_against_all_pairs(spark, monkeypatch):
    """Many tiles and blocks, parts of rows and of queries, equal scores at the cut, repeated vectors and words."""
    import numpy as np

    r = np.random.default_rng(3)
    v = r.integers(-2, 3, (700, 3)).astype(float)
    q = r.integers(-2, 3, (90, 3)).astype(float)
    monkeypatch.setattr(retrieval, "PER_TILE", 100)
    monkeypatch.setattr(retrieval, "PER_BLOCK", 25)
    vectors = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)] + [(9999, None)], "chunk_id long, v array<double>")
    asked = spark.createDataFrame([(f"q{i}", x.tolist()) for i, x in enumerate(q)] + [("none", None)], "query_id string, q array<double>")
    want = []
    for i, x in enumerate(q):
        best = sorted(((-float(((x - y) ** 2).sum()) + 0.0, n) for n, y in enumerate(v)), key=lambda t: (-t[0], t[1]))[:4]
        want += [(f"q{i}", k, n, s) for k, (s, n) in enumerate(best, 1)]
    assert hits_of(retrieval.dense(vectors, asked, 4)) == sorted(want)
    words = ["".join(r.choice(list("abcd"), 3)) for _ in range(3000)]
    chunks_ = spark.createDataFrame([(f"c{i}", " ".join(r.choice(words, 12))) for i in range(600)] + [("empty", ""), ("null", None)], "chunk_id string, text string")
    questions_ = spark.createDataFrame([(i, " ".join(r.choice(words, 3))) for i in range(80)] + [(99, "zz9"), (100, None)], "query_id long, text string")
    index = retrieval.Bm25Index(chunks_)
    everything = questions_.select("query_id").crossJoin(chunks_.select("chunk_id"))  # as a scope: scored over postings
    assert hits_of(retrieval.bm25(index, questions_, 6)) == hits_of(retrieval.bm25(index, questions_, 6, scope=everything)) != []


def test_search_plans_hold_no_queries(spark):
    """The plan of a search doesn't grow with its queries, and nothing is collected to make it."""
    import numpy as np

    r = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(50)], "chunk_id long, v array<double>")
    plans = [str(retrieval.dense(vectors, spark.range(n).select(F.col("id").alias("query_id"), F.array(*[F.rand(k) for k in range(4)]).alias("q")))._jdf.queryExecution().optimizedPlan()) for n in (10, 100_000)]
    assert abs(len(plans[0]) - len(plans[1])) < 50


def test_sparse_index_against_all_products(spark, tmp_path):
    """Small blocks, lists in several parts, hot terms, negative and repeated weights; the index is found by its signature alone, and only when it is whole."""
    import random

    from gleanspark.operators import indexes

    r = random.Random(2)
    vectors = [(f"c{i}", f"t{int(40 * r.random() ** 3)}", round(r.expovariate(1), 2)) for i in range(300) for _ in range(6)]
    vectors = [(c, t, w) for (c, t), w in {(c, t): w for c, t, w in vectors}.items()] + [("neg", "t0", -5.0), ("neg", "t1", 0.0)]
    asked = [(q, f"t{int(40 * r.random() ** 2)}", round(r.random() + 0.1, 2)) for q in range(25) for _ in range(4)] + [(77, "unknown", 1.0), (78, "t0", -1.0)]
    kept, total = {}, {}
    for c in {c for c, _, _ in vectors}:
        for t, w in sorted(((t, w) for d, t, w in vectors if d == c and w > 0), key=lambda x: (-x[1], x[0]))[:4]:
            kept[c, t] = w
    for q, t, w in asked:
        for (c, u), x in kept.items():
            if u == t and w > 0:
                total[q, c] = total.get((q, c), 0.0) + w * x
    want = []
    for q in {q for q, _ in total}:
        best = sorted(((round(s, 6), c) for (p, c), s in total.items() if p == q), key=lambda x: (-x[0], x[1]))[:7]
        want += [(q, k, c) for k, (_, c) in enumerate(best, 1)]
    path, df = str(tmp_path / "index"), spark.createDataFrame(vectors, "chunk_id string, term string, w double")
    assert indexes.SparseIndex.open(spark, path, "one") is None
    index = indexes.SparseIndex.of(path, "one", lambda: df, spark, top_terms=4, size=3)
    assert [x[:3] for x in hits_of(index.search(spark.createDataFrame(asked, "query_id long, term string, w double"), 7))] == sorted(want)
    assert index.blocks.filter("size(entries) > 3").count() == 0
    again = indexes.SparseIndex.of(path, "one", lambda: 1 / 0, spark)
    assert again.blocks.count() == index.blocks.count() and indexes.SparseIndex.open(spark, path, "two") is None


def test_words_are_cut_once(spark, tmp_path):
    """A hundredth of new chunks cuts a hundredth of the texts; copies count once; another tokenizer has words of its own."""
    from gleanspark.operators import indexes

    rows = [(f"c{i}", f"some words of number{i % 150}") for i in range(200)]
    cache, n = indexes.WordCache(spark, str(tmp_path / "words")), spark.sparkContext.accumulator(0)
    first = cache.words(spark.createDataFrame(rows, "chunk_id string, text string"), n)
    assert first.count() == 200 and n.value == 150
    more = spark.createDataFrame(rows + [("new", "a new text"), ("null", None)], "chunk_id string, text string")
    got = {r.chunk_id: r.words for r in cache.words(more, n).collect()}
    assert n.value == 151 and len(got) == 202 and got["c3"] == ["some", "words", "of", "number3"] and got["null"] is None
    cache.words(more, n)
    assert n.value == 151
    letters = indexes.WordCache(spark, str(tmp_path / "words"), "letters", lambda c: F.split(c, ""))
    letters.words(more, n)
    assert n.value == 302
    plain, cached = retrieval.Bm25Index(more), retrieval.Bm25Index(more, cache=cache)
    asked = spark.createDataFrame([(1, "number3 new text")], "query_id long, text string")
    assert hits_of(retrieval.bm25(plain, asked, 5)) == hits_of(retrieval.bm25(cached, asked, 5)) != []


# Splitters


def plain_filled(text, size, overlap, separators):
    """By definition, on strings: parts are joined while they fit; what is too long goes to the next separator."""

    def cut(piece, left):
        if len(piece) <= size:
            return [piece]
        if not left or not left[0]:
            return [piece[i : i + size] for i in range(0, len(piece), size)]
        out, held = [], ""
        for part in piece.split(left[0]):
            if len(held + left[0] + part if held else part) <= size:
                held = held + left[0] + part if held else part
                continue
            out += [held] * (held != "")
            held = "" if len(part) > size else part
            out += cut(part, left[1:]) if len(part) > size else []
        return out + [held] * (held != "")

    out, before = [], ""
    for piece in cut(text, separators) if text.strip() else []:
        out.append(before + piece)
        before = (before + piece)[-overlap:] if overlap else ""
    return out


def plain_slid(text, size, overlap, separators):
    """By definition, on lists of parts: the first parts go until the rest leaves room for the next."""
    sep = next(s for s in separators if s in text)
    parts = [(sep if k else "") + p for k, p in enumerate(text.split(sep))] if sep else list(text)
    out, held = [], []
    for part in filter(None, parts):
        if len(part) >= size and sep:
            out += ["".join(held)] + plain_slid(part, size, overlap, separators[separators.index(sep) + 1 :])
            held = []
            continue
        if len("".join(held)) + len(part) > size:
            out.append("".join(held))
            while len("".join(held)) > overlap or held and len("".join(held)) + len(part) > size:
                held.pop(0)
        held.append(part)
    return [p.strip() for p in out + ["".join(held)] if p.strip()]


def test_splitters_against_their_rules(spark):
    import random

    from gleanspark.operators import splitting

    r = random.Random(2)
    texts = ["".join(r.choice(["a", "b", "cc", " ", "  ", ". ", "\n", "\n\n", "ddddd", "ö", "가😀"]) for _ in range(r.randint(0, 200))) for _ in range(250)] + ["", " ", "\n\n", "x" * 300, " " * 50 + "a", "a" * 20 + " ", "12345678901234567890"]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, text string")
    for size, overlap in ((20, 5), (50, 10), (7, 3), (30, 0), (12, 11), (1, 0)):
        got = {x.i: (x.f, x.s) for x in df.select("i", splitting.filled_pieces(F.col("text"), size, overlap).alias("f"), splitting.sliding_pieces(F.col("text"), size, overlap).alias("s")).collect()}
        assert got.pop(-1) == ([], [])
        for i, t in enumerate(texts):
            assert got[i][0] == plain_filled(t, size, overlap, splitting.COARSE) == chunking.split_text(t, size, overlap), (size, t)
            assert got[i][1] == (plain_slid(t, size, overlap, splitting.SENTENCES) if len(t) > size else [t.strip()] * bool(t.strip())), (size, t)
    with pytest.raises(ValueError):
        splitting.sliding_pieces(F.col("text"), 10, 10)
    assert "Python" not in df.select(splitting.filled_pieces(F.col("text")), splitting.sliding_pieces(F.col("text")))._jdf.queryExecution().toString()


# What extraction kept, and what work costs


def test_table_quality_by_hand(spark):
    from gleanspark.operators import quality

    text = "intro\n| a | b |\n|---|---|\n| 1 |  |\ntext between\n|x|\n| p | q | r |\n|  |  |\n\n|  |"
    docs = spark.createDataFrame([(1, "intro\na 10 letter line\nb\nlost for ever", text), (2, None, None), (3, "", "no table | here"), (4, "x", "| a \\| b | c |")], "doc_id int, plain string, text string")
    rendered = spark.createDataFrame([(1, "| a | b |"), (1, "| gone |"), (1, ""), (1, None), (2, "| y |")], "doc_id int, table string")
    got = {r.doc_id: r for r in quality.table_quality(docs, rendered).collect()}
    one = got[1]
    assert (one.tables, one.cells, one.empty, one.whole, one.fill, one.blank) == (3, 11, 1, round(2 / 3, 3), round(7 / 14, 3), round(1 - 7 / 11, 3))
    assert (one.lost, one.lost_chars, one.lines, one.short_lines, one.chars) == (1, 8, 0.0, 0.5, len(text))
    assert (got[2].tables, got[2].lost, got[2].fill, got[2].lines, got[2].chars) == (0, 1, None, None, 0) and got[3].tables == 0 and (got[4].cells, got[4].short_lines) == (2, 0.0)


def test_similarity_against_difflib(spark):
    import difflib
    import random

    from gleanspark.operators import quality

    r = random.Random(4)
    rows = [(k, "".join(r.choice("abc 가😀\n") for _ in range(r.randint(0, 40))), "".join(r.choice("abd 가\n") for _ in range(r.randint(0, 40)))) for k in range(60)] + [(98, "", ""), (99, "a", "")]
    got = {x.k: x.similarity for x in quality.similar(spark.createDataFrame(rows, "k int, a string, b string"), "k", "a", "b").collect()}
    assert got == {k: round(difflib.SequenceMatcher(None, a, b, autojunk=False).quick_ratio(), 6) for k, a, b in rows}


def test_costs_come_from_a_run(spark):
    from gleanspark.operators import quality

    costs = quality.Costs()
    out = costs.stage("some", spark.range(1000).select("id").repartition(4), F.lit(8).cast("long"))
    (row,) = costs.table(spark).collect()
    assert out.count() == 1000 and (row.stage, row.rows, row.bytes) == ("some", 1000, 8000) and row.tasks >= 4 and row.seconds > 0
    got = {r.stage: (r.rows, r.bytes) for r in quality.search_costs(spark.createDataFrame([("c1", "alpha beta x"), ("c2", "beta gamma"), ("c3", "delta delta")], "chunk_id string, text string"), spark.createDataFrame([(1, "alpha gamma")], "query_id int, text string"), 2).collect()}
    assert got == {"tokenise": (3, len("alpha beta") + len("beta gamma") + len("delta delta")), "index": (4, len("alphabetagammadelta")), "search": (2, 4)}


# Sets, metadata files and dictionaries


def test_evaluation_sets_by_name(spark, tmp_path):
    """.json before .jsonl; a missing one names those that are there."""
    with pytest.raises(FileNotFoundError):
        tables.evalset_path(spark, str(tmp_path / "none"), "a")
    for name in ("a.json", "a.jsonl", "b.jsonl", "b.meta.json"):
        (tmp_path / name).write_text("[]")
    assert tables.evalset_path(spark, str(tmp_path), "a").endswith("/a.json") and tables.evalset_path(spark, f"{tmp_path}/", "b").endswith("/b.jsonl")
    with pytest.raises(FileNotFoundError, match=r"\['a', 'b'\]"):
        tables.evalset_path(spark, str(tmp_path), "c")


def test_metadata_in_the_older_encoding(spark, tmp_path):
    head = ",".join(k for k in tables.FIELDS)
    row = {k: "" for k in tables.FIELDS} | {"공고 번호": "N1", "사업명": "학사 정보 시스템", "파일명": "제안요청서.hwp"}
    for name, encoding in (("new.csv", "utf-8-sig"), ("old.csv", "cp949")):
        (tmp_path / name).write_bytes(f"{head}\n{','.join(row.values())}\n".encode(encoding))
        got = tables.read_metadata(spark, str(tmp_path / name)).first()
        assert (got.title, got.file_name, got.doc_id) == ("학사 정보 시스템", "제안요청서.hwp", "N1"), name


def test_sets_are_made_again_when_chunks_change(spark, tmp_path):
    chunks_ = spark.createDataFrame([("c1", "text one"), ("c2", "text two")], "chunk_id string, text string")
    made = []
    build = lambda c: made.append(1) or c.select(F.col("text").alias("question"))
    folder = str(tmp_path)
    assert evalsets.ensured(spark, folder, "set", "v1", chunks_, build) is False and not made  # not managed
    rewritten(tmp_path / "set.meta.json", '{"chunks": {"v0": "1-1", "v1": "other"}}')
    assert evalsets.ensured(spark, folder, "set", "v1", chunks_, build) is True and len(made) == 1
    assert sorted(r.question for r in tables.read_evalset(spark, f"{folder}/set.jsonl").collect()) == ["text one", "text two"]
    assert evalsets.ensured(spark, folder, "set", "v1", chunks_, build) is False and evalsets.ensured(spark, folder, "set", "v1", chunks_.limit(1), build) is True and len(made) == 2


def test_dictionary_use_by_hand(spark):
    pairs = spark.createDataFrame([(1, "what budget", "a", "the cost is 5"), (2, "budget and term", "b", None), (3, "other", None, "cost"), (4, None, "a", "x")], "query_id int, text string, kind string, gold string")
    by_kind, words = mining.dictionary_use(pairs, {"budget": ["cost", "price"], "term": ["cost", "days"]})
    assert {r.kind: (r.asked, r.fired) for r in by_kind.collect()} == {None: (4, 2), "a": (2, 1), "b": (1, 1), "": (1, 0)}
    assert {r.word: (r.useful, r.wasted) for r in words.collect()} == {"cost": (1, 1), "price": (0, 2), "days": (0, 1)}


def test_pruning_by_hand(spark):
    words = spark.createDataFrame([("k", "b", 0), ("k", "dead", 1), ("k", "a", 2), ("k", "b", 3), ("k", "unknown", 4), ("gone", "dead", 0)], "key string, word string, place int")
    df = spark.createDataFrame([("a", 3, 10), ("b", 1, 10), ("dead", 9, 10)], "term string, df int, n int")
    assert [(r.key, r.words, r.gone) for r in mining.pruned(words, df).collect()] == [("k", ["b", "a"], ["dead", "unknown"])]
