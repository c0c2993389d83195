"""The engine beside the corpus operators: every registered query against its SQL, and the parts by small cases."""

import io
import zipfile

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleanspark.functions import models
from gleanspark.functions import text as X
from gleanspark.operators import chunking, documents, markup, mining, retrieval
from gleanspark.plans import catalog, cleanup, evaluation, reports, search, stores  # noqa: F401
from gleanspark.sources import files, listings, tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == "float64":
            df[c] = df[c].round(6)
    df = df.astype(object).where(df.notna(), None)
    return sorted(map(repr, df.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_query_against_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(catalog.SQL[name]).df())


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize("value, want", [("150000000.0", "1억 5,000만원"), ("1500000000", "15억원"), ("46200000", "4,620만원"), ("9999", "9,999원"), ("abc", "abc"), (None, None)])
def test_money(spark, value, want):
    assert one(spark, X.money(F.col("v")), v=value) == want


def test_ids(spark):
    no, revision = X.split_doc_id(F.col("v"))
    got = spark.createDataFrame([("A-1-002",), ("A",), ("A-b",)], "v string").select(no.alias("n"), revision.alias("r")).collect()
    assert [tuple(r) for r in got] == [("A-1", 2), ("A", None), ("A-b", None)]


def test_cleaning(spark):
    repeated = "\n".join(["머리말"] * 5 + ["합니다."] + ["끝입니다."] * 5 + ["본문 하나"])
    assert one(spark, X.drop_repeated_lines(F.col("v")), v=repeated).split("\n") == ["합니다."] + ["끝입니다."] * 5 + ["본문 하나"]
    assert one(spark, X.tidy_whitespace(F.col("v")), v="a \t b\n- 3 -\n\n\n\n----\nc") == "a b\n\nc"
    assert one(spark, X.remove_marks(F.col("v")), v="a<표>b( )\x01c") == "abc"
    assert one(spark, X.preview(F.col("v"), F.col("q"), 30), v="x" * 50 + " needle " + "y" * 50, q="a needle") == ("x" * 50 + " needle " + "y" * 50)[41:71]
    assert one(spark, X.no_info(F.col("v")), v="문서에서 찾을 수 없습니다") is True


def test_revisions_and_hashes(spark):
    data = [("A", 0, 0, "x"), ("A", 1, 0, "x"), ("B", 0, 0, "x"), ("B", 1, 0, "y"), ("E", 0, 0, "x"), ("E", 1, 0, "y"), ("E", 2, 0, "y"), ("F", 0, 0, "p"), ("F", 0, 1, "q"), ("F", 1, 0, "q"), ("F", 1, 1, "p"), ("G", None, 0, "x")]
    c = spark.createDataFrame(data, "notice_no string, revision int, order int, text string")
    assert sorted(map(tuple, documents.stale_revisions(c).collect())) == [("A", 0), ("E", 1)]
    h = {r.doc_id: r.digest for r in documents.doc_hashes(c.withColumn("doc_id", F.concat("notice_no", F.coalesce(F.col("revision").cast("string"), F.lit(""))))).collect()}
    assert h["F0"] == h["F1"] and h["B0"] != h["B1"]


def test_sync(spark):
    frame = lambda x: spark.createDataFrame(x, "doc_id string, digest string")
    old, new = frame([("A", "1"), ("B", "2"), ("D", "9")]), frame([("A", "3"), ("B", "2"), ("C", "4")])
    status = documents.diff(old, new)
    assert {r.doc_id: r.status for r in status.collect()} == {"A": "changed", "B": "kept", "C": "added", "D": "gone"}
    assert sorted(map(tuple, documents.synced(old, new, status).collect())) == [("A", "3"), ("B", "2"), ("C", "4")]


def test_heading_path_and_pages(spark):
    marks = spark.createDataFrame([("d", 0, 1, "Ⅰ"), ("d", 5, 2, "1."), ("d", 9, 3, "가."), ("d", 20, 1, "Ⅳ"), ("d", 25, None, None), ("d", 30, 2, "2."), ("d", 31, None, None)], "doc_id string, pos int, depth int, title string")
    assert {r.pos: r.path for r in documents.heading_path(marks).collect()} == {0: "Ⅰ", 5: "Ⅰ > 1.", 9: "Ⅰ > 1. > 가.", 20: "Ⅳ", 25: "Ⅳ", 30: "Ⅳ > 2.", 31: "Ⅳ > 2."}
    pages = spark.createDataFrame([("d", 3, 78), ("d", 24, 88)], "doc_id string, pos int, page int")
    assert [(r.start, r.stop, r.page, r.next_page) for r in documents.page_ranges(pages).orderBy("start").collect()] == [(3, 24, 78, 88), (24, None, 88, 98)]


def test_sparse_search(spark):
    chunks = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 1.0), ("b", 1, 2.0), ("b", 2, 1.0), ("c", 3, 5.0), ("c", 4, 5.0)], "chunk_id string, term int, w double")
    q = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0)], "query_id int, term int, w double")
    assert [r.chunk_id for r in retrieval.sparse(chunks, q).orderBy("rank").collect()] == ["b", "a"]


def test_fusion_keeps_first_seen_order(spark):
    hits = lambda x: spark.createDataFrame([(0, c, n + 1) for n, c in enumerate(x)], "query_id int, chunk_id string, rank int")
    got = retrieval.fuse([(hits("ab"), 0.5), (hits("cd"), 0.5)], 4).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["a", "c", "b", "d"]


def test_context_budget(spark):
    hits = spark.createDataFrame([(0, 1, "x" * 700, "h"), (0, 2, "y" * 200, "h"), (0, 3, "z", "h"), (1, 1, "w" * 900, "h")], "query_id int, rank int, text string, header string")
    got = {r.query_id: r.chunks for r in retrieval.contexts(hits, 800).collect()}
    assert got == {0: 1, 1: 1}


def test_splitters(spark):
    text = "가나다 " * 400 + "\n예산 1억원\n" + "라마바 " * 400
    pieces = chunking.split_text(text, 1500, 250)
    assert len(pieces) > 1 and all(len(p) <= 1750 for p in pieces) and all(w in "".join(pieces) for w in ("예산", "라마바"))
    table = "\n".join(["| a | b |", "|---|---|"] + [f"| {i} | {'v' * 40} |" for i in range(200)])
    cut = chunking.split_with_tables("intro\n" + table + "\nend", 1500)
    assert cut[0] == "intro" and cut[-1] == "end" and all(c.startswith("| a | b |\n|---|---|") for c in cut[1:-1]) and len(cut) > 4
    got = chunking.chunked(spark.createDataFrame([("d", text), ("e", None), ("f", "")], "doc_id string, text string"), lambda t: chunking.split_text(t, 500, 0)).collect()
    assert {r.doc_id for r in got} == {"d"} and got[0].chunk_id == "d::0000"


def test_metadata_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿공고 번호, 공고 차수,사업명,사업 금액,공개 일자,파일명\nN1,0.0,하나,100.5,2024-03-01 10:00:00,a.hwp\nN2,,둘,,bad,b.hwp\n,,셋,nan,,c.hwp\n", encoding="utf-8")
    got = [(r.doc_id, r.title, r.budget, r.published_at) for r in tables.read_metadata(spark, str(tmp_path / "m.csv")).collect()]
    assert got[0] == ("N1-0", "하나", 100.5, "2024-03-01") and got[1] == ("N2", "둘", None, None) and got[2][0].startswith("nofile-") and got[2][2] is None


def test_chunk_lines(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"text": "t", "meta": {"doc_id": "A-1", "order": "2", "chunk_id": "A-1::0002"}}\n{"page_content": "p", "page_content_for_generation": "g", "metadata": {"공고 번호": "N", "공고 차수": "3.0", "chunk_index": "1"}}\n', encoding="utf-8")
    got = {tuple(r)[:5] for r in tables.read_chunks(spark, str(tmp_path / "c.jsonl")).collect()}
    assert got == {("A-1::0002", "A-1", 2, "t", None), ("N-3::0001", "N-3", 1, "p", "g")}


def test_merge_metadata(spark):
    left = spark.createDataFrame([("a very long file name (final).hwp",), ("b.pdf",), ("none.hwp",)], "file_name string")
    right = spark.createDataFrame([("a very long file name (fin.hwp", "A"), ("b.hwp", "B")], "file_name string, title string")
    assert {r.file_name[0]: (r.title, r.match) for r in tables.merge_metadata(left, right).collect()} == {"a": ("A", "fuzzy"), "b": ("B", "exact"), "n": (None, None)}


def test_versions(spark, tmp_path):
    df = spark.range(3)
    assert tables.new_version(spark, df, str(tmp_path / "t")).endswith("v1") and tables.new_version(spark, df, str(tmp_path / "t")).endswith("v2")


def test_hwpx(spark):
    cell = lambda t: f"<tc><subList><p><run><t>{t}</t></run></p></subList></tc>"
    xml = f"<sec><p><run><t>before</t></run></p><p><run><tbl><tr>{cell('k1')}{cell('v1')}</tr><tr>{cell('k2')}{cell('v2')}</tr></tbl></run></p><p><run><t>after</t></run></p></sec>"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("Contents/section0.xml", xml)
    got = {r.path: r for r in files.extract(spark.createDataFrame([("x.hwpx", bytearray(buffer.getvalue())), ("y.hwpx", bytearray(b"no zip")), ("z.exe", bytearray(b""))], "path string, content binary")).collect()}
    assert got["x.hwpx"].text == "before\nk1: v1\nk2: v2\nafter" and got["x.hwpx"].tables_total == 1
    assert got["y.hwpx"].extractor == "failed" and got["z.exe"].extractor == "unsupported"
    assert files.render([["a", "b", "c"], ["1|2", "", "3"]]) == "| a | b | c |\n|---|---|---|\n| 1\\|2 |  | 3 |"


def test_hwp_records():
    text = "한글".encode("utf-16-le")
    data = (67 | 1 << 10 | len(text) << 20).to_bytes(4, "little") + text + (66 | 0xFFF << 20).to_bytes(4, "little") + (4).to_bytes(4, "little") + b"abcd"
    assert [(t, l, len(p)) for t, l, p in files.records(data)] == [(67, 1, 4), (66, 0, 4)]
    assert files.paragraph_text("가".encode("utf-16-le") + (2).to_bytes(2, "little") + b"\0" * 14 + "나\n".encode("utf-16-le")) == "가나\n"


def test_models(spark):
    df = spark.createDataFrame([("Abc def",), (None,)], "t string")
    got = df.select(models.embed(F.col("t")).alias("v"), models.ask(F.concat(F.lit("질문:\n"), "t")).alias("a")).collect()
    assert abs(sum(x * x for x in got[0].v) - 1) < 1e-5 and sum(got[1].v) == 0 and got[0].a == "Abc def"


def test_listing_items(spark):
    row = {"bidNtceNo": "20241001798", "bidNtceOrd": "000", "bidNtceNm": "포털 구축", "presmptPrce": "5000", "ntceInsttNm": "조달청", "rgstDt": "2024", "file_name": "a.HWP", "ntceSpecFileNm1": "공고문.hwp", "ntceSpecDocUrl1": "u 1", "ntceSpecFileNm3": "과업내용서.pdf", "ntceSpecDocUrl3": "u3"}
    names = ["bidNtceNo", "bidNtceOrd", "bidNtceNm", "asignBdgtAmt", "presmptPrce", "dminsttNm", "ntceInsttNm", "bidNtceDt", "rgstDt", "bidBeginDt", "bidClseDt", "ntceKindNm", "befBidBbancNo", "sucsfbidMthdNm", "cntrctCnclsMthdNm", "file_name"] + [f"ntceSpec{k}{n}" for n in range(1, 11) for k in ("FileNm", "DocUrl")]
    items = spark.createDataFrame([tuple(row.get(n) for n in names), tuple([None] * len(names))], ", ".join(f"{n} string" for n in names))
    got = listings.metadata_rows(items).collect()[0]
    assert (got.doc_id, got.budget, got.budget_kind, got.agency, got.published_at, got.file_type) == ("20241001798-0", "5000", "추정가격", "조달청", "2024", "hwp")
    picked = items.select(listings.attachment().alias("a"), listings.wanted().alias("w"), listings.superseded().alias("s")).collect()
    assert (picked[0].a.url, picked[0].w, picked[0].s, picked[1].a, picked[1].w) == ("u3", True, None, None, False)
    known = spark.createDataFrame([], "doc_id string")
    assert [r.doc_id for r in listings.arrivals(items, known).collect()] == ["20241001798-0"]


def test_paged_scan(spark):
    fetch = lambda page: {"n": page} if page == 3 else [{"n": page}, {"n": -page}]
    assert sorted((r.page, r.item) for r in listings.paged(spark, fetch, 5, 2).collect()) == [(1, '{"n": -1}'), (1, '{"n": 1}'), (2, '{"n": -2}'), (2, '{"n": 2}'), (3, '{"n": 3}')]


def test_table_markup(spark):
    plain = lambda t: one(spark, markup.without_table_markup(F.col("v")), v=t)
    table = "앞\n| 구분 | 기간 |\n|---|---|\n| 가 | 3<br>월 |\n|  | 4\\|5 |\n뒤<br>끝\n[행 1] 시각: 15:00 [행 2] 이름: 값"
    assert plain(table) == "앞\n구분 가 기간 3 월\n기간 4|5\n뒤\n끝\n시각 15:00 이름 값"
    assert plain("") == "" and plain("| 하나 | 둘 |") == "하나 둘"
    assert plain("| a | b |\n|---|---|\n| | |\n\n| c |\n| d |") == "a b\n\nc d"


def test_contents_table(spark):
    cut = lambda t: one(spark, markup.without_toc(F.col("v")), v=t)
    entries = [f"{i}. 항목 {i}" for i in range(1, 10)]
    text = "\n".join(["목 차", *entries, "1. 항목 1", "본문입니다."])
    assert cut(text) == "1. 항목 1\n본문입니다."
    assert cut("\n".join(entries[:5])) == "\n".join(entries[:5]) and cut("") == ""


def test_labelled_values(spark):
    got = one(spark, markup.labelled_values(F.col("v")), v="○ 사업기간\n\n□ 계약방법: 협상에\n의한 계약\n4. 다음\n※ 끝 사업기간 : 12개월")
    assert got["사업기간"] == "12개월" and got["계약방식"] == "협상에 의한 계약" and got["보안특약"] is None


def test_semantic_split_and_diversity(spark):
    assert markup.split_by_meaning("", models.hashed_trigrams) == []
    axis = {"a": [1.0, 0.0], "b": [0.0, 1.0]}
    assert markup.split_by_meaning("a. a. b. b.", lambda s: [axis[x[0]] for x in s]) == ["a. a.", "b. b."]
    rows = [(1, 1, [1.0, 0.0], [1.0, 0.2]), (1, 2, [1.0, 0.001], [1.0, 0.2]), (1, 3, [0.3, 1.0], [1.0, 0.2])]
    got = markup.diverse(spark.createDataFrame(rows, "query_id int, chunk_id int, v array<double>, q array<double>"), 2)
    assert [r.chunk_id for r in got.orderBy("rank").collect()] == [2, 3]


def test_resolution_reasons(spark):
    names = spark.createDataFrame([("사업 계획서 최종.hwp",), ("사업 계획",), ("사업 제안",), ("없는 이름",)], "name string")
    known = spark.createDataFrame([("사업 계획서 최종", 1), ("사업 제안 가", 2), ("사업 제안 나", 3)], "key string, doc_id long")
    assert {r.name: (r.doc_id, r.reason) for r in mining.resolved(names, known).collect()} == {"사업 계획서 최종.hwp": (1, "exact"), "사업 계획": (1, "prefix"), "사업 제안": (None, "ambiguous"), "없는 이름": (None, "none")}


def test_refusals_and_types(spark):
    assert one(spark, X.no_info(F.col("v")).cast("string"), v="정보가 없습니다") == "true"
    assert [one(spark, X.question_type(F.col("v"), F.lit("3점")), v=v) for v in ("SFR-001 은?", "언제?")] == ["요구사항", "배점"]


def test_resolution_of_short_names(spark):
    known = spark.createDataFrame([("사업 계획서 최종", 1), ("사업 제안서 1", 2), ("교육", 4), ("ab", 5)], "key string, doc_id int")
    names = spark.createDataFrame([("교.hwp",), ("사",), ("사업 .pdf",), ("ab",), ("abc",), ("x",)], "name string")
    got = {r.name: (r.doc_id, r.reason) for r in mining.resolved(names, known).collect()}
    assert got == {"교.hwp": (4, "prefix"), "사": (None, "ambiguous"), "사업 .pdf": (None, "ambiguous"), "ab": (5, "exact"), "abc": (None, "none"), "x": (None, "none")}
