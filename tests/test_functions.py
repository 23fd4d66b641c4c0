"""Scalar functions on literals, file sources, streaming ingestion; queries against DuckDB."""

import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from lantern.functions import text as T
from lantern.operators import packing
from lantern.plans import answers, catalog, evidence, questions, records, scoring  # noqa: F401, these register their queries
from lantern.sources import files
from lantern.streaming import tasks


def one(spark, make, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(make(F.col("v"))).collect()]


def test_text(spark):
    assert one(spark, T.normalize, "ＡＢ１　 x\n\ty ", None) == ["AB1 x y", None]
    assert one(spark, T.match_key, "Ａ b（C）") == ["ab(c)"]
    assert one(spark, lambda c: T.clip(c, 6), "abcdefg", "abcdef") == ["abc...", "abcdef"]
    assert one(spark, T.chinese_number, "二十一", "十", "一百零五", "两千", "三万二百", "12", "x", "", "二〇二四", "二零二零") == [21, 10, 105, 2000, 30200, 12, None, None, 2024, 2020]
    assert one(spark, T.number_tokens, "5 of 12.5% in 2020, 5") == [["5", "12.5%"]]
    assert one(spark, T.year_tokens, "x_2020_1999 12020 2020") == [["2020", "1999"]]
    assert one(spark, T.version_date, "20200528 and 2021-3-4", "2021-3-4 order 202135 ok", "order 202135 ok", "2021年3月4日") == ["20200528", "20210304", None, "20210304"]
    assert one(spark, T.last_date, "2019年 and 2020年5月28日, 2021年3月", "20200528") == ["2021年3月", None]
    assert one(spark, T.citations, "a ##3$$ b ##1$$##3$$") == [[3, 1]]
    assert one(spark, T.canonical_citations, "x [ID: 2] 【4】") == ["x ##2$$##4$$"]
    assert one(spark, T.html_rows, "<table><tr><th>a</th><td> <b>1</b></td></tr><tr><td></td></tr></table>") == [[["a", "1"]]]


def test_packing():
    sizes, none = [3, 4, 5, 1, 9, 2], [False] * 6
    assert packing.greedy(sizes, none, 6, before=False) == [0, 0, 1, 1, 1, 2]
    assert packing.greedy(sizes, none, 8, before=True) == [0, 0, 1, 1, 2, 3]
    assert packing.greedy(sizes, [True, False, False, True, False, False], 100, before=True) == [0, 0, 0, 1, 1, 1]
    assert packing.greedy([], [], 5, before=True) == []


def test_conditions(spark):
    df = spark.range(6).selectExpr("id", "cast(id % 3 as string) s")
    assert records.where_equal(df, {"s": ["1", "2"], "id": 4}).count() == 1 and records.where_equal(df, {"s": "", "id": 0}).count() == 6
    with pytest.raises(TypeError):
        records.where_equal(df, {"s": 1.5})


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo")
    (tmp_path / "b.pdf").write_bytes(b"not a pdf")
    (tmp_path / "c.exe").write_bytes(b"x")
    (tmp_path / "d.txt").write_bytes(b"")
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>He</w:t><w:t>llo</w:t></w:p></w:document>')
    found = files.accepted(files.scan(spark, str(tmp_path)))
    assert {r["name"] for r in found.collect()} == {"a.txt", "e.docx"}
    assert sorted(tuple(r) for r in files.sections(found).collect()) == [("a.txt", 0, "one"), ("a.txt", 1, "two"), ("e.docx", 0, "Hello")]


def test_sheets_with_gaps_and_other_order(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="people" r:id="r2"/><sheet name="Sheet2" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row>{cell("A1", "k")}</row><row>{cell("A2", "v")}</row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row>{cell("A1", "name")}{cell("B1", "age")}{cell("C1", "city")}</row><row>{cell("A2", "ann")}{cell("C2", "Rome")}{cell("D2", "more")}</row></sheetData></worksheet>')
    with zipfile.ZipFile(tmp_path / "t.docx", "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>')
    found = files.accepted(files.scan(spark, str(tmp_path)))
    assert sorted(tuple(r) for r in files.sections(found).collect()) == [("s.xlsx", 0, "name：ann; city：Rome; more ——people"), ("s.xlsx", 1, "k：v"), ("t.docx", 0, "one"), ("t.docx", 1, "<table><tr><td>a</td><td></td></tr></table>")]
    assert files.column_number("AB3") == 27 and {"path", "modificationTime"} <= set(files.snapshot(found).columns)


def test_ingestion_adds_each_key_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (range(0, 5), range(3, 8)):
        spark.createDataFrame([(i, f"t{i}") for i in part], "id long, text string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long, text string").parquet(source)
        tasks.ingest(stream, target, str(tmp_path / "ck"), "id").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == list(range(8))


@pytest.mark.parametrize("name", ["bm25_topk", "retrieval_metrics", "doc_round_robin", "tag_lift", "line_chunks", "soft_hard_filter", "cross_query_fusion", "region_overlap", "cross_page_tables", "crash_recovery", "answer_metrics", "latency_percentile", "corpus_fingerprint", "dup_uploads", "question_slots", "question_routes", "question_weights", "planned_queries", "coverage_rerank", "answerability", "answer_checks", "evidence_order", "token_chunks", "merged_boxes", "document_metadata", "numerals_and_dates", "retrieval_report", "markdown_tables"])
def test_queries_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "lineitem", "events", "orders", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(columns)} from ({catalog.ORACLES[name]})").fetchall()
    tidy = lambda rows: sorted([tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows], key=repr)
    assert tidy(tuple(r) for r in got.select(*columns).collect()) == tidy(want)
