"""File sources: scans, signatures, DOCX and XLSX sections, snapshots. Binary formats are decoded by Arrow batches, everything else by columns."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lantern.sources.encodings import like_text

ALLOWED = ("pdf", "docx", "txt", "md", "html", "json", "xlsx", "xls", "pptx", "ppt")
LARGEST = 5 * 1024 * 1024


def scan(spark: SparkSession, path: str, allowed=ALLOWED) -> DataFrame:
    """path, name, ext, length, content, of files with an allowed extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.withColumn("name", F.regexp_extract("path", r"[^/]+$", 0)).withColumn("ext", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    return files.where(F.col("ext").isin(*allowed)).select("path", "name", "ext", "length", "modificationTime", "content").orderBy("name", "path")


def signature_ok(ext: Column, content: Column) -> Column:
    """Whether the first bytes fit the extension; of a text, whether all of it is one."""
    head = F.hex(F.substring(content, 1, 8))
    zipped = F.rlike(head, F.lit("^504B(0304|0506|0708)"))
    return (
        F.when(ext == "pdf", F.startswith(head, F.lit("255044462D"))).when(ext.isin("docx", "xlsx", "pptx"), zipped)
        .when(ext.isin("xls", "ppt", "doc"), F.startswith(head, F.lit("D0CF11E0A1B11AE1"))).otherwise(like_text(content))
    )


def accepted(files: DataFrame, largest: int = LARGEST) -> DataFrame:
    return files.where((F.col("length") > 0) & (F.col("length") <= largest) & signature_ok(F.col("ext"), F.col("content")))


def snapshot(files: DataFrame) -> DataFrame:
    columns = ["path", "name", "length", *(["modificationTime"] if "modificationTime" in files.columns else [])]
    return files.select(*columns, F.sha2("content", 256).alias("sha256"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_RELS = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def docx_paragraphs(content: bytes) -> list[str]:
    """Paragraphs in order; a table as one HTML table in its place."""

    def words(node) -> str:
        return "".join(t.text or "" for t in node.iter(f"{_W}t"))

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        tree = ElementTree.fromstring(z.read("word/document.xml"))
    body = tree.find(f"{_W}body")
    out = []
    for node in body if body is not None else tree:
        if node.tag == f"{_W}p":
            out.append(words(node))
        elif node.tag == f"{_W}tbl":
            # direct children only: a nested table's words stand in its cell, once
            rows = ["".join(f"<td>{words(c)}</td>" for c in r.findall(f"{_W}tc")) for r in node.findall(f"{_W}tr")]
            out.append("<table>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>")
    return out


def column_number(reference: str) -> int:
    """0 for A1, 27 for AB3."""
    n = 0
    for ch in reference:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def xlsx_rows(content: bytes) -> list[tuple[str, list[str]]]:
    """(sheet, cells) of each row."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        links = {}
        if "xl/_rels/workbook.xml.rels" in names:
            links = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{_RELS}Relationship")}
        out = []
        for number, entry in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"), 1):
            path = "xl/" + links.get(entry.get(_REL), f"worksheets/sheet{number}.xml")
            for row in ElementTree.fromstring(z.read(path)).iter(f"{_S}row") if path in names else ():
                cells: list[str] = []
                for c in row.iter(f"{_S}c"):
                    v, inline = c.find(f"{_S}v"), "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    at = column_number(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    cells[at] = shared[int(v.text)] if c.get("t") == "s" and v is not None else inline or (v.text if v is not None else "") or ""
                out.append((entry.get("name"), cells))
        return out


def sections(files: DataFrame) -> DataFrame:
    """(name, seq, section): lines of text files, paragraphs of DOCX, "header：value; ..." rows of XLSX."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, ext, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ext == "docx":
                    found = docx_paragraphs(content)
                elif ext == "xlsx":
                    found, header = [], {}
                    for sheet, cells in xlsx_rows(content):
                        if sheet not in header:
                            header[sheet] = cells
                            continue
                        heads = header[sheet] + [""] * (len(cells) - len(header[sheet]))  # cells beyond the header have no name
                        line = "; ".join(f"{h}：{c}" if h else c for h, c in zip(heads, cells, strict=False) if c)
                        found.append(line if "sheet" in sheet.lower() else f"{line} ——{sheet}")
                else:
                    found = content.decode("utf-8", "replace").splitlines()
                rows += [(name, i, s) for i, s in enumerate(x for x in found if x.strip())]
            yield pa.RecordBatch.from_pydict({"name": pa.array([r[0] for r in rows], pa.string()), "seq": pa.array([r[1] for r in rows], pa.int32()), "section": pa.array([r[2] for r in rows], pa.string())})

    return files.select("name", "ext", "content").mapInArrow(run, "name string, seq int, section string")
