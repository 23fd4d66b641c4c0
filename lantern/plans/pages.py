"""Registered queries on boxes of pages, tables made of cells, each with its SQL twin.

Eight orders are a page. A line's numbers give its box: columns of a width, rows of a height, some of them a little off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lantern.operators import boxes as B
from lantern.plans.catalog import query, table

_SIDES = """l_orderkey // 8 AS page, (l_orderkey % 8) * 8 + l_linenumber AS box, (l_partkey % 5) * 100 + l_discount * 200 AS x0, (l_partkey % 5) * 100 + l_discount * 200 + 40 + l_quantity * 2 AS x1,
    (l_suppkey % 9) * 30 + l_tax * 100 AS top, (l_suppkey % 9) * 30 + l_tax * 100 + 14 + l_linenumber AS bottom, CASE l_returnflag WHEN 'A' THEN 'text' WHEN 'N' THEN 'title' ELSE 'table' END AS layout,
    l_returnflag AS kind, l_extendedprice AS score, l_linestatus || l_partkey::VARCHAR || substr('.,;。，:)x ', 1 + (l_quantity::INT % 9), 1) AS text"""
_FROM = "FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity, max(l_extendedprice) AS l_extendedprice, max(l_discount) AS l_discount, max(l_tax) AS l_tax, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus FROM lineitem GROUP BY ALL)"
_BOXES = f"b AS (SELECT {_SIDES} {_FROM})"


def page_boxes(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumn("page", F.expr("l_orderkey DIV 8")).repartition("page")  # once, for all that goes by page
    of = lines.groupBy("page", "l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")))
    return of.select("page", *(F.expr(e.strip().replace("//", "DIV").replace("::VARCHAR", "").replace("l_quantity::INT", "int(l_quantity)")) for e in _split(_SIDES)[1:]))


def _split(columns: str) -> list[str]:
    """The columns of a list, commas inside parentheses and quotes left alone."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(columns):
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


_LIST = "list({{'box': box, 'x0': x0, 'x1': x1, 'top': top, 'bottom': bottom{more}}} ORDER BY {order}, box)"
#: A fold in SQL: each box is wrapped in a list, so that what is made and what comes are of one type.
_FOLD = "list_reduce(list_transform(bs, lambda x: [x]), lambda made, e: {step})"


def _listed(order: str, more: str = "") -> str:
    return f"p AS (SELECT page, {_LIST.format(more=more, order=order)} AS bs, avg(bottom - top) AS height FROM b GROUP BY page)"


def _given(spark, d, *order: str, more=()) -> DataFrame:
    return B.pages(page_boxes(spark, d), *order, more=more, height=F.avg(F.col("bottom") - F.col("top")))


_PASS = """list_reverse(list_reduce(list_prepend(e, list_transform(list_reverse(made), lambda y: [y])), lambda s, a:
    CASE WHEN abs(s[-1].top - a[1].top) < height AND s[-1].x0 < a[1].x0 THEN s[:-2] || a || [s[-1]] ELSE s || a END))"""


@query(f"WITH {_BOXES}, {_listed('top, x0')}, r AS (SELECT page, {_FOLD.format(step=_PASS)} AS bs FROM p) SELECT page, bs[i].box AS box, i AS place FROM (SELECT page, bs, unnest(range(1, len(bs) + 1)) AS i FROM r)")
def fuzzy_order(spark, d):
    """Boxes by top and left side, where those less than a line apart have changed places in turn."""
    p = _given(spark, d, "top", "x0").select("page", B.in_reading_order(F.col("boxes"), F.col("height")).alias("boxes")).select("page", F.posexplode("boxes").alias("place", "b"))
    return p.select("page", "b.box", (F.col("place") + 1).cast("long").alias("place"))


_COVER = "greatest(least(k.x1, e[1].x1) - greatest(k.x0, e[1].x0), 0) * greatest(least(k.bottom, e[1].bottom) - greatest(k.top, e[1].top), 0)"
_WORSE = f"len(list_filter(made, lambda k: k.kind = e[1].kind AND ({_COVER} >= 0.5 * (k.x1 - k.x0) * (k.bottom - k.top) OR {_COVER} >= 0.5 * (e[1].x1 - e[1].x0) * (e[1].bottom - e[1].top)))) > 0"


@query(f"WITH {_BOXES}, {_listed('-score', ', kind: kind')}, r AS (SELECT page, {_FOLD.format(step=f'CASE WHEN {_WORSE} THEN made ELSE made || e END')} AS bs FROM p) SELECT page, x.box AS box FROM (SELECT page, unnest(bs) AS x FROM r)".replace(", kind: kind", ", 'kind': kind"))
def suppressed_boxes(spark, d):
    """Of boxes of one kind that cover each other by half the one of the higher score stays."""
    kept = _given(spark, d, "-score", more=("kind",)).select("page", F.explode(B.suppressed(F.col("boxes"), 0.5)).alias("b"))
    return kept.select("page", "b.box")


_ACROSS = """CASE WHEN made[-1].layout = e[1].layout AND made[-1].layout NOT IN ('table', 'figure', 'equation') AND abs((e[1].top + e[1].bottom) / 2 - (made[-1].top + made[-1].bottom) / 2) < height / 3
    THEN made[:-2] || [{'box': made[-1].box, 'x0': made[-1].x0, 'x1': e[1].x1, 'top': (made[-1].top + e[1].top) / 2, 'bottom': (made[-1].bottom + e[1].bottom) / 2, 'layout': made[-1].layout, 'text': made[-1].text || e[1].text}] ELSE made || e END"""
_DOWN = f"""CASE WHEN (NOT (made[-1].layout <> e[1].layout OR ('{B.STOPS}' LIKE '%' || right(trim(made[-1].text), 1) || '%' AND trim(made[-1].text) <> '') OR e[1].top - made[-1].bottom > height * 1.5)
        OR ('{B.GOES_ON.replace("'", "''")}' LIKE '%' || right(trim(made[-1].text), 1) || '%' AND trim(made[-1].text) <> '') OR ('{B.BEFORE}' LIKE '%' || left(trim(e[1].text), 1) || '%' AND trim(e[1].text) <> '')) AND made[-1].x1 >= e[1].x0 AND made[-1].x0 <= e[1].x1
    THEN made[:-2] || [{{'box': made[-1].box, 'x0': least(made[-1].x0, e[1].x0), 'x1': greatest(made[-1].x1, e[1].x1), 'top': made[-1].top, 'bottom': e[1].bottom, 'layout': made[-1].layout, 'text': made[-1].text || e[1].text}}] ELSE made || e END"""
_MADE = "SELECT page, x.box AS box, round(x.x0, 6) AS x0, round(x.x1, 6) AS x1, round(x.top, 6) AS top, round(x.bottom, 6) AS bottom, x.text AS text FROM (SELECT page, unnest(bs) AS x FROM r)"


def _made(folded: DataFrame) -> DataFrame:
    return folded.select("page", "b.box", *(F.round(f"b.{s}", 6).alias(s) for s in B.SIDES), "b.text")


@query(f"WITH {_BOXES}, {_listed('top, x0', ', layout: layout, text: text')}, r AS (SELECT page, {_FOLD.format(step=_ACROSS)} AS bs FROM p) {_MADE}".replace(", layout: layout, text: text", ", 'layout': layout, 'text': text"))
def boxes_merged_across(spark, d):
    """Boxes of a layout in one line, each merged with what the ones before it have become."""
    p = _given(spark, d, "top", "x0", more=("layout", "text"))
    return _made(p.select("page", F.explode(B.merged_across(F.col("boxes"), F.col("height"))).alias("b")))


@query(f"WITH {_BOXES}, {_listed('top, x0', ', layout: layout, text: text')}, r AS (SELECT page, {_FOLD.format(step=_DOWN)} AS bs FROM p) {_MADE}".replace(", layout: layout, text: text", ", 'layout': layout, 'text': text"))
def boxes_merged_down(spark, d):
    """Boxes under each other as paragraphs, by marks at their ends, layouts and gaps."""
    p = _given(spark, d, "top", "x0", more=("layout", "text"))
    return _made(p.select("page", F.explode(B.merged_down(F.col("boxes"), F.col("height"))).alias("b")))


@query()
def table_lines(spark, d):
    """Each page's boxes as a table: rows as "header: value"; tests hold spans, lone cells and headers against plain tables."""
    return B.lines(B.headed(B.cells(page_boxes(spark, d))))


@query()
def table_html(spark, d):
    """The same tables as HTML with spans."""
    return B.html(B.headed(B.cells(page_boxes(spark, d))))
