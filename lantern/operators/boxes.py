"""Order-dependent work on the boxes of a page: reading order, merges, suppression, tables from cells.

Each is a fold over a page's boxes in a fixed order, in which a decision depends on what has been made so far. Merges and suppression are
aggregations over the page's array of boxes, in the JVM. Reading order and cells take many steps for each box, so they run over many pages at
once, as matrices of sides with a row for each page. Pages spread over tasks, and a page is as small as paper is. Nulls in sides drop a box;
ties in an order go to the smaller box number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

SIDES = ("x0", "x1", "top", "bottom")
#: Places of a matrix of pages and boxes that is worked on at once; a page of more is worked on alone.
PLACES = 1 << 18


def pages(boxes: DataFrame, *order: str, more: tuple[str, ...] = (), **beside: Column) -> DataFrame:
    """(page, boxes): each page's boxes in ``order`` and by number, with all sides and ``more``; ``beside`` are aggregates of all its boxes, dropped ones too."""
    whole = F.col("box").isNotNull()
    for side in SIDES:
        whole &= F.col(side).isNotNull() & ~F.isnan(side)
    keys = [F.expr(o).alias(f"o{i}") for i, o in enumerate(order)]
    row = F.struct(*keys, "box", *SIDES, *more)
    plain = lambda b: F.struct(*(b[c].alias(c) for c in ("box", *SIDES, *more)))
    held = boxes.where("page is not null") if beside else boxes.where(F.col("page").isNotNull() & whole)
    listed = F.transform(F.array_sort(F.collect_list(F.when(whole, row) if beside else row)), plain)
    out = held.groupBy("page").agg(listed.alias("boxes"), *(c.alias(name) for name, c in beside.items()))
    return out.where(F.size("boxes") > 0) if beside else out


def _alike(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Pages of like sizes, as many as fit into ``PLACES`` when filled up to the largest."""
    order, start = np.argsort(sizes, kind="stable"), 0
    order = order[sizes[order] > 0]
    while start < len(order):
        filled = sizes[order[start:]] * np.arange(1, len(order) - start + 1)
        stop = start + max(1, int(np.searchsorted(filled, PLACES, "right")))
        yield order[start:stop]
        start = stop


def _matrices(lists: list[pa.Array]) -> Iterator[tuple]:
    """For some pages at a time: their numbers, the places of their boxes in all lists put together, which of the matrix are boxes, and the matrices, NaN elsewhere."""
    ends = np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False))
    starts = np.concatenate(([0], ends))[:-1]
    flat = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
    for some in _alike(ends - starts):
        at = starts[some][:, None] + np.arange((ends - starts)[some].max())
        there = at < ends[some][:, None]
        yield some, at[there], there, [np.where(there, x[np.minimum(at, len(x) - 1)], np.nan) for x in flat]


def _sides(boxes: Column, *names: str) -> list[Column]:
    side = lambda name: F.transform(boxes, lambda b: b[name].cast("double"))
    return [side(name) for name in names]


def _fold(boxes: Column, step) -> Column:
    """From the array of the first box on, ``step(made, box)`` for each later one."""
    return F.aggregate(F.slice(boxes, 2, F.greatest(F.size(boxes), F.lit(1))), F.slice(boxes, 1, 1), step)


def _init(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.size(a) - 1)


def _swapped(across: np.ndarray, along: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Each page's boxes as numbers in their new order.

    Pass i compares neighbours from (i, i + 1) up to (0, 1). Pass i + 1 needs a pair only after pass i has left it and the one above, two steps
    later, so at step t the pairs j = t, t - 2, ... of as many passes are compared at once.
    """
    across, along = across.copy(), along.copy()
    order, n = np.tile(np.arange(across.shape[1]), (len(across), 1)), across.shape[1]
    for t in range(2 * n - 3):
        first, last = slice(t % 2, min(t, 2 * (n - 2) - t) + 1, 2), slice(t % 2 + 1, min(t, 2 * (n - 2) - t) + 2, 2)
        swap = (np.abs(across[:, last] - across[:, first]) < near[:, None]) & (along[:, last] < along[:, first])
        for x in (across, along, order):
            a, b = x[:, first], x[:, last]
            x[:, first], x[:, last] = np.where(swap, b, a), np.where(swap, a, b)
    return order


def in_reading_order(boxes: Column, near: Column, across: str = "top", along: str = "x0") -> Column:
    """Boxes sorted by ``across`` and ``along``, of which those nearer than ``near`` have then changed places where ``along`` asks for it.

    Each box in turn goes through those before it, from the last to the first, and of two that lie side by side the left one is in front from then on.
    """

    def order(across: pa.Array, along: pa.Array, near: pa.Array) -> pa.Array:
        out, near = np.zeros(len(across.flatten()), np.int32), near.to_numpy(zero_copy_only=False).astype(float)
        for some, at, there, (a, b) in _matrices([across, along]):
            out[at] = _swapped(a, b, near[some])[there]
        return _listed(across, pa.array(out))

    places = F.arrow_udf(order, "array<int>").asNondeterministic()(*_sides(boxes, across, along), near.cast("double"))
    return F.transform(places, lambda i: F.get(boxes, i))


def _listed(like: pa.Array, values: pa.Array) -> pa.Array:
    """values in lists of the same lengths."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(like.value_lengths().to_numpy(zero_copy_only=False)))), pa.int32()), values)


def _share(a: Column, b: Column) -> Column:
    """The part of a that b covers."""
    wide, high = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])
    area = (a["x1"] - a["x0"]) * (a["bottom"] - a["top"])
    return F.when((wide > 0) & (high > 0) & (area > 0), wide * high / area).otherwise(0.0)


def suppressed(boxes: Column, least: float = 0.7) -> Column:
    """Of boxes by falling score those that no better one of their kind, itself kept, covers by ``least`` or is covered by."""
    worse = lambda kept, b: F.exists(kept, lambda k: (k["kind"] == b["kind"]) & ((_share(b, k) >= least) | (_share(k, b) >= least)))
    return _fold(boxes, lambda kept, b: F.when(worse(kept, b), kept).otherwise(F.concat(kept, F.array(b))))


def _middle(b: Column) -> Column:
    return (b["top"] + b["bottom"]) / 2


def merged_across(boxes: Column, height: Column) -> Column:
    """Each box joins the one made so far if both are of one layout, which isn't a table or figure, and their middles are within a third of a line."""

    def step(made: Column, b: Column) -> Column:
        a = F.element_at(made, -1)
        joins = (a["layout"] == b["layout"]) & ~a["layout"].isin("table", "figure", "equation") & (F.abs(_middle(b) - _middle(a)) < height / 3)
        one = F.struct(
            a["box"].alias("box"), a["x0"].alias("x0"), b["x1"].alias("x1"), ((a["top"] + b["top"]) / 2).alias("top"), ((a["bottom"] + b["bottom"]) / 2).alias("bottom"),
            a["layout"].alias("layout"), F.concat(a["text"], b["text"]).alias("text"),
        )
        return F.when(joins, F.concat(_init(made), F.array(one))).otherwise(F.concat(made, F.array(b)))

    return _fold(boxes, step)


#: At these ends a line goes on, after these it stops, before these it has gone on.
GOES_ON, STOPS, BEFORE = ",;:'\"，、‘“；：-", "。？！?", "。；？！?”）),，、："


def merged_down(boxes: Column, height: Column) -> Column:
    """Each box joins the one above unless layout, a full stop or a gap speaks against it and no mark for it, or they lie beside each other."""

    def step(made: Column, b: Column) -> Column:
        a = F.element_at(made, -1)
        above, below = F.trim(a["text"]), F.trim(b["text"])
        last, first = F.right(above, F.lit(1)), F.left(below, F.lit(1))
        has = lambda marks, c: (c != "") & F.contains(F.lit(marks), c)
        against = (a["layout"] != b["layout"]) | has(STOPS, last) | (b["top"] - a["bottom"] > height * 1.5)
        joins = (~against | has(GOES_ON, last) | has(BEFORE, first)) & (a["x1"] >= b["x0"]) & (a["x0"] <= b["x1"])
        one = F.struct(
            a["box"].alias("box"), F.least(a["x0"], b["x0"]).alias("x0"), F.greatest(a["x1"], b["x1"]).alias("x1"), a["top"].alias("top"), b["bottom"].alias("bottom"),
            a["layout"].alias("layout"), F.concat(a["text"], b["text"]).alias("text"),
        )
        return F.when(joins, F.concat(_init(made), F.array(one))).otherwise(F.concat(made, F.array(b)))

    return _fold(boxes, step)


def bands(start: np.ndarray, end: np.ndarray, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bands of each page's boxes sorted by ``start``: their starts and runs, and how many; a box opens the next one if it starts behind the run, the least end in the last one.

    So a cell that spans several bands doesn't make them one.
    """
    starts, runs = np.full(start.shape, np.nan), np.full(start.shape, np.nan)
    page, at, run = np.arange(len(start)), np.full(len(start), -1), np.full(len(start), -np.inf)
    for i in range(start.shape[1]):
        s, e = start[:, i], end[:, i]
        there = ~np.isnan(s)
        opens = there & (s >= run - slack)
        at += opens
        run = np.where(opens, e, np.where(there, np.minimum(run, e), run))
        starts[page[opens], at[opens]] = s[opens]
        runs[page[there], at[there]] = run[there]
    most = int(at.max()) + 1
    return starts[:, :most], runs[:, :most], at + 1


def _placed(starts: np.ndarray, runs: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each box the last band that starts at or before ``lo``, from 0, and how many it spans from there on: those whose middles it covers."""
    place, spans, middles = np.full(lo.shape, -1), np.zeros(lo.shape, int), (starts + runs) / 2
    for k in range(starts.shape[1]):
        place += starts[:, k, None] <= lo
    place = np.maximum(place, 0)
    for k in range(starts.shape[1]):
        s, m = starts[:, k, None], middles[:, k, None]
        spans += (k >= place) & (s <= hi) & (m <= hi) & (m >= lo)
    return place, np.maximum(spans, 1)


def _relocated(page: np.ndarray, row: np.ndarray, col: np.ndarray, x0: np.ndarray, x1: np.ndarray, high: np.ndarray, width: int) -> np.ndarray:
    """New columns of cells. In a page that is ``high`` a column of one cell goes to the neighbour that is nearer to it; later columns move up.

    It stays where it has neighbours in its row on both sides, or none at all. Columns that lie beside each other aren't moved both.
    """
    wide = width + 2  # an empty column on either side
    column = page * wide + col + 1
    n = np.bincount(column, minlength=(page.max() + 1) * wide)
    ends, begins = np.full(len(n), -np.inf), np.full(len(n), np.inf)
    np.maximum.at(ends, column, x1)
    np.minimum.at(begins, column, x0)
    alone = n == 1
    lone = np.flatnonzero((alone & ~np.concatenate(([False], alone[:-1])))[column] & high[page])
    c, place = column[lone], lambda c, r: c * (row.max() + 1) + r
    taken = place(column, row)
    open_ = lambda d: (n[c + d] > 0) & ~np.isin(place(c + d, row[lone]), taken)
    left, right = np.where(open_(-1), x0[lone] - ends[c - 1], np.nan), np.where(open_(1), begins[c + 1] - x1[lone], np.nan)
    moved = column.copy()
    moved[lone] += np.where(np.isnan(left) & np.isnan(right), 0, np.where(np.isnan(right) | (left < right), -1, 1))
    used = np.zeros(len(n), int)
    used[moved] = 1
    return used.reshape(-1, wide).cumsum(1).ravel()[moved] - 1


def _cells(x0: pa.Array, x1: pa.Array, top: pa.Array, bottom: pa.Array) -> pa.Array:
    """The places and spans of boxes that come in the order of their tops and left sides."""
    out = np.zeros((4, len(top.flatten())), np.int32)
    for _, at, there, (left, right, above, below) in _matrices([x0, x1, top, bottom]):
        rows = bands(above, below, 3.0)
        order = np.lexsort((above, left), axis=-1)
        cols = bands(np.take_along_axis(left, order, 1), np.take_along_axis(right, order, 1))
        row, n_rows = _placed(*rows[:2], above, below)
        col, n_cols = _placed(*cols[:2], left, right)
        new = _relocated(np.nonzero(there)[0], row[there], col[there], left[there], right[there], rows[2] >= 4, there.shape[1])
        out[:, at] = row[there], new, n_rows[there], n_cols[there]
    return _listed(top, pa.StructArray.from_arrays(list(map(pa.array, out)), ["row", "col", "rows", "cols"]))


def cells(boxes: DataFrame) -> DataFrame:
    """(page, box, row, col, rows, cols, text): the boxes of each page as the cells of a table.

    Rows and columns are bands of tops and of left sides. A cell spans the bands whose middles it covers. In a table of four rows and more a
    column of a single cell goes to the side where the nearer cell is.
    """
    place = F.arrow_udf(_cells, "array<struct<row:int,col:int,rows:int,cols:int>>").asNondeterministic()
    each = pages(boxes, "top", "x0", more=("text",)).select("page", "boxes", place(*_sides(F.col("boxes"), *SIDES)).alias("at"))
    return each.select("page", F.inline(F.arrays_zip("boxes", "at"))).select("page", "boxes.box", "at.row", "at.col", "at.rows", "at.cols", "boxes.text")


NUMERIC = r"^[-+(]?[0-9][0-9,.]*\)?%?$"


def headed(cells: DataFrame) -> DataFrame:
    """cells with ``header``: of a table that is mostly numbers, the rows of which over half isn't; without one the first row."""
    number = F.coalesce(F.rlike(F.trim("text"), F.lit(NUMERIC)), F.lit(False))
    row, page = Window.partitionBy("page", "row"), Window.partitionBy("page")
    words = cells.repartition("page").withColumn("_number", number).withColumn("_words", 2 * F.count_if("_number").over(row) < F.count("*").over(row))
    numeric = (2 * F.count_if("_number").over(page) > F.count("*").over(page)) & F.max("_words").over(page)
    return words.withColumn("header", F.when(numeric, F.col("_words")).otherwise(F.col("row") == 0)).drop("_number", "_words")


def lines(cells: DataFrame) -> DataFrame:
    """(page, row, line): for each row without header its values as "header: value", by columns; headers are those of the rows above."""
    words = cells.groupBy("page", "row", "col", "header").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("box", "text"))), lambda x: x["text"]), " ").alias("text"), F.max("cols").alias("cols"))
    # a header is there for each column that it spans
    over = F.when(F.col("header"), F.sequence("col", F.col("col") + F.col("cols") - 1)).otherwise(F.array("col"))
    each = words.select("page", "row", "header", "text", F.explode(over).alias("col"))
    before = Window.partitionBy("page", "col").orderBy("row").rangeBetween(Window.unboundedPreceding, -1)
    heads = F.collect_set(F.when(F.col("header"), F.struct("row", "text"))).over(before)
    values = each.withColumn("heads", heads).where("not header")
    head = F.array_join(F.transform(F.array_sort("heads"), lambda x: x["text"]), " ")
    cell = F.when(head != "", F.concat(head, F.lit(": "), "text")).otherwise(F.col("text"))
    return values.groupBy("page", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", cell.alias("t")))), lambda x: x["t"]), "; ").alias("line"))


def html(cells: DataFrame) -> DataFrame:
    """(page, html): one table for each page, spans given where a cell has more than one row or column."""
    span = lambda name, n: F.when(F.col(n) > 1, F.concat(F.lit(f' {name}="'), F.col(n), F.lit('"'))).otherwise("")
    tag = F.when(F.col("header"), "th").otherwise("td")
    body = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cell = F.concat(F.lit("<"), tag, span("rowspan", "rows"), span("colspan", "cols"), F.lit(">"), body, F.lit("</"), tag, F.lit(">"))
    row = cells.groupBy("page", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "box", cell.alias("t")))), lambda x: x["t"]), "").alias("t"))
    page = row.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "t"))), lambda x: F.concat(F.lit("<tr>"), x["t"], F.lit("</tr>"))), "").alias("t"))
    return page.select("page", F.concat(F.lit("<table>"), "t", F.lit("</table>")).alias("html"))
