"""Geometry of boxes on pages: overlap joins, neighbours, running offsets and tables that go on over a page break.

A box has a page, x0, x1, top and bottom. All joins are on the page, so pages spread over tasks and only a page's own boxes meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SIDES = ("x0", "x1", "top", "bottom")


def area(box: str | None = None) -> Column:
    c = [F.col(f"{box}.{s}" if box else s) for s in SIDES]
    return (c[1] - c[0]) * (c[3] - c[2])


def overlap(a: str, b: str) -> Column:
    """Area that two struct columns share, 0 if apart."""
    wide = F.least(f"{a}.x1", f"{b}.x1") - F.greatest(f"{a}.x0", f"{b}.x0")
    high = F.least(f"{a}.bottom", f"{b}.bottom") - F.greatest(f"{a}.top", f"{b}.top")
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def iou(a: str, b: str) -> Column:
    shared = overlap(a, b)
    return shared / (area(a) + area(b) - shared)


def assign(boxes: DataFrame, regions: DataFrame, page: str, box: str, region: str, least: float = 0.0) -> DataFrame:
    """Each box with the region of its page that covers most of it (smallest id on ties), null below ``least``; share of it covered."""
    a = boxes.select(F.col(page), F.col(box), F.struct(*SIDES).alias("a"))
    b = regions.select(F.col(page), F.col(region), F.struct(*SIDES).alias("b"))
    share = overlap("a", "b") / area("a")
    pairs = a.join(b, page).withColumn("share", share).where((F.col("share") > 0) & (F.col("share") >= least))
    best = pairs.groupBy(page, box).agg(F.max_by(F.struct(region, "share"), F.struct("share", -F.col(region))).alias("best"))
    return boxes.select(page, box).join(best, [page, box], "left").select(page, box, f"best.{region}", F.coalesce("best.share", F.lit(0.0)).alias("share"))


def same_row(boxes: DataFrame, page: str, around: int = 12) -> DataFrame:
    """boxes with the number of others among the ``around`` before and after whose vertical middles lie inside the box."""
    order = Window.partitionBy(page).orderBy("top", "x0", "x1", "bottom").rowsBetween(-around, around)
    middle = (F.col("top") + F.col("bottom")) / 2
    near = boxes.withColumn("middles", F.collect_list(middle).over(order))
    inside = F.filter("middles", lambda m: (m >= F.col("top")) & (m <= F.col("bottom")))
    return near.withColumn("in_row", (F.size(inside) - 1).cast("long")).drop("middles")


def page_offsets(pages: DataFrame, doc: str, page: str, height: str) -> DataFrame:
    """pages with the height of all pages before them in their document."""
    before = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("offset", F.coalesce(F.sum(height).over(before), F.lit(0)))


def continued(tables: DataFrame, doc: str, page: str, distance: Column, most: float) -> DataFrame:
    """tables with the first page of the run of following pages that each lie near enough to the one before."""
    order = Window.partitionBy(doc).orderBy(page)
    breaks = F.coalesce((F.col(page) != F.lag(page).over(order) + 1) | (distance > most), F.lit(True))
    marked = tables.withColumn("_start", F.when(breaks, F.col(page)))
    return marked.withColumn("first_page", F.last("_start", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")
