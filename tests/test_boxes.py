import random

import pytest
from pyspark.sql import functions as F

from lantern.operators import boxes as B

SCHEMA = "page long, box int, x0 double, x1 double, top double, bottom double, kind string, layout string, score double, text string"


def made(seed, n, pages=3):
    rng = random.Random(seed)
    out = []
    for page in range(pages):
        for box in range(n):
            x, y = rng.randint(0, 6) * 50 + rng.random() * 8, rng.randint(0, 8) * 20 + rng.random() * 6
            out.append((page, box, x, x + rng.randint(10, 70), y, y + rng.randint(8, 18), rng.choice("ab"), rng.choice(["text", "table", "title"]), rng.random(), rng.choice(["12", "3.5%", "word", "end.", "go on,", " ", "。x"])))
    return out


def by_page(rows, key):
    out = {}
    for r in sorted(rows, key=key):
        out.setdefault(r[0], []).append(list(r))
    return out


@pytest.mark.parametrize("n", [1, 2, 25])
def test_fuzzy_order_as_plain_swaps(spark, n):
    rows = made(n, n)
    got = B.pages(spark.createDataFrame(rows, SCHEMA), "top", "x0").select("page", B.in_reading_order(F.col("boxes"), F.lit(12.0)).alias("b"))
    for r in got.collect():
        want = by_page(rows, lambda r: (r[4], r[2], r[1]))[r["page"]]
        for i in range(len(want) - 1):
            for j in range(i, -1, -1):
                if abs(want[j + 1][4] - want[j][4]) < 12 and want[j + 1][2] < want[j][2]:
                    want[j], want[j + 1] = want[j + 1], want[j]
        assert [b["box"] for b in r["b"]] == [w[1] for w in want]


def test_suppression_as_plain_greedy_choice(spark):
    rows = made(3, 40)

    def share(a, b):
        w, h = min(a[3], b[3]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[4], b[4])
        return w * h / ((a[3] - a[2]) * (a[5] - a[4])) if w > 0 and h > 0 else 0

    got = B.pages(spark.createDataFrame(rows, SCHEMA), "-score", more=("kind",)).select("page", B.suppressed(F.col("boxes"), 0.4).alias("b"))
    for r in got.collect():
        kept = []
        for b in by_page(rows, lambda r: (-r[8], r[1]))[r["page"]]:
            if not any(k[6] == b[6] and max(share(b, k), share(k, b)) >= 0.4 for k in kept):
                kept.append(b)
        assert [b["box"] for b in r["b"]] == [k[1] for k in kept] and len(kept) < 40


def cells_of(spark, rows):
    got = B.cells(spark.createDataFrame([(1, i, *map(float, r[:4]), "", "", 0.0, r[4]) for i, r in enumerate(rows)], SCHEMA))
    return got


def test_spans_in_both_directions(spark):
    rows = [  # left, right, top, bottom, text
        (0, 40, 0, 10, "name"), (60, 240, 0, 10, "both"),
        (0, 40, 20, 50, "tall"), (60, 140, 20, 30, "1"), (160, 240, 20, 30, "2"),
        (60, 140, 40, 50, "3"), (160, 240, 40, 50, "4"),
    ]
    got = {r["text"]: tuple(r[c] for c in ("row", "col", "rows", "cols")) for r in cells_of(spark, rows).collect()}
    assert got == {"name": (0, 0, 1, 1), "both": (0, 1, 1, 2), "tall": (1, 0, 2, 1), "1": (1, 1, 1, 1), "2": (1, 2, 1, 1), "3": (2, 1, 1, 1), "4": (2, 2, 1, 1)}
    headed = B.headed(cells_of(spark, rows))
    assert {r["text"] for r in headed.where("header").collect()} == {"name", "both"}
    assert {r["line"] for r in B.lines(headed).collect()} == {"name: tall; both: 1; both: 2", "both: 3; both: 4"}
    assert B.html(headed).first()["html"] == (
        '<table><tr><th>name</th><th colspan="2">both</th></tr><tr><td rowspan="2">tall</td><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>'
    )


def test_a_lone_cell_goes_to_the_nearer_side(spark):
    rows = [(c * 100, c * 100 + 40, r * 20, r * 20 + 10, f"{r}{c}") for r in range(5) for c in (0, 2)]
    near_left = [*rows, (60, 90, 100, 110, "lone")]
    got = {r["text"]: (r["row"], r["col"]) for r in cells_of(spark, near_left).collect()}
    assert got["lone"] == (5, 0) and got["02"] == (0, 1) and got["00"] == (0, 0)
    near_right = [*rows, (150, 195, 100, 110, "lone")]
    got = {r["text"]: (r["row"], r["col"]) for r in cells_of(spark, near_right).collect()}
    assert got["lone"] == (5, 1) and got["42"] == (4, 1)
    few = [r for r in near_left if r[2] < 40 or r[4] == "lone"]  # three rows: it stays
    assert {r["text"]: r["col"] for r in cells_of(spark, few).collect()}["02"] == 2


def test_headers_of_numbers_and_escapes(spark):
    rows = [(c * 100, c * 100 + 40, r * 20, r * 20 + 10, ["<a>", "b & c"][c] if r in (0, 2) else "1,000.5%") for r in range(6) for c in range(2)]
    headed = B.headed(cells_of(spark, rows))
    assert sorted({r["row"] for r in headed.where("header").collect()}) == [0, 2]
    lines = {r["row"]: r["line"] for r in B.lines(headed).collect()}
    assert lines[1] == "<a>: 1,000.5%; b & c: 1,000.5%" and lines[3] == "<a> <a>: 1,000.5%; b & c b & c: 1,000.5%"
    assert "&lt;a&gt;" in B.html(headed).first()["html"] and "b &amp; c" in B.html(headed).first()["html"]


def test_nulls_and_empty_pages(spark):
    rows = [(1, 0, None, 1.0, 0.0, 1.0, "a", "text", 1.0, "x"), (1, 1, 0.0, 1.0, 0.0, 1.0, "a", "text", 1.0, None)]
    p = B.pages(spark.createDataFrame(rows, SCHEMA), "top", more=("layout", "text"))
    assert [len(r["b"]) for r in p.select(B.merged_down(F.col("boxes"), F.lit(1.0)).alias("b")).collect()] == [1]
    none = spark.createDataFrame([], SCHEMA)
    assert B.pages(none, "top").count() == 0 and B.cells(none).count() == 0
