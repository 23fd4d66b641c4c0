"""Layout and re-ranking helpers on literals."""

from pyspark.sql import functions as F

from lantern.operators import layout, rerank


def test_same_row_counts_others_inside(spark):
    boxes = spark.createDataFrame([(1, 0.0, 5.0, 0.0, 10.0), (1, 6.0, 9.0, 1.0, 9.0), (1, 0.0, 5.0, 20.0, 30.0), (2, 0.0, 1.0, 0.0, 10.0)], "page int, x0 double, x1 double, top double, bottom double")
    got = {(r["page"], r["x0"], r["top"]): r["in_row"] for r in layout.same_row(boxes, "page").collect()}
    assert got == {(1, 0.0, 0.0): 1, (1, 6.0, 1.0): 1, (1, 0.0, 20.0): 0, (2, 0.0, 0.0): 0}


def test_token_measures(spark):
    df = spark.createDataFrame([(["a", "b", "b"], ["b", "c"]), (["a"], [])], "q array<string>, d array<string>")
    rows = df.select(F.round(rerank.token_similarity(F.col("q"), F.col("d")), 6), F.round(rerank.token_overlap(F.col("q"), F.col("d")), 5)).collect()
    assert [tuple(r) for r in rows] == [(0.5, 0.5), (0.0, 0.0)]


def test_phrases_of_short_lists(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(rerank.neighbours_boost(F.col("t"))).collect()] == [["a b", "b c"], [], []]
