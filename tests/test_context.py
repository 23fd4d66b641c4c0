from pyspark.sql import functions as F

from lantern.operators import context


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_budget_keeps_whole_snippets_in_order(spark):
    df = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, None), (1, 3, "bbbb"), (1, 4, "cccc"), (2, 1, ""), (3, 1, "x" * 50)], "g int, n int, t string")
    assert rows(context.budgeted(df, "g", [F.col("n")], "t", 5, 10, 9)) == [(1, "aaaa\nbbbb", 2)]
    assert rows(context.budgeted(df, "g", [F.col("n")], "t", 1, 3, 9)) == [(1, "aaa", 1), (3, "xxx", 1)]
    assert rows(context.budgeted(df.where("false"), "g", [F.col("n")], "t", 5, 10, 9)) == []


def test_cite_takes_the_highest_level_of_an_answer(spark):
    df = spark.createDataFrame([(1, "a", 1, 0.9), (1, "a", 2, 0.9), (1, "a", 3, 0.5), (1, "b", 1, 0.55), (2, "a", 1, 0.4), (3, "a", 1, 0.2)], "q int, s string, d int, sim double")
    assert rows(context.cite(df, "q", "s", "d", "sim")) == [(1, "a", 1, 0.9), (1, "a", 2, 0.9), (2, "a", 1, 0.4)]


def test_html_tables_split_by_size(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "c")], "g int, n int, v string")
    assert rows(context.html_tables(df, "g", "n", ["v"], 2)) == [(1, 0, "<table><tr><td>a</td></tr><tr><td></td></tr></table>", 2), (1, 1, "<table><tr><td>c</td></tr></table>", 1)]


def test_a_table_wins_only_if_closer(spark):
    c = spark.createDataFrame([(1, 9, 0.0, 0.0), (2, 9, 0.0, 0.0)], "page int, c int, x0 double, top double")
    t = spark.createDataFrame([(1, 1, 1.0, 0.0, "table"), (1, 2, 0.0, 1.0, "figure"), (2, 1, 1.0, 0.0, "table"), (2, 2, 0.0, 3.0, "figure")], "page int, t int, x0 double, top double, kind string")
    assert rows(context.nearest(c, t, "page", "c", "t", "kind", "table")) == [(1, 9, 2, "figure"), (2, 9, 1, "table")]


def test_headings_close_deeper_ones(spark):
    df = spark.createDataFrame([(1, 1, 1, "A"), (1, 2, 2, "B"), (1, 3, 3, "x"), (1, 4, 1, "C"), (1, 5, 3, "y")], "d int, p int, l int, h string")
    got = {r["p"]: r["path"] for r in context.heading_paths(df, "d", "p", "l", "h", 3).collect()}
    assert got == {1: "", 2: "A", 3: "A > B", 4: "", 5: "C"}


def test_term_weights_sum_to_one_and_prefer_rare_terms(spark):
    docs = spark.createDataFrame([(1, "red red blue"), (2, "red"), (3, None)], "doc_id int, text string")
    q = spark.createDataFrame([(7, "red blue"), (8, None)], "item_id int, text string")
    got = {r["term"]: r["weight"] for r in context.term_weights(q, docs, "item_id", "doc_id").collect()}
    assert set(got) == {"red", "blue"} and abs(sum(got.values()) - 1) < 1e-9 and got["blue"] > got["red"]


def test_field_search_needs_a_share_in_one_field(spark):
    docs = spark.createDataFrame([(1, "red", "other words"), (2, None, "red blue"), (3, "zz", None)], "doc_id int, title string, text string")
    q = spark.createDataFrame([(7, "red blue")], "item_id int, text string")
    got = {r["doc_id"] for r in context.field_search(q, docs, "item_id", "doc_id", {"title": 10.0, "text": 1.0}, share=0.6).collect()}
    assert got == {2}
