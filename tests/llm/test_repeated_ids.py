"""Rows that repeat a doc_id, or have none, in substring dedup and near-duplicate removal."""

from collections import Counter

import pytest
from test_scans import many, plain_dedup

from lantern.llm import ngram_join, substring_dedup

PASSAGE = " ".join(f"p{i}" for i in range(60))
own = lambda k, n: " ".join(f"o{k}x{i}" for i in range(n))


@pytest.fixture(scope="module")
def repeated():
    """7 occurs three times with a passage of 3, 8 with two texts that hold it at different places, 3 itself twice."""
    rows = [(3, f"{own(1, 5)} {PASSAGE}"), (3, f"{own(2, 30)} {PASSAGE}"), (9, own(9, 80))]
    rows += [(7, f"{own(3, 20)} {PASSAGE} {own(4, 9)}")] * 3
    rows += [(8, f"{PASSAGE} {own(5, 70)}"), (8, f"{own(6, 70)} {PASSAGE}"), (8, own(7, 100)), (8, own(7, 100))]
    return rows


@pytest.mark.parametrize("parts", [1, 4])
def test_substring_dedup_of_repeated_ids(spark, repeated, parts):
    docs = spark.createDataFrame(repeated, "doc_id long, text string").repartition(parts)
    want = plain_dedup(repeated)
    assert Counter(w[2] for w in want)[60] == 5
    assert many(substring_dedup.dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    none = spark.createDataFrame([(None, r[1]) for r in repeated], "doc_id long, text string")
    assert sum(r["n_removed"] for r in substring_dedup.dedup(none).collect()) == 0


def test_one_row_of_each_group_stays(spark):
    x, y, z, u = own(1, 60), own(2, 60), own(3, 60), own(4, 60)
    near = x.replace("o1x59", "other")
    rows = [(5, x, 1), (5, x, 1), (4, near, 2), (6, x, 3), (5, y, 4), (5, y, 4), (None, z, 5), (None, z, 5), (None, x, 6), (2, u, 7), (9, u, 8), (9, None, 9), (9, "", 9), (None, " ", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other long").repartition(3)
    got = ngram_join.first_of_each(docs)
    assert got.columns == docs.columns
    assert many(got, *docs.columns) == sorted([(4, near, 2), (5, y, 4), (None, z, 5), (2, u, 7), (9, None, 9), (9, "", 9), (None, " ", 9)], key=repr)
