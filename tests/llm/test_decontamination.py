"""The pipeline's benchmark stage against a plain search."""

import re

import pytest

import corpus_pipeline
from lantern.llm import decontamination

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_cut(text, items, n=10, limit=0.1):
    """The words that stay, or None where the document goes. Items of fewer than n words don't count."""
    w, hit = low(text), set()
    grams = {tuple(i[p : p + n]) for i in map(low, items) for p in range(len(i) - n + 1)}
    for p in range(len(w) - n + 1):
        if tuple(w[p : p + n]) in grams:
            hit.update(range(p, p + n))
    return None if len(hit) > limit * len(w) else [x for i, x in enumerate(w) if i not in hit]


def test_stage_cuts_and_keeps_as_plain_search(spark, tmp_path):
    item = " ".join(f"i{k}" for k in range(30))
    clean = lambda k, n: " ".join(f"c{k}x{j}" for j in range(n))
    rows = [
        (1, f"{clean(1, 300)} {item[: item.index(' i12')]}. {clean(2, 40)}", "en", "a", 1),  # 12 of 352 words
        (2, f"{clean(3, 100)} {item}", "en", "a", 1),  # 30 of 130
        (3, f"three {clean(4, 4)} three", "en", "a", 1),
        (4, f"{item.upper()} {clean(5, 900)}", None, "a", 1),
        (5, None, "en", None, None),
        (6, " ".join(item.split()[:9]), "en", "a", 1),  # one word short of a window
    ]
    spark.createDataFrame([(1, item), (2, "three"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    items = [item, "three"]
    got = {r["doc_id"]: r for r in corpus_pipeline.benchmark(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()}
    want = {r[0]: plain_cut(r[1], items) for r in rows}
    assert {d: low(r["text"]) for d, r in got.items()} == {d: w for d, w in want.items() if w is not None}
    assert sorted(got) == [1, 3, 4, 5, 6] and got[3]["text"] == rows[2][1] and got[5]["text"] is None
    assert got[1]["n_chars"] == len(got[1]["text"]) and got[1]["text"].endswith(rows[0][1][-len(clean(2, 40)) :])


def test_stage_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {r["doc_id"]: plain_cut(r["text"], items) for r in docs.collect()}
    got = {r["doc_id"]: low(r["text"]) for r in corpus_pipeline.benchmark(spark, docs, sf).collect()}
    assert got == {d: w for d, w in want.items() if w is not None}
    whole = {r["doc_id"] for r in decontamination.decontaminate(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert len(set(got) - whole) >= 5


REPEATED = [
    (1, " ".join(f"i{k}" for k in range(20)) + " end", "en", "a", 1),
    (1, "a text of its own", "en", "a", 1),
    (1, "a text of its own", "en", "a", 1),
    (None, " ".join(f"j{k}" for k in range(20)), "en", "a", 1),
    (None, " ".join(f"i{k}" for k in range(15)) + " " + " ".join(f"j{k}" for k in range(10)) + " c" * 40, "en", "a", 1),
    (2, None, "en", "a", 1),
    (3, "c " * 60 + " ".join(f"i{k}" for k in range(5, 20)), "en", "a", 1),
]


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(f"i{k}" for k in range(20))), (2, " ".join(f"j{k}" for k in range(20))), (3, "end")], "item_id long, text string")


@pytest.mark.parametrize("shard_words", [1_000_000, 5])
def test_each_row_has_its_hits_at_each_shard_size(spark, bench, shard_words):
    docs = spark.createDataFrame(REPEATED, SCHEMA).repartition(3)
    assert shard_words > 5 or len(list(decontamination._shards(bench, shard_words))) > 1
    got = sorted((str(r["doc_id"]), r["n_words"], [tuple(s) for s in r["spans"]], r["items"]) for r in decontamination.hits(docs, bench, shard_words=shard_words).collect())
    assert got == sorted([("1", 21, [(0, 21)], ["1", "3"]), ("1", 5, [], []), ("1", 5, [], []), ("None", 20, [(0, 20)], ["2"]), ("None", 65, [(0, 25)], ["1", "2"]), ("2", 0, [], []), ("3", 75, [(60, 75)], ["1"])])


@pytest.mark.parametrize("shard_words", [1_000_000, 5])
def test_coverage_is_judged_once_over_all_shards(spark, bench, shard_words):
    """The row of both items is 25 of 65 words hit; each item alone covers less than 0.25."""
    docs = spark.createDataFrame(REPEATED, SCHEMA).repartition(3)
    for limit, n in ((0.25, 5), (0.4, 6)):
        clean = decontamination.decontaminate(docs, bench, coverage_limit=limit, shard_words=shard_words)
        assert clean.columns == docs.columns and clean.count() == n - 1
        got = sorted((str(r["doc_id"]), low(r["text"])) for r in clean.collect())
        want = [("1", low("a text of its own"))] * 2 + [("2", []), ("3", ["c"] * 60)] + [("None", ["c"] * 40)] * (limit == 0.4)
        assert got == sorted(want)
