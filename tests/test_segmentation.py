import itertools
import math
import pickle
import random
import time

import pytest
from pyspark.sql import functions as F

from lantern.operators import dense, segmentation as S
from lantern.plans import segments


def plain_best(run, words, least=1):
    """All divisions, by listing them."""
    best = None
    for cuts in itertools.product((0, 1), repeat=len(run) - 1):
        parts, start = [], 0
        for i, c in enumerate((*cuts, 1), 1):
            if c:
                parts.append(run[start:i])
                start = i
        if len(parts) < least or any(len(p) > 1 and p not in words for p in parts):
            continue
        total = sum(words.get(p, S.UNKNOWN) for p in parts)
        score = round((S.SPREAD + sum(len(p) > 1 for p in parts)) / len(parts) + total, 9)
        best = max(best or (score, -len(parts)), (score, -len(parts)))
    return best


def score_of(parts, words):
    return round((S.SPREAD + sum(len(p) > 1 for p in parts)) / len(parts) + sum(words.get(p, S.UNKNOWN) for p in parts), 9), -len(parts)


def test_best_paths_as_all_divisions_listed():
    rng = random.Random(1)
    for _ in range(150):
        words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): rng.randint(-13, -2) for _ in range(rng.randint(2, 14))}
        run = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 10)))
        for least in (1, 2):
            want, got = plain_best(run, words, least), S._best(run, words, least)
            assert "".join(got) == run
            if want and len(run) >= least:
                assert score_of(got, words) == want


def test_readings_that_agree_stand_and_long_texts_are_cut_in_pieces():
    words = {"研究": -5, "研究生": -7, "生命": -5, "命": -8, "起源": -6}
    assert S.divide("研究生命起源", words) == ["研究", "生命", "起源"]
    assert S.divide("研究生", words) == ["研究生"] and S.finer("研究生", words) == ["研究", "生"]
    assert S.finer("xyz", words) == ["xyz"] and S.finer("研究", words) == ["研究"]
    assert "".join(S.divide("研究生命" * 5000, words)) == "研究生命" * 5000


def test_runs_divided_at_once_as_one_by_one(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(S, "BLOCK", 7)
    for _ in range(120):
        words = {"".join(rng.choice("abc𝒳") for _ in range(rng.randint(1, rng.choice([3, 12])))): rng.randint(-13, 3) for _ in range(rng.randint(0, 40))}
        runs = ["".join(rng.choice("abcd𝒳") for _ in range(rng.randint(1, 130))) for _ in range(20)]
        tree, short = S.Words(words), [r[: rng.randint(1, 12)] for r in runs]
        assert S.divided(runs, tree) == [S.divide(r, words) for r in runs]
        assert S.divided(short, tree, fine=True) == [S.finer(r, words) for r in short]


def test_many_sentences_without_a_common_reading_take_little_time():
    rng = random.Random(6)
    words = {"".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))): rng.randint(-13, -2) for _ in range(3000)}
    texts = ["".join(rng.choice("abcdefgh") for _ in range(120)) for _ in range(2000)]
    tree, start = S.Words(words), time.process_time()
    out = S.in_chunks([*texts, None, ""], tree)
    assert time.process_time() - start < 3 and ["".join(t) for t in out] == [*texts, "", ""]  # one by one 6.6 seconds were measured


def test_joined_and_broadcast_dictionaries_agree(spark):
    rng = random.Random(2)
    words = [("".join(rng.choice("abc") for _ in range(rng.randint(1, 5))), rng.randint(1, 9000), "t") for _ in range(60)]
    dictionary = spark.createDataFrame(list({w[0]: w for w in words}.values()), "word string, freq long, tag string")
    texts = spark.createDataFrame([(i, " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 40))) for _ in range(3))) for i in range(40)] + [(98, None), (99, ""), (100, "ab"), (101, "ab")], "id long, text string")
    for fine in (False, True):
        one, two = (sorted((r["id"], r["tokens"]) for r in S.segmented(texts, dictionary, "text", fine, small).collect()) for small in (10**6, 1))
        assert one == two and dict(one)[98] == [] == dict(one)[99]


def test_user_words_replace_and_unknown_words_have_no_tag(spark):
    dictionary = spark.createDataFrame([("a", 5, "x"), ("b", 6, "y")], "word string, freq long, tag string")
    more = spark.createDataFrame([("b", 1, "u"), ("b", 3, "v"), ("c", 9, "w")], "word string, freq long, tag string")
    both = S.with_user_words(dictionary, more)
    tokens = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("b",)], "token string")
    assert sorted(tuple(r) for r in S.looked_up(tokens, both).collect()) == [("a", 5, "x"), ("b", 3, "v"), ("b", 3, "v"), ("c", 9, "w"), ("d", 0, "")]
    assert [r[0] for r in both.select(S.weight(both["freq"])).collect()] and math.isclose(S.DENOMINATOR, 1e6)


@pytest.mark.parametrize("clustered", [True, False])
def test_inverted_file_finds_nine_of_ten_neighbours(spark, clustered):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)] if clustered else [rng.gauss(0, 1) for _ in range(16)]) for i in range(1500)] + [(5000, None), (5001, [0.0] * 16)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    q = v.where("id % 20 = 0").withColumnRenamed("id", "q")
    exact = {(r["q"], r["id"]) for r in dense.knn(q, v, "q", "id", "v", 10).collect()}
    near = {(r["q"], r["id"]) for r in dense.knn_near(q, v, "q", "id", "v", 10).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
    if clustered:
        assert dense.fitted(v, "id", "v", 10, 0.95)[1] <= 20


def test_blocks_of_queries_and_rows_change_nothing(spark, monkeypatch):
    rng = random.Random(4)
    v = spark.createDataFrame([(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(200)], "id long, v array<double>")
    q = v.where("id % 10 = 0").withColumnRenamed("id", "q")
    one = sorted(map(tuple, dense.knn(q, v, "q", "id", "v", 7).collect()))
    monkeypatch.setattr(dense, "QUERIES", 6)
    monkeypatch.setattr(dense, "ROWS", 32)
    assert sorted(map(tuple, dense.knn(q, v, "q", "id", "v", 7).collect())) == one and len(one) == 140


def test_large_dictionaries_take_little_room_and_are_not_joined(spark, capsys):
    rng = random.Random(7)
    words = {"".join(rng.choice("abcdefghijklmnopqrstuvwxyzéèçñ") for _ in range(rng.randint(4, 12))): -12 for _ in range(100_000)}
    assert len(pickle.dumps(S.Words(words))) < 90 * len(words)  # 73 were measured, 147 as a hash table
    letters = F.translate(F.conv(F.col("id").cast("string"), 10, 20), "0123456789", "klmnopqrst")
    dictionary = spark.range(2_100_000).select(F.lower(letters).alias("word"), F.lit(5).alias("freq"), F.lit("").alias("tag"))
    texts = spark.createDataFrame([("lkab", ["lkab"]), ("bbbbbbxy", ["b" * 5, "b", "x", "y"])], "run string, want array<string>")
    out = S.segmented(texts, dictionary, "run")
    assert [r["tokens"] for r in out.where("run = 'lkab'").collect()] == [["lkab"]] and all("".join(r["tokens"]) == r["run"] for r in out.collect())
    out.explain()
    assert "Join" not in capsys.readouterr().out


def test_large_alphabets_and_white_space_as_one_by_one(monkeypatch):
    rng = random.Random(8)
    for alphabet in ("abé", "".join(map(chr, range(0x4E00, 0x4E46))) + "ab𝒳", "".join(map(chr, range(0x4E00, 0x6000)))):
        for few, chunk in ((0, 50), (100, 1 << 17)):
            monkeypatch.setattr(S, "FEW", few)
            monkeypatch.setattr(S, "CHUNK", chunk)
            words = {"".join(rng.choice(alphabet) for _ in range(rng.choice([1, 1, 2, 2, 3, 12]))): rng.randint(-13, 3) for _ in range(300)}
            held = list(words)
            runs = ["".join(rng.choices(held, k=rng.randint(0, 9)) + rng.choices(alphabet + "d", k=rng.randint(0, 3))) for _ in range(40)]
            texts = [" ".join(rng.choices(runs, k=rng.randint(0, 4))) + rng.choice(["", " ", "　", " \n"]) for _ in range(30)] + [None, "", " "]
            assert S.in_chunks(texts, S.Words(words)) == [[w for r in (t or "").split() for w in S.divide(r, words)] for t in texts]


def test_words_of_documents_are_not_shuffled_but_those_of_repeated_ids(spark, tmp_path, monkeypatch, capsys):
    def search(rows):
        at = str(tmp_path / str(len(rows)))
        spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(1, "Old dog. Cat, new fish"), (2, None), (3, "tree tree")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        kept = {}

        def written(df, name):
            df.explain()
            plan = capsys.readouterr().out
            df = df.localCheckpoint()
            kept[name] = (plan, df)
            return df

        monkeypatch.setattr(segments, "written", written)
        found = [tuple(r) for r in segments.segmented_bm25(spark, at).collect()]
        return found, {k: (plan, sorted(((r[0], sorted(r["text"].split())) for r in df.collect()), key=str)) for k, (plan, df) in kept.items() if k != "dictionary"}

    rows = [(1, "The old dog. The cat\nand a fish", "en"), (2, "new fish, new dog; the tree", "en"), (3, "12 ... !", "en"), (4, None, None), (5, "old dog the cat a fish new tree and", "en")]
    found, tables = search(rows)
    assert found and all("Exchange" not in plan for plan, _ in tables.values()) and [i for i, _ in tables["doc_id"][1]] == [1, 2, 5] and [i for i, _ in tables["item_id"][1]] == [1, 3]
    again, more = search([*rows, (1, "new tree", "en"), (3, "...", "en"), (None, "cat", "en"), (None, "dog", "en")])
    texts = dict(more["doc_id"][1])
    assert again and sorted(texts, key=str) == [1, 2, 5, None] and texts[1] == sorted([*dict(tables["doc_id"][1])[1], "new", "tree"]) and texts[None] == ["cat", "dog"]
