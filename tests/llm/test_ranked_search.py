import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lantern.llm import ranked_search

LETTERS = set("abcdefghijklmnopqrstuvwxyz0123456789")


def plain_terms(text) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c in LETTERS or ord(c) > 127 else " " for c in lowered).split(" ")


def plain(docs, items, k=10) -> list[tuple]:
    each = [(d[0], [t for t in plain_terms(d[1]) if t]) for d in docs]
    held = [(i, t) for i, t in each if t]
    n_docs, length = len(held), sum(len(t) for _, t in held)
    df = Counter(t for _, terms in held for t in set(terms))
    out = []
    for item, text in dict.fromkeys(items):
        asked = Counter(t for t in plain_terms(text) if t)
        scores = []
        for doc, terms in held:
            tf, m = Counter(terms), 25 + 75 * len(terms) * n_docs // length
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t, q in asked.items() if tf[t])
            if score > 0:
                scores.append((score, doc))
        scores.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(item, i + 1, doc, score) for i, (score, doc) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def found(docs, items, **more) -> list[tuple]:
    return sorted((tuple(r) for r in ranked_search.search(docs, items, **more).collect()), key=repr)


@pytest.fixture(scope="module")
def asked(rows):
    rng = random.Random(3)
    words = [w for r in rows if r[1] for w in r[1].split()]
    items = [(f"i{i}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(25)]
    return items + [("i0", "w w w w"), ("blank", " \n"), ("null", None), (None, rows[3][1]), ("same", rows[5][1]), ("same", rows[5][1]), ("none", "nothingofthis"), ("long", " ".join(words[:5000]))]


def test_all_items_as_plainly_ranked(spark, docs, rows, asked):
    items = spark.createDataFrame(asked, "item_id string, text string")
    assert found(docs, items) == plain(rows, asked)


def test_sketches_that_collide_change_nothing(spark, docs, rows, asked, monkeypatch):
    monkeypatch.setattr(ranked_search, "FIRST", 3)
    monkeypatch.setattr(ranked_search, "BATCH_TERMS", 60)
    items = spark.createDataFrame(asked, "item_id string, text string")
    narrow = ranked_search.index(docs)
    assert found(docs, items, indexed=narrow, k=2) == plain(rows, asked, 2)


def test_bounds_are_never_below_scores(rows):
    texts = [(r[1] or "").encode() for r in rows]
    held = [t for t in texts if ranked_search.terms(t)]
    length = sum(len(ranked_search.terms(t)) for t in held)
    asked = [{"query": q, "term": t, "held": 1 + q % 2, "weight": 100 + q} for q, body in enumerate(held[:20]) for t in set(ranked_search.terms(body))]
    for width in (8, 64, 1 << 16):
        batch = ranked_search._Batch(asked, len(held), length)
        for body in held:
            tf = Counter(ranked_search.terms(body))
            at = ranked_search._coordinates(tf) % width
            folded: dict = {}
            for c, t in zip(at.tolist(), tf.values(), strict=True):
                folded[c] = max(folded.get(c, 0), min(t, 255))
            if width == 1 << 16:
                import numpy as np

                places = sorted(folded)
                bound = batch.bounds([sum(tf.values())], [np.array(places, "<u2").tobytes()], [np.array([folded[p] for p in places], np.uint8).tobytes()])[0]
                assert all(b >= s for b, s in zip(bound.tolist(), batch.scores(body, list(range(20))), strict=True))


def test_copies_tie_by_id_and_repeated_rows_count(spark):
    docs = [(i, "alpha beta", None, None, None) for i in range(300, 0, -1)] + [(None, "alpha beta", None, None, None), (7, "alpha beta", None, None, None), (1000, "gamma " * 400, None, None, None), (1001, "gamma", None, None, None)]
    items = [("a", "alpha"), ("g", "gamma gamma")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(9)
    assert found(frame, spark.createDataFrame(items, "item_id string, text string")) == plain(docs, items)


def test_empty(spark, empty, docs):
    items = spark.createDataFrame([("a", "one")], "item_id string, text string")
    assert found(empty, items) == []
    assert found(docs, items.where("false")) == []


def test_clashing_columns(spark, docs, rows):
    more = docs.withColumns({c: F.lit(1) for c in ("key", "n", "places", "term", "df", "query", "score", "rank", "id")})
    items = spark.createDataFrame([("a", rows[3][1])], "item_id string, text string").withColumns({c: F.lit(1) for c in ("query", "item", "term", "weight", "doc_id")})
    assert found(more, items) == plain(rows, [("a", rows[3][1])])
