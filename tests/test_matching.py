import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lantern.operators import context, lexical, matching

RNG = random.Random(7)
WORDS = [f"w{i}" for i in range(12)]
QUERIES = [(i, " ".join(RNG.choice(WORDS) for _ in range(RNG.randint(1, 6)))) for i in range(9)] + [(20, ""), (21, "nowhere")]
DOCS = [(i, " ".join(RNG.choice(WORDS[:10]) for _ in range(RNG.randint(0, 8)))) for i in range(150)] + [(200, None), (7, "w1 w2 w2"), (7, "w3 w2 w4")]


def plain_bm25(k=5):
    sizes = [len((t or "").split()) for _, t in DOCS]
    mean, n = sum(sizes) / len(DOCS), len(DOCS)
    df = Counter(w for _, t in DOCS for w in set((t or "").split()))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    out = []
    for q, text in QUERIES:
        held = Counter()
        for i, t in DOCS:
            for w in (t or "").split():
                held[i, len((t or "").split()), w] += 1
        scores = Counter()
        for (i, size, w), tf in held.items():
            if w in text.split():
                scores[i] += text.split().count(w) * (low if raw[w] < 0 else raw[w]) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))
        best = sorted((-round(s, 6), i) for i, s in scores.items())[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def given(spark):
    return spark.createDataFrame(QUERIES, "q long, text string"), spark.createDataFrame(DOCS, "d long, text string").repartition(3)


@pytest.mark.parametrize("postings,rows", [(10**6, 1000), (5, 16)])
def test_best_documents_as_by_plain_search(given, monkeypatch, postings, rows):
    monkeypatch.setattr(matching, "POSTINGS", postings)
    monkeypatch.setattr(matching, "ROWS", rows)
    got = sorted((r["q"], r["rank"], r["d"], round(r["score"], 6)) for r in lexical.bm25(*given, "q", "d").collect())
    assert [g[:3] for g in got] == [w[:3] for w in plain_bm25()] and all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, plain_bm25(), strict=True))


def test_coverage_and_its_best(given):
    every = {(r["q"], r["d"]): r["hits"] for r in lexical.coverage(*given, "q", "d", 0.0).collect()}
    for q, text in QUERIES:
        want = Counter((q, i) for i, t in DOCS for w in set((t or "").split()) & set(text.split()))
        assert {k: v for k, v in every.items() if k[0] == q} == want
        best = [r["d"] for r in lexical.coverage_top(*given, "q", "d", 5).where(F.col("q") == q).orderBy("rank").collect()]
        assert best == [i for (_, i), _ in sorted(want.items(), key=lambda x: (-x[1], x[0][1]))[:5]]


def test_only_the_best_of_some_documents_leave_a_task(spark, given, monkeypatch):
    monkeypatch.setattr(matching, "ROWS", 50)
    docs = spark.range(400).coalesce(1).select(F.col("id").alias("d"), F.split(F.lit("w1 w2 w3"), " ").alias("tokens"))
    asked = spark.createDataFrame([(q, "w1", 1.0, 1) for q in range(6)], "q long, term string, weight double, least long")
    out = matching.matches(docs, asked, "d", "q", k=5)
    assert out.count() <= 6 * 5 * 400 / 50 and sorted({r["d"] for r in out.where("d < 50").collect()}) == [0, 1, 2, 3, 4]


def test_best_field_as_by_plain_search(spark, given):
    docs = given[1].withColumn("title", F.substring_index(F.coalesce("text", F.lit("")), " ", 2))
    got = {(r["q"], r["d"]): r["score"] for r in context.field_search(given[0], docs, "q", "d", {"title": 10.0, "text": 2.0}).collect()}
    fields = {"title": (10.0, lambda t: t[:2]), "text": (2.0, lambda t: t)}
    df = {f: Counter(w for _, t in DOCS for w in set(cut((t or "").split()))) for f, (_, cut) in fields.items()}
    idf = lambda c: math.log(1 + (len(DOCS) - c + 0.5) / (c + 0.5)) / math.log(1 + (len(DOCS) - 0.5) / 1.5)
    want = {}
    for q, text in QUERIES:
        for f, (boost, cut) in fields.items():
            held = {}
            for i, t in DOCS:  # rows of equal id are one document
                held.setdefault(i, []).extend(w for w in set(cut((t or "").split())) if w in set(text.split()))
            for i, words in held.items():
                if words and len(words) >= 0.3 * len(set(text.split())):
                    want[q, i] = max(want.get((q, i), 0.0), sum(boost * idf(df[f][w]) for w in words))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
