import random

import numpy as np
from pyspark.sql import functions as F

from lantern.llm import minhash, ngram_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, n) -> frozenset:
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset([tuple(w)] if 0 < len(w) < n else (tuple(w[i : i + n]) for i in range(len(w) - n + 1)))


def plain(rows, n, num, den) -> list[tuple]:
    sets = [(r[0], shingles(r[1], n)) for r in rows]
    distinct = list({s for i, s in sets if s and i is not None})
    up = list(range(len(distinct)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(distinct):
        for j in range(i):
            if den * len(x & distinct[j]) >= num * len(x | distinct[j]):
                up[top(i)] = top(j)
    at = {s: top(i) for i, s in enumerate(distinct)}
    least: dict = {}
    for i, s in sets:
        if s and i is not None:
            least[at[s]] = min(i, least.get(at[s], i))
    component = lambda i, s: None if i is None else least[at[s]] if s else i
    return sorted(((i, len(s), component(i, s), i is not None and component(i, s) == i) for i, s in sets), key=repr)


def found(docs, *how) -> list[tuple]:
    return sorted((tuple(r) for r in minhash.groups(docs, *how).collect()), key=repr)


def test_all_rows_as_plainly_linked(docs, rows):
    assert found(docs, 5, 85, 100) == plain(rows, 5, 85, 100)
    assert found(docs) == plain(rows, 5, 80, 100)


def test_near_copies_chains_and_pairs_below_the_threshold(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 5000)}"
    base, rows = [word() for _ in range(200)], []
    for i in range(120):  # a walk: neighbours are near, ends aren't
        base[rng.randrange(len(base))] = word()
        rows.append((500 - i, " ".join(base), None, None, None))
    for i in range(150):  # all near one text, few near each other
        w = base[:]
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = word()
        rows.append((1000 + i, " ".join(w), None, None, None))
    for i in range(100):  # alike at about 0.75: none links
        w = [f"x{j}" for j in range(200)]
        for _ in range(3):
            w[rng.randrange(len(w))] = word()
        rows.append((2000 + i, " ".join(w), None, None, None))
    rows += [(3000, None, None, None, None), (None, "a b c d e f", None, None, None), (3001, "a b c d e f", None, None, None), (3001, "other words under the same id here", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert found(docs, 5, 85, 100) == plain(rows, 5, 85, 100)


def test_hot_leader(spark):
    """A group of very many near copies: found whole, and no task compares them all."""
    base = [f"v{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"tail{i}"]), None, None, None) for i in range(3000)]
    got = found(spark.createDataFrame(rows, SCHEMA).repartition(8), 5, 85, 100)
    assert {r[2] for r in got} == {0} and sum(r[3] for r in got) == 1


def test_agreement_of_minima_follows_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 1000, np.uint64)
    y = np.concatenate((x[:850], rng.integers(0, 1 << 63, 150, np.uint64)))
    share = np.mean([np.mean(minhash.minima(x + np.uint64(i)) == minhash.minima(y + np.uint64(i))) for i in range(20)])
    assert abs(share - 850 / 1150) < 0.03


def test_empty_and_clashing_columns(empty, docs, rows):
    assert found(empty) == []
    more = docs.withColumns({c: F.lit(1) for c in ("key", "block", "sketch", "bands", "print", "n", "value", "kept", "component_id")})
    assert found(more, 5, 85, 100) == plain(rows, 5, 85, 100)


def test_both_joins_agree(docs):
    one = sorted((tuple(r) for r in ngram_join.groups(docs, 5, 85, 100).collect()), key=repr)
    assert [r[:3] for r in found(docs, 5, 85, 100)] == one
