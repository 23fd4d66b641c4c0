"""Secret scans, decontamination, substring dedup, quality rules against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict
from math import comb

import pytest
from pyspark.sql import functions as F

from lantern.llm import decontamination, quality_rules, secret_scan, substring_dedup
from lantern.llm.automaton import SuffixAutomaton

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def many(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def plain_secrets(text):
    text, found = text or "", []
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    found += [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_secrets_as_plain_matching(docs, rows):
    got = secret_scan.digest(secret_scan.scan(docs))
    want = []
    for doc, text, *_ in rows:
        found = plain_secrets(text)
        n = Counter(x[3] for x in found)
        want.append((doc, n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in found))))
    assert many(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want, key=repr)
    assert sum(w[1] + w[2] + w[3] for w in want) >= 7
    assert any("pem:" in r["spans"] and "bearer:" in r["spans"] for r in got.collect())


def test_secrets_over_the_given_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r["base_sha256"] for r in secret_scan.digest(secret_scan.scan(docs)).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in plain_secrets(r["text"])))


def test_trigram_queries():
    q = secret_scan.trigram_query
    assert q("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert q("[0-9a-f]{32,}") == [frozenset()]
    assert set(q("(?:passwd|api_?key)x")) == {frozenset({"pas", "ass", "ssw", "swd", "wdx"}), frozenset({"api", "pi_", "i_k", "_ke", "key", "eyx"}), frozenset({"api", "pik", "ike", "key", "eyx"})}
    assert q("ab(?:cd)*ef") == [frozenset()] and q("abc.*def") == [frozenset({"abc", "def"})]


def test_secrets_of_an_empty_table_and_clashing_columns(empty, docs):
    assert secret_scan.scan(empty).count() == 0
    assert secret_scan.scan(docs.withColumn("rules", F.lit(1)).withColumn("spans", F.lit(2))).count() == docs.count()


def test_automaton_finds_every_run():
    import random

    rng = random.Random(1)
    texts = [[rng.randrange(3) for _ in range(rng.randint(1, 25))] for _ in range(12)]
    machine = SuffixAutomaton()
    for owner, t in enumerate(texts):
        machine.add(t, owner)
    machine.finish()
    query = [rng.randrange(4) for _ in range(300)]
    for i, (state, n) in enumerate(machine.matching(query), 1):
        holds = lambda k: [o for o, t in enumerate(texts) if any(t[j : j + k] == query[i - k : i] for j in range(len(t) - k + 1))]
        assert n == max((k for k in range(1, i + 1) if holds(k)), default=0) if i < 40 else True
        for k in range(1, n + 1):
            assert machine.holder(state, k) == min(holds(k))


def plain_hits(text, items, n=10):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = low(text), set(), set()
    for item, t in items:
        w = low(t)
        m = min(n, len(w))
        for g in {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else ():
            for p in range(len(words) - m + 1):
                if tuple(words[p : p + m]) == g:
                    hit.update(range(p, p + m))
                    found.add(str(item))
    return len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


@pytest.fixture(scope="module")
def items(rows):
    long = [r[1] for r in rows if r[1] and len(r[1].split()) > 80]
    return [(1, " ".join(long[0].split()[5:40]).upper()), (2, "ONE-two"), (10, "three"), (3, " ".join(long[2].split()[:9])), (4, None), (5, "!?"), (6, " ".join(long[3].split()[7:18])), (None, "漢字 🎉🎉")]


@pytest.mark.parametrize("shard_words", [1_000_000, 5])
def test_hits_as_plain_search(spark, docs, rows, items, shard_words):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.digest(decontamination.hits(docs, bench, shard_words=shard_words))
    named = [("null" if i is None else i, t) for i, t in items]
    want = [(r[0], *plain_hits(r[1], named)) for r in rows]
    assert many(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)
    assert sum(w[5] for w in want) >= 5


def test_cut_and_drop(spark, docs, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    named = [(i, t) for i, t in items]
    clean = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs, bench).collect()}
    assert clean == {r[0]: r[1] for r in rows if not plain_hits(r[1], named)[4]}
    cut = decontamination.decontaminate(docs, bench, coverage_limit=0.9)
    assert cut.columns == docs.columns
    for r in cut.collect():
        assert plain_hits(r["text"], [x for x in named if x[0] in (1, 6)])[1] == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == len(rows)


def plain_dedup(rows, window=50):
    words = [(d, WORD.findall(t or "")) for d, t, *_ in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(d, first.get(g, d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=repr)


def test_substring_dedup_as_plain_search(docs, rows, monkeypatch):
    names = ("doc_id", "n_words", "n_removed", "kept_sha256")
    want = plain_dedup(rows)
    assert sum(w[2] > 0 for w in want) > 12
    assert many(substring_dedup.dedup(docs).dropDuplicates(["doc_id"]), *names) == sorted(set(want), key=repr)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 150)
    monkeypatch.setattr(substring_dedup, "TASK_WORDS", 200)
    assert many(substring_dedup.dedup(docs), *names) == want


def test_substring_dedup_short_window_and_empty(docs, rows, empty):
    names = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert many(substring_dedup.dedup(docs, window=12, gram=5), *names) == plain_dedup(rows, 12)
    assert substring_dedup.dedup(empty).count() == 0


def plain_measures(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_as_plain_counts(docs, rows, spark, sf):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert many(quality_rules.measures(docs), *names) == sorted(((r[0], *plain_measures(r[1])) for r in rows), key=repr)
    given = spark.read.parquet(f"{sf}/documents.parquet")
    assert many(quality_rules.measures(given), *names) == sorted(((r["doc_id"], *plain_measures(r["text"])) for r in given.collect()), key=repr)


def test_binomial_tail(spark):
    cases = [(10, 0), (10, 3), (200, 1), (200, 9), (5000, 60), (90_000, 1500), (0, 0)]
    got = [r[0] for r in spark.createDataFrame(cases, "n long, k long").select(quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.02)).collect()]
    from fractions import Fraction

    for (n, k), g in zip(cases, got, strict=True):
        if n <= 5000:
            p = Fraction(2, 100)
            assert g == pytest.approx(float(sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))), rel=1e-6)
        assert 0 <= g <= 1 + 1e-9


def test_cutoffs_hold_the_risk(spark):
    """Good texts never have symbols, bad ones do; long words say nothing."""
    rows, labels = [], []
    for i in range(3000):
        good, stratum = i % 3 > 0, "few" if i % 60 == 0 else "many"
        w = [f"w{(i * 7 + j * j) % 977}x{j}" for j in range(60)]
        rows.append((i, " ".join(w) + ("" if good else " ### $$$ &&&" * 4), stratum))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame([*rows, (9999, None, None), (10_000, "", "many")], "doc_id long, text string, lang string")
    known = spark.createDataFrame([*labels, (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    measured = quality_rules.measures(docs, "lang")
    cut = {(r["stratum"], r["rule"]): r for r in quality_rules.calibrate(measured, known, "lang").collect()}
    assert set(cut) == {("many", "symbols")} or ("many", "symbols") in cut
    assert not any(s == "few" for s, _ in cut)
    tests = 2 * sum(len(c) for _, c in quality_rules.RULES.values())
    for r in cut.values():
        assert r["bound"] <= quality_rules.DELTA / tests and r["n_rejected"] < quality_rules.RISK * r["n_good"]
    judged = {r["doc_id"]: r for r in quality_rules.apply(docs, known).collect()}
    assert all(judged[i]["kept"] for i, q, _ in labels if q)
    assert not any(judged[i]["kept"] for i, q, _ in labels if not q and rows[i][2] == "many")
    assert judged[9999]["base_failed"] and judged[10_000]["n_words"] == 0 and not judged[10_000]["kept"]
    assert all(r["kept"] != r["base_failed"] for r in quality_rules.apply(docs, known.limit(0)).collect())
