"""Quality classifier with hierarchical empirical Bayes.

``fit`` learns two logistic models (good quality, toxic) from labelled documents, at most ``SAMPLE`` of them, those with the
smallest hashes; this is the only bounded part. Features are shares of characters and words, and the words of a lexicon that
the labels themselves tell apart (by a z-score of document frequencies). ``score`` gives each document's evidence.

``posteriors`` adds the evidence up by path and by host, both over all documents. A host's rate of good documents is shrunk
towards the global one and a path's towards its host's, each by a strength that the spread between sites shows (method of
moments), so that sparse sites stay near the prior. ``judge`` combines the two by Bayes' rule: a document's log-odds less the global
ones are its likelihood ratio, and its path's posterior log-odds are the prior. It is kept if it is likely good and not likely toxic.

A null or empty text has no evidence but the models' constants. A null host or path is a site of its own. With labels of one kind
only, the model is the constant that they show; with none, everything is kept. Extra columns are kept and may not start with ``q_``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lantern.llm.common import slices, stored

SAMPLE, LEXICON, LEAST_Z = 20_000, 200, 6.0
_WORD = re.compile(r"[^\W\d_]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]")


@dataclass
class Model:
    lexicon: dict[str, int] = field(default_factory=dict)
    mean: np.ndarray = None
    spread: np.ndarray = None
    good: np.ndarray = None
    toxic: np.ndarray = None


def shape(text: str) -> list[float]:
    """Shares that tell junk from prose."""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        np.log1p(len(words)), len("".join(words)) / n, np.log1p(100 * len(_SYMBOLS.findall(text)) / n), np.log1p(100 * text.count("!") / n),
        sum(w.isupper() and len(w) > 1 for w in words) / n, 1 - len(set(words)) / n, sum(map(str.isdigit, text)) / chars, 1 - len(set(lines)) / max(1, len(lines)),
    ]


def _features(texts: list[str], lexicon: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(texts), 8 + len(lexicon)))
    for row, text in zip(x, texts, strict=True):
        row[:8] = shape(text)
        for w in {*_WORD.findall(text.lower())} & lexicon.keys():
            row[8 + lexicon[w]] = 1
    return x


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (constant first) by Newton's method with a ridge; rows are taken in pieces, so that the driver holds them once."""
    k = x.shape[1] + 1
    w, ridge = np.zeros(k), np.eye(k)
    ridge[0, 0] = 1e-3
    for _ in range(25):
        first, second = -ridge @ w, ridge.copy()
        for i in range(0, len(x), 1000):
            part = np.column_stack([np.ones(len(x[i : i + 1000])), x[i : i + 1000]])
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            second += (part * (p * (1 - p))[:, None]).T @ part
            first += part.T @ (y[i : i + 1000] - p)
        step = np.linalg.solve(second, first)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("of")).agg(F.max("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    known = known.orderBy(F.xxhash64("of"), "of").limit(sample)
    # the limit bounds what is broadcast; of rows that share a labelled doc_id one text is fitted on, so ``sample`` bounds the rows too
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("of"))
    joined = texts.groupBy("doc_id", "quality", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).persist()
    kinds = ["quality", "toxic"]
    words = joined.select(*kinds, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0)))).alias("word"))
    total = joined.agg(F.count("*").alias("n"), *(F.sum(k).alias(k) for k in kinds)).first()
    n, model = total["n"], Model()
    if not n:
        joined.unpersist()
        return model
    scores = []
    for k in kinds:  # difference of two shares over its standard error
        a, b = F.sum(k), F.count("*") - F.sum(k)
        one, zero = max(1, total[k]), max(1, n - total[k])
        p = F.count("*") / n
        scores.append(F.abs(a / one - b / zero) / F.sqrt(p * (1 - p) * (1 / one + 1 / zero) + 1e-12))
    ranked = words.groupBy("word").agg(F.count("*").alias("held"), F.greatest(*scores).alias("z")).where((F.col("held") >= 4) & (F.col("z") >= LEAST_Z)).orderBy(F.col("z").desc(), "word").limit(LEXICON)
    model.lexicon = {r["word"]: i for i, r in enumerate(ranked.collect())}
    lexicon = model.lexicon

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                x = _features(part.column(0).to_pylist(), lexicon).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), part.column(1), part.column(2)], ["x", "quality", "toxic"])

    rows = joined.select("text", F.col("quality").cast("int"), F.col("toxic").cast("int")).mapInArrow(run, "x binary, quality int, toxic int").collect()  # at most ``sample``
    joined.unpersist()
    rows.sort(key=lambda r: (bytes(r["x"]), r["quality"], r["toxic"]))
    good, toxic = (np.array([float(r[k] == 1) for r in rows]) for k in kinds)
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(len(rows), -1)
    del rows
    model.mean = x.mean(0, dtype=float)
    model.spread = x.std(0, dtype=float) + 1e-3
    x = ((x - model.mean.astype(np.float32)) / model.spread.astype(np.float32)).astype(np.float32)
    model.good, model.toxic = _logistic(x, good), _logistic(x, toxic)
    return model


def score(docs: DataFrame, model: Model, *columns: str) -> DataFrame:
    """docs, or these columns of them, with q_good and q_toxic, log-odds from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = columns or tuple(docs.columns)
    docs = docs.select(*columns, *(["text"] if "text" not in columns else []))
    at = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in slices(batch):
                odds = [np.full(part.num_rows, 3.0), np.full(part.num_rows, -3.0)]
                if m.good is not None:
                    x = (_features([t or "" for t in part.column(at).to_pylist()], m.lexicon) - m.mean) / m.spread
                    odds = [w[0] + x @ w[1:] for w in (m.good, m.toxic)]
                kept = part.select(columns)
                yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(np.clip(o, -30, 30), pa.float64()) for o in odds)], [*columns, "q_good", "q_toxic"])

    fields = [docs.schema[c] for c in columns]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("q_good", T.DoubleType()), T.StructField("q_toxic", T.DoubleType())]))


def _probability(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def _odds(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _strength(mean: Column, between: Column) -> Column:
    """Pseudo-counts of the prior: large where sites hardly differ, 1 to 10,000."""
    return F.greatest(F.lit(1.0), F.least(F.lit(1e4), mean * (1 - mean) / F.greatest(between, F.lit(1e-9)) - 1))


def posteriors(scored: DataFrame, host: str, path: str) -> DataFrame:
    """host, path, host_rate, path_rate, global_rate of good documents."""
    p = _probability(F.col("q_good"))
    paths = scored.groupBy(F.col(host).alias("q_host"), F.col(path).alias("q_path")).agg(F.count("*").alias("n"), F.sum(p).alias("s"))
    hosts = paths.groupBy("q_host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    spread = lambda n, s, mean: F.greatest(F.lit(0.0), F.sum(n * (s / n - mean) * (s / n - mean)) / F.sum(n) - mean * (1 - mean) * F.count("*") / F.sum(n))
    overall = hosts.agg((F.sum("host_s") / F.sum("host_n")).alias("mu"))
    overall = hosts.join(F.broadcast(overall)).groupBy("mu").agg(spread(F.col("host_n"), F.col("host_s"), F.col("mu")).alias("between"))  # one row
    mu = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("mu")))
    k = _strength(mu, F.col("between"))
    rated = hosts.join(F.broadcast(overall)).select(F.col("q_host").alias("h"), mu.alias("global_rate"), ((F.col("host_s") + k * mu) / (F.col("host_n") + k)).alias("host_rate"))
    joined = paths.join(rated, paths["q_host"].eqNullSafe(F.col("h"))).drop("h")
    inside = joined.groupBy().agg((F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("host_rate"), 2)) / F.sum("n") - F.avg(F.col("host_rate") * (1 - F.col("host_rate"))) * F.count("*") / F.sum("n")).alias("within"))
    k = _strength(F.col("host_rate"), F.col("within"))
    return joined.join(F.broadcast(inside)).select("q_host", "q_path", "global_rate", "host_rate", ((F.col("s") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate"))


def judge(scored: DataFrame, rates: DataFrame, host: str, path: str) -> DataFrame:
    """scored with q_host_rate, q_path_rate, q_odds and q_kept."""
    r = rates.select("q_host", "q_path", F.col("global_rate").alias("q_global"), F.col("host_rate").alias("q_host_rate"), F.col("path_rate").alias("q_path_rate"))
    joined = scored.join(r, F.col(host).eqNullSafe(F.col("q_host")) & F.col(path).eqNullSafe(F.col("q_path")), "left")
    joined = joined.withColumn("q_odds", F.col("q_good") - _odds(F.col("q_global")) + _odds(F.col("q_path_rate")))
    return joined.withColumn("q_kept", (F.col("q_odds") >= 0) & (F.col("q_toxic") < 0)).drop("q_host", "q_path", "q_global")


def classify(docs: DataFrame, labels: DataFrame, *columns: str, host: str = "source", path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """docs, or these columns, with q_good, q_toxic, q_host_rate, q_path_rate, q_odds, q_kept.

    Scores are written once, beside the columns asked for, and serve the rates and the verdicts. Where texts are asked for, only the
    sites' scores are written and the texts are scored again, since to write all of them would cost as much disk as the input.
    """
    model = fit(docs, labels, sample)
    columns = columns or tuple(docs.columns)
    small = [c for c in columns if c != "text"] if "text" not in columns else []
    scored = stored(score(docs, model, *dict.fromkeys([*small, host, path])), "scores")
    rates = stored(posteriors(scored, host, path), "rates")
    verdicts = judge(score(docs, model, *dict.fromkeys([*columns, host, path])) if "text" in columns else scored, rates, host, path)
    return verdicts.select(*columns, "q_good", "q_toxic", "q_host_rate", "q_path_rate", "q_odds", "q_kept")
