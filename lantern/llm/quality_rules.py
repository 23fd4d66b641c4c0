"""Quality rules with risk-controlled thresholds. DataFrame functions only.

``measures`` counts, for each text, what the rules look at. ``calibrate`` chooses, in each stratum, one cutoff for each rule (or
none) from labelled holdouts, all of them together: a choice is allowed only if an exact binomial test shows, at level ``delta``
divided by the number of all choices in all strata (Bonferroni), that the documents which fail any of its rules are less than
``risk`` of the good ones; that is, if the Clopper-Pearson upper bound of its false rejections is at most ``risk``. So the
guarantee holds for the verdict. Of the allowed choices the one with the best difference between the shares of bad and good
documents rejected is taken; a stratum without one that gains something rejects nothing. ``judge`` applies the base rule and the
cutoffs.

Good documents are labelled of quality 1 and not toxic, all other labelled ones are bad. A null or empty text has no words and
fails the base rule. A null stratum is a stratum. Repeated rows are judged alike; a document that is labelled twice counts twice.
Without labels only the base rule rejects. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lantern.llm.common import WORD, stored

#: Rule: (its measure, cutoffs in rising order). A document fails where the measure is above the cutoff.
RULES = {
    "symbols": ("try_divide(n_symbols, n_words)", (0.01, 0.03, 0.1, 0.3)),
    "dup_lines": ("try_divide(n_dup_lines, n_lines)", (0.05, 0.1, 0.2, 0.3, 0.5)),
    "repeats": ("try_divide(n_repeat_words, n_words)", (0.05, 0.1, 0.2, 0.3, 0.4)),
    "long_words": ("try_divide(word_chars, n_words)", (6.0, 7.0, 8.0, 10.0, 12.0)),
    "short_words": ("-try_divide(word_chars, n_words)", (-4.0, -3.0, -2.5, -2.0)),
}
RISK, DELTA = 0.02, 0.05


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, ``keep`` and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long)."""
    text = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    a = text.select("doc_id", *keep, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), F.expr("regexp_count(text, '[#*$%&|<>]')").alias("n_symbols"), lines.alias("lines"))
    n = F.size("words")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at("words", i), F.element_at("words", i + 1), F.element_at("words", i + 2))))
    b = a.select(
        "doc_id", *keep, n.alias("n_words"), F.length(F.array_join("words", "")).alias("word_chars"), "n_symbols",
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), windows.alias("w"),
    )
    # positions of each window that occurs twice or more, in rising order: only for texts that have one
    pairs = F.when(F.size(F.array_distinct("w")) < F.size("w"), F.sort_array(F.transform("w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    c = b.withColumn("pairs", pairs).drop("w")
    same = lambda k, x: F.coalesce(F.get("pairs", k)["h"] == x["h"], F.lit(False))
    twice = F.sort_array(F.transform(F.filter("pairs", lambda x, k: same(k - 1, x) | same(k + 1, x)), lambda x: x["i"]))
    d = c.withColumn("at", twice).drop("pairs")
    covered = F.aggregate(F.transform("at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - p, F.lit(3)))), F.lit(0), lambda s, x: s + x)
    long = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")]
    # written, since a filter on the counts would else be pushed down with all of this inlined
    return stored(d.select("doc_id", *keep, *long, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")), "measures")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed term by term in logarithms."""
    ratio = F.log(F.lit(p / (1 - p)))
    zero = n * F.log(F.lit(1 - p))

    def add(acc, j):
        term = acc["term"] + F.log((n - j + 1) / j) + ratio
        top = F.greatest(acc["sum"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(F.least(acc["sum"], term) - top))).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.aggregate(steps, F.struct(zero.alias("term"), zero.alias("sum")), add, lambda acc: F.exp(acc["sum"]))


def _most(n: Column, level: Column, p: float) -> Column:
    """The largest k with P(X <= k) <= level for X ~ Binomial(n, p), -1 if there is none."""
    ratio = F.log(F.lit(p / (1 - p)))
    zero = n * F.log(F.lit(1 - p))
    log = F.log(level)

    def add(acc, j):
        term = acc["term"] + F.log((n - j + 1) / j) + ratio
        top = F.greatest(acc["sum"], term)
        total = top + F.log1p(F.exp(F.least(acc["sum"], term) - top))
        return F.struct(term.alias("term"), total.alias("sum"), F.when(total <= log, j).otherwise(acc["k"]).alias("k"))

    none = F.when(zero <= log, F.lit(0)).otherwise(F.lit(-1)).cast("long")
    mean = F.floor(n * p).cast("long")  # beyond the mean the tail is no small one
    steps = F.when(mean >= 1, F.sequence(F.lit(1).cast("long"), mean)).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.aggregate(steps, F.struct(zero.alias("term"), zero.alias("sum"), none.alias("k")), add, lambda acc: acc["k"])


def calibrate(measured: DataFrame, labels: DataFrame, stratum: str, rules=RULES, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_rejected, bound): of all rules together n_rejected good documents fail one, and bound is the
    probability of so few at the risk.

    Documents are counted by how many cutoffs of each rule they exceed, which makes a table of bounded size. Choices are the
    combinations of one cutoff or none for each rule; those that keep a document are the ones above its own counts.
    """
    toxic = F.coalesce("toxic", F.lit(0)) if "toxic" in labels.columns else F.lit(0)
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("labelled"), ((F.col("quality") == 1) & (toxic == 0)).cast("int").alias("good"))
    held = measured.where(~base_failed()).join(known, F.col("doc_id") == F.col("labelled"))
    names, depth = list(rules), {name: len(cutoffs) for name, (_, cutoffs) in rules.items()}
    above = [sum((F.coalesce(F.expr(measure) > c, F.lit(False)).cast("int") for c in cutoffs), F.lit(0)).alias(name) for name, (measure, cutoffs) in rules.items()]
    cells = held.select(F.col(stratum).alias("stratum"), "good", *above).groupBy("stratum", *names).agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    cells = stored(cells, "cells")
    kept = cells  # choice j of a rule rejects documents above j - 1 of its cutoffs; the last one rejects none
    for name in names:
        kept = kept.withColumn(name, F.explode(F.sequence(F.col(name) + 1, F.lit(depth[name] + 1))))
    kept = kept.groupBy(F.col("stratum").alias("of"), *names).agg(F.sum("good").alias("kept_good"), F.sum("bad").alias("kept_bad"))
    choices = 1
    for name in names:
        choices *= depth[name] + 1
    totals = cells.groupBy("stratum").agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"))
    level = F.lit(delta) / (F.count("*").over(Window.partitionBy()) * choices)  # a row for each stratum
    totals = totals.withColumn("level", level).withColumn("most", _most(F.col("n_good"), F.col("level"), risk))
    tried = kept.join(totals, F.col("of").eqNullSafe(F.col("stratum"))).withColumn("n_rejected", F.col("n_good") - F.col("kept_good"))
    gain = F.coalesce(F.try_divide(F.col("n_bad") - F.col("kept_bad"), "n_bad"), F.lit(0.0)) - F.coalesce(F.try_divide("n_rejected", "n_good"), F.lit(0.0))
    allowed = tried.withColumn("gain", gain).where("n_rejected <= most and gain > 0")
    lenient = sum((F.col(n) for n in names), F.lit(0))
    best = Window.partitionBy("stratum").orderBy(F.col("gain").desc(), lenient.desc(), *names)
    best = allowed.withColumn("place", F.row_number().over(best)).where("place = 1").withColumn("bound", binomial_tail(F.col("n_good"), F.col("n_rejected"), risk))
    chosen = [F.struct(F.lit(name).alias("rule"), F.get(F.array(*(F.lit(float(c)) for c in rules[name][1])), F.col(name) - 1).alias("cutoff")) for name in names]
    return best.select("stratum", F.explode(F.array(*chosen)).alias("c"), "n_good", "n_rejected", "bound").where("c.cutoff is not null").select("stratum", "c.rule", "c.cutoff", "n_good", "n_rejected", "bound")


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str, rules=RULES) -> DataFrame:
    """measured with base_failed, failed (names of the rules that fail) and kept."""
    by = cutoffs.groupBy(F.col("stratum").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cut"))
    joined = measured.join(by, F.col(stratum).eqNullSafe(F.col("of")), "left")
    fails = F.array_compact(F.array(*(F.when(F.coalesce(F.expr(m) > F.try_element_at("cut", F.lit(name)), F.lit(False)), F.lit(name)) for name, (m, _) in rules.items())))
    return joined.withColumn("base_failed", base_failed()).withColumn("failed", fails).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("of", "cut")


def apply(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Cutoffs and verdicts are made from one written table of measures."""
    measured = measures(docs, stratum)
    return judge(measured, calibrate(measured, labels, stratum), stratum)
