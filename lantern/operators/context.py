"""What goes to a reader: budgeted contexts, citations of sentences, packed tables, nearest captions, headings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lantern.functions import text as T
from lantern.operators.lexical import by_id
from lantern.operators.matching import matches
from lantern.sources.shared import written


def budgeted(df: DataFrame, by: str, order: list[Column], text: str, most: int, each: int, total: int, sep: str = "\n") -> DataFrame:
    """by, context, parts: the first ``most`` texts of a group, each cut to ``each`` characters, while they fit in ``total``.

    A row_number filter comes first, so that a group's task holds few rows. Null texts count as empty and are left out.
    """
    w = Window.partitionBy(by).orderBy(*order)
    first = df.where(F.length(text) > 0).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    cut = first.select(by, "_n", F.left(F.col(text), F.lit(each)).alias("_t"))
    running = F.sum(F.length("_t")).over(Window.partitionBy(by).orderBy("_n"))
    kept = cut.withColumn("_sum", running).where(F.col("_sum") <= total)
    rows = kept.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("_n", "_t"))).alias("_r"))
    return rows.select(by, F.array_join(F.transform("_r", lambda x: x["_t"]), sep).alias("context"), F.size("_r").cast("long").alias("parts"))


def cite(pairs: DataFrame, answer: str, sentence: str, doc: str, similarity: str, levels: tuple = (0.63, 0.504, 0.4032, 0.32256), most: int = 4) -> DataFrame:
    """answer, sentence, doc, similarity: what each sentence cites.

    An answer takes the highest level that its best sentence reaches; each sentence at or above it cites the documents within a
    hundredth of its own best, ``most`` at most, as the feature asks.
    """
    best = F.round(F.max(similarity).over(Window.partitionBy(answer, sentence)) * 0.99, 9)
    rows = pairs.withColumn("_best", best)
    top = F.max("_best").over(Window.partitionBy(answer))
    level = F.coalesce(*(F.when(top >= x, F.lit(x)) for x in levels))
    rows = rows.withColumn("_level", level).where((F.col("_best") >= F.col("_level")) & (F.col(similarity) > F.col("_best")))
    w = Window.partitionBy(answer, sentence).orderBy(F.round(similarity, 9).desc(), doc)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).select(answer, sentence, doc, similarity)


def html_tables(rows: DataFrame, by: str, order: str, cells: list[str], size: int) -> DataFrame:
    """by, part, html, n: every ``size`` rows of a group as one HTML table."""
    number = F.row_number().over(Window.partitionBy(by).orderBy(order))
    row = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("</td>")) for c in cells), F.lit("</tr>"))
    parts = rows.select(by, number.alias("_n"), row.alias("_row")).withColumn("part", F.floor((F.col("_n") - 1) / size))
    joined = parts.groupBy(by, "part").agg(F.sort_array(F.collect_list(F.struct("_n", "_row"))).alias("_r"))
    html = F.concat(F.lit("<table>"), F.array_join(F.transform("_r", lambda x: x["_row"]), ""), F.lit("</table>"))
    return joined.select(by, "part", html.alias("html"), F.size("_r").cast("long").alias("n"))


def nearest(captions: DataFrame, targets: DataFrame, page: str, caption: str, target: str, kind: str, preferred: str) -> DataFrame:
    """page, caption, target, kind: the target nearest to each caption; at equal distance the ``preferred`` kind loses, then ids decide.

    An equi-join on the page, which holds few boxes.
    """
    right = targets.select(page, target, kind, F.col("x0").alias("_x"), F.col("top").alias("_y"))
    squared = F.pow(F.col("x0") - F.col("_x"), 2) + F.pow(F.col("top") - F.col("_y"), 2)
    key = F.struct(squared.alias("d"), (F.col(kind) == preferred).alias("p"), F.col(target).alias("t"), F.col(kind).alias("k"))
    best = captions.join(right, page).groupBy(page, caption).agg(F.min(key).alias("_b"))
    return best.select(page, caption, F.col("_b.t").alias(target), F.col("_b.k").alias(kind))


def heading_paths(lines: DataFrame, doc: str, pos: str, level: str, name: str, depth: int) -> DataFrame:
    """Adds path: the headings above a line, joined by ' > '. A heading closes those of its own and deeper levels."""
    before = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    lasts = {k: F.max(F.when(F.col(level) == k, F.struct(F.col(pos).alias("p"), F.col(name).cast("string").alias("h")))).over(before) for k in range(1, depth)}
    df = lines
    for k, c in lasts.items():
        df = df.withColumn(f"_h{k}", c)
    parts = []
    for k in lasts:
        alive = F.col(f"_h{k}").isNotNull() & (F.col(level) > k)
        for shallower in range(1, k):
            alive &= F.col(f"_h{shallower}").isNull() | (F.col(f"_h{shallower}.p") < F.col(f"_h{k}.p"))
        parts.append(F.when(alive, F.col(f"_h{k}.h")))
    return df.withColumn("path", F.concat_ws(" > ", *parts)).drop(*(f"_h{k}" for k in lasts))


def term_weights(queries: DataFrame, docs: DataFrame, qid: str, id: str, text: str = "text") -> DataFrame:
    """qid, term, weight: a query's terms, weighted by corpus frequency and document frequency, summing to 1.

    Statistics are over all documents; terms that no document has count as frequency 0.
    """
    tf = docs.select(id, F.explode(T.tokens(F.col(text))).alias("term")).groupBy(id, "term").agg(F.count("*").alias("tf"))
    stats = tf.groupBy("term").agg(F.sum("tf").alias("freq"), F.count("*").alias("df"))
    idf = lambda c, n: F.log10(10 + (n - F.coalesce(c, F.lit(0)) + 0.5) / (F.coalesce(c, F.lit(0)) + 0.5))
    asked = queries.select(qid, F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("term")).join(stats, "term", "left")
    raw = asked.select(qid, "term", (0.3 * idf(F.col("freq"), 1e7) + 0.7 * idf(F.col("df"), 1e9)).alias("raw"))
    return raw.select(qid, "term", (F.col("raw") / F.sum("raw").over(Window.partitionBy(qid))).alias("weight"))


def field_search(queries: DataFrame, docs: DataFrame, qid: str, id: str, boosts: dict[str, float], share: float = 0.3, text: str = "text") -> DataFrame:
    """qid, id, score: best field of a document, where a field scores its boost times the presence idf of the query's terms it has.

    A document needs ``share`` of the query's terms in one field. Each task adds up its documents' scores; the idf is in [0, 1].
    """
    held = docs.select(id, *(F.array_distinct(T.tokens(F.col(name))).alias(name) for name in boosts))
    fields = lambda rows: rows.select(id, F.explode(F.array(*(F.struct(F.lit(name).alias("field"), F.col(name).alias("terms")) for name in boosts))).alias("f"))
    long = lambda rows: fields(rows).select(id, "f.field", F.explode("f.terms").alias("term"))
    n = docs.agg(F.count("*").alias("n"))  # one row
    df = long(held).groupBy("field", "term").agg(F.count("*").alias("df")).join(F.broadcast(n))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) / F.log(1 + (F.col("n") - 0.5) / 1.5)
    boost = F.coalesce(*(F.when(F.col("field") == name, F.lit(float(x))) for name, x in boosts.items()))
    asked = queries.select(qid, F.array_distinct(T.tokens(F.col(text))).alias("_q")).select(qid, (share * F.size("_q")).alias("least"), F.explode("_q").alias("term"))
    asked = written(asked.join(df, "term").select(qid, "field", "term", (boost * idf).alias("weight"), "least"), "asked")
    single, several = by_id(held, id)
    found = [matches(single.select(id, F.col(name).alias("tokens")), asked.where(F.col("field") == name), id, qid).select(qid, id, "score") for name in boosts]
    if several is not None:
        hits = asked.join(long(several), ["field", "term"]).groupBy(qid, id, "field", "least").agg(F.count("*").alias("shared"), F.sum("weight").alias("score"))
        found.append(hits.where("shared >= least").select(qid, id, "score"))
    return reduce(DataFrame.unionByName, found).groupBy(qid, id).agg(F.max("score").alias("score"))
