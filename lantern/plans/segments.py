"""Registered queries on texts without spaces and on their dictionary, each with its SQL twin.

The given documents are written with spaces, so the queries take them out: a sentence becomes one run of letters, and the dictionary,
made from the documents' own words, has to find its words again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lantern.operators import lexical, segmentation as S
from lantern.plans.catalog import query, table
from lantern.sources.shared import written

_WORDS = r"SELECT doc_id, lang, unnest(string_split_regex(lower(coalesce(text, '')), '[^\p{L}]+')) AS word FROM documents"
_DICT = rf"""w AS ({_WORDS}),
    dict AS (SELECT word, count(*) AS freq, max({{'n': n, 'tag': tag}}).tag AS tag FROM (SELECT word, coalesce(lang, '') AS tag, count(*) OVER (PARTITION BY word, lang) AS n FROM w WHERE length(word) BETWEEN 1 AND 12) GROUP BY word HAVING count(*) >= 2),
    wt AS (SELECT word, trunc(ln(freq / 1e6) + 0.5)::INT AS wt FROM dict)"""
_RUNS = r"""parts AS (SELECT item_id, i - 1 AS part, regexp_replace(p[i], '[^\p{L}]+', '', 'g') AS run FROM (SELECT item_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT item_id, string_split_regex(lower(coalesce(text, '')), '[.\n]') AS p FROM benchmark))),
    runs AS (SELECT row_number() OVER () AS r, run FROM (SELECT DISTINCT run FROM parts WHERE length(run) > 0))"""
#: All words in the runs, and single letters: start, end, weight.
_MATCHES = """m AS (SELECT r, s, s + n AS e, wt, p.word FROM (SELECT r, s, n, substr(run, s + 1, n) AS word FROM (SELECT r, run, unnest(range(0, length(run))) AS s FROM runs), range(1, 13) t(n) WHERE s + n <= length(run)) p JOIN wt USING (word)),
    every AS (SELECT r, s, e, wt, word FROM m UNION ALL SELECT r, s, s + 1, -12, substr(run, s + 1, 1) FROM (SELECT r, run, unnest(range(0, length(run))) AS s FROM runs) ANTI JOIN (SELECT r, s FROM m WHERE e = s + 1) o USING (r, s))"""
#: The best path through stretches (run, a, b): by number of words.
_PATHS = """inside AS (SELECT x.r, a, b, s, e, wt, word FROM every x JOIN stretch y ON x.r = y.r AND s >= a AND e <= b),
    path AS (SELECT r, a, b, a AS pos, 0 AS n, {'f': 0::BIGINT, 'l': 0, 's': 0::BIGINT, 't': ''} AS best FROM stretch
          UNION ALL SELECT i.r, i.a, i.b, e, n + 1, max({'f': (best.f + wt)::BIGINT, 'l': best.l + (e > s + 1)::INT, 's': -s::BIGINT, 't': best.t || ' ' || word})
          FROM path p JOIN inside i ON i.r = p.r AND i.a = p.a AND i.s = p.pos GROUP BY i.r, i.a, i.b, e, n),
    won AS (SELECT r, a, b, arg_max(best.t, {'score': round((30 + best.l) / n + best.f, 9), 'n': -n}) AS t FROM path WHERE pos = b AND n >= LEAST_N GROUP BY r, a, b)"""


def dictionary(docs: DataFrame) -> DataFrame:
    """Words of up to 12 letters that occur twice and more, with the language in which they occur most."""
    words = docs.select(F.coalesce("lang", F.lit("")).alias("tag"), F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+")).alias("word"))
    counts = words.where(F.length("word").between(1, S.LONGEST)).groupBy("word", "tag").agg(F.count("*").alias("n"))
    best = counts.groupBy("word").agg(F.sum("n").alias("freq"), F.max(F.struct("n", "tag")).alias("best"))
    return best.where("freq >= 2").select("word", "freq", F.col("best.tag").alias("tag"))


def runs(docs: DataFrame, id: str) -> DataFrame:
    """(id, part, run): the letters of each sentence."""
    parts = docs.select(id, F.posexplode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[.\n]")).alias("part", "text"))
    return parts.where(F.col("text").rlike(r"\p{L}")).select(id, "part", F.regexp_replace("text", r"[^\p{L}]+", "").alias("run"))


@query(rf"""WITH RECURSIVE {_DICT}, {_RUNS}, {_MATCHES},
    far AS (SELECT r, s, max(e) AS e FROM every GROUP BY r, s), near AS (SELECT r, e, min(s) AS s FROM every GROUP BY r, e),
    fw AS (SELECT r, 0::BIGINT AS p FROM runs UNION ALL SELECT fw.r, far.e FROM fw JOIN far ON fw.r = far.r AND fw.p = far.s),
    bw AS (SELECT r, length(run)::BIGINT AS p FROM runs UNION ALL SELECT bw.r, near.s FROM bw JOIN near ON bw.r = near.r AND bw.p = near.e),
    b AS (SELECT f.r, f.f, g.g FROM (SELECT r, list(p ORDER BY p) AS f FROM fw GROUP BY r) f JOIN (SELECT r, list(p ORDER BY p) AS g FROM bw GROUP BY r) g ON f.r = g.r),
    c AS (SELECT r, f, g, list_reduce(list_transform(f, lambda x: [x]), lambda acc, x: CASE WHEN list_contains(g, x[1]) OR x[1] - acc[-1] >= 48 THEN acc || x ELSE acc END) AS cuts FROM b),
    st AS (SELECT r, f, g, cuts[i] AS a, cuts[i + 1] AS b FROM (SELECT *, unnest(range(1, len(cuts))) AS i FROM c)),
    judged AS (SELECT r, a, b, list_contains(g, b) AND len(list_filter(f || g, lambda x: x > a AND x < b)) = 0 AS agreed FROM st),
    stretch AS (SELECT r, a, b FROM judged WHERE NOT agreed), {_PATHS.replace('LEAST_N', '1')},
    done AS (SELECT run, string_agg(CASE WHEN agreed THEN substr(run, a + 1, b - a) ELSE trim(t) END, ' ' ORDER BY a) AS words FROM judged JOIN runs USING (r) LEFT JOIN won USING (r, a, b) GROUP BY r, run)
    SELECT item_id, part::INT AS part, words, len(string_split(words, ' ')) AS n_words FROM parts JOIN done USING (run)""")
def segmented_items(spark, d):
    """The words of the items' sentences, written without spaces, by the documents' dictionary: longest match from both ends, best path where they differ."""
    out = S.segmented(runs(table(spark, d, "benchmark"), "item_id"), dictionary(table(spark, d, "documents")), "run")
    return out.select("item_id", "part", F.array_join("tokens", " ").alias("words"), F.size("tokens").cast("long").alias("n_words"))


@query()
def segmented_sentences(spark, d):
    """The same for all sentences of all documents; too slow in SQL, tests hold it against plain recursion."""
    docs = table(spark, d, "documents")
    out = S.segmented(runs(docs, "doc_id"), written(dictionary(docs), "dictionary"), "run")
    return out.select("doc_id", "part", F.array_join("tokens", " ").alias("words"), F.size("tokens").cast("long").alias("n_words"))


@query()
def segmented_bm25(spark, d):
    """BM25 of items in documents, both written without spaces, over the words that segmentation finds."""
    docs = table(spark, d, "documents")
    words = written(dictionary(docs), "dictionary")
    sent = S.shared(words)

    def runs_of(rows, id):
        lower = F.lower(F.coalesce("text", F.lit("")))
        run = F.translate(F.regexp_replace(lower, r"[^\p{L}.\n]+", ""), ".\n", "  ")  # sentences' runs
        return S.segmented(rows.where(lower.rlike(r"\p{L}")).select(id, run.alias("run")), words, "run", sent=sent)

    def spaced(rows, id):
        """The words of each id; only rows of repeated ids are put together."""
        single, several = lexical.by_id(rows.select(id, "text"), id)
        found = runs_of(single, id).select(id, F.array_join("tokens", " ").alias("text"))
        return found if several is None else found.unionByName(runs_of(several, id).groupBy(id).agg(F.array_join(F.flatten(F.collect_list("tokens")), " ").alias("text")))

    items, texts = (written(spaced(rows, id), id) for rows, id in ((table(spark, d, "benchmark"), "item_id"), (docs, "doc_id")))
    return lexical.bm25(items, texts, "item_id", "doc_id")


@query(rf"""WITH RECURSIVE {_DICT}, runs AS (SELECT row_number() OVER () AS r, word AS run FROM dict WHERE length(word) BETWEEN 3 AND 10), {_MATCHES}, stretch AS (SELECT r, 0::BIGINT AS a, length(run)::BIGINT AS b FROM runs), {_PATHS.replace('LEAST_N', '2')}
    SELECT word, CASE WHEN t IS NULL OR length(t) = 2 * length(word) THEN word ELSE trim(t) END AS parts FROM dict LEFT JOIN (SELECT run, t FROM runs JOIN won USING (r)) x ON word = run""")
def fine_words(spark, d):
    """Each word of the dictionary in its second, finer division."""
    words = dictionary(table(spark, d, "documents"))
    return S.segmented(words.select("word"), words, "word", fine=True).select("word", F.array_join("tokens", " ").alias("parts"))


@query(rf"""WITH {_DICT}, u AS (SELECT word, max(n) AS freq FROM (SELECT word, count(*) AS n FROM (SELECT item_id, unnest(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}]+')) AS word FROM benchmark) WHERE length(word) >= 8 GROUP BY word, item_id) GROUP BY word),
    merged AS (SELECT word, freq, tag FROM dict ANTI JOIN u USING (word) UNION ALL SELECT word, freq, 'user' FROM u),
    t AS (SELECT word AS token, count(*) AS n FROM w WHERE length(word) > 0 GROUP BY word)
    SELECT token, n, coalesce(freq, 0)::BIGINT AS freq, coalesce(tag, '') AS tag FROM t LEFT JOIN merged ON token = word""")
def word_tags(spark, d):
    """Frequency and tag of all words, by a dictionary in which a user's words (here those of the benchmark, of 8 letters and more) replace others."""
    docs = table(spark, d, "documents")
    split = lambda c: F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}]+")
    more = table(spark, d, "benchmark").select("item_id", F.explode(split(F.col("text"))).alias("word")).where("length(word) >= 8")
    more = more.groupBy("word", "item_id").agg(F.count("*").alias("freq")).select("word", "freq", F.lit("user").alias("tag"))
    tokens = docs.select(F.explode(split(F.col("text"))).alias("token")).where("length(token) > 0").groupBy("token").agg(F.count("*").alias("n"))
    return S.looked_up(tokens, S.with_user_words(dictionary(docs), more)).select("token", "n", "freq", "tag")
