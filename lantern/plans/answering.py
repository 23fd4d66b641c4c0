"""Registered queries on term weights, boosted fields, contexts, citations, answers' checks and tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

from lantern.functions import text as T
from lantern.operators import context, lexical
from lantern.plans.catalog import _TOKENS, query, table
from lantern.plans.evidence import _BOXES, _CANDIDATES, _boxes, _candidates, _lineitems

_IDF = "log10(10 + ({n} - coalesce({c}, 0) + 0.5) / (coalesce({c}, 0) + 0.5))"


@query(f"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY ALL), s AS (SELECT term, sum(tf) AS freq, count(*) AS df FROM tf GROUP BY term),
    q AS (SELECT item_id, unnest(list_distinct({_TOKENS})) AS term FROM benchmark),
    r AS (SELECT item_id, q.term, 0.3 * {_IDF.format(n="1e7", c="freq")} + 0.7 * {_IDF.format(n="1e9", c="df")} AS raw FROM q LEFT JOIN s ON q.term = s.term)
    SELECT item_id, term, round(raw / sum(raw) OVER (PARTITION BY item_id), 6) AS weight FROM r""")
def term_weights(spark, d):
    w = context.term_weights(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id")
    return w.withColumn("weight", F.round("weight", 6))


def _terms(c: str) -> str:
    """SQL of the tokens of another column."""
    return _TOKENS.replace("text", c)


@query(f"""WITH t AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10))[1] AS title FROM documents),
    l AS (SELECT doc_id, 'title' AS field, 10.0 AS boost, unnest(list_distinct({_terms("title")})) AS term FROM t UNION ALL SELECT doc_id, 'text', 2.0, unnest(list_distinct({_TOKENS})) FROM t),
    i AS (SELECT field, term, count(*) AS df FROM l GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents),
    w AS (SELECT field, term, ln(1 + (n - df + 0.5) / (df + 0.5)) / ln(1 + (n - 0.5) / 1.5) AS idf FROM i, n), q AS (SELECT item_id, len(list_distinct({_TOKENS})) AS nq, unnest(list_distinct({_TOKENS})) AS term FROM benchmark),
    h AS (SELECT item_id, doc_id, l.field, nq, count(*) AS shared, sum(boost * idf) AS score FROM q JOIN l ON q.term = l.term JOIN w ON l.field = w.field AND l.term = w.term GROUP BY ALL)
    SELECT item_id, doc_id, round(max(score), 5) AS score FROM h WHERE shared >= 0.3 * nq GROUP BY item_id, doc_id""")
def field_search(spark, d):
    docs = table(spark, d, "documents").withColumn("title", F.substring_index(F.coalesce("text", F.lit("")), "\n", 1))
    out = context.field_search(table(spark, d, "benchmark"), docs, "item_id", "doc_id", {"title": 10.0, "text": 2.0})
    return out.withColumn("score", F.round("score", 5))


@query(f"""WITH {_CANDIDATES}, s AS (SELECT *, shared / n_query AS lex, shared / sqrt(n_query * n_doc) AS vec FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(lex, 9) DESC, doc_id) AS a, row_number() OVER (PARTITION BY item_id ORDER BY round(vec, 9) DESC, doc_id) AS b FROM s),
    f AS (SELECT item_id, doc_id, round(0.45 * vec + 0.35 * lex + 2.2 * (0.5 / (60 + a) + 0.5 / (60 + b)) + 0.15 * (lex >= 0.5)::INT - 1.6 * (source = 'src0')::INT, 6) AS score FROM r)
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 5""")
def smart_rerank(spark, d):
    """Vector, lexical and rank fusion scores, a bonus for required terms and a penalty for what conflicts; the five best."""
    s = _candidates(spark, d).select("item_id", "doc_id", "source", (F.col("shared") / F.col("n_query")).alias("lex"), (F.col("shared") / F.sqrt(F.col("n_query") * F.col("n_doc"))).alias("vec"))
    place = lambda c: F.row_number().over(Window.partitionBy("item_id").orderBy(F.round(c, 9).desc(), "doc_id"))
    r = s.withColumn("a", place("lex")).withColumn("b", place("vec"))
    fused = 0.5 / (60 + F.col("a")) + 0.5 / (60 + F.col("b"))
    score = 0.45 * F.col("vec") + 0.35 * F.col("lex") + 2.2 * fused + 0.15 * (F.col("lex") >= 0.5).cast("int") - 1.6 * (F.col("source") == "src0").cast("int")
    f = r.select("item_id", "doc_id", F.round(score, 6).alias("score"))
    return f.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")).cast("long")).where("rank <= 5")


@query(f"""WITH p AS (SELECT item_id, len({_TOKENS}) <= 12 AS short, regexp_matches(coalesce(text, ''), '[0-9]') AS exact FROM benchmark)
    SELECT item_id, round(least(0.42, greatest(0.08, 0.12 + 0.12 * short::INT + 0.06 * exact::INT))::DOUBLE, 6) AS text_weight, round(1 - least(0.42, greatest(0.08, 0.12 + 0.12 * short::INT + 0.06 * exact::INT))::DOUBLE, 6) AS vector_weight FROM p""")
def fusion_weights(spark, d):
    """The weights of text and vector by what a query is like, held in bounds."""
    t = F.coalesce("text", F.lit(""))
    short, exact = (F.size(T.tokens(F.col("text"))) <= 12).cast("int"), t.rlike("[0-9]").cast("int")
    w = F.least(F.lit(0.42), F.greatest(F.lit(0.08), 0.12 + 0.12 * short + 0.06 * exact))
    return table(spark, d, "benchmark").select("item_id", F.round(w, 6).alias("text_weight"), F.round(1 - w, 6).alias("vector_weight"))


@query("""WITH r AS (SELECT conv_id, turn, left(text, 320) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations WHERE length(text) > 0),
    s AS (SELECT *, sum(length(t)) OVER (PARTITION BY conv_id ORDER BY n) AS total FROM r WHERE n <= 8)
    SELECT conv_id, string_agg(t, chr(10) ORDER BY n) AS context, count(*) AS parts FROM s WHERE total <= 600 GROUP BY conv_id""")
def context_budget(spark, d):
    """The first snippets of a conversation that fit in a budget; the cut is the feature."""
    return context.budgeted(table(spark, d, "conversations"), "conv_id", [F.col("turn"), F.col("text")], "text", 8, 320, 600)


@query(rf"""WITH {_CANDIDATES}, top AS (SELECT item_id, doc_id FROM c QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) <= 5),
    u AS (SELECT item_id, unnest(list_distinct(list_filter(string_split_regex(coalesce(text, ''), '[.!?\n]+'), lambda s: regexp_matches(s, '[A-Za-z]{{2}}')))) AS sentence FROM benchmark),
    st AS (SELECT item_id, sentence, len(list_distinct({_terms("sentence")})) AS n, unnest(list_distinct({_terms("sentence")})) AS term FROM u),
    dt AS (SELECT top.item_id, top.doc_id, unnest(t) AS term FROM top JOIN d ON top.doc_id = d.doc_id),
    p AS (SELECT st.item_id, sentence, doc_id, count(*) / n AS sim FROM st JOIN dt ON st.item_id = dt.item_id AND st.term = dt.term GROUP BY st.item_id, sentence, doc_id, n),
    m AS (SELECT *, round(max(sim) OVER (PARTITION BY item_id, sentence) * 0.99, 9) AS best FROM p),
    v AS (SELECT *, max(best) OVER (PARTITION BY item_id) AS top FROM m),
    k AS (SELECT *, CASE WHEN top >= 0.63 THEN 0.63 WHEN top >= 0.504 THEN 0.504 WHEN top >= 0.4032 THEN 0.4032 WHEN top >= 0.32256 THEN 0.32256 END AS level FROM v)
    SELECT item_id, sentence, doc_id, round(sim, 6) AS sim FROM k WHERE best >= level AND sim > best QUALIFY row_number() OVER (PARTITION BY item_id, sentence ORDER BY round(sim, 9) DESC, doc_id) <= 4""")
def citation_insert(spark, d):
    """The documents that each sentence of an item cites, from the item's five best."""
    top = lexical.coverage_top(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id", 5).select("item_id", "doc_id")
    terms = table(spark, d, "documents").select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("t")).join(F.broadcast(top), "doc_id").select("item_id", "doc_id", F.explode("t").alias("term"))
    said = F.array_distinct(F.filter(F.split(F.coalesce("text", F.lit("")), r"[.!?\n]+", -1), lambda s: s.rlike("[A-Za-z]{2}")))
    u = table(spark, d, "benchmark").select("item_id", F.explode(said).alias("sentence")).withColumn("t", F.array_distinct(T.tokens(F.col("sentence"))))
    st = u.select("item_id", "sentence", F.size("t").alias("n"), F.explode("t").alias("term"))
    pairs = st.join(terms, ["item_id", "term"]).groupBy("item_id", "sentence", "doc_id", "n").agg((F.count("*") / F.col("n")).alias("sim")).drop("n")
    return context.cite(pairs, "item_id", "sentence", "doc_id", "sim").withColumn("sim", F.round("sim", 6))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, '<tr><td>' || o_orderkey || '</td><td>' || coalesce(o_orderstatus, '') || '</td><td>' || coalesce(o_orderpriority, '') || '</td></tr>' AS row, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
    SELECT o_custkey, (n - 1) // 10 AS part, '<table>' || string_agg(row, '' ORDER BY n) || '</table>' AS html, count(*) AS n FROM r GROUP BY ALL""")
def html_tables(spark, d):
    """Rows of a sheet as HTML tables of ten."""
    return context.html_tables(table(spark, d, "orders"), "o_custkey", "o_orderkey", ["o_orderkey", "o_orderstatus", "o_orderpriority"], 10)


@query(f"""WITH {_BOXES}, p AS (SELECT c.page, c.box AS caption, t.box AS target, CASE WHEN t.box % 3 = 1 THEN 'table' ELSE 'figure' END AS kind, (c.x0 - t.x0) ** 2 + (c.top - t.top) ** 2 AS dist FROM b c JOIN b t ON c.page = t.page WHERE c.box % 3 = 0 AND t.box % 3 <> 0)
    SELECT page, caption, target, kind FROM p QUALIFY row_number() OVER (PARTITION BY page, caption ORDER BY dist, kind = 'table', target) = 1""")
def caption_nearest(spark, d):
    """The figure or table that a caption belongs to; a table wins only where it is strictly closer."""
    b = _boxes(spark, d)
    targets = b.where("box % 3 <> 0").withColumn("kind", F.when(F.col("box") % 3 == 1, "table").otherwise("figure")).withColumnRenamed("box", "target")
    return context.nearest(b.where("box % 3 = 0").withColumnRenamed("box", "caption"), targets, "page", "caption", "target", "kind", "table")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, 1 + max(l_quantity)::INT % 3 AS level FROM lineitem GROUP BY ALL),
    h AS (SELECT *, max(CASE WHEN level = 1 THEN l_linenumber END) OVER w AS a, max(CASE WHEN level = 2 THEN l_linenumber END) OVER w AS b FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT l_orderkey, l_linenumber, level, concat_ws(' > ', CASE WHEN level > 1 THEN a::VARCHAR END, CASE WHEN level > 2 AND (a IS NULL OR a < b) THEN b::VARCHAR END) AS path FROM h""")
def heading_paths(spark, d):
    """The open headings above each line."""
    lines = _lineitems(spark, d).select("l_orderkey", "l_linenumber", (1 + F.col("l_quantity").cast("int") % 3).alias("level"))
    return context.heading_paths(lines, "l_orderkey", "l_linenumber", "level", "l_linenumber", 3)


@query("""SELECT l_orderkey, count(*) AS n, round(CASE WHEN count(*) > 4 THEN avg(l_extendedprice) ELSE min(l_extendedprice) END, 6) AS low, round(CASE WHEN count(*) > 4 THEN avg(l_extendedprice) ELSE max(l_extendedprice) END, 6) AS high, round(median(l_extendedprice), 6) AS mid FROM lineitem GROUP BY l_orderkey""")
def alignment(spark, d):
    """Where the edges of a row lie: the mean of many boxes, the outermost of few."""
    x = "l_extendedprice"
    many = F.count("*") > 4
    edge = lambda f: F.round(F.when(many, F.avg(x)).otherwise(f(x)), 6)
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), edge(F.min).alias("low"), edge(F.max).alias("high"), F.round(F.median(x), 6).alias("mid"))


_KIND = """CASE WHEN regexp_matches(line, '^[0-9., %-]+$') THEN 'number' WHEN regexp_matches(line, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date' WHEN regexp_matches(line, '^[A-Z][^a-z]*$') THEN 'code' WHEN length(line) <= 40 THEN 'short' ELSE 'long' END"""


def _kind(line: Column) -> Column:
    kinds = F.when(line.rlike("^[0-9., %-]+$"), "number").when(line.rlike("[0-9]{4}-[0-9]{2}-[0-9]{2}"), "date").when(line.rlike("^[A-Z][^a-z]*$"), "code")
    return kinds.when(F.length(line) <= 40, "short").otherwise("long")


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), k AS (SELECT doc_id, {_KIND} AS kind, count(*) AS n FROM l WHERE line <> '' GROUP BY ALL)
    SELECT doc_id, kind, n FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, kind) = 1""")
def cell_vote(spark, d):
    """The commonest kind among a document's lines, ties by name."""
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line")).where("line <> ''")
    counts = lines.groupBy("doc_id", _kind(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))
    best = counts.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "kind", "n")).alias("b"))
    return best.select("doc_id", "b.kind", "b.n")


@query("""SELECT l_returnflag, count(*) AS cases, count(*) FILTER (WHERE abs(l_extendedprice - l_quantity * p_retailprice) <= 0.02 * greatest(abs(l_extendedprice), abs(l_quantity * p_retailprice))) AS close,
    count(*) FILTER (WHERE l_extendedprice = l_quantity * p_retailprice) AS exact FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_returnflag""")
def numeric_agreement(spark, d):
    """Numbers that are equal, and those within two hundredths of each other."""
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    a, b = F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice")
    close = F.abs(a - b) <= 0.02 * F.greatest(F.abs(a), F.abs(b))
    return j.groupBy("l_returnflag").agg(F.count("*").alias("cases"), F.count_if(close).alias("close"), F.count_if(a == b).alias("exact"))


@query(r"""SELECT conv_id, turn, role, concat_ws(',', CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' END, CASE WHEN length(text) < 40 THEN 'short' END, CASE WHEN role = 'assistant' AND NOT regexp_matches(coalesce(text, ''), '##[0-9]+\$\$') THEN 'uncited' END,
    CASE WHEN regexp_matches(coalesce(text, ''), '[0-9]') THEN 'numeric' END, CASE WHEN contains(text, '?') THEN 'question' END) AS labels FROM conversations""")
def answer_labels(spark, d):
    """Every check that a turn fails or trait that it has, in a fixed order."""
    t = F.coalesce("text", F.lit(""))
    labels = [
        (F.trim(t) == "", "empty"), (F.length("text") < 40, "short"), ((F.col("role") == "assistant") & ~t.rlike(r"##[0-9]+\$\$"), "uncited"),
        (t.rlike("[0-9]"), "numeric"), (F.contains(t, F.lit("?")), "question"),
    ]
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.concat_ws(",", *(F.when(c, n) for c, n in labels)).alias("labels"))


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN role IS NULL OR coalesce(text, '') = '' THEN 'none' WHEN length(text) < 80 THEN 'rule' ELSE 'model' END AS route FROM conversations)
    SELECT route, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM t GROUP BY route""")
def answer_routes(spark, d):
    """How many turns each way of answering takes."""
    t = F.coalesce("text", F.lit(""))
    route = F.when(F.col("role").isNull() | (t == ""), "none").when(F.length(t) < 80, "rule").otherwise("model")
    return table(spark, d, "conversations").groupBy(route.alias("route")).agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("conversations"))


@query(f"""WITH t AS (SELECT doc_id, {_terms("string_split(coalesce(text, ''), chr(10))[1]")} AS a, {_TOKENS} AS b FROM documents), u AS (SELECT doc_id, unnest(a) AS term, 2 AS w FROM t UNION ALL SELECT doc_id, unnest(b), 1 FROM t)
    SELECT doc_id, term, sum(w)::BIGINT AS weight FROM u GROUP BY doc_id, term""")
def weighted_bag(spark, d):
    """Terms of a document; those of its first line count twice more."""
    first = T.tokens(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1))
    weigh = lambda terms, w: F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))
    both = F.concat(weigh(first, 2), weigh(T.tokens(F.col("text")), 1))
    return table(spark, d, "documents").select("doc_id", F.explode(both).alias("x")).groupBy("doc_id", F.col("x.term").alias("term")).agg(F.sum("x.w").alias("weight"))


@query(f"""WITH {_BOXES}, t AS (SELECT page, box, '@@' || box || chr(9) || x0::INT || chr(9) || x1::INT || '##' AS tag FROM b)
    SELECT page, box, regexp_extract(tag, '@@([0-9]+)\t([0-9]+)\t([0-9]+)##', 2)::BIGINT AS x0, regexp_extract(tag, '@@([0-9]+)\t([0-9]+)\t([0-9]+)##', 3)::BIGINT AS x1, regexp_replace('line ' || tag, '@@[^#]*##', '') AS plain FROM t""")
def position_tags(spark, d):
    """Places read back from the tags in a text, and the text without them."""
    tag = F.concat(F.lit("@@"), F.col("box"), F.lit("\t"), F.col("x0").cast("int"), F.lit("\t"), F.col("x1").cast("int"), F.lit("##"))
    part = lambda n: F.regexp_extract("tag", r"@@([0-9]+)\t([0-9]+)\t([0-9]+)##", n).cast("long")
    b = _boxes(spark, d).select("page", "box", tag.alias("tag"))
    return b.select("page", "box", part(2).alias("x0"), part(3).alias("x1"), F.regexp_replace(F.concat(F.lit("line "), F.col("tag")), "@@[^#]*##", "").alias("plain"))


@query(r"""SELECT conv_id, turn, regexp_replace(text, '(?i)(^|[ \n])(the|and|der|und|les)([ \n.,]|$)', '\1<em>\2</em>\3', 'g') AS marked FROM conversations""")
def highlight(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"(?i)(^|[ \n])(the|and|der|und|les)([ \n.,]|\z)", "$1<em>$2</em>$3").alias("marked"))


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100""")
def result_page(spark, d):
    """The third page of fifty; the page is the feature."""
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(100).limit(50)
