"""Registered queries on joins of evidence, re-ranking, page layout, answers and task bookkeeping, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lantern.functions import text as T
from lantern.operators import layout, rerank
from lantern.operators.matching import matches
from lantern.plans.catalog import _TOKENS, query, table
from lantern.sources.shared import written


def _tokens(c: str = "text") -> Column:
    return T.tokens(F.col(c))


_NAME = r"regexp_replace(lower(translate(coalesce({}, ''), '（）', '()')), '\s+', '', 'g')"


# ---- joins ----


@query(f"""WITH e AS (SELECT o_orderkey AS case_id, 'Customer #' || o_custkey AS expected FROM orders),
    i AS (SELECT {_NAME.format("regexp_replace(c_name, '#0*', ' #')")} AS k, max(c_custkey) AS indexed FROM customer GROUP BY 1)
    SELECT case_id, expected, indexed, indexed IS NOT NULL AS found FROM e LEFT JOIN i ON {_NAME.format('e.expected')} = i.k""")
def expected_names(spark, d):
    """Expected names against indexed ones on a normalised key; of equal names the last counts."""
    key = lambda c: F.regexp_replace(F.lower(F.translate(F.coalesce(c, F.lit("")), "（）", "()")), r"\s+", "")
    cases = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.concat(F.lit("Customer #"), F.col("o_custkey")).alias("expected"))
    index = table(spark, d, "customer").groupBy(key(F.regexp_replace("c_name", "#0*", " #")).alias("k")).agg(F.max("c_custkey").alias("indexed"))
    return cases.join(index, key(F.col("expected")) == F.col("k"), "left").select("case_id", "expected", "indexed", F.col("indexed").isNotNull().alias("found"))


@query("""SELECT c_custkey, n_name, r_name, r_name || ' > ' || n_name || ' > ' || c_name AS path FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def ancestors(spark, d):
    """Each leaf with its ancestors in a hierarchy of fixed depth."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    joined = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.select("c_custkey", "n_name", "r_name", F.concat(F.col("r_name"), F.lit(" > "), F.col("n_name"), F.lit(" > "), F.col("c_name")).alias("path"))


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click') SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup' AND user_id IN (SELECT user_id FROM a)""")
def active_conflicts(spark, d):
    """New tasks whose owner has an active one."""
    e = table(spark, d, "events")
    active = e.where("event_type = 'click'").select("user_id")
    return e.where("event_type = 'signup'").join(active, "user_id", "left_semi").select("event_id", "user_id", "ts")


@query("""SELECT source, count(*) AS documents, count(DISTINCT lang) AS langs, count(DISTINCT lang) >= 2 AS conflicting, array_to_string(list_sort(list(doc_id))[:3], ',') AS first_three FROM documents GROUP BY source""")
def source_conflicts(spark, d):
    """Sources with several values of a field, and their first three documents."""
    docs = table(spark, d, "documents")
    first = docs.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("n <= 3").groupBy("source").agg(F.array_join(F.sort_array(F.collect_list("doc_id")).cast("array<string>"), ",").alias("first_three"))
    counts = docs.groupBy("source").agg(F.count("*").alias("documents"), F.count_distinct("lang").alias("langs"))
    return counts.join(first.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("source", "documents", "langs", (F.col("langs") >= 2).alias("conflicting"), "first_three")


# ---- aggregations ----


@query(f"""WITH t AS (SELECT unnest(list_distinct({_TOKENS})) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
    SELECT term, count(*) AS df, round(ln((any_value(n) + 1) / (count(*) + 1)) + 1, 6) AS idf FROM t, n GROUP BY term""")
def smoothed_idf(spark, d):
    docs = table(spark, d, "documents")
    n = docs.agg(F.count("*").alias("n"))  # one row
    df = docs.select(F.explode(F.array_distinct(_tokens())).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("term", "df", F.round(F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1, 6).alias("idf"))


@query("""WITH c AS (SELECT source, coalesce(quality, 0) AS hit, coalesce(toxic, 0) AS abstain, l.doc_id IS NOT NULL AS answered FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT source, count(*) AS cases, round(avg(hit), 6) AS accuracy, round(avg(answered::INT), 6) AS answered_share, round(coalesce(sum(abstain * (1 - hit))::DOUBLE / nullif(sum(abstain), 0), 0), 6) AS abstain_success,
    round(1 - coalesce(sum(abstain * (1 - hit))::DOUBLE / nullif(sum(abstain), 0), 0), 6) AS hallucination FROM c GROUP BY GROUPING SETS ((), (source))""")
def answer_metrics(spark, d):
    """Accuracy, share of answered cases, abstentions that hold and the rest, overall and by kind."""
    c = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    c = c.select("source", F.coalesce("quality", F.lit(0)).alias("hit"), F.coalesce("toxic", F.lit(0)).alias("abstain"), F.col("quality").isNotNull().cast("int").alias("answered"))
    held = F.coalesce(F.sum(F.col("abstain") * (1 - F.col("hit"))) / F.nullif(F.sum("abstain"), F.lit(0)), F.lit(0.0))
    sums = c.groupingSets([[], ["source"]], "source").agg(F.count("*").alias("cases"), F.round(F.avg("hit"), 6).alias("accuracy"), F.round(F.avg("answered"), 6).alias("answered_share"), F.round(held, 6).alias("abstain_success"), F.round(1 - held, 6).alias("hallucination"))
    return sums


@query("""SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS place FROM documents GROUP BY source, lang""")
def label_counts(spark, d):
    n = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.col("n").desc(), "lang")).cast("long"))


@query("""WITH r AS (SELECT p_brand, p_type, min(p_partkey) AS f FROM part GROUP BY p_brand, p_type) SELECT p_brand, string_agg(p_type, '|' ORDER BY f) AS types, count(*) AS n FROM r GROUP BY p_brand""")
def ordered_distinct(spark, d):
    """Distinct values in the order of their first place."""
    first = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("f"))
    rows = first.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("f", "p_type"))).alias("r"))
    return rows.select("p_brand", F.array_join(F.transform("r", lambda x: x["p_type"]), "|").alias("types"), F.size("r").cast("long").alias("n"))


_FACTS = """CASE WHEN doc_id % 7 = 0 THEN ' 共3.5亿元' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN ' 同比 +12%' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN ' 20 GWh' ELSE '' END"""


@query(rf"""WITH t AS (SELECT doc_id, coalesce(text, '') || {_FACTS} AS t FROM documents)
    SELECT doc_id, regexp_matches(t, '(?i)[0-9]+([.][0-9]+)?\s*(亿元|亿|万元|万)')::INT + regexp_matches(t, '[0-9]+([.][0-9]+)?%')::INT + regexp_matches(t, '(?i)[0-9]+([.][0-9]+)?\s*(gwh|wh|pct)')::INT AS numeric_facts FROM t""")
def numeric_fact_count(spark, d):
    """How many kinds of numbers a text has: money, shares, amounts of power."""
    kinds = (r"(?i)[0-9]+(?:\.[0-9]+)?\s*(?:亿元|亿|万元|万)", r"(?:同比|环比)?\s*[+-]?[0-9]+(?:\.[0-9]+)?%", r"(?i)[0-9]+(?:\.[0-9]+)?\s*(?:gwh|wh|pct)")
    t = F.concat(F.coalesce("text", F.lit("")), F.expr(_FACTS))
    return table(spark, d, "documents").select("doc_id", sum((F.rlike(t, F.lit(k)).cast("int") for k in kinds[1:]), F.rlike(t, F.lit(kinds[0])).cast("int")).alias("numeric_facts"))


# ---- ranking ----

_CANDIDATES = f"""q AS (SELECT item_id, list_distinct({_TOKENS}) AS q FROM benchmark), d AS (SELECT doc_id, source, list_distinct({_TOKENS}) AS t FROM documents),
    hits AS (SELECT item_id, doc_id, count(*) AS shared FROM (SELECT item_id, unnest(q) AS term FROM q) a JOIN (SELECT doc_id, unnest(t) AS term FROM d) b ON a.term = b.term GROUP BY item_id, doc_id),
    c AS (SELECT hits.item_id, hits.doc_id, source, shared, len(q) AS n_query, len(t) AS n_doc FROM hits JOIN q ON hits.item_id = q.item_id JOIN d ON hits.doc_id = d.doc_id)"""


def _candidates(spark, d, least: float = 0.0) -> DataFrame:
    """item_id, doc_id, source, shared, n_query, n_doc of the pairs that share a term, and at least this part of the query's."""
    return _shared(spark, d, least=least)


def _shared(spark, d, least: float = 0.0, weight=lambda n: F.lit(1.0), **best) -> DataFrame:
    """The same; ``best`` keeps those that can be among the best by ``weight`` of the query's size."""
    q = table(spark, d, "benchmark").select("item_id", F.array_distinct(_tokens()).alias("q")).select("item_id", F.size("q").cast("long").alias("n_query"), F.explode("q").alias("term"))
    docs = table(spark, d, "documents").select("doc_id", "source", F.array_distinct(_tokens()).alias("tokens"))
    asked = q.select("item_id", "term", weight(F.col("n_query")).alias("weight"), F.greatest(F.lit(1.0), least * F.col("n_query")).alias("least"))
    found = matches(docs, asked, "doc_id", "item_id", **best).join(F.broadcast(q.select("item_id", "n_query").distinct()), "item_id")
    return found.select("item_id", "doc_id", "source", "n_query", F.col("n").alias("n_doc"), "shared")


@query(f"WITH {_CANDIDATES} SELECT item_id, doc_id, shared, round(shared / (n_query + 1e-6), 6) AS overlap, round((shared + 1e-9) / (n_query + 1e-9), 6) AS similarity FROM c")
def token_overlaps(spark, d):
    c = _candidates(spark, d)
    return c.select("item_id", "doc_id", "shared", F.round(F.col("shared") / (F.col("n_query") + 1e-6), 6).alias("overlap"), F.round((F.col("shared") + 1e-9) / (F.col("n_query") + 1e-9), 6).alias("similarity"))


@query(f"""WITH {_CANDIDATES}, s AS (SELECT item_id, doc_id, shared / n_query AS lex, shared / sqrt(n_query * n_doc) AS vec FROM c),
    l AS (SELECT item_id, doc_id, lex, vec, row_number() OVER (PARTITION BY item_id ORDER BY round(lex, 9) DESC, doc_id) AS rank FROM s UNION ALL SELECT item_id, doc_id, lex, vec, row_number() OVER (PARTITION BY item_id ORDER BY round(vec, 9) DESC, doc_id) AS rank FROM s),
    f AS (SELECT item_id, doc_id, round(sum(1.2 / (60 + rank) + 0.75 * lex + 0.20 * vec + 0.05 * vec), 6) AS fusion, count(*) AS appearances, min(rank) AS best_rank FROM l WHERE rank <= 20 GROUP BY item_id, doc_id)
    SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY fusion DESC, appearances DESC, best_rank, doc_id) <= 5""")
def cross_query_fusion(spark, d):
    """Two ranked lists for each query, fused; the five best."""
    shared = F.col("shared")
    scores = lambda c: c.select("item_id", "doc_id", (shared / F.col("n_query")).alias("lex"), (shared / F.sqrt(F.col("n_query") * F.col("n_doc"))).alias("vec"))
    by = lambda c: F.row_number().over(Window.partitionBy("item_id").orderBy(F.round(c, 9).desc(), "doc_id")).cast("long").alias("rank")
    lex = scores(_shared(spark, d, k=20))  # a query's shares of shared terms are in the order of their number
    vec = scores(_shared(spark, d, weight=lambda n: 1 / F.sqrt(n), value=lambda _, n: 1 / n**0.5, k=20, digits=9))
    lists = lex.select("*", by("lex")).where("rank <= 20").unionByName(vec.select("*", by("vec")).where("rank <= 20"))
    fused = rerank.fuse_queries(lists, "item_id", "doc_id", "rank", "lex", "vec", "vec").withColumn("fusion", F.round("fusion", 6)).drop("best_similarity")
    order = Window.partitionBy("item_id").orderBy(F.col("fusion").desc(), F.col("appearances").desc(), "best_rank", "doc_id")
    return fused.withColumn("n", F.row_number().over(order)).where("n <= 5").drop("n")


@query(f"""WITH {_CANDIDATES}, strict AS (SELECT item_id, doc_id, shared FROM c WHERE shared >= 0.9 * n_query), loose AS (SELECT item_id, doc_id, shared FROM c WHERE shared >= 0.3 * n_query)
    SELECT * FROM strict UNION ALL SELECT * FROM loose WHERE item_id NOT IN (SELECT item_id FROM strict)""")
def zero_hit_relaxation(spark, d):
    c = written(_candidates(spark, d, 0.3), "loose")
    pick = lambda share: c.where(F.col("shared") >= share * F.col("n_query")).select("item_id", "doc_id", "shared")
    return rerank.relaxed(pick(0.9), pick(0.3), "item_id")


@query(f"""WITH {_CANDIDATES}, k AS (SELECT *, source = 'src0' AS conflict, max(source <> 'src0') OVER (PARTITION BY item_id) AS any_left FROM c),
    p AS (SELECT item_id, doc_id, shared, row_number() OVER (PARTITION BY item_id ORDER BY (shared >= 0.5 * n_query) DESC, shared DESC, doc_id) AS place FROM k WHERE NOT conflict OR NOT any_left) SELECT * FROM p""")
def soft_hard_filter(spark, d):
    c = _candidates(spark, d)
    out = rerank.prefer(c, "item_id", F.col("source") == "src0", F.col("shared") >= 0.5 * F.col("n_query"), F.col("shared").desc(), F.col("doc_id"))
    return out.select("item_id", "doc_id", "shared", F.col("place").cast("long").alias("place"))


@query(f"""WITH t AS (SELECT item_id, {_TOKENS} AS t FROM benchmark), p AS (SELECT item_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS phrase FROM t WHERE len(t) > 1)
    SELECT item_id, phrase, count(*) AS n FROM p GROUP BY item_id, phrase""")
def adjacent_phrases(spark, d):
    t = table(spark, d, "benchmark").select("item_id", _tokens().alias("t"))
    return t.select("item_id", F.explode(rerank.neighbours_boost(F.col("t"))).alias("phrase")).groupBy("item_id", "phrase").agg(F.count("*").alias("n"))


# ---- layout: an order is a page, its lines are boxes, and those of even numbers are regions ----

_BOXES = "b AS (SELECT l_orderkey AS page, l_linenumber AS box, l_quantity AS x0, l_quantity + 20 AS x1, l_linenumber * 10.0 AS top, l_linenumber * 10.0 + 16 AS bottom FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL))"


def _lineitems(spark, d) -> DataFrame:
    """One for each order and number."""
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))


def _boxes(spark, d) -> DataFrame:
    top = F.col("l_linenumber") * F.lit(10.0)
    return _lineitems(spark, d).select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("box"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 20).alias("x1"), top.alias("top"), (top + 16).alias("bottom"))


@query(f"""WITH {_BOXES}, p AS (SELECT b.page, b.box, r.box AS region, greatest(least(b.x1, r.x1) - greatest(b.x0, r.x0), 0) * greatest(least(b.bottom, r.bottom) - greatest(b.top, r.top), 0) / ((b.x1 - b.x0) * (b.bottom - b.top)) AS share
      FROM b JOIN b r ON b.page = r.page AND r.box % 2 = 0),
    m AS (SELECT page, box, region, share FROM p WHERE share >= 0.1 QUALIFY row_number() OVER (PARTITION BY page, box ORDER BY share DESC, region) = 1)
    SELECT b.page, b.box, region, round(coalesce(share, 0), 6) AS share FROM b LEFT JOIN m ON b.page = m.page AND b.box = m.box""")
def region_overlap(spark, d):
    b = _boxes(spark, d)
    regions = b.where("box % 2 = 0").withColumnRenamed("box", "region")
    return layout.assign(b, regions, "page", "box", "region", 0.1).withColumn("share", F.round("share", 6))


@query(f"""WITH {_BOXES}, p AS (SELECT a.page, a.box AS a, b.box AS b, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.bottom, b.bottom) - greatest(a.top, b.top), 0) AS o FROM b a JOIN b ON a.page = b.page AND a.box < b.box)
    SELECT page, a, b, round(o / (640 - o), 6) AS iou FROM p WHERE o > 0""")
def box_iou(spark, d):
    """Pairs of boxes of a page that overlap; a page has few boxes."""
    b = _boxes(spark, d)
    sides = F.struct(*layout.SIDES)
    pairs = b.select("page", F.col("box").alias("a"), sides.alias("s")).join(b.select("page", F.col("box").alias("b"), sides.alias("r")), "page").where("a < b")
    return pairs.where(layout.overlap("s", "r") > 0).select("page", "a", "b", F.round(layout.iou("s", "r"), 6).alias("iou"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice, round(coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS "offset" FROM orders""")
def page_offsets(spark, d):
    pages = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return layout.page_offsets(pages, "o_custkey", "o_orderkey", "o_totalprice").withColumn("offset", F.round("offset", 2))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, coalesce(l_linenumber <> lag(l_linenumber) OVER w + 1 OR abs(l_quantity - lag(l_quantity) OVER w) > 23, true) AS b FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
    SELECT l_orderkey, l_linenumber, max(CASE WHEN b THEN l_linenumber END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS first_page FROM s""")
def cross_page_tables(spark, d):
    t = _lineitems(spark, d)
    gap = F.abs(F.col("l_quantity") - F.lag("l_quantity").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")))
    return layout.continued(t, "l_orderkey", "l_linenumber", gap, 23).drop("l_quantity")


# ---- text ----

#: Fixed patterns of lines that say nothing: bullets, rights, addresses, dots, page numbers, links, sources, mail, glyph codes.
GARBAGE = r"^•+$|版权归©|免责条款|地址[:：]|\.{3,}|^[0-9]{1,2} / ?[0-9]{1,2}$|^[0-9]{1,2} of [0-9]{1,2}$|^http://[^ ]{12,}|(资料|数据)来源[:：]|[0-9a-z._-]+@[a-z0-9-]+\.[a-z]{2,3}|\(cid *: *[0-9]+ *\)"


@query(r"""SELECT doc_id, sha1(doc_id || '||' || coalesce(source, '') || '||' || left(coalesce(text, ''), 240))[:12] AS citation_key, coalesce(source, '') || '_' || doc_id || '.txt' AS name FROM documents""")
def citation_keys(spark, d):
    """A short stable key of a document's id, name and first 240 characters, as the feature asks for."""
    source = F.coalesce("source", F.lit(""))
    key = F.concat_ws("||", F.col("doc_id").cast("string"), source, F.left(F.coalesce("text", F.lit("")), F.lit(240)))
    return table(spark, d, "documents").select("doc_id", F.substring(F.sha1(key.cast("binary")), 1, 12).alias("citation_key"), F.concat(source, F.lit("_"), F.col("doc_id"), F.lit(".txt")).alias("name"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
    SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '^•+$|版权归©|免责条款|地址[:：]|[.]{3,}|^[0-9]{1,2} / ?[0-9]{1,2}$|^[0-9]{1,2} of [0-9]{1,2}$|^http://[^ ]{12,}|(资料|数据)来源[:：]|[0-9a-z._-]+@[a-z0-9-]+[.][a-z]{2,3}|[(]cid *: *[0-9]+ *[)]')) AS garbage, count(*) AS lines FROM l GROUP BY doc_id""")
def garbage_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    bad = F.rlike("line", F.lit(GARBAGE))
    return lines.groupBy("doc_id").agg(F.count_if(bad).alias("garbage"), F.count("*").alias("lines"))


@query(r"""WITH c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\d+') AS nums, regexp_extract_all(coalesce(text, ''), '(19|20)\d{2}') AS years FROM documents)
    SELECT doc_id, len(nums)::BIGINT AS numbers, len(years)::BIGINT AS years, len(nums) >= 4 OR (len(nums) >= 3 AND len(years) >= 1) AS dense FROM c""")
def table_dense(spark, d):
    """Texts with many numbers, or some and a year."""
    t = F.coalesce("text", F.lit(""))
    c = table(spark, d, "documents").select("doc_id", F.regexp_count(t, F.lit(r"\d+")).cast("long").alias("numbers"), F.regexp_count(t, F.lit(r"(19|20)\d{2}")).cast("long").alias("years"))
    return c.withColumn("dense", (F.col("numbers") >= 4) | ((F.col("numbers") >= 3) & (F.col("years") >= 1)))


# ---- task state ----


@query("""WITH l AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS status, max(ts) AS at, count(*) FILTER (WHERE event_type = 'error') AS retries FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN status IN ('click', 'view') THEN 'failed' ELSE status END AS status, status IN ('click', 'view') AS recovered, retries FROM l""")
def crash_recovery(spark, d):
    """Tasks whose last state is an active one are failed at a restart."""
    latest = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.count_if(F.col("event_type") == "error").alias("retries"))
    active = F.col("last").isin("click", "view")
    return latest.select("user_id", F.when(active, "failed").otherwise(F.col("last")).alias("status"), active.alias("recovered"), "retries")


@query("""WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS back FROM conversations) SELECT conv_id, turn, text, back FROM r WHERE back <= 3""")
def last_turns(spark, d):
    """The last three turns of each session."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc_nulls_last(), F.col("text").desc_nulls_last())
    return table(spark, d, "conversations").select("conv_id", "turn", "text", F.row_number().over(w).cast("long").alias("back")).where("back <= 3")
