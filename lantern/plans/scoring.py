"""Registered queries on reports, checks of answers, fallbacks, markdown and cases, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lantern.functions import answers as A, questions as Q
from lantern.functions.text import canonical_citations, citations
from lantern.operators import metrics
from lantern.plans.answers import _ANSWER, _CITED, _CLEAN, _CORE, _FORMS, _GUARD, _MARK, _R, _SEVERAL, _anc, _anchors, _gathered, answer_decisions, references
from lantern.plans.catalog import query, table
from lantern.plans.evidence import _BOXES, _boxes
from lantern.plans.questions import _FILE, _P, _Q, _distinct, _has, _profiled, asked, questions

# ---- reports ----

_RESULTS = f"""{_Q}, {_R}, res AS (SELECT a.q_id, a.route, o_totalprice / 100 AS latency, min(i + 1) FILTER (WHERE len(list_filter(titles, lambda t: contains(name, t))) > 0) AS document_rank, len(articles) > 0 AS expected,
        min(i + 1) FILTER (WHERE len(list_filter(articles, lambda x: contains(text, x))) > 0) AS evidence_rank FROM asked a JOIN orders ON a.q_id = o_orderkey LEFT JOIN refs ON a.q_id = refs.q_id GROUP BY a.q_id, a.route, o_totalprice, articles)"""


def _results(spark, d) -> DataFrame:
    """For each question the rank of the first file with a title of it, and of the first evidence with an article of it."""
    a = asked(spark, d).select("q_id", "route", "titles", "articles").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("q_id"), (F.col("o_totalprice") / 100).alias("latency")), "q_id")
    held = lambda words, c: F.exists(words, lambda t: F.contains(F.col(c), t))
    r = a.join(references(spark, d), "q_id", "left")
    ranks = r.groupBy("q_id").agg(F.min(F.when(held("titles", "name"), F.col("i") + 1)).alias("document_rank"), F.min(F.when(held("articles", "text"), F.col("i") + 1)).alias("evidence_rank"))
    return a.join(ranks, "q_id").select("q_id", "route", "latency", "document_rank", "evidence_rank", (F.size("articles") > 0).alias("expected"))


@query(f"""WITH {_RESULTS}, p AS (SELECT route, list_sort(list(latency)) AS s, count(*) AS n FROM res GROUP BY GROUPING SETS ((), (route))),
    m AS (SELECT route, count(*) AS cases, round(avg(coalesce(document_rank <= 1, false)::INT), 6) AS hit_1, round(avg(coalesce(document_rank <= 3, false)::INT), 6) AS hit_3, round(avg(coalesce(1.0 / document_rank, 0)), 6) AS mrr, round(avg(latency), 4) AS avg_latency, max(latency) AS max_latency,
        count(*) FILTER (WHERE expected) AS evidence_cases, round(coalesce(avg(coalesce(evidence_rank <= 3, false)::INT) FILTER (WHERE expected), 0), 6) AS evidence_hit_3 FROM res GROUP BY GROUPING SETS ((), (route)))
    SELECT m.*, s[(round_even((n - 1) * 0.95, 0) + 1)::INT] AS p95_latency FROM m JOIN p ON m.route IS NOT DISTINCT FROM p.route""")
def retrieval_report(spark, d):
    """Ranks, latencies and evidence of all cases and of each route."""
    r = _results(spark, d)
    share = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    hit = lambda c, n: F.coalesce(F.col(c) <= n, F.lit(False)).cast("double")
    m = r.groupingSets([[], ["route"]], "route").agg(
        F.count("*").alias("cases"), share(hit("document_rank", 1)).alias("hit_1"), share(hit("document_rank", 3)).alias("hit_3"), share(F.coalesce(1 / F.col("document_rank"), F.lit(0.0))).alias("mrr"), F.round(F.avg("latency"), 4).alias("avg_latency"),
        F.max("latency").alias("max_latency"), F.count_if("expected").alias("evidence_cases"), share(F.when(F.col("expected"), hit("evidence_rank", 3))).alias("evidence_hit_3"),
    )
    both = r.select("route", "latency").unionByName(r.select(F.lit(None).cast("string").alias("route"), "latency"))
    p = metrics.percentile(both, "route", "latency", 0.95).select(F.col("route").alias("r"), F.col("percentile").alias("p95_latency"))
    return m.join(p, F.col("route").eqNullSafe(F.col("r"))).drop("r")


@query(f"""WITH {_GUARD}, o AS (SELECT g.q_id, reason, {_has(A.CERTAIN, 'question')} OR {_SEVERAL} AS rule FROM guarded g)
    SELECT CASE WHEN reason <> '' THEN 'abstain' WHEN rule THEN 'rule' ELSE 'other' END AS outcome, reason, count(*) AS n FROM o GROUP BY ALL""")
def answer_outcomes(spark, d):
    """How many questions end without an answer for want of evidence, and how many of the others are left to rules."""
    g = _gathered(spark, d).withColumn("names", _anchors("name")).withColumn("texts", _anchors("text"))
    g = g.select("question", A.guard(F.col("names"), F.col("texts"))["reason"].alias("reason"))
    rule = Q.any_of(F.col("question"), A.CERTAIN) | A.wants_several(F.col("question"))
    return g.groupBy(F.when(F.col("reason") != "", "abstain").when(rule, "rule").otherwise("other").alias("outcome"), "reason").agg(F.count("*").alias("n"))


# ---- checks of answers ----

_YEARS = lambda p: f"CASE WHEN regexp_full_match({p}, '20[0-9]{{2}}年') THEN [left({p}, 4)] ELSE [] END"
_HIT = lambda t, p: f"(contains({t}, {_anc(p)}) OR len(list_filter({_YEARS(_anc(p))}, lambda v: contains({t}, v))) > 0)"


@query(f"""WITH {_P}, {_R}, base AS (SELECT p.q_id, question, o_orderkey % 4 AS n, regexp_replace(replace({_MARK.format(_ANSWER)}, '　', ' '), '[ ]+', ' ', 'g') AS answer, {_distinct(f"a || regexp_extract_all(question, '指导性案例第?[0-9]+号') || list_filter(regexp_extract_all(question, '[{chr(92)}p{{L}}{chr(92)}p{{N}}_]+'), lambda x: regexp_full_match(x, '(?:19|20)[0-9]{{6}}')) || regexp_extract_all(question, '(?:19|20)[0-9]{{2}}版') || regexp_extract_all(question, '(?:19|20)[0-9]{{2}}年(?:[0-9]{{1,2}}月(?:[0-9]{{1,2}}日)?)?')")} AS required FROM profile p JOIN orders ON p.q_id = o_orderkey),
    c AS (SELECT *, {_CITED} AS cited, {_anc('answer')} AS hay, {_SEVERAL} AS several FROM base),
    l AS (SELECT c.*, coalesce(r.names, []) AS names FROM c LEFT JOIN (SELECT q_id, list(name ORDER BY i) AS names FROM refs GROUP BY q_id) r ON c.q_id = r.q_id)
    SELECT q_id, array_to_string(CASE WHEN n > 0 AND len(cited) = 0 THEN ['missing_citation'] ELSE [] END || CASE WHEN {_has(A.ABSTAIN, 'answer')} THEN ['unexpected_abstain'] ELSE [] END
        || CASE WHEN several AND len(list_filter(string_split(answer, chr(10)), lambda x: trim(x) <> '')) < 2 AND len(cited) < 2 AND len(list_distinct(list_transform(cited, lambda j: names[j]))) < 2 THEN ['pair_documents_not_complete'] ELSE [] END
        || list_transform(list_filter(required, lambda p: NOT {_HIT('hay', 'p')}), lambda p: 'missing_required_phrase:' || p), '|') AS failures FROM l""")
def answer_checks(spark, d):
    """What an answer lacks: citations, both documents of a pair, phrases that the question asks for; or that it shouldn't abstain."""
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("q_id"), F.expr(_ANSWER).alias("answer"))
    g = _gathered(spark, d).join(a, "q_id").withColumn("answer", canonical_citations(F.col("answer")))
    q, text = F.col("question"), F.col("answer")
    required = Q.ordered_of(F.col("article_terms"), Q.every(q, "指导性案例第?[0-9]+号"), Q.every(q, A.DATE8), Q.every(q, "(?:19|20)[0-9]{2}版"), Q.every(q, "(?:19|20)[0-9]{2}年(?:[0-9]{1,2}月(?:[0-9]{1,2}日)?)?"))
    cited = F.filter(citations(text), lambda j: (j >= 1) & (j <= F.size("refs")))
    g = g.select("q_id", "question", "answer", "refs", required.alias("required"), cited.alias("cited"))
    documents = F.array_distinct(F.transform("cited", lambda j: F.get(F.col("refs"), j - 1)["name"]))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    when = lambda c, name: F.when(c, F.array(F.lit(name))).otherwise(Q.strings())
    pair = A.wants_several(q) & (F.size(lines) < 2) & (F.size("cited") < 2) & (F.size(documents) < 2)
    lost = F.transform(F.filter("required", lambda p: ~A.phrase_hit(text, p)), lambda p: F.concat(F.lit("missing_required_phrase:"), p))
    every = F.concat(when((F.size("refs") > 0) & (F.size("cited") == 0), "missing_citation"), when(Q.any_of(text, A.ABSTAIN), "unexpected_abstain"), when(pair, "pair_documents_not_complete"), lost)
    return g.select("q_id", F.array_join(every, "|").alias("failures"))


@query(f"""WITH {_Q}, {_R}, x AS (SELECT a.q_id, i, art, text FROM (SELECT q_id, unnest(articles) AS art FROM asked) a JOIN refs ON a.q_id = refs.q_id WHERE contains(text, art))
    SELECT q_id, art, i, CASE WHEN length(s) > 180 THEN rtrim(left(s, 177)) || '...' ELSE s END AS snippet FROM (SELECT q_id, art, i, trim(regexp_extract(text, art || '([^第]*)')) AS s FROM x) QUALIFY row_number() OVER (PARTITION BY q_id, art ORDER BY i) = 1""")
def article_snippets(spark, d):
    """An article's text up to the next one, from the first evidence that holds it."""
    a = asked(spark, d).select("q_id", F.explode("articles").alias("art"))
    x = a.join(references(spark, d), "q_id").where(F.contains("text", F.col("art"))).groupBy("q_id", "art").agg(F.min(F.struct("i", "text")).alias("m"))
    tail = F.expr("substring(m.text, locate(art, m.text) + length(art))")
    s = F.trim(F.concat("art", F.regexp_extract(tail, "^[^第]*", 0)))
    return x.select("q_id", "art", "m.i", F.when(F.length(s) > 180, F.concat(F.rtrim(F.substring(s, 1, 177)), F.lit("..."))).otherwise(s).alias("snippet"))


@query(f"""WITH {_GUARD} SELECT q_id, unnest(list_distinct(flatten(list_transform(raw, lambda x: {_FORMS('x')})))) AS form, NULL::VARCHAR AS core FROM guarded WHERE len(raw) > 0
    UNION ALL SELECT q_id, unnest(list_distinct(list_transform(raw, lambda x: {_CORE(_anc('x'))}))), 'core' FROM guarded WHERE len(raw) > 0""")
def title_forms(spark, d):
    """All ways to write the titles of a question, and their cores."""
    t = questions(spark, d).select("q_id", A.raw_titles(F.trim("q")).alias("raw")).where(F.size("raw") > 0)
    forms = t.select("q_id", F.explode(F.array_distinct(F.flatten(F.transform("raw", A.variants)))).alias("form"), F.lit(None).cast("string").alias("core"))
    return forms.unionByName(t.select("q_id", F.explode(F.array_distinct(F.transform("raw", lambda x: A.core(A.anchor(x))))).alias("form"), F.lit("core").alias("core")))


# ---- routes and fallbacks ----

# What a question may ask for.
_ASKS = ("法条原文", "条文原文", "法律原文", "司法解释原文", "指导性案例原文", "完整条文", "全文", "原文", "不要解读", "不看解读", "仅要法条", "仅要条文")
_SUMS = ("摘要", "表格", "办事流程", "申请材料", "受理条件", "办理时限", "不用全文", "不看全文", "不用整本", "不看整本")


@query(f"""WITH {_P} SELECT q_id, contains(question, '公报') AND regexp_matches(question, '20[0-9]{{2}}|第\\s*[0-9一二两三四五六七八九十百]+\\s*期') AS gazette, contains(question, '公报') OR regexp_matches(question, '第\\s*[0-9一二两三四五六七八九十百]+\\s*期') AS legacy,
        NOT is_table AND ((contains(text, '公报') AND regexp_matches(text, '第|期|并列|同时')) OR ({_has(_ASKS, 'question')} AND NOT {_has(_SUMS, 'question')} AND (regexp_matches(question, '(?:不要|不看|不用).{{0,8}}(?:解读|评述|点评|说明)') OR NOT regexp_matches(question, '点评|研报')))) AS original,
        array_to_string(list_filter([CASE WHEN regexp_matches(question, '条|款|项') THEN '法条' END, CASE WHEN regexp_matches(question, '申请条件|申请材料|办理流程|办理时限') THEN '程序要素' END, CASE WHEN regexp_matches(question, '违约责任|解除条件|争议解决') THEN '合同条款' END], lambda x: x IS NOT NULL), '|') AS measures,
        regexp_matches(question, '现行|修订|生效') AND regexp_matches(question, '比较|对比|区别') AS mixed FROM profile""")
def question_predicates(spark, d):
    """Which way a question goes: gazettes, the older route, originals; what it measures, and whether it compares versions."""
    p = _profiled(spark, d)
    q, issue = F.col("question"), r"第\s*[0-9一二两三四五六七八九十百]+\s*期"
    gazette = F.contains(q, F.lit("公报"))
    wants = F.contains(F.col("text"), F.lit("公报")) & Q.any_of(F.col("text"), ("第", "期", "并列", "同时"))
    plain = Q.any_of(q, _ASKS) & ~Q.any_of(q, _SUMS) & (F.rlike(q, F.lit("(?:不要|不看|不用).{0,8}(?:解读|评述|点评|说明)")) | ~Q.any_of(q, ("点评", "研报")))
    when = lambda words, name: F.when(Q.any_of(q, words), F.lit(name))
    measures = F.array_compact(F.array(when(("条", "款", "项"), "法条"), when(("申请条件", "申请材料", "办理流程", "办理时限"), "程序要素"), when(("违约责任", "解除条件", "争议解决"), "合同条款")))
    mixed = Q.any_of(q, ("现行", "修订", "生效")) & Q.any_of(q, ("比较", "对比", "区别"))
    return p.select("q_id", (gazette & F.rlike(q, F.lit(f"20[0-9]{{2}}|{issue}"))).alias("gazette"), (gazette | F.rlike(q, F.lit(issue))).alias("legacy"), (~F.col("is_table") & (wants | plain)).alias("original"), F.array_join(measures, "|").alias("measures"), mixed.alias("mixed"))


@query(f"""WITH {_Q}, {_R}, sc AS (SELECT a.q_id, i, name, (len(list_filter(titles, lambda t: contains(name, t))) + len(list_filter(titles, lambda t: contains(text, t))) + len(list_filter((years || dates)[1:6], lambda t: contains(name, t))) + len(list_filter((years || dates)[1:6], lambda t: contains(text, t))))::INT AS score
        FROM asked a JOIN refs ON a.q_id = refs.q_id) SELECT q_id, i, name, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, i) AS place FROM sc WHERE score > 0""")
def name_fallback(spark, d):
    """Evidence found by phrases of titles and up to six dates in names and texts, the most hits first."""
    a = asked(spark, d).select("q_id", "titles", F.slice(F.concat("years", "dates"), 1, 6).alias("periods"))
    x = a.join(references(spark, d), "q_id")
    n = lambda words, c: F.size(F.filter(words, lambda t: F.contains(F.col(c), t)))
    x = x.select("q_id", "i", "name", (n("titles", "name") + n("titles", "text") + n("periods", "name") + n("periods", "text")).alias("score")).where("score > 0")
    return x.withColumn("place", F.row_number().over(Window.partitionBy("q_id").orderBy(F.col("score").desc(), "i")))


@query(f"""WITH {_Q}, {_R}, n AS (SELECT q_id, count(*) AS n FROM refs GROUP BY q_id) SELECT a.q_id, CASE WHEN coalesce(n, 0) = 0 OR route IN ('law_article_lookup', 'general') THEN false WHEN route = 'version_lookup' THEN len(titles) > 0 AND len(dates) > 0 ELSE n >= least(wanted, 5) END AS enough FROM asked a LEFT JOIN n ON a.q_id = n.q_id""")
def metadata_enough(spark, d):
    """Whether files found by name answer a question without a search."""
    n = references(spark, d).groupBy("q_id").agg(F.count("*").alias("n"))
    none = (F.coalesce("n", F.lit(0)) == 0) | F.col("route").isin("law_article_lookup", "general")
    enough = F.when(none, False).when(F.col("route") == "version_lookup", (F.size("titles") > 0) & (F.size("dates") > 0)).otherwise(F.col("n") >= F.least(F.col("wanted"), F.lit(5)))
    return asked(spark, d).join(n, "q_id", "left").select("q_id", enough.alias("enough"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, coalesce(value, 0) AS v, max((event_type = 'click')::INT) OVER (PARTITION BY user_id) = 1 AS has FROM events)
    SELECT event_id, round(v + CASE WHEN NOT has THEN 0 WHEN event_type = 'click' THEN 0.06 ELSE -0.06 END, 6) AS adjusted FROM e""")
def family_adjusted(spark, d):
    """Scores of a group are moved up or down only where the group has a member of the family that was asked for."""
    mine = F.col("event_type") == "click"
    has = F.max(mine.cast("int")).over(Window.partitionBy("user_id")) == 1
    e = table(spark, d, "events").select("event_id", F.coalesce("value", F.lit(0.0)).alias("v"), mine.alias("mine"), has.alias("has"))
    return e.select("event_id", F.round(F.col("v") + F.when(~F.col("has"), 0.0).when(F.col("mine"), 0.06).otherwise(-0.06), 6).alias("adjusted"))


# ---- markdown, cells, cases ----

# Patterns of bordered and borderless tables.
_TABLE, _BARE = r"(?:\n|^)(?:\|.*?\|.*?\|.*?\n)(?:\|(?:\s*[:-]+[-| :]*\s*)\|.*?\n)(?:\|.*?\|.*?\|.*?\n)+", r"(?:\n|^)(?:\S.*?\|.*?\n)(?:(?:\s*[:-]+[-| :]*\s*).*?\n)(?:\S.*?\|.*?\n)+"
_MD = """CASE page_id % 3 WHEN 0 THEN 'intro' || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | ' || url || ' |' || chr(10) || '| 2 | y |' || chr(10) || 'tail' WHEN 1 THEN '# head' || chr(10) || url || chr(10) || 'k | v' || chr(10) || '--- | ---' || chr(10) || 'x | 1' || chr(10) || 'end' ELSE url || chr(10) || '## two' || chr(10) || 'body' END || chr(10)"""


@query(rf"""WITH m AS (SELECT page_id, {_MD} AS t FROM pages), a AS (SELECT page_id, len(regexp_extract_all(t, '{_TABLE}')) AS n, regexp_replace(t, '{_TABLE}', '', 'g') AS rest FROM m)
    SELECT page_id, (n + len(regexp_extract_all(rest, '{_BARE}')))::INT AS tables, regexp_replace(rest, '{_BARE}', '', 'g') AS rest FROM a""")
def markdown_tables(spark, d):
    """Tables of a Markdown text, with and without borders, and what is left of it."""
    m = table(spark, d, "pages").select("page_id", F.expr(_MD).alias("t"))
    m = m.select("page_id", F.size(Q.every(F.col("t"), _TABLE)).alias("n"), F.regexp_replace("t", _TABLE, "").alias("rest"))
    return m.select("page_id", (F.col("n") + F.size(Q.every(F.col("rest"), _BARE))).alias("tables"), F.regexp_replace("rest", _BARE, "").alias("rest"))


@query(f"""WITH {_BOXES} SELECT page, box, dense_rank() OVER (PARTITION BY page ORDER BY floor(top / 12)) - 1 AS row_no, dense_rank() OVER (PARTITION BY page ORDER BY floor(x0 / 20)) - 1 AS col_no FROM b""")
def cell_numbers(spark, d):
    """Rows and columns of cells by the bands in which they stand."""
    rank = lambda c, n: F.dense_rank().over(Window.partitionBy("page").orderBy(F.floor(F.col(c) / n))) - 1
    return _boxes(spark, d).select("page", "box", rank("top", 12).alias("row_no"), rank("x0", 20).alias("col_no"))


@query(f"""WITH f AS (SELECT DISTINCT regexp_replace({_FILE}, '[.][^.]+$', '') AS stem FROM documents), t AS (SELECT stem, unnest(CASE WHEN contains(stem, '公报') THEN ['gazette', 'same_name'] WHEN regexp_matches(stem, '_[0-9]{{8}}$') THEN ['version', 'pair', 'title'] ELSE ['title'] END) AS kind FROM f)
    SELECT 'case_' || lpad(row_number() OVER (ORDER BY stem, kind)::VARCHAR, 5, '0') AS id, kind, CASE kind WHEN 'gazette' THEN stem || '对应哪一期公报' WHEN 'same_name' THEN '同名文件中只要' || stem WHEN 'version' THEN '《' || regexp_replace(stem, '_[0-9]{{8}}$', '') || '》' || right(stem, 8) || '版在哪里' WHEN 'pair' THEN '比较《' || regexp_replace(stem, '_[0-9]{{8}}$', '') || '》基础版与' || right(stem, 8) ELSE '《' || stem || '》原文' END AS question, stem AS expected FROM t""")
def benchmark_cases(spark, d):
    """Questions made for each file by its kind, with stable ids. Names of files are few: they are numbered in one task."""
    f = table(spark, d, "documents").select(F.regexp_replace(F.expr(_FILE), "[.][^.]+$", "").alias("stem")).distinct()
    stem, dated = F.col("stem"), F.regexp_replace("stem", "_[0-9]{8}$", "")
    kinds = F.when(F.contains(stem, F.lit("公报")), F.array(F.lit("gazette"), F.lit("same_name"))).when(F.rlike(stem, F.lit("_[0-9]{8}$")), F.array(F.lit("version"), F.lit("pair"), F.lit("title"))).otherwise(F.array(F.lit("title")))
    k, day = F.col("kind"), F.right(stem, F.lit(8))
    text = (
        F.when(k == "gazette", F.concat(stem, F.lit("对应哪一期公报"))).when(k == "same_name", F.concat(F.lit("同名文件中只要"), stem)).when(k == "version", F.concat(F.lit("《"), dated, F.lit("》"), day, F.lit("版在哪里")))
        .when(k == "pair", F.concat(F.lit("比较《"), dated, F.lit("》基础版与"), day)).otherwise(F.concat(F.lit("《"), stem, F.lit("》原文")))
    )
    number = F.row_number().over(Window.orderBy("stem", "kind")).cast("string")
    return f.select("stem", F.explode(kinds).alias("kind")).select(F.concat(F.lit("case_"), F.lpad(number, 5, "0")).alias("id"), "kind", text.alias("question"), stem.alias("expected"))


@query(f"""WITH {_R}, k AS (SELECT q_id, i, sha1(name || '||' || text)[:12] AS key FROM refs), f AS (SELECT q_id, key, min(i) + 1 AS citation_index FROM k GROUP BY q_id, key)
    SELECT k.q_id, i, citation_index::INT AS citation_index FROM k JOIN f ON k.q_id = f.q_id AND k.key = f.key""")
def citation_index(spark, d):
    """The number under which a piece of evidence is cited: that of the first one with the same key."""
    k = references(spark, d).select("q_id", "i", F.substring(F.sha1(F.concat_ws("||", "name", "text").cast("binary")), 1, 12).alias("key"))
    return k.select("q_id", "i", (F.min("i").over(Window.partitionBy("q_id", "key")) + 1).alias("citation_index"))


@query(r"""WITH t AS (SELECT o_orderkey AS q_id, CASE o_orderkey % 4 WHEN 0 THEN '第' || (o_orderkey % 30) || '条 罚款 ' || (o_orderkey % 900 + 1) || '.50元' WHEN 1 THEN '增长' || (o_orderkey % 90) || '%，共3万元' WHEN 2 THEN '2亿元 与 1.0万' ELSE o_orderpriority END AS t FROM orders),
    m AS (SELECT q_id, unnest(regexp_extract_all(t, '[0-9]+(?:[.][0-9]+)?(?:亿元|亿|万元|万|元|%|条)')) AS x FROM t), p AS (SELECT q_id, regexp_extract(x, '^[0-9.]+')::DOUBLE AS n, regexp_extract(x, '[^0-9.]+$') AS u FROM m)
    SELECT DISTINCT q_id, round(CASE WHEN u IN ('亿元', '亿') THEN n * 100000000 WHEN u IN ('万元', '万') THEN n * 10000 ELSE n END, 4) AS value, CASE WHEN u = '条' THEN 'article' WHEN u = '%' THEN 'ratio' ELSE 'money' END AS kind FROM p""")
def numeric_mentions(spark, d):
    """Numbers with their units as values of a kind: articles, ratios, money in its smallest unit."""
    k = F.col("o_orderkey")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("第"), k % 30, F.lit("条 罚款 "), k % 900 + 1, F.lit(".50元"))).when(k % 4 == 1, F.concat(F.lit("增长"), k % 90, F.lit("%，共3万元"))).when(k % 4 == 2, F.lit("2亿元 与 1.0万")).otherwise(F.col("o_orderpriority"))
    )
    m = table(spark, d, "orders").select(k.alias("q_id"), F.explode(Q.every(text, "[0-9]+(?:[.][0-9]+)?(?:亿元|亿|万元|万|元|%|条)")).alias("x"))
    n, u = F.regexp_extract("x", "^[0-9.]+", 0).cast("double"), F.regexp_extract("x", "[^0-9.]+$", 0)
    scale = F.when(u.isin("亿元", "亿"), 1e8).when(u.isin("万元", "万"), 1e4).otherwise(1.0)
    return m.select("q_id", F.round(n * scale, 4).alias("value"), F.when(u == "条", "article").when(u == "%", "ratio").otherwise("money").alias("kind")).distinct()


@query(f"""WITH {_Q}, {_R}, y AS (SELECT q_id, list_distinct(flatten(list(regexp_extract_all(name || ' ' || text, '(?:19|20)[0-9]{{2}}')))) AS found FROM refs GROUP BY q_id)
    SELECT a.q_id, len(years) > 0 AND len(found) > 0 AND len(list_intersect(years, found)) = 0 AS conflict FROM asked a JOIN y ON a.q_id = y.q_id""")
def year_conflicts(spark, d):
    """Whether the years of a question and of its evidence have none in common."""
    y = references(spark, d).select("q_id", F.explode_outer(Q.years(F.concat_ws(" ", "name", "text"))).alias("y")).groupBy("q_id").agg(F.collect_set("y").alias("found"))
    return asked(spark, d).join(y, "q_id").select("q_id", ((F.size("years") > 0) & (F.size("found") > 0) & ~F.arrays_overlap("years", "found")).alias("conflict"))


# ---- sections, dictionaries, forms ----

_LINES = f"l AS (SELECT page_id, unnest(string_split(t, chr(10))) AS line, unnest(range(0, len(string_split(t, chr(10))))) AS n FROM (SELECT page_id, {_MD} AS t FROM pages))"
_WORDS = "len(regexp_extract_all(line, '[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]'))"


@query(f"""WITH {_LINES}, f AS (SELECT *, {_WORDS} > 12 AS large, starts_with(trim(line), '#') AS head FROM l),
    h AS (SELECT page_id, n, part, CASE WHEN large THEN CASE WHEN part = 0 THEN left(line, length(line) // 2) ELSE substr(line, length(line) // 2 + 1) END ELSE line END AS line, large, head AND NOT (large AND part = 1) AS head FROM f, (SELECT unnest(range(2)) AS part) WHERE large OR part = 0),
    s AS (SELECT *, last_value(CASE WHEN head THEN 1 WHEN large THEN 0 END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY n, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inside FROM h),
    g AS (SELECT *, sum((large OR head OR coalesce(inside, 0) = 0)::INT) OVER (PARTITION BY page_id ORDER BY n, part ROWS UNBOUNDED PRECEDING) AS section FROM s)
    SELECT page_id, section::INT AS section, string_agg(line, chr(10) ORDER BY n, part) AS text FROM g GROUP BY page_id, section""")
def markdown_sections(spark, d):
    """Lines of Markdown; those behind a heading belong to it, an overlong one is halved and stands alone."""
    m = table(spark, d, "pages").select("page_id", F.posexplode(F.split(F.expr(_MD), "\n", -1)).alias("n", "line"))
    large = F.regexp_count("line", F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")) > 12
    m = m.withColumn("large", large).withColumn("head", F.startswith(F.trim("line"), F.lit("#")))
    half = F.floor(F.length("line") / 2).cast("int")
    parts = F.when(F.col("large"), F.array(F.left("line", half), F.substring("line", half + 1, F.length("line")))).otherwise(F.array("line"))
    m = m.select("page_id", "n", "large", "head", F.posexplode(parts).alias("part", "line")).withColumn("head", F.col("head") & ~(F.col("large") & (F.col("part") == 1)))
    w = Window.partitionBy("page_id").orderBy("n", "part")
    inside = F.last(F.when(F.col("head"), 1).when(F.col("large"), 0), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (F.col("large") | F.col("head") | (F.coalesce(inside, F.lit(0)) == 0)).cast("int")
    g = m.withColumn("fresh", fresh).withColumn("section", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    g = g.groupBy("page_id", "section").agg(F.sort_array(F.collect_list(F.struct("n", "part", "line"))).alias("l"))
    return g.select("page_id", "section", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


_BULLETS = (("chapter", "^第[一二三四五六七八九十百0-9]+(?:编|章|节|条)"), ("number", "^[0-9]{1,2}[.、]"), ("mark", "^(?:#|[(（][一二三四五六七八九十0-9]+[)）])"), ("dash", "^[-|]"))


@query(f"""WITH {_LINES}, v AS (SELECT page_id, k, count(*) AS n FROM (SELECT page_id, unnest(list_filter([{', '.join(f"CASE WHEN regexp_matches(trim(line), '{p}') THEN {i} END" for i, (_, p) in enumerate(_BULLETS))}], lambda x: x IS NOT NULL)) AS k FROM l) GROUP BY page_id, k)
    SELECT page_id, {list(n for n, _ in _BULLETS)}[k + 1] AS kind, n FROM v QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, k) = 1""")
def bullet_votes(spark, d):
    """The kind of numbering that most lines of a page have, the first of equal ones."""
    lines = table(spark, d, "pages").select("page_id", F.explode(F.transform(F.split(F.expr(_MD), "\n"), lambda x: F.trim(x))).alias("line"))
    kinds = F.array_compact(F.array(*(F.when(F.rlike("line", F.lit(p)), F.lit(i)) for i, (_, p) in enumerate(_BULLETS))))
    v = lines.select("page_id", F.explode(kinds).alias("k")).groupBy("page_id", "k").agg(F.count("*").alias("n"))
    best = v.groupBy("page_id").agg(F.max_by(F.struct("k", "n"), F.struct("n", -F.col("k"))).alias("b"))
    return best.select("page_id", F.element_at(F.array(*(F.lit(n) for n, _ in _BULLETS)), F.col("b.k") + 1).alias("kind"), "b.n")


_ALIASES = {"economy": ("econ", "budget"), "standard": ("std", "default"), "promo": ("promotion",), "small": ("mini", "tiny"), "large": ("big", "huge")}


@query(f"""WITH e AS (SELECT unnest({list(_ALIASES)}) AS entry, unnest({[list(v) for v in _ALIASES.values()]}) AS aliases), t AS (SELECT p_partkey, lower(trim(p_type)) AS kind, lower(p_name) AS name FROM part)
    SELECT p_partkey, min(entry) AS entry, min(CASE WHEN kind = entry THEN 0 WHEN list_contains(aliases, kind) THEN 1 ELSE 2 END)::INT AS how FROM t JOIN e ON kind = entry OR list_contains(aliases, kind) OR contains(name, entry) GROUP BY p_partkey""")
def dictionary_lookup(spark, d):
    """Entries of a dictionary by name, by alias or inside a text; the dictionary is small and sent to all tasks."""
    entries = spark.createDataFrame([(k, list(v)) for k, v in _ALIASES.items()], "entry string, aliases array<string>")
    t = table(spark, d, "part").select("p_partkey", F.lower(F.trim("p_type")).alias("kind"), F.lower("p_name").alias("name"))
    alias = F.array_contains("aliases", F.col("kind"))
    how = F.when(F.col("kind") == F.col("entry"), 0).when(alias, 1).otherwise(2)
    found = t.join(F.broadcast(entries), (F.col("kind") == F.col("entry")) | alias | F.contains("name", F.col("entry")))
    return found.groupBy("p_partkey").agg(F.min("entry").alias("entry"), F.min(how).alias("how"))


@query("""SELECT o_orderkey, regexp_replace(regexp_replace(o_totalprice::DECIMAL(18, 2)::VARCHAR, '0+$', ''), '[.]$', '') AS price, sha256(json_object('status', o_orderstatus, 'total', regexp_replace(regexp_replace(o_totalprice::DECIMAL(18, 2)::VARCHAR, '0+$', ''), '[.]$', ''))::VARCHAR)[:16] AS id FROM orders""")
def canonical_records(spark, d):
    """Numbers without needless zeros, and ids of records by their canonical JSON."""
    price = F.regexp_replace(F.regexp_replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), "0+$", ""), "[.]$", "")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", price.alias("price"))
    return o.select("o_orderkey", "price", F.left(F.sha2(F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("price").alias("total"))), 256), F.lit(16)).alias("id"))


@query(f"""SELECT name, count(*) AS chunks, min(doc_id) AS first_id FROM (SELECT doc_id, {_FILE} AS name FROM documents) GROUP BY name""")
def indexed_names(spark, d):
    """Names in the index with the number of their chunks."""
    return table(spark, d, "documents").groupBy(F.expr(_FILE).alias("name")).agg(F.count("*").alias("chunks"), F.min("doc_id").alias("first_id"))


# ---- payloads ----


@query(f"""WITH {_R}, g AS (SELECT o_orderkey AS q_id, {_ANSWER} AS answer, (o_orderkey % 4)::INT AS n FROM orders), c AS (SELECT q_id, n, len({_CITED})::INT AS cited FROM g),
    f AS (SELECT q_id, name, min(i) AS i FROM refs GROUP BY q_id, name), t AS (SELECT q_id, string_agg(name, '|' ORDER BY i) FILTER (WHERE k <= 3) AS top FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY i) AS k FROM f) GROUP BY q_id)
    SELECT c.q_id, n AS evidence, cited, coalesce(top, '') AS documents, n > 0 AND cited = 0 AS review FROM c LEFT JOIN t ON c.q_id = t.q_id""")
def audit_payloads(spark, d):
    """What is kept of an answer: how much evidence it had, how much it cites, the first three documents, whether someone should look."""
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("q_id"), F.expr(_ANSWER).alias("answer"), (F.col("o_orderkey") % 4).cast("int").alias("evidence"))
    cited = F.size(F.filter(citations(canonical_citations(F.col("answer"))), lambda j: (j >= 1) & (j <= F.col("evidence"))))
    r = references(spark, d).groupBy("q_id").agg(F.sort_array(F.collect_list(F.struct("i", "name"))).alias("l"))
    top = F.array_join(F.slice(F.array_distinct(F.transform("l", lambda x: x["name"])), 1, 3), "|")
    a = a.select("q_id", "evidence", cited.alias("cited")).join(r.select("q_id", top.alias("documents")), "q_id", "left")
    return a.select("q_id", "evidence", "cited", F.coalesce("documents", F.lit("")).alias("documents"), ((F.col("evidence") > 0) & (F.col("cited") == 0)).alias("review"))


@query(f"""WITH {_R} SELECT q_id, i, '【' || regexp_replace(name, '[.][^.]+$', '') || '】' || CASE WHEN len(a) > 0 THEN '锚点：' || array_to_string(a, '、') || chr(10) ELSE '' END || text AS enriched, sha1(name || '#' || i)[:16] AS id
    FROM (SELECT *, {_distinct(f"regexp_extract_all(text, '{Q.ARTICLE}')")}[1:16] AS a FROM refs)""")
def enriched_chunks(spark, d):
    """A chunk's text behind its document's name and its first 16 anchors, with an id of its own."""
    r = references(spark, d).withColumn("a", F.slice(Q.ordered(Q.every(F.col("text"), Q.ARTICLE)), 1, 16))
    head = F.concat(F.lit("【"), F.regexp_replace("name", "[.][^.]+$", ""), F.lit("】"))
    anchors = F.when(F.size("a") > 0, F.concat(F.lit("锚点："), F.array_join("a", "、"), F.lit("\n"))).otherwise("")
    return r.select("q_id", "i", F.concat(head, anchors, F.col("text")).alias("enriched"), F.substring(F.sha1(F.concat_ws("#", "name", "i").cast("binary")), 1, 16).alias("id"))


_STOPS = ("第", "《", "的", "版", "现行", "公报", "年", "，")


@query(f"""WITH {_Q}, p AS (SELECT q_id, question, list_min(list_filter([{', '.join(f"strpos(question, '{w}')" for w in _STOPS)}], lambda x: x > 0)) AS stop FROM asked)
    SELECT q_id, CASE WHEN length(c) BETWEEN 2 AND 16 THEN c ELSE '' END AS subject FROM (SELECT q_id, string_split_regex(trim(CASE WHEN stop IS NULL THEN question ELSE left(question, stop - 1) END), '[，。？?：:\\s]')[1] AS c FROM p)""")
def subject_candidates(spark, d):
    """What stands before the first word that can't belong to a name, if it is as long as a name."""
    q = asked(spark, d).select("q_id", "question")
    places = F.filter(F.array(*(F.instr("question", w) for w in _STOPS)), lambda x: x > 0)
    stop = F.array_min(places)
    head = F.trim(F.when(stop.isNull(), F.col("question")).otherwise(F.left("question", stop - 1)))
    c = F.get(F.split(head, r"[，。？?：:\s]"), 0)
    return q.select("q_id", F.when(F.length(c).between(2, 16), c).otherwise("").alias("subject"))


_PERIODS = "CASE o_orderkey % 5 WHEN 0 THEN '2' || (o_orderkey % 10) || 'Q' || (o_orderkey % 4 + 1) || '营收' WHEN 1 THEN '2023年报与23H1' WHEN 2 THEN '2022三季报、2022半年报' WHEN 3 THEN '24q1 和 24Q1' ELSE o_orderpriority END"


@query(f"""WITH t AS (SELECT o_orderkey AS q_id, {_PERIODS} AS t FROM orders), x AS (SELECT q_id, regexp_extract_all(t, '(?i)[0-9]{{2}}(?:Q[1-4]|H[12])') || regexp_extract_all(t, '[0-9]{{4}}(?:年报|三季报|中报|半年报)') AS p FROM t)
    SELECT q_id, array_to_string({_distinct('p')}, '|') AS periods, len(p)::INT AS n FROM x""")
def report_periods(spark, d):
    """Quarters, halves and reports that a text names."""
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("q_id"), F.expr(_PERIODS).alias("t"))
    p = F.concat(Q.every(F.col("t"), "(?i)[0-9]{2}(?:Q[1-4]|H[12])"), Q.every(F.col("t"), "[0-9]{4}(?:年报|三季报|中报|半年报)"))
    return t.select("q_id", F.array_join(F.array_distinct(p), "|").alias("periods"), F.size(p).alias("n"))


@query("""SELECT event_id, floor(epoch(ts))::BIGINT AS seconds, strftime(ts, '%Y-%m') AS month, date_diff('day', ts::DATE, DATE '2030-01-01')::INT AS days, floor(date_diff('day', ts::DATE, DATE '2030-01-01') / 365.25)::INT AS age FROM events""")
def date_parts(spark, d):
    """Seconds, months, days and whole years up to a day."""
    days = F.datediff(F.lit("2030-01-01").cast("date"), F.to_date("ts"))
    return table(spark, d, "events").select("event_id", F.unix_timestamp("ts").alias("seconds"), F.date_format("ts", "yyyy-MM").alias("month"), days.alias("days"), F.floor(days / 365.25).cast("int").alias("age"))
