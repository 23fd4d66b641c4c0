"""Registered queries on the evidence and the answers of legal questions, each with its SQL twin. See questions.py for their making."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lantern.functions import answers as A, questions as Q
from lantern.functions.text import canonical_citations, citations
from lantern.plans.catalog import query, table
from lantern.plans.questions import _CASE, _DATE8, _FILE, _NUMERAL, _OTHER, _P, _QUESTION, _TITLE, _distinct, _has, _profiled

_REF_NAME = _FILE.replace("doc_id", "(o_custkey + 8 * (o_orderkey + i) + CASE WHEN i = 1 THEN 3 ELSE 0 END)")
_REF_TEXT = f"""CASE (o_orderkey + i) % 5 WHEN 0 THEN '第' || {_NUMERAL} || '条　当事人应当遵守《' || {_TITLE} || '》。' WHEN 1 THEN '第' || CAST(o_orderkey % 300 + 1 AS STRING) || '条 处罚 500元'
    WHEN 2 THEN {_DATE8} || ' 修订 现行 指导性案例第' || CAST(o_custkey % 90 + 1 AS STRING) || '号' WHEN 3 THEN '申请条件：年满18周岁。申请材料：身份证' ELSE o_orderpriority END"""
_ANSWER = f"""CASE o_orderkey % 6 WHEN 0 THEN '结论：无法回答，缺少直接证据。##1$$' WHEN 1 THEN '依据《' || {_TITLE} || '》第' || {_NUMERAL} || '条 ##1$$' WHEN 2 THEN '结论：见 ' || {_TITLE} || ' ##2$$ 与 ' || {_OTHER} || ' ##1$$' || chr(10) || '差异见上'
    WHEN 3 THEN {_TITLE} || ' ' || {_DATE8} || ' [1] 【ID:2】' WHEN 4 THEN '答案在文件里' ELSE '结论：第' || CAST(o_orderkey % 300 + 1 AS STRING) || '条规定的对象与依据为关键 ##3$$##9$$' END"""
_R = f"refs AS (SELECT o_orderkey AS q_id, i::INT AS i, {_REF_NAME} AS name, {_REF_TEXT} AS text FROM orders, (SELECT unnest(range(3)) AS i) WHERE i < o_orderkey % 4)"


def references(spark, d) -> DataFrame:
    """Up to three pieces of evidence for each question: q_id, i, name, text."""
    made = table(spark, d, "orders").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2)))).where(F.col("i") < F.col("o_orderkey") % 4)
    return made.select(F.col("o_orderkey").alias("q_id"), "i", F.expr(_REF_NAME).alias("name"), F.expr(_REF_TEXT).alias("text"))


def _gathered(spark, d) -> DataFrame:
    """Each question with its evidence in order."""
    r = references(spark, d).groupBy("q_id").agg(F.sort_array(F.collect_list(F.struct("i", "name", "text"))).alias("refs"))
    return _profiled(spark, d).join(r, "q_id", "left").withColumn("refs", F.coalesce("refs", F.expr("cast(array() as array<struct<i:int,name:string,text:string>>)")))


def _anchors(field: str):
    return F.transform("refs", lambda r: A.anchor(r[field]))


_SEVERAL = f"(regexp_matches(question, '{'|'.join(x.replace('+', '[+]') for x in A.PAIRS)}|第[0-9一二三四五六七八九十]{{1,2}}期和第[0-9一二三四五六七八九十]{{1,2}}期') OR len(regexp_extract_all(question, '{A.PAIR}')) >= 2)"


@query(f"""WITH {_P}, b AS (SELECT *, {_has(A.CERTAIN, 'question')} OR (regexp_matches(question, '只要|直接给|精确到|精确返回') AND NOT regexp_matches(question, '解释|理由|差异|区别')) AS certain,
        {_has(A.SEMANTIC, "regexp_replace(question, '不要泛泛解释|不要解释|不需要解释', '', 'g')")} OR intent IN ('case_reasoning', 'comparison', 'penalty_elements') AS semantic, regexp_matches(question, '有没有|是否有|是否存在|找不到|没有的话') AS ex FROM profile),
    c AS (SELECT *, certain OR {_SEVERAL} OR contains(question, '只输出文件名') OR (intent = 'article_locate' AND NOT regexp_matches(question, '解释|含义|理由|比较|对比|区别')) AS rule FROM b)
    SELECT q_id, CASE WHEN ex OR rule THEN 'A' WHEN semantic THEN 'B' ELSE 'A' END AS class, CASE WHEN ex OR rule OR NOT semantic THEN 'rule' ELSE 'model' END AS mode, CASE WHEN ex THEN 'none' WHEN rule OR NOT semantic THEN 'model' ELSE 'rule' END AS fallback,
        CASE WHEN ex THEN 'abstain_guarded_existence_query' WHEN rule THEN 'rule_first_high_certainty:' || intent WHEN semantic THEN 'semantic_intent:' || intent ELSE 'high_certainty_or_rule_extract:' || intent END AS reason FROM c""")
def answer_decisions(spark, d):
    """Rules or a model first, and why."""
    p = _profiled(spark, d)
    plain = Q.intent_of(A.without_refusals(F.col("question")))
    return p.select("q_id", *(c.alias(n) for n, c in A.decision(F.col("question"), F.col("intent"), plain).items()))


def _anc(c: str) -> str:
    return f"regexp_replace(replace({c}, '　', ' '), '\\s+', '', 'g')"


_STRIP = lambda c: f"regexp_replace({c}, '{A.EDGES}', '', 'g')"
_CLEAN = lambda c: _STRIP(f"coalesce(nullif(regexp_extract({_STRIP(_anc(c))}, '{A.PREFIX}', 1), ''), {_STRIP(_anc(c))})")
_CORE = lambda c: f"coalesce(nullif(regexp_extract(replace({c}, '中华人民共和国', ''), '^(.+?)(?:实施条例|办事指南|服务指南|申请表|申报表|合同|条例|公报|案例|法)$', 1), ''), replace({c}, '中华人民共和国', ''))"
_CHARS = lambda c: f"list_distinct(string_split({c}, ''))"
_FORMS = lambda c: f"list_distinct([{_anc(c)}, {', '.join(f'replace({_anc(c)}, {a!r}, {b!r})' for a, b in A.SAME)}])"
_GUARD = f"""{_P}, {_R}, g AS (SELECT p.*, coalesce(r.names, []) AS names, coalesce(r.texts, []) AS texts FROM profile p LEFT JOIN (SELECT q_id, list({_anc('name')} ORDER BY i) AS names, list({_anc('text')} ORDER BY i) AS texts FROM refs GROUP BY q_id) r ON p.q_id = r.q_id),
    t1 AS (SELECT *, array_to_string(names, chr(10)) AS docs, array_to_string(texts, chr(10)) AS body, {_distinct('a')} AS arts, {_distinct('c')} AS cs, {_distinct('dt')} AS ds,
        {_distinct(f"list_filter(list_transform(regexp_extract_all(question, '《([^》]{{2,80}})》', 1), lambda x: {_CLEAN('x')}) || list_transform(regexp_extract_all(question, '{A.BARE}'), lambda x: {_CLEAN('x')}), lambda x: NOT list_contains({list(A.NOISE)}, x))").replace('list_filter(list_filter', 'list_filter(list_filter')} AS raw FROM g),
    t2 AS (SELECT *, list_filter(t || raw, lambda x: {_CLEAN('x')} <> '') AS named FROM t1),
    t3 AS (SELECT *, list_transform(named, lambda x: {_CLEAN('x')}) AS cleaned, list_filter(regexp_extract_all(question, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '(?:19|20)[0-9]{{6}}')) AS d8,
        list_filter({_CHARS(_anc('question'))}, lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]') AND NOT contains('{A.COMMON}', x)) AS mine FROM t2),
    t4 AS (SELECT *, coalesce(list_max(list_transform(names, lambda n: len(list_intersect(mine, {_CHARS('n')})))), 0) AS overlap, len(names) > 0 AND len(d8) > 0 AND len(list_filter(d8, lambda x: contains(docs, x))) > 0 AS dated,
        list_filter(list_transform(range(1, len(named) + 1), lambda j: {{'t': named[j], 'c': cleaned[j], 'first': list_position(cleaned, cleaned[j]) = j}}), lambda x: x.first) AS firsts FROM t3),
    t5 AS (SELECT *, list_transform(firsts, lambda x: {{'t': x.t, 'ok': len(list_filter({_FORMS('x.c')}, lambda v: contains(docs, v))) > 0 OR (len({_CHARS('x.c')}) >= 4 AND len(list_filter(names, lambda n: len(list_filter({_FORMS('x.c')},
            lambda v: NOT (starts_with(v, '中华人民共和国') AND NOT contains(n, {_CORE('v')})) AND (contains(n, v) OR len(list_intersect({_CHARS('v')}, {_CHARS('n')})) >= greatest(4, floor(len({_CHARS('v')}) * 0.72))))) > 0)) > 0)}}) AS tested FROM t4),
    t6 AS (SELECT *, len(names) > 0 AND {_has(A.LOW_BAR, 'question')} AND (len(list_filter(raw, lambda x: len(list_filter({_FORMS('x')}, lambda v: contains(docs, v))) > 0)) > 0 OR dated OR (regexp_matches(question, '申请表|申报表|办事指南|合同|公报') AND overlap >= 4) OR overlap >= 6) AS low,
        list_filter(cs, lambda x: NOT contains(docs, {_anc('x')})) AS lost_cases, {_SEVERAL} AS several FROM t5),
    t7 AS (SELECT *, CASE WHEN len(list_filter(tested, lambda x: x.ok)) > 0 AND NOT several THEN [] ELSE list_transform(list_filter(tested, lambda x: NOT x.ok AND NOT (len(cs) > 0 AND len(lost_cases) = 0 AND x.t IN ('需含案例', '案号', '指导性案例')) AND NOT (low AND list_contains({list(A.GENERIC)}, x.t))), lambda x: '缺少目标文档标题锚点: ' || x.t) END AS lost FROM t6),
    t8 AS (SELECT *, CASE WHEN len(names) = 0 THEN ['未检索到任何参考证据'] ELSE list_transform(list_filter(arts, lambda x: NOT contains(docs, x) AND NOT contains(body, x)), lambda x: '缺少条款锚点: ' || x) || list_transform(lost_cases, lambda x: '缺少案例锚点: ' || x)
        || list_transform(list_filter(ds, lambda x: NOT contains(docs, x) AND NOT contains(docs, regexp_replace(x, '[年月日]', '', 'g'))), lambda x: '缺少版本日期锚点: ' || x) || lost
        || CASE WHEN exact AND len(firsts) = 0 AND len(cs) = 0 AND len(ds) = 0 AND overlap < 4 AND NOT low AND NOT (dated AND (len(d8) > 0 OR regexp_matches(question, '版本|现行|修订|生效|第|期'))) THEN ['缺少可验证的目标文档名称锚点'] ELSE [] END
        || CASE WHEN several AND len(list_distinct(names)) < 2 THEN ['并列检索证据不足两个文档'] ELSE [] END END AS missing FROM t7),
    guarded AS (SELECT *, CASE WHEN len(names) = 0 THEN 'no_references' WHEN len(missing) = 0 THEN '' WHEN regexp_matches(question, '有没有|是否有|是否存在') THEN 'existence_not_proved' ELSE 'anchor_missing' END AS reason FROM t8)"""


@query(f"""WITH {_GUARD} SELECT q_id, reason, array_to_string(missing, '|') AS missing, CASE WHEN reason = '' THEN NULL ELSE '结论：无法回答，无法依据当前语料作答。' || chr(10) || '原因：缺少目标实体对应证据（' || reason || '）' || CASE WHEN len(names) > 0 THEN '##1$' || '$' ELSE '' END || chr(10) || '缺失信息：' || array_to_string(missing, '；') END AS abstain FROM guarded""")
def answerability(spark, d):
    """What the evidence lacks of what the question names, and the answer that says so."""
    g = _gathered(spark, d).withColumn("names", _anchors("name")).withColumn("texts", _anchors("text"))
    g = g.select("q_id", "names", A.guard(F.col("names"), F.col("texts")).alias("g")).select("q_id", "names", "g.*")
    text = A.abstain_text(F.col("reason"), F.col("missing"), F.size("names") > 0)
    return g.select("q_id", "reason", F.array_join("missing", "|").alias("missing"), F.when(F.col("reason") != "", text).alias("abstain"))


_MARK = "regexp_replace({}, '[\\[【] *(?:ID *[:：] *)?([0-9]{{1,6}}) *[\\]】]', '##\\1$' || '$', 'g')"
_CITED = f"list_distinct(list_filter(list_transform(regexp_extract_all({_MARK.format('answer')}, '##([0-9]{{1,6}})[$][$]', 1), lambda x: x::INT), lambda x: x >= 1 AND x <= n))"


@query(f"""WITH {_P}, {_R}, n AS (SELECT o_orderkey AS q_id, {_ANSWER} AS answer, (o_orderkey % 4)::INT AS n FROM orders), c AS (SELECT q_id, answer, n, {_CITED} AS cited FROM n),
    k AS (SELECT c.*, coalesce(r.names, []) AS names FROM c LEFT JOIN (SELECT q_id, list(name ORDER BY i) AS names FROM refs GROUP BY q_id) r ON c.q_id = r.q_id)
    SELECT q_id, array_to_string(list_sort(cited), '|') AS cited, len(cited)::INT AS n_cited, n > 0 AND len(cited) = 0 AS missing_citation, {_has(A.ABSTAIN, 'answer')} AS abstains,
        len(list_distinct(list_transform(cited, lambda j: names[j])))::INT AS n_documents, len(cited) > 0 AND len(list_filter(cited, lambda j: coalesce(names[j], '') = '')) = 0 AS bound FROM k""")
def answer_citations(spark, d):
    """Citations of an answer that point to evidence, and whether all of it is bound to a document."""
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("q_id"), F.expr(_ANSWER).alias("answer"))
    g = _gathered(spark, d).select("q_id", "refs").join(a, "q_id")
    n = F.size("refs")
    cited = F.filter(citations(canonical_citations(F.col("answer"))), lambda j: (j >= 1) & (j <= n))
    g = g.withColumn("cited", cited)
    names = F.transform("cited", lambda j: F.get(F.col("refs"), j - 1)["name"])
    return g.select(
        "q_id", F.array_join(F.array_sort("cited").cast("array<string>"), "|").alias("cited"), F.size("cited").alias("n_cited"), ((n > 0) & (F.size("cited") == 0)).alias("missing_citation"), Q.any_of(F.col("answer"), A.ABSTAIN).alias("abstains"),
        F.size(F.array_distinct(names)).alias("n_documents"), ((F.size("cited") > 0) & ~F.exists(names, lambda x: F.coalesce(x, F.lit("")) == "")).alias("bound"),
    )


_LOW = "regexp_replace(lower(translate({}, '（）《》【】：，。；', '()<>[]:,.;')), '[\\s　]+', '', 'g')"


@query(f"""WITH {_P}, {_R}, c AS (SELECT q_id, question, intent, {_distinct('a')} AS a, {_distinct('c')} AS c, {_distinct('dt')} AS dt, t, list_filter({list(Q.INTENT_DOC_TYPES)}, lambda x: contains(text, x)) AS ty FROM profile),
    x AS (SELECT c.*, i, name, refs.text AS body, {_LOW.format("name || ' ' || refs.text")} AS hay, 1.0 / (i + 1) AS fusion FROM c JOIN refs ON c.q_id = refs.q_id),
    s AS (SELECT q_id, i, name, (4 * len(list_filter(ty, lambda v: contains(hay, {_LOW.format('v')}))) + 6 * len(list_filter(a, lambda v: contains(hay, {_LOW.format('v')}))) + 6 * len(list_filter(c, lambda v: contains(hay, {_LOW.format('v')})))
        + 2 * len(list_filter(dt, lambda v: contains(hay, {_LOW.format('v')}))) + 6 * len(list_filter(t, lambda v: contains(hay, {_LOW.format('v')}))))::INT AS boost, round(fusion, 6)::DOUBLE AS fusion FROM x)
    SELECT q_id, i, name, boost, fusion, row_number() OVER (PARTITION BY q_id ORDER BY boost DESC, fusion DESC, i) AS place FROM s""")
def context_order(spark, d):
    """Evidence by how much of the question's terms it holds, then by fusion score and rank."""
    low = lambda c: F.regexp_replace(F.lower(F.translate(c, "（）《》【】：，。；", "()<>[]:,.;")), r"(?U)\s+", "")
    worth = (("type_terms", 4), ("article_terms", 6), ("case_terms", 6), ("date_terms", 2), ("title_terms", 6))
    p = _profiled(spark, d).select("q_id", *(w[0] for w in worth)).join(references(spark, d), "q_id")
    p = p.withColumn("hay", low(F.concat_ws(" ", "name", "text")))
    boost = sum((F.lit(n) * F.size(F.filter(c, lambda v: F.contains(F.col("hay"), low(v)))) for c, n in worth), F.lit(0))
    p = p.select("q_id", "i", "name", boost.alias("boost"), F.round(1 / (F.col("i") + 1), 6).alias("fusion"))
    return p.withColumn("place", F.row_number().over(Window.partitionBy("q_id").orderBy(F.col("boost").desc(), F.col("fusion").desc(), "i")))


_C = f"""must AS (SELECT q_id, m, nn, prefer, avoid, hard FROM (SELECT q_id, {_distinct("a || c || dt || t || regexp_extract_all(question, '[0-9]{4}版') || CASE WHEN contains(question, '公报') THEN ['公报'] ELSE [] END")} AS m,
        {_distinct("regexp_extract_all(question, '不要([^，。；,.]{1,24})', 1)")} AS nn, CASE WHEN intent IN ('case_reasoning', 'case_holding', 'comparison') THEN ['指导性案例', '司法解释'] WHEN contains(question, '公报') THEN ['公报'] ELSE [] END AS prefer,
        CASE WHEN contains(question, '公报') THEN ['解释'] ELSE [] END AS avoid, len(t) > 0 AND intent IN ('article_locate', 'version_effect', 'doc_precise') AS hard FROM profile))"""


@query(f"""WITH {_P}, {_R}, {_C}, x AS (SELECT p.q_id, refs.i, name, refs.text AS body, {_LOW.format("name || ' ' || refs.text")} AS hay, m, nn, prefer, avoid, hard, {_distinct('a')} AS a, {_distinct('c')} AS c, {_distinct('dt')} AS dt, t FROM profile p JOIN refs ON p.q_id = refs.q_id JOIN must ON must.q_id = p.q_id),
    k AS (SELECT *, len(list_filter(m, lambda v: contains(hay, {_LOW.format('v')}) OR contains(hay, regexp_replace({_LOW.format('v')}, '[<>]', '', 'g')))) AS mh, len(list_filter(nn, lambda v: contains(hay, {_LOW.format('v')}) OR contains(hay, regexp_replace({_LOW.format('v')}, '[<>]', '', 'g')))) AS nh,
        len(list_filter(t, lambda v: contains(hay, {_LOW.format('v')}))) AS th FROM x),
    s AS (SELECT *, (CASE WHEN len(list_filter(a, lambda v: contains(name, v) OR contains(body, v))) > 0 THEN 2 ELSE 0 END + CASE WHEN len(list_filter(c, lambda v: contains(name, v) OR contains(body, v))) > 0 THEN 2 ELSE 0 END + CASE WHEN len(list_filter(dt, lambda v: contains(name, v) OR contains(body, v))) > 0 THEN 1 ELSE 0 END
            + 3 * mh + CASE WHEN mh > 0 AND mh = len(m) THEN 5 ELSE 0 END)::INT AS hardness, CASE WHEN len(t) = 0 THEN 0 WHEN hard THEN CASE WHEN th > 0 THEN 8 * th ELSE -6 END ELSE 2 * th END::INT AS title,
        (3 * len(list_filter(prefer, lambda v: contains(name, v))) - 4 * len(list_filter(avoid, lambda v: contains(name, v))))::INT AS kind FROM k WHERE nh = 0)
    SELECT q_id, i, name, hardness, title, kind, row_number() OVER (PARTITION BY q_id ORDER BY hardness DESC, title DESC, kind DESC, i) AS place FROM s""")
def evidence_order(spark, d):
    """Evidence without what is refused, in the order of anchors, titles and kinds of document."""
    low = lambda c: F.regexp_replace(F.lower(F.translate(c, "（）《》【】：，。；", "()<>[]:,.;")), r"(?U)\s+", "")
    q, when = F.col("question"), (lambda c, *v: F.when(c, F.array(*map(F.lit, v))).otherwise(Q.strings()))
    gazette, comments = F.contains(q, F.lit("公报")), F.col("intent").isin("case_reasoning", "case_holding", "comparison")
    p = _profiled(spark, d).select(
        "q_id", "article_terms", "case_terms", "date_terms", "title_terms", Q.ordered_of(F.col("article_terms"), F.col("case_terms"), F.col("date_terms"), F.col("title_terms"), Q.every(q, "[0-9]{4}版"), when(gazette, "公报")).alias("must"),
        Q.ordered(Q.every(q, "不要([^，。；,.]{1,24})", 1)).alias("must_not"), F.when(comments, F.array(F.lit("指导性案例"), F.lit("司法解释"))).otherwise(when(gazette, "公报")).alias("prefer"), when(gazette, "解释").alias("avoid"),
        ((F.size("title_terms") > 0) & F.col("intent").isin("article_locate", "version_effect", "doc_precise")).alias("hard"),
    )
    x = p.join(references(spark, d), "q_id").withColumn("hay", low(F.concat_ws(" ", "name", "text")))
    fits = lambda v: F.contains(F.col("hay"), low(v)) | F.contains(F.col("hay"), F.regexp_replace(low(v), "[<>]", ""))
    held = lambda c, n: F.when(F.exists(c, lambda v: F.contains(F.col("name"), v) | F.contains(F.col("text"), v)), n).otherwise(0)
    named = lambda c: F.size(F.filter(c, lambda v: F.contains(F.col("name"), v)))
    x = x.where(~F.exists("must_not", fits)).withColumn("met", F.size(F.filter("must", fits))).withColumn("th", F.size(F.filter("title_terms", lambda v: F.contains(F.col("hay"), low(v)))))
    hardness = held("article_terms", 2) + held("case_terms", 2) + held("date_terms", 1) + 3 * F.col("met") + F.when((F.col("met") > 0) & (F.col("met") == F.size("must")), 5).otherwise(0)
    title = F.when(F.size("title_terms") == 0, 0).when(F.col("hard"), F.when(F.col("th") > 0, 8 * F.col("th")).otherwise(-6)).otherwise(2 * F.col("th"))
    x = x.select("q_id", "i", "name", hardness.alias("hardness"), title.alias("title"), (3 * named("prefer") - 4 * named("avoid")).alias("kind"))
    return x.withColumn("place", F.row_number().over(Window.partitionBy("q_id").orderBy(F.col("hardness").desc(), F.col("title").desc(), F.col("kind").desc(), "i")))
