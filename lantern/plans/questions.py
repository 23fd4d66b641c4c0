"""Registered queries on legal questions and the documents they ask for, each with its SQL twin.

The given tables hold no questions, so each order makes one, from a template with its own title, article, issue and date; each
document makes the name of a file. The SQL that makes them is the same on both sides; what is read from them is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lantern.functions import questions as Q
from lantern.operators import corpus
from lantern.plans.catalog import query, table


def _pick(n: str, *values: str) -> str:
    return f"CASE ({n}) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_NAMES = ("民法典", "刑法", "著作权法", "专利法", "劳动合同法", "自然保护区条例", "行政处罚法", "行政处罚法实施条例")
_TITLE, _OTHER = _pick("o_custkey", *_NAMES), _pick("o_custkey + 3", *_NAMES)
_NUMERAL = _pick("o_orderkey", "二十三", "一百零五", "十", "三百四十一", "两千", "二〇二四", "7", "12")
_ISSUE, _ISSUE2 = _pick("o_custkey", *"一二三四五六七八九", "十", "11", "十二"), _pick("o_custkey + 5", *"一二三四五六七八九", "十", "11", "十二")
_DAY = "substr(CAST(o_orderdate AS STRING), 1, 10)"
_YEAR, _DATE8 = f"substr({_DAY}, 1, 4)", f"replace({_DAY}, '-', '')"
_TEMPLATES = (
    f"'请返回《' || {_TITLE} || '》第' || {_NUMERAL} || '条的原文'", f"'《' || {_TITLE} || '》第' || CAST(o_orderkey % 300 + 1 AS STRING) || '条怎么规定？'",
    f"'全国人大常委会公报' || {_YEAR} || '年第' || {_ISSUE} || '期'", f"{_YEAR} || '年公报第' || {_ISSUE} || '期，不要第' || {_ISSUE2} || '期'",
    f"'比较《' || {_TITLE} || '》与《' || {_OTHER} || '》的差异'", f"'《' || {_TITLE} || '》基础版与' || {_DATE8} || '版本对比'", f"'《' || {_TITLE} || '》基础版，不要带日期后缀'",
    f"'只要《' || {_TITLE} || '》 ' || {_DATE8} || ' 的文件'", f"'指导性案例第' || CAST(o_custkey % 90 + 1 AS STRING) || '号的裁判要旨是什么'",
    f"'同名文件去歧义：《' || {_TITLE} || '》，不要《' || {_OTHER} || '》正文'", f"'请问' || {_TITLE} || '现行版何时生效？'", "'办事指南的申请条件和申请材料有哪些'", "'合同解除的违约责任条款'",
    "'违约金上限是多少元'", "'劳动合同试用期期限多久'", "'自然保护区核心区的处罚情形'", f"'并列给出' || {_YEAR} || '年第' || {_ISSUE} || '期与第' || {_ISSUE2} || '期公报'",
    f"'是否包含《' || {_TITLE} || '》第' || {_NUMERAL} || '款'", "'裁判理由和争议焦点为什么'", f"'  《' || {_TITLE} || '》' || {_YEAR} || '年修订了什么，不要基础版 '",
    f"{_YEAR} || '年3月' || CAST(o_custkey % 28 + 1 AS STRING) || '日生效的' || {_TITLE}", "lower(o_orderpriority) || ' order status ' || o_orderstatus",
)
_QUESTION = f"CASE o_orderkey % {len(_TEMPLATES)} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_TEMPLATES)) + " END"
_FILE = f"""CASE WHEN doc_id % 5 = 0 THEN CAST(1992 + doc_id % 7 AS STRING) || '_' || CAST(doc_id % 12 + 1 AS STRING) || '_NPC公报.pdf'
    WHEN doc_id % 5 < 3 THEN {_pick("doc_id", *_NAMES)} || '_' || CAST(19920101 + (doc_id % 7) * 10000 + (doc_id % 12) * 100 + doc_id % 28 AS STRING) || '.pdf'
    WHEN doc_id % 5 = 3 THEN '中华人民共和国' || {_pick("doc_id", *_NAMES)} || '.pdf' ELSE '关于适用' || {_pick("doc_id", *_NAMES)} || '的解释.docx' END"""

_N = "0-9一二两三四五六七八九十百千〇零"


def _number(c: str) -> str:
    """SQL: a numeral's Arabic digits."""
    t = f"translate({c}, '零〇一二两三四五六七八九', '001223456789')"
    unit = lambda u, n: f"(CASE WHEN contains({t}, '{u}') THEN coalesce(try_cast(regexp_extract({t}, '([0-9]*){u}', 1) AS INT), 1) * {n} ELSE 0 END)"
    return f"(CASE WHEN regexp_full_match({c}, '[0-9]+') THEN {c}::BIGINT ELSE {unit('千', 1000)} + {unit('百', 100)} + {unit('十', 10)} + coalesce(try_cast(regexp_extract({t}, '([0-9]*)$', 1) AS INT), 0) END)::VARCHAR"


def _tidy(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^(?:请|给|我|你|帮|返回|定位|检索|提供|回答|并列|同时|不要|只要|答案)+', ''), '^[，。；：:、 ]+|[，。；：:、 ]+$', '', 'g')"


def _distinct(c: str) -> str:
    """SQL: first occurrences in order, without empty ones."""
    return f"list_filter({c}, lambda x, i: x <> '' AND list_position({c}, x) = i)"


_ENDS = "(?:法典|法律|法|实施条例|条例|规定|办法|公报|合同|指南|申请表|申报表|案例|标准)"
_Q = f"""q AS (SELECT o_orderkey AS q_id, trim({_QUESTION}) AS question FROM orders),
    s0 AS (SELECT *, list_transform(regexp_extract_all(question, '不要《([^》]{{2,120}})》', 1), lambda x: {_tidy('x')}) AS refused_titles,
        list_transform(regexp_extract_all(question, '《([^》]{{2,120}})》', 1), lambda x: {_tidy('x')}) AS quoted,
        list_transform(regexp_extract_all(question, '[\\x{{4e00}}-\\x{{9fa5}}A-Za-z0-9·（）()、]{{2,90}}?{_ENDS}'), lambda x: {_tidy('x')}) AS bare,
        regexp_extract_all(question, '(?:19|20)[0-9]{{2}}') AS ys, list_filter(regexp_extract_all(question, '[0-9]+'), lambda x: regexp_full_match(x, '(?:19|20)[0-9]{{6}}')) AS d8,
        list_transform(regexp_extract_all(question, '(?:19|20)[0-9]{{2}}年[0-9]{{1,2}}月[0-9]{{1,2}}日'), lambda x: substr(x, 1, 4) || lpad(regexp_extract(x, '年([0-9]+)月', 1), 2, '0') || lpad(regexp_extract(x, '月([0-9]+)日', 1), 2, '0')) AS dw,
        list_transform(regexp_extract_all(question, '第([{_N}]+)期', 1), lambda x: {_number('x')}) AS all_issues, list_transform(regexp_extract_all(question, '不要第([{_N}]+)期', 1), lambda x: {_number('x')}) AS refused_issues,
        list_transform(regexp_extract_all(question, '[{_N}]+(?:条|款|项|章|节|编)'), lambda x: '第' || {_number("left(x, length(x) - 1)")} || right(x, 1)) AS arts,
        regexp_extract_all(question, '指导性案例第?([0-9]+)号', 1) AS cases, regexp_extract_all(question, '不要([^，。；,.]{{1,28}})', 1) AS refs FROM q),
    s1 AS (SELECT *, list_filter(quoted, lambda x: NOT list_contains(refused_titles, x)) AS wanted_titles,
        list_filter(bare, lambda x: NOT regexp_matches(x, '^(?:请|给|我要|我只要|我担心)') AND NOT list_contains(refused_titles, x)) AS loose,
        list_filter(all_issues, lambda x: NOT list_contains(refused_issues, x)) AS iss, d8 || dw AS ds,
        refs || CASE WHEN contains(question, '不要基础版') THEN ['基础版'] ELSE [] END || CASE WHEN contains(question, '不要带日期') THEN ['带日期后缀', '日期后缀'] ELSE [] END AS refusals,
        regexp_matches(question, '同时|并列|对比|比较|》(?:与|和|及|以及)《|第[{_N}]+期(?:与|和|及|以及)第|基础版(?:与|和|及|以及)(?:现行版|最新版|(?:19|20)[0-9]{{6}})') AS parallel FROM s0),
    s AS (SELECT q_id, question, refused_titles, refused_issues, {_distinct('refusals')} AS refusals, parallel, {_distinct('ys')} AS years, {_distinct('iss')} AS issues, {_distinct('ds')} AS dates, {_distinct('arts')} AS articles, cases,
        CASE WHEN len(wanted_titles) > 0 THEN {_distinct('wanted_titles')} WHEN contains(question, '公报') THEN [CASE WHEN contains(question, '全国人大常委会') THEN '{Q.GAZETTE}' ELSE '公报' END] ELSE {_distinct('loose')} END AS titles FROM s1),
    r0 AS (SELECT *, CASE WHEN contains(question, '自然保护区') AND len(list_filter(titles, lambda x: contains(x, '自然保护区'))) = 0 THEN ['自然保护区'] ELSE [] END || CASE WHEN contains(question, '全国人大常委会公报') THEN ['{Q.GAZETTE}'] ELSE [] END AS subjects,
        CASE WHEN contains(question, '公报') AND len(years) + len(issues) > 0 THEN CASE WHEN len(refusals) > 0 OR regexp_matches(question, '同名|去歧义') THEN 'same_name_disambiguation' ELSE 'gazette_issue_lookup' END
            WHEN contains(question, '基础版') AND len(dates) > 0 AND parallel THEN 'version_diff_lookup' WHEN parallel AND (len(titles) > 1 OR len(dates) > 0 OR contains(question, '基础版')) THEN 'version_conflict_lookup'
            WHEN len(refusals) > 0 OR regexp_matches(question, '同名|只要|不要') THEN 'same_name_disambiguation' WHEN len(dates) > 0 THEN 'version_lookup' ELSE 'general' END AS r,
        CASE WHEN contains(question, '公报') THEN flatten(list_transform(years, lambda y: list_transform(issues, lambda i: y || '_' || i || '_npc'))) ELSE [] END AS keys FROM s),
    r AS (SELECT *, CASE WHEN r <> 'gazette_issue_lookup' AND len(articles) > 0 AND len(titles) + len(subjects) > 0 THEN 'law_article_lookup' ELSE r END AS route FROM r0),
    asked AS (SELECT *, route <> 'general' AS strong, CASE WHEN len(keys) > 0 THEN len(keys) WHEN NOT parallel THEN 1 WHEN route = 'version_diff_lookup' AND len(dates) > 0 THEN 2 WHEN len(titles) > 1 THEN len(titles) WHEN len(dates) > 1 THEN len(dates) ELSE 2 END AS wanted FROM r)"""


def questions(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("q_id"), F.expr(_QUESTION).alias("q"))


def texts(spark, d) -> DataFrame:
    """Each different question once, its text as q_id, with slots and routes: many ask in the same words."""
    s = questions(spark, d).select("q").distinct().select(F.col("q").alias("q_id"), Q.once(Q.slots(F.col("q"))).alias("s"))
    return s.select("q_id", "s", Q.once(Q.routed(F.col("s"))).alias("r")).select("q_id", "s.*", "r.*")


def asked(spark, d) -> DataFrame:
    """Questions with their slots and routes."""
    parsed = texts(spark, d)
    return questions(spark, d).join(parsed.withColumnRenamed("q_id", "q"), "q").select("q_id", *parsed.columns[1:])


def _profiled(spark, d) -> DataFrame:
    """Questions with their profiles; each different text is read once."""
    p = questions(spark, d).select("q").distinct().select("q", Q.once(Q.profile(F.col("q"))).alias("p")).select(F.col("q").alias("asked_as"), "p.*")
    p = p.select("*", *(c.alias(n) for n, c in Q.flags().items()))
    return questions(spark, d).join(p, F.col("q").eqNullSafe(F.col("asked_as"))).select("q_id", *p.columns[1:])


def _joined(*names: str):
    return [F.array_join(n, "|").alias(n) for n in names]


_LISTS = ("titles", "years", "issues", "dates", "articles", "cases", "refusals", "refused_issues", "refused_titles")


@query(f"WITH {_Q} SELECT q_id, question, {', '.join(f'array_to_string({n}, $$|$$) AS {n}' for n in _LISTS)} FROM asked".replace("$$", "'"))
def question_slots(spark, d):
    return asked(spark, d).select("q_id", "question", *_joined(*_LISTS))


@query(f"WITH {_Q} SELECT q_id, route, strong, parallel, wanted::INT AS wanted, array_to_string(keys, '|') AS keys, array_to_string(subjects, '|') AS subjects FROM asked")
def question_routes(spark, d):
    return asked(spark, d).select("q_id", "route", "strong", "parallel", F.col("wanted").cast("int").alias("wanted"), *_joined("keys", "subjects"))


def _has(words, c="text") -> str:
    return f"regexp_matches({c}, '{'|'.join(words)}')"


_CASE = r"指导性案例\s*第?\d+号|\(?\d{4}\)?[\x{4e00}-\x{9fa5}]{1,6}\d{2,8}号"
_P = f"""q AS (SELECT o_orderkey AS q_id, trim({_QUESTION}) AS question FROM orders),
    e AS (SELECT *, list_distinct(flatten([{', '.join(f"CASE WHEN {_has((k, *v), 'question')} THEN {[k, *v]} ELSE [] END" for k, v in Q.SYNONYMS.items())}])) AS more0,
        flatten([{', '.join(f"CASE WHEN {_has((k, *v), 'question')} THEN {[k, *v]} ELSE [] END" for k, v in Q.SYNONYMS.items())}]) AS m FROM q),
    p0 AS (SELECT q_id, question, question || CASE WHEN len(m) > 0 THEN ' ' || array_to_string({_distinct('m')}, ' ') ELSE '' END AS text FROM e),
    p AS (SELECT *, CASE WHEN {_has(('同时', '并列', '对比', '比较', '区别'))} THEN 'comparison' WHEN {_has(('版', '生效', '修订', '现行'))} THEN 'version_effect' WHEN regexp_matches(text, '指导性案例|{_CASE}') THEN 'case_holding'
        WHEN regexp_matches(text, '{Q.ARTICLE}') THEN 'article_locate' WHEN {_has(('办事指南', '申请条件', '申请材料', '办理流程', '办理时限'))} THEN 'procedure_extract'
        WHEN contains(text, '合同') AND {_has(('条款', '违约责任', '解除条件', '争议解决'))} THEN 'contract_clause' {' '.join(f"WHEN {_has(w)} THEN '{n}'" for n, w in Q.INTENTS.items())} ELSE 'doc_precise' END AS intent,
        regexp_extract_all(text, '{Q.ARTICLE}') AS a, regexp_extract_all(text, '{_CASE}') AS c,
        regexp_extract_all(text, '(?:19|20)[0-9]{{2}}年(?:[0-9]{{1,2}}月(?:[0-9]{{1,2}}日)?)?') || list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '(?:19|20)[0-9]{{6}}')) AS dt,
        regexp_extract_all(text, '《([^》]{{2,80}})》', 1) AS tq, list_filter(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fa5}}A-Za-z0-9·（）()、]{{2,80}}?(?:法典|法律|法|实施条例|条例|规定|办法|公报|合同|合同法|指南|申请表|申报表|案例)'),
            lambda x: NOT regexp_matches(x, '^(?:请|给|我|你|帮|返回|定位|检索|提供|回答|并列|同时|不要|只要|答案)')) AS tb,
        {_has(Q.TABLES)} AS is_table, {_has(Q.DEADLINES)} AS is_deadline, {_has(Q.AMOUNTS)} AS is_amount, {_has(Q.CASES)} AS is_case FROM p0),
    pr AS (SELECT *, CASE WHEN len(tq) > 0 THEN {_distinct('tq')} ELSE {_distinct('tb')} END AS t FROM p),
    f AS (SELECT *, len(a) + len(c) + len(dt) + len(t) > 0 OR intent IN ('article_locate', 'doc_precise', 'version_effect', 'procedure_extract', 'contract_clause') AS sparse,
        intent IN ('case_reasoning', 'case_holding', 'comparison', 'penalty_elements') AS dense FROM pr),
    profile AS (SELECT *, sparse OR is_table OR is_case OR is_deadline OR is_amount AS exact FROM f)"""


@query(f"WITH {_P} SELECT q_id, text, intent, array_to_string({_distinct('a')}, '|') AS article_terms, array_to_string({_distinct('c')}, '|') AS case_terms, array_to_string({_distinct('dt')}, '|') AS date_terms, array_to_string(t, '|') AS title_terms FROM profile")
def question_intents(spark, d):
    return _profiled(spark, d).select("q_id", "text", "intent", *_joined("article_terms", "case_terms", "date_terms", "title_terms"))


@query(f"""WITH {_P}, w AS (SELECT q_id, 0.12 + 0.12 * sparse::INT + 0.06 * exact::INT + 0.06 * is_deadline::INT + 0.05 * is_amount::INT - 0.02 * (intent = 'comparison')::INT - 0.03 * dense::INT AS f,
        0.6 - 0.08 * sparse::INT - 0.04 * exact::INT - 0.06 * is_deadline::INT - 0.05 * is_amount::INT + 0.06 * dense::INT + 0.04 * (intent = 'comparison')::INT AS v FROM profile)
    SELECT q_id, round(least(0.42, greatest(0.08, f)), 6)::DOUBLE AS text_weight, round(1 - least(0.42, greatest(0.08, f)), 6)::DOUBLE AS vector_weight, round(least(0.82, greatest(0.3, v)), 6)::DOUBLE AS rerank_weight FROM w""")
def question_weights(spark, d):
    """Weights of text and vectors in fusion and in re-ranking, by what the question asks for."""
    w = Q.fusion_weight()
    return _profiled(spark, d).select("q_id", w.alias("text_weight"), F.round(1 - w, 6).alias("vector_weight"), Q.rerank_weight().alias("rerank_weight"))


_SPELLED = f"flatten(list_transform(regexp_extract_all(question, '第([{_N}]+)期', 1), lambda x: ['第' || x || '期', '_' || x || '_npc', '_' || x || '.pdf']))"
_IN_YEARS = "list_transform(regexp_extract_all(question, '((?:19|20)[0-9]{2})年', 1), lambda x: x || '年')"


@query(f"""WITH {_P}, c AS (SELECT q_id, question, intent, t, is_table, contains(question, '公报') AS g, contains(question, '公报') AND regexp_matches(text, '第|期|并列|同时') AS asks,
        a || c || dt || t || list_filter(regexp_extract_all(question, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[0-9]{{8}}')) || regexp_extract_all(question, '[0-9]{{4}}版') || CASE WHEN contains(question, '公报') THEN ['{Q.GAZETTE}', '公报'] || {_IN_YEARS} || {_SPELLED} ELSE [] END AS must,
        regexp_extract_all(question, '不要([^，。；,.]{{1,24}})', 1) || CASE WHEN regexp_matches(question, '不要第') AND contains(question, '期') THEN {_SPELLED} ELSE [] END || CASE WHEN regexp_matches(question, '基础版|不要带日期') THEN ['_20', '_19'] ELSE [] END AS must_not FROM profile),
    k AS (SELECT *, CASE WHEN asks THEN ['公报', '公告'] WHEN is_table THEN ['申请表', '申报表', '办事指南'] WHEN intent IN ('case_reasoning', 'case_holding', 'comparison') THEN ['指导性案例', '裁判文书', '司法解释'] ELSE [] END || CASE WHEN g THEN ['公报'] ELSE [] END AS prefer,
        CASE WHEN asks THEN ['案例', '合同', '申请表'] ELSE [] END || CASE WHEN g THEN ['案例', '合同', '申请表', '办事指南', '裁判文书'] ELSE [] END AS avoid FROM c)
    SELECT q_id, array_to_string({_distinct('must')}, '|') AS must, array_to_string({_distinct('must_not')}, '|') AS must_not, array_to_string({_distinct('prefer')}, '|') AS prefer, array_to_string({_distinct('avoid')}, '|') AS avoid,
        (len(t) > 0 AND intent IN ('article_locate', 'version_effect', 'doc_precise')) OR g AS hard_title, CASE WHEN intent = 'comparison' OR regexp_matches(question, '并列|同时|对比|比较') THEN 2 ELSE 1 END AS wanted FROM k""")
def question_constraints(spark, d):
    c = _profiled(spark, d).select("q_id", *(x.alias(n) for n, x in Q.constraints().items()))
    return c.select("q_id", *_joined("must", "must_not", "prefer", "avoid"), "hard_title", "wanted")


def _first(c: str, n: int) -> str:
    return f"({c})[1:{n}]"


_ARTS, _CASES2 = _first(f"regexp_extract_all(question, '{Q.ARTICLE}')", 2), _first(f"regexp_extract_all(question, '{_CASE}')", 2)
_SAID = _first("regexp_extract_all(question, '(?:19|20)[0-9]{2}年(?:[0-9]{1,2}月(?:[0-9]{1,2}日)?)?')", 2)
_KINDS = "CASE " + " ".join(f"WHEN x = '{k}' THEN {list(v)}" for k, v in Q.TYPE_ALIASES.items()) + " ELSE [x] END"


@query(f"""WITH {_P}, b AS (SELECT q_id, question, intent, exact, {_first('t', 2)} AS heads, {_ARTS} AS arts, {_CASES2} AS cases, {_SAID} AS said, {_IN_YEARS} AS ys, {_SPELLED} AS sp,
        [question] || flatten([{', '.join(f"CASE WHEN contains(question, '{a}') AND NOT contains(question, '{b}') THEN [replace(question, '{a}', '{b}')] ELSE [] END" for a, b in Q.FULL_NAMES)}]) AS names,
        flatten(list_transform(list_filter({list(Q.INTENT_DOC_TYPES)}, lambda x: contains(text, x)), lambda x: {_KINDS})) AS kinds FROM profile),
    b2 AS (SELECT *, {_first(_distinct('ys'), 2)} AS y2, {_first(_distinct('sp'), 4)} AS n4, {_first(_distinct('kinds'), 4)} AS k4 FROM b),
    l AS (SELECT q_id, list_filter(list_transform(names
        || CASE WHEN exact THEN flatten(list_transform(heads, lambda t: [t || ' 原文'] || flatten(list_transform(arts, lambda a: [t || ' ' || a, t || ' ' || a || ' 条文原文'])))) || list_transform(cases, lambda c: c || ' 原文') || list_transform(said, lambda s: question || ' ' || s) ELSE [] END
        || CASE WHEN intent = 'article_locate' THEN flatten(list_transform(arts, lambda a: flatten(list_transform(names[1:2], lambda n: [n || ' ' || a || ' 条文原文', n || ' ' || a || ' 原文位置']))))
            || flatten(list_transform(heads, lambda t: flatten(list_transform(arts, lambda a: ['《' || t || '》 ' || a || ' 原文', t || ' 全文 ' || a || ' 条文', '中华人民共和国' || t || ' ' || a])))) ELSE [] END
        || CASE WHEN intent = 'procedure_extract' THEN [question || ' 申请条件 申请材料 办理流程 办理时限 受理机关', question || ' 办事指南 许可目录 申报表'] ELSE [] END
        || CASE WHEN intent IN ('penalty_elements', 'version_effect') AND NOT exact THEN [question || ' 适用条件 构成要件 处罚', question || ' 生效 修订 现行'] ELSE [] END
        || CASE WHEN intent IN ('case_holding', 'case_reasoning') THEN list_transform(cases, lambda c: c || ' 裁判要旨 争议焦点 裁判理由') || [question || ' 基本案情 裁判理由 结论'] ELSE [] END
        || CASE WHEN intent = 'contract_clause' THEN [question || ' 合同目的 权利义务 违约责任 解除条件 争议解决'] WHEN intent = 'comparison' THEN [question || ' 对比 差异 适用范围', question || ' 法条 比较'] ELSE [] END
        || CASE WHEN contains(question, '公报') THEN [question || ' {Q.GAZETTE}'] || CASE WHEN len(y2) > 0 AND len(n4) > 0 THEN flatten(list_transform(y2, lambda y: flatten(list_transform(n4, lambda n: ['{Q.GAZETTE} ' || y || ' ' || n, '{Q.GAZETTE} ' || y || ' ' || n || ' npc']))))
            WHEN len(y2) > 0 THEN list_transform(y2, lambda y: '{Q.GAZETTE} ' || y) ELSE list_transform(n4, lambda n: '{Q.GAZETTE} ' || n) END ELSE [] END
        || list_transform(k4, lambda k: question || ' ' || k) || list_transform(said, lambda s: question || ' ' || s || ' 生效 修订'), lambda x: trim(x)), lambda x: x <> '') AS planned FROM b2),
    u AS (SELECT q_id, p, min(i) AS i FROM (SELECT q_id, unnest(planned) AS p, generate_subscripts(planned, 1) AS i FROM l) GROUP BY q_id, p)
    SELECT q_id, (row_number() OVER (PARTITION BY q_id ORDER BY i) - 1)::INT AS place, p AS planned FROM u QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY i) <= 8""")
def planned_queries(spark, d):
    """Up to eight queries for each question."""
    return _profiled(spark, d).select("q_id", F.posexplode(Q.planned()).alias("place", "planned"))


def _key(c: str) -> str:
    return f"regexp_replace(replace(lower(translate({c}, '《》【】（）：，。；、', '<>[]():,.;,')), '中华人民共和国', ''), '\\s+', '', 'g')"


_LEGAL = f"""{_Q}, files AS (SELECT DISTINCT {_FILE} AS name FROM documents), n AS (SELECT name, {_key('name')} AS k, regexp_extract(name, '(?:19|20)[0-9]{{6}}') AS version FROM files WHERE name LIKE '%.pdf'),
    x AS (SELECT *, list_transform(titles, lambda t: {_key('t')}) AS tk, list_transform(refused_titles, lambda t: {_key('t')}) AS rk, list_transform(subjects, lambda t: {_key('t')}) AS sk FROM asked WHERE strong),
    m AS (SELECT x.*, n.*, list_filter(tk, lambda t: contains(k, t) AND len(list_filter(tk, lambda o: o <> t AND contains(o, t) AND contains(k, o))) = 0) AS got FROM x, n),
    c AS (SELECT *, (contains(name, '公报') AND len(list_filter(refused_issues, lambda i: contains(name, '_' || i || '_npc') OR contains(name, '_' || i || '.'))) > 0)
        OR (contains(question, '不要带日期') AND version <> '') OR (contains(question, '不要基础版') AND version = '') OR (len(list_filter(rk, lambda t: contains(k, t))) > 0 AND len(got) = 0) AS conflict,
        CASE WHEN len(keys) > 0 THEN len(list_filter(keys, lambda y: contains(k, y))) > 0 WHEN len(titles) > 0 AND len(got) = 0 THEN false WHEN len(subjects) > 0 THEN len(list_filter(sk, lambda t: contains(k, t))) > 0 ELSE true END AS anchored FROM m),
    sc AS (SELECT *, k || CASE WHEN version = '' THEN '基础版' ELSE version END AS body, contains(question, '公报') OR route = 'gazette_issue_lookup' AS g FROM c),
    score AS (SELECT q_id, name, wanted, conflict, anchored, route, k, version, titles, tk, sk, keys, subjects, (CASE WHEN conflict THEN -200 ELSE 0 END + len(got) * 35 + CASE WHEN len(titles) > 0 AND len(got) = len(titles) THEN 20 ELSE 0 END
        + CASE WHEN route = 'law_article_lookup' AND len(got) > 0 THEN 70 + CASE WHEN regexp_matches(name, '关于适用|解释|批复|案例|合同') THEN -55 ELSE 45 END ELSE 0 END + 18 * len(list_filter(sk, lambda t: contains(body, t)))
        + CASE WHEN g THEN CASE WHEN contains(name, '公报') THEN 40 ELSE 0 END + CASE WHEN contains(lower(name), 'npc') THEN 15 ELSE 0 END + 160 * len(list_filter(keys, lambda y: contains(k, y))) + 25 * len(list_filter(years, lambda y: contains(name, y)))
            + 35 * len(list_filter(issues, lambda i: contains(name, '_' || i || '_npc') OR contains(name, '_' || i || '.'))) ELSE 0 END
        + coalesce(list_sum(list_transform(dates, lambda t: CASE WHEN contains(body, t) THEN 55 WHEN version <> '' THEN -15 ELSE 0 END)), 0) + CASE WHEN regexp_matches(question, '现行|最新版') AND version <> '' THEN 35 ELSE 0 END
        + CASE WHEN contains(question, '基础版') AND NOT contains(question, '不要基础版') THEN CASE WHEN version = '' THEN 60 ELSE -45 END ELSE 0 END
        + coalesce(list_sum(list_transform(articles, lambda t: CASE WHEN contains(body, t) THEN 15 WHEN route = 'law_article_lookup' THEN -10 ELSE 0 END)), 0) + 35 * len(list_filter(cases, lambda t: contains(body, t))))::INT AS score FROM sc)"""


@query(f"WITH {_LEGAL} SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, name) AS rank, name, score FROM score WHERE score > 0 AND NOT conflict AND anchored QUALIFY rank <= greatest(5, wanted)")
def corpus_rank(spark, d):
    """The best files for each strong question by their names alone."""
    ids, profiles = _profiles(spark, d)
    return corpus.of_questions(corpus.ranked(profiles, _files(spark, d), 5).select("q_id", "rank", "name", "score"), ids).select("q_id", "rank", "name", "score")


def _profiles(spark, d) -> tuple[DataFrame, DataFrame]:
    ids, profiles = corpus.profiles(texts(spark, d))
    return questions(spark, d).join(ids.withColumnRenamed("q_id", "q"), "q").select("q_id", "p_id"), profiles


def _files(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.expr(_FILE).alias("name")).where(F.col("name").endswith(".pdf")).distinct()


@query(f"""WITH {_LEGAL}, rk AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, name) AS pos FROM score WHERE score > 0 AND NOT conflict AND anchored QUALIFY pos <= greatest(5, wanted)),
    cov AS (SELECT *, CASE WHEN len(list_filter(keys, lambda y: contains(k, y))) > 0 THEN list_filter(keys, lambda y: contains(k, y))[1]
        WHEN len(list_filter(tk, lambda t: contains(k, t))) > 0 THEN 'title:' || list_reduce(list_filter(tk, lambda t: contains(k, t)), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) || ':' || CASE WHEN version = '' THEN 'base' ELSE version END
        WHEN len(list_filter(sk, lambda t: contains(k, t))) > 0 THEN 'subject:' || list_filter(sk, lambda t: contains(k, t))[1] || ':' || CASE WHEN version = '' THEN 'base' ELSE version END ELSE k END AS coverage FROM rk),
    fst AS (SELECT *, row_number() OVER (PARTITION BY q_id, coverage ORDER BY pos) = 1 AS lead FROM cov),
    nth AS (SELECT *, sum(lead::INT) OVER (PARTITION BY q_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS nth FROM fst)
    SELECT q_id, name, coverage, row_number() OVER (PARTITION BY q_id ORDER BY CASE WHEN wanted > 1 AND lead AND nth <= wanted THEN 0 ELSE 1 END, pos) AS place FROM nth""")
def coverage_rerank(spark, d):
    """The ranked files with one of each wanted target first."""
    ids, profiles = _profiles(spark, d)
    found = corpus.covered(corpus.ranked(profiles, _files(spark, d), 5)).select("q_id", "name", "coverage", "place")
    return corpus.of_questions(found, ids).select("q_id", "name", "coverage", "place")
