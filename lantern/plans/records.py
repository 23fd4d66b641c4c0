"""Registered queries on names, filters, boxes, chunks, metadata and rankings, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lantern.functions import answers as A, questions as Q
from lantern.functions import text as T
from lantern.operators import packing
from lantern.plans.answers import _R, _REF_TEXT, _anc, references
from lantern.plans.catalog import TABLED, query, table
from lantern.plans.evidence import _BOXES, _boxes
from lantern.plans.questions import _FILE, _Q, _QUESTION, _distinct, _has, asked, questions

# ---- filters and projections ----


def where_equal(df: DataFrame, conditions: dict) -> DataFrame:
    """Lists are tested by membership, strings and numbers for equality; empty conditions don't count."""
    for name, value in conditions.items():
        if not value:
            continue
        if isinstance(value, list):
            df = df.where(F.col(name).isin(value))
        elif isinstance(value, str | int):
            df = df.where(F.col(name) == value)
        else:
            raise TypeError(f"{name}: a condition is a list, a string or a whole number")
    return df


@query("SELECT doc_id, source, lang, n_chars FROM documents WHERE source IN ('src1', 'src2', 'src9') AND lang = 'en' AND NOT coalesce(n_chars < 1000, false)")
def condition_filter(spark, d):
    """Compiled conditions, and availability as "not below", which nulls pass."""
    docs = where_equal(table(spark, d, "documents"), {"source": ["src1", "src2", "src9"], "lang": "en", "doc_id": 0, "text": ""})
    return docs.where(F.col("n_chars").isNull() | (F.col("n_chars") >= 1000)).select("doc_id", "source", "lang", "n_chars")


@query(f"""SELECT doc_id, name, ext, coalesce(lang, 'unknown') AS lang, n_chars::VARCHAR AS size, name || ' [' || lang || ']' AS location FROM (SELECT doc_id, lang, n_chars, {_FILE} AS path FROM documents),
    LATERAL (SELECT regexp_extract('in/' || path, '[^/]+$') AS name, lower(regexp_extract(path, '[.]([^.]+)$', 1)) AS ext)""")
def result_shape(spark, d):
    """The columns of a result: base name, extension, defaults, numbers as text, a label of the place."""
    f = table(spark, d, "documents").select("doc_id", "lang", "n_chars", F.concat(F.lit("in/"), F.expr(_FILE)).alias("path"))
    name = F.regexp_extract("path", "[^/]+$", 0)
    return f.select("doc_id", name.alias("name"), F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("ext"), F.coalesce("lang", F.lit("unknown")).alias("lang"), F.col("n_chars").cast("string").alias("size"), F.concat(name, F.lit(" ["), F.col("lang"), F.lit("]")).alias("location"))


_ALLOWED = ("pdf", "docx", "txt", "md", "html", "json", "xlsx", "xls", "pptx", "ppt")


@query(f"""WITH f AS (SELECT page_id, trim(CASE page_id % 4 WHEN 0 THEN 'C:\\Docs\\' || url || '.PDF' WHEN 1 THEN ' ' || url || '/x.exe ' WHEN 2 THEN url || '/a.Docx' ELSE '..' END) AS raw FROM pages)
    SELECT page_id, n AS name, list_contains({list(_ALLOWED)}, lower(regexp_extract(n, '[.]([^.]+)$', 1))) AND n NOT IN ('', '.', '..') AS accepted FROM (SELECT page_id, regexp_extract(replace(raw, '\\', '/'), '[^/]*$') AS n FROM f)""")
def upload_names(spark, d):
    """The last part of an uploaded path, and whether its kind may come in."""
    made = F.expr(r"trim(CASE page_id % 4 WHEN 0 THEN 'C:\\Docs\\' || url || '.PDF' WHEN 1 THEN ' ' || url || '/x.exe ' WHEN 2 THEN url || '/a.Docx' ELSE '..' END)")
    f = table(spark, d, "pages").select("page_id", F.regexp_extract(F.translate(made, "\\", "/"), "[^/]*$", 0).alias("name"))
    return f.select("page_id", "name", (F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(*_ALLOWED) & ~F.col("name").isin("", ".", "..")).alias("accepted"))


@query("""SELECT line_id, regexp_extract(replace(trim(trim(trim(replace(line, chr(65279), '')), '"'), ''''), '\\', '/'), '[^/]+$') AS name FROM (SELECT s_suppkey AS line_id,
    CASE WHEN s_suppkey = 0 THEN chr(65279) ELSE '' END || CASE s_suppkey % 3 WHEN 0 THEN '"D:\\law\\' || s_name || '.pdf"' WHEN 1 THEN '''data/' || s_name || '.pdf'' ' ELSE '' END AS line FROM supplier) WHERE trim(replace(line, chr(65279), '')) <> ''""")
def corpus_list(spark, d):
    """File names of a list of paths: its mark of order, quotes and both kinds of slash are taken off, empty lines left out."""
    s = F.col("s_name")
    line = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit('"D:\\law\\'), s, F.lit('.pdf"'))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("'data/"), s, F.lit(".pdf' "))).otherwise("")
    lines = table(spark, d, "supplier").select(F.col("s_suppkey").alias("line_id"), F.concat(F.when(F.col("s_suppkey") == 0, "\ufeff").otherwise(""), line).alias("line"))
    bare = F.regexp_replace(F.trim(F.regexp_replace("line", "^\ufeff", "")), "^[\"']+|[\"']+$", "")
    return lines.select("line_id", bare.alias("bare")).where("bare <> ''").select("line_id", F.regexp_extract(F.translate("bare", "\\", "/"), "[^/]+$", 0).alias("name"))


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system' AND conv_id IS NOT NULL) OR conv_id IS NULL")
def delete_by_session(spark, d):
    """What stays when all turns of some conversations are deleted."""
    c = table(spark, d, "conversations")
    return c.join(c.where("role = 'system'").select("conv_id"), "conv_id", "left_anti").select("conv_id", "turn", "role")


@query("SELECT source, count(*) AS chunks, (count(*) + 127) // 128 AS pages FROM documents GROUP BY source")
def scan_pages(spark, d):
    """How many pages of 128 rows a scan of each index takes."""
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("chunks")).withColumn("pages", F.floor((F.col("chunks") + 127) / 128))


@query("SELECT doc_id, line_no, line FROM (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE line_no < 24")
def first_chunks(spark, d):
    """The first 24 lines of each document in order; the limit is the feature."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.slice(F.split("text", "\n"), 1, 24)).alias("line_no", "line"))


@query(f"""SELECT page_id, len(regexp_extract_all({TABLED}, '(?is)<tr[ >]'))::INT AS html_rows, len(string_split(html, chr(10)))::INT AS text_rows FROM pages""")
def row_counts(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_count(F.expr(TABLED), F.lit("(?is)<tr[ >]")).alias("html_rows"), F.size(F.split("html", "\n")).alias("text_rows"))


# ---- boxes ----


@query(f"WITH {_BOXES}, m AS (SELECT page, avg(bottom - top) AS mean, max(x1) AS width FROM b GROUP BY page) SELECT b.page, box FROM b JOIN m ON b.page = m.page WHERE box % 5 = 0 OR x1 - x0 > width / 3 OR bottom - top > mean")
def useful_boxes(spark, d):
    """Boxes that are typed, wide or taller than their page's mean."""
    b = _boxes(spark, d)
    page = Window.partitionBy("page")
    b = b.withColumn("mean", F.avg(F.col("bottom") - F.col("top")).over(page)).withColumn("width", F.max("x1").over(page))
    return b.where((F.col("box") % 5 == 0) | (F.col("x1") - F.col("x0") > F.col("width") / 3) | (F.col("bottom") - F.col("top") > F.col("mean"))).select("page", "box")


@query(f"""WITH {_BOXES}, m AS (SELECT *, max(bottom) OVER (PARTITION BY page) AS height, CASE box % 4 WHEN 0 THEN 'header' WHEN 1 THEN 'footer' WHEN 2 THEN 'reference' ELSE 'text' END AS kind FROM b)
    SELECT page, box, kind FROM m WHERE kind = 'text' OR (kind = 'footer' AND bottom < height * 0.9) OR (kind = 'header' AND top > height * 0.1)""")
def running_heads(spark, d):
    """Boxes without headers, footers and references, unless a head or foot stands inside the page."""
    kind = F.when(F.col("box") % 4 == 0, "header").when(F.col("box") % 4 == 1, "footer").when(F.col("box") % 4 == 2, "reference").otherwise("text")
    b = _boxes(spark, d).withColumn("height", F.max("bottom").over(Window.partitionBy("page"))).withColumn("kind", kind)
    keep = (F.col("kind") == "text") | ((F.col("kind") == "footer") & (F.col("bottom") < F.col("height") * 0.9)) | ((F.col("kind") == "header") & (F.col("top") > F.col("height") * 0.1))
    return b.where(keep).select("page", "box", "kind")


@query(f"""WITH {_BOXES}, c AS (SELECT page, box AS col, x0, x1 FROM b WHERE box <= 3), p AS (SELECT b.page, b.box, c.col, round(abs(b.x0 - c.x0) + abs(b.x1 - c.x1), 6) AS gap FROM b JOIN c ON b.page = c.page WHERE b.box > 3)
    SELECT page, box, col, gap FROM p QUALIFY row_number() OVER (PARTITION BY page, box ORDER BY gap, col) = 1""")
def tightest_column(spark, d):
    """For each box of a page the column whose edges are nearest."""
    b = _boxes(spark, d)
    c = b.where("box <= 3").select("page", F.col("box").alias("col"), F.col("x0").alias("c0"), F.col("x1").alias("c1"))
    gap = F.round(F.abs(F.col("x0") - F.col("c0")) + F.abs(F.col("x1") - F.col("c1")), 6)
    best = b.where("box > 3").join(c, "page").groupBy("page", "box").agg(F.min(F.struct(gap.alias("gap"), "col")).alias("m"))
    return best.select("page", "box", "m.col", "m.gap")


@query(f"WITH {_BOXES} SELECT page, box, row_number() OVER (PARTITION BY page ORDER BY floor(top / 24), x0, box) AS place FROM b")
def reading_order(spark, d):
    """Boxes from top to bottom in bands of a line's height, and from left to right in them."""
    return _boxes(spark, d).select("page", "box", F.row_number().over(Window.partitionBy("page").orderBy(F.floor(F.col("top") / 24), "x0", "box")).alias("place"))


@query(f"""WITH {_BOXES}, o AS (SELECT *, coalesce(box - lag(box) OVER (PARTITION BY page ORDER BY box) > 1 OR abs(x0 - lag(x0) OVER (PARTITION BY page ORDER BY box)) > 15, true)::INT AS fresh FROM b),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY box ROWS UNBOUNDED PRECEDING) AS part FROM o) SELECT page, part::INT AS part, min(x0) AS x0, max(x1) AS x1, min(top)::DOUBLE AS top, max(bottom)::DOUBLE AS bottom, count(*) AS boxes FROM g GROUP BY page, part""")
def merged_boxes(spark, d):
    """Boxes that follow each other and start near each other, as one."""
    w = Window.partitionBy("page").orderBy("box")
    fresh = F.coalesce((F.col("box") - F.lag("box").over(w) > 1) | (F.abs(F.col("x0") - F.lag("x0").over(w)) > 15), F.lit(True))
    g = _boxes(spark, d).withColumn("fresh", fresh.cast("int")).withColumn("part", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return g.groupBy("page", "part").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.count("*").alias("boxes"))


# ---- text rules ----

# Phrases that a request begins with, and what its subject is cut at.
_ASK = "^(?:我想先看|我想看|我需要|我只想|先把|先给我|先看|帮我找|帮我看|给我|把|发我|给我发|告诉我|我先看)"
_CUT = "的?(?:法条原文|条文原文|法律原文|司法解释原文|案例原文|原文|全文|摘要|办事流程|申请材料|受理条件|办理时限|解读|评述|点评|核心内容|适用条件)|[,，。；]"
_PERIOD = "20[0-9]{2}年?(?:[0-9]{1,2}月)?(?:[0-9]{1,2}日)?"
_REQUEST = f"CASE o_orderkey % 3 WHEN 0 THEN '给我发' WHEN 1 THEN '帮我找 先看' ELSE '' END || replace({_QUESTION}, '19', '20')"


@query(f"""WITH r AS (SELECT o_orderkey AS q_id, trim({_REQUEST}) AS t FROM orders), s AS (SELECT q_id, trim(regexp_replace(t, '^(?:(?:{_ASK[1:]})\\s*)+', '')) AS plain FROM r)
    SELECT q_id, plain, trim(string_split_regex(regexp_replace(plain, '{_PERIOD}', ''), '{_CUT}')[1]) AS subject FROM s""")
def requests_stripped(spark, d):
    """Questions without request words in front, and what they are about: without the first period, up to the first word of a form."""
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("q_id"), F.trim(F.expr(_REQUEST)).alias("t"))
    s = r.select("q_id", F.trim(F.regexp_replace("t", rf"^(?:(?:{_ASK[1:]})\s*)+", "")).alias("plain"))
    first = F.regexp_extract("plain", f"^(.*?)(?:{_PERIOD})(.*)$", 1)
    without = F.when(F.rlike("plain", F.lit(_PERIOD)), F.concat(first, F.regexp_extract("plain", f"^(.*?)(?:{_PERIOD})(.*)$", 2))).otherwise(F.col("plain"))
    return s.select("q_id", "plain", F.trim(F.get(F.split(without, _CUT), 0)).alias("subject"))


_ALIASES = "[y, y || '年'] || CASE WHEN m <> '' THEN [y || '年' || m || '月', y || lpad(m, 2, '0')] ELSE [] END || CASE WHEN m <> '' AND dd <> '' THEN [y || '年' || m || '月' || dd || '日', y || lpad(m, 2, '0') || lpad(dd, 2, '0')] ELSE [] END"


@query(f"""WITH r AS (SELECT o_orderkey AS q_id, unnest(regexp_extract_all(replace({_QUESTION}, '19', '20'), '{_PERIOD}')) AS p FROM orders), x AS (SELECT q_id, p, left(p, 4) AS y, regexp_extract(p, '^20[0-9]{{2}}年?([0-9]{{1,2}})月', 1) AS m, regexp_extract(p, '([0-9]{{1,2}})日$', 1) AS dd FROM r)
    SELECT DISTINCT q_id, unnest(list_distinct([p] || {_ALIASES})) AS alias FROM x""")
def period_aliases(spark, d):
    """All ways to write the periods that a question names."""
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("q_id"), F.explode(Q.every(F.expr(f"replace({_QUESTION}, '19', '20')"), _PERIOD)).alias("p"))
    q = q.select("q_id", "p", F.substring("p", 1, 4).alias("y"), F.regexp_extract("p", "^20[0-9]{2}年?([0-9]{1,2})月", 1).alias("m"), F.regexp_extract("p", "([0-9]{1,2})日$", 1).alias("dd"))
    y, m, dd = F.col("y"), F.col("m"), F.col("dd")
    two = lambda c: F.lpad(c, 2, "0")
    month = F.when(m != "", F.array(F.concat(y, F.lit("年"), m, F.lit("月")), F.concat(y, two(m)))).otherwise(Q.strings())
    day = F.when((m != "") & (dd != ""), F.array(F.concat(y, F.lit("年"), m, F.lit("月"), dd, F.lit("日")), F.concat(y, two(m), two(dd)))).otherwise(Q.strings())
    return q.select("q_id", F.explode(F.concat(F.array("p", y, F.concat(y, F.lit("年"))), month, day)).alias("alias")).distinct()


# Words of questions that say nothing of their subject.
_WHAT = "是*(什么样的|哪家|一下|那家|请问|啥样|咋样了|什么时候|何时|何地|何人|是否|是不是|多少|哪里|怎么|哪儿|怎么样|如何|哪些|是啥|啥是|啊|吗|呢|吧|咋|什么|有没有|呀|谁|哪位|哪个)是*"
_FILL = "(^| )('s|'re|is|are|were|was|do|does|did|don't|doesn't|didn't|has|have|be|there|you|me|your|my|mine|just|please|may|i|should|would|wouldn't|will|won't|done|go|for|with|so|the|a|an|by|i'm|it's|he's|she's|they|they're|you're|as|by|on|in|at|up|out|down|of|to|or|and|if) "
_MIXED = f"CASE WHEN o_orderkey % 4 = 0 THEN 'What is The ' || o_orderpriority || ' of a list, and how is it done ' || o_orderstatus ELSE {_QUESTION} END"


@query(f"""WITH m AS (SELECT o_orderkey AS q_id, {_MIXED} AS q FROM orders), w AS (SELECT q_id, q, regexp_replace(regexp_replace(regexp_replace(q, '{_WHAT}', '', 'g'), '(?i)(^| )(what|who|how|which|where|why)(''re|''s)? ', ' ', 'g'), '(?i){_FILL.replace(chr(39), chr(39) * 2)}', ' ', 'g') AS bare FROM m),
    a AS (SELECT *, string_split_regex(q, '[ \\t]+') AS parts FROM w)
    SELECT q_id, bare, len(parts) <= 3 OR len(list_filter(parts, lambda x: NOT regexp_full_match(x, '[a-zA-Z]+'))) / len(parts) >= 0.7 AS chinese, regexp_replace(q, '([:{{}}/\\[\\]*"()|+~^-])', '\\\\\\1', 'g') AS escaped FROM a""")
def question_words(spark, d):
    """Questions without question and function words, whether they are Chinese, and with search signs escaped."""
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("q_id"), F.expr(_MIXED).alias("q"))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("q", _WHAT, ""), "(?i)(^| )(what|who|how|which|where|why)('re|'s)? ", " "), f"(?i){_FILL}", " ")
    parts = F.split("q", "[ \t]+")
    chinese = (F.size(parts) <= 3) | (F.size(F.filter(parts, lambda x: ~F.rlike(x, F.lit("^[a-zA-Z]+$")))) / F.size(parts) >= 0.7)
    return q.select("q_id", bare.alias("bare"), chinese.alias("chinese"), F.regexp_replace("q", r'([:{}/\[\]*"()|+~^-])', r"\\$1").alias("escaped"))


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_replace(text, '(?i)([^a-z0-9.,\)>]) +([^ ])', '\1\2', 'g'), '(?i)([^ ]) +([^a-z0-9.,\(<])', '\1\2', 'g') AS tight, regexp_matches(trim(text), '^[ `a-zA-Z.,'':;/"?<>!\(\)-]') AS english FROM conversations""")
def tight_text(spark, d):
    """Text without the blanks that only Latin words need, and whether it starts as English does."""
    tight = F.regexp_replace(F.regexp_replace("text", r"(?i)([^a-z0-9.,\)>]) +([^ ])", "$1$2"), r"(?i)([^ ]) +([^a-z0-9.,\(<])", "$1$2")
    return table(spark, d, "conversations").select("conv_id", "turn", tight.alias("tight"), F.rlike(F.trim("text"), F.lit(r"""^[ `a-zA-Z.,':;/"?<>!\(\)-]""")).alias("english"))


@query(r"""SELECT conv_id, count(*) AS n, round(avg(regexp_matches(trim(text), '^[ `a-zA-Z.,'':;/"?<>!\(\)-]')::INT), 6) AS share, avg(regexp_matches(trim(text), '^[ `a-zA-Z.,'':;/"?<>!\(\)-]')::INT) > 0.8 AS english FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""")
def english_vote(spark, d):
    """Conversations in which more than four of five turns start as English does."""
    share = F.avg(F.rlike(F.trim("text"), F.lit(r"""^[ `a-zA-Z.,':;/"?<>!\(\)-]""")).cast("int"))
    return table(spark, d, "conversations").where("text is not null").groupBy("conv_id").agg(F.count("*").alias("n"), F.round(share, 6).alias("share"), (share > 0.8).alias("english"))


@query("""SELECT conv_id, turn, trim(regexp_extract(fenced, '(?s)^\\s*```[a-z]*\\n?(.*?)\\n?```\\s*$', 1)) AS body FROM (SELECT conv_id, turn, '```json' || chr(10) || text || chr(10) || '```' AS fenced FROM conversations)""")
def code_fences(spark, d):
    """What stands inside a fence, however long."""
    fenced = F.concat(F.lit("```json\n"), F.col("text"), F.lit("\n```"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.trim(F.regexp_extract(fenced, r"(?s)^\s*```[a-z]*\n?(.*?)\n?```\s*$", 1)).alias("body"))


_CN = "零〇一二两三四五六七八九十百千"


@query(f"""WITH n AS (SELECT o_orderkey AS q_id, CASE o_orderkey % 9 WHEN 0 THEN '二〇二四' WHEN 1 THEN '二零二零' WHEN 2 THEN '三百四十一' WHEN 3 THEN '十' WHEN 4 THEN '两千零五' WHEN 5 THEN '十二' WHEN 6 THEN '' || o_orderkey WHEN 7 THEN '九百' ELSE 'x' END AS raw,
        CASE o_orderkey % 5 WHEN 0 THEN 'v20200528a' WHEN 1 THEN 'of 2021-3-4, 2020.1.2' WHEN 2 THEN 'order 202135 ok' WHEN 3 THEN '2022年12月1日发布 20230102' ELSE '2019/7/30' END AS dated FROM orders)
    SELECT q_id, CASE o_orderkey % 9 WHEN 0 THEN 2024 WHEN 1 THEN 2020 WHEN 2 THEN 341 WHEN 3 THEN 10 WHEN 4 THEN 2005 WHEN 5 THEN 12 WHEN 6 THEN o_orderkey WHEN 7 THEN 900 END::BIGINT AS number,
        CASE o_orderkey % 5 WHEN 0 THEN '20200528' WHEN 1 THEN '20210304' WHEN 3 THEN '20230102' WHEN 4 THEN '20190730' END AS version, CASE WHEN o_orderkey % 5 = 3 THEN '2022年12月1日' END AS last FROM n JOIN orders ON q_id = o_orderkey""")
def numerals_and_dates(spark, d):
    """Numbers written in Chinese, and dates of versions, against what they say."""
    pick = lambda n, *v: F.element_at(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in v)), (F.col("o_orderkey") % n + 1).cast("int"))
    raw = pick(9, "二〇二四", "二零二零", "三百四十一", "十", "两千零五", "十二", F.col("o_orderkey").cast("string"), "九百", "x")
    dated = pick(5, "v20200528a", "of 2021-3-4, 2020.1.2", "order 202135 ok", "2022年12月1日发布 20230102", "2019/7/30")
    dated = F.replace(dated, F.lit("2019/7/30"), F.lit("2019.7.30"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("q_id"), T.chinese_number(raw).alias("number"), T.version_date(dated).alias("version"), T.last_date(dated).alias("last"))


# ---- metadata ----

# What a name or text says about its document, the first that fits.
_TYPES = (("法律", ("法典", "法律", "法", "法案")), ("条例", ("条例", "实施条例", "办法", "细则", "规定")), ("地方性法规", ("地方", "省", "市", "自治区", "自治州", "条例")), ("司法解释", ("司法解释", "解释", "批复", "答复", "意见")), ("指导性案例", ("指导性案例", "典型案例", "参考案例")), ("裁判文书", ("判决书", "裁定书", "调解书", "赔偿案", "纠纷案", "刑事案", "知识产权案", "案例")), ("合同范本", ("合同", "协议", "示范文本", "范本")), ("办事指南", ("办事指南", "办事", "申请", "许可", "审批", "申报", "服务指南", "目录", "编码规则", "申报表")), ("公报", ("公报", "通告", "公告")))
_DOMAINS = (("民法", ("民法", "民事", "婚姻", "继承", "人格权", "物权", "侵权")), ("刑法", ("刑法", "刑事", "犯罪", "量刑", "刑罚")), ("行政法", ("行政", "许可", "复议", "处罚", "政务")), ("知识产权", ("知识产权", "专利", "商标", "著作权", "版权")), ("税法", ("税", "税收", "纳税", "增值税", "企业所得税")), ("劳动法", ("劳动", "社保", "工伤", "劳动合同", "工资")), ("网络安全", ("网络", "数据", "个人信息", "隐私", "信息安全", "网络安全")))
_PROCEDURE, _CONTRACT = "申请条件|申请材料|办理流程|审查时限|受理机关|办理时限|办理地点", "合同目的|权利义务|违约责任|解除条件|争议解决|适用法律|合同期限"
_first_sql = lambda groups, c: "CASE " + " ".join(f"WHEN {_has(w, c)} THEN '{n}'" for n, w in groups) + " END"


def _first_of(groups, c: Column) -> Column:
    out = None
    for name, words in groups:
        out = F.when(Q.any_of(c, words), name) if out is None else out.when(Q.any_of(c, words), name)
    return out


@query(f"""WITH {_R}, m AS (SELECT q_id, i, name, regexp_replace(name, '[.][^.]+$', '') || ' ' || trim(regexp_replace(text, '[ \\t]+', ' ', 'g')) AS t FROM refs)
    SELECT q_id, i, {_first_sql(_TYPES, 't')} AS doc_type, {_first_sql(_DOMAINS, 't')} AS domain, list_last(regexp_extract_all(t, '(?:19|20)[0-9]{{2}}年(?:[0-9]{{1,2}}月(?:[0-9]{{1,2}}日)?)?')) AS revised,
        CASE WHEN regexp_matches(t, '现行|最新') THEN '现行' WHEN contains(t, '修订') THEN '修订版' ELSE nullif(regexp_extract(t, '(?:19|20)[0-9]{{2}}年版'), '') END AS scope, array_to_string({_distinct(f"regexp_extract_all(t, '{Q.ARTICLE}')")}[1:24], '|') AS articles,
        array_to_string({_distinct(f"regexp_extract_all(t, '{_PROCEDURE}')")}, '|') AS procedures, array_to_string({_distinct(f"regexp_extract_all(t, '{_CONTRACT}')")}, '|') AS contracts FROM m""")
def document_metadata(spark, d):
    """Type, domain, date, scope and anchors of a document, from its name and text."""
    r = references(spark, d).select("q_id", "i", F.concat(F.regexp_replace("name", "[.][^.]+$", ""), F.lit(" "), F.trim(F.regexp_replace("text", "[ \t]+", " "))).alias("t"))
    t = F.col("t")
    scope = F.when(Q.any_of(t, ("现行", "最新")), "现行").when(F.contains(t, F.lit("修订")), "修订版").otherwise(F.regexp_substr(t, F.lit("(?:19|20)[0-9]{2}年版")))
    anchors = lambda p: F.array_join(F.slice(Q.ordered(Q.every(t, p)), 1, 24), "|")
    local = F.contains(t, F.lit("地方")) & F.contains(t, F.lit("条例"))
    kind = F.when(~Q.any_of(t, dict(_TYPES)["法律"] + dict(_TYPES)["条例"]) & local, "地方性法规").otherwise(_first_of(_TYPES, t))
    return r.select("q_id", "i", kind.alias("doc_type"), _first_of(_DOMAINS, t).alias("domain"), T.last_date(t).alias("revised"), scope.alias("scope"), anchors(Q.ARTICLE).alias("articles"), anchors(_PROCEDURE).alias("procedures"), anchors(_CONTRACT).alias("contracts"))


_SIZED = f"SELECT doc_id, {_FILE} AS name, n_chars * 4000 AS size FROM documents"


@query(f"""WITH f AS ({_SIZED}), k AS (SELECT *, lower(name) LIKE '%.pdf' AS pdf, size >= 5242880 AS large, {_first_sql(_TYPES, "regexp_replace(name, '[.][^.]+$', '')")} AS kind FROM f)
    SELECT doc_id, greatest(128, CASE WHEN NOT pdf THEN 0 WHEN large OR regexp_matches(name, '第[一二三四五六七八九十百千0-9]+条|指导性案例|案号|申请材料|办理流程|违约责任') THEN 224 WHEN kind IN ('法律', '条例', '地方性法规', '司法解释') THEN 196 WHEN kind IN ('指导性案例', '裁判文书') THEN 220
        WHEN kind = '合同范本' THEN 200 WHEN kind IN ('办事指南', '公报') THEN 180 ELSE 0 END)::INT AS tokens, CASE WHEN pdf AND (large OR kind IS NOT NULL) THEN 'plain' ELSE 'layout' END AS reader FROM k""")
def parser_config(spark, d):
    """How many tokens a chunk of a file may hold, and which reader takes it."""
    f = table(spark, d, "documents").select("doc_id", F.expr(_FILE).alias("name"), (F.col("n_chars") * 4000).alias("size"))
    name, stem = F.col("name"), F.regexp_replace("name", "[.][^.]+$", "")
    f = f.select("doc_id", "name", F.endswith(F.lower(name), F.lit(".pdf")).alias("pdf"), (F.col("size") >= 5 * 1024 * 1024).alias("large"), _first_of(_TYPES, stem).alias("kind"))
    k = F.col("kind")
    by_kind = F.when(k.isin("法律", "条例", "地方性法规", "司法解释"), 196).when(k.isin("指导性案例", "裁判文书"), 220).when(k == "合同范本", 200).when(k.isin("办事指南", "公报"), 180).otherwise(0)
    wide = F.col("large") | F.rlike("name", F.lit("第[一二三四五六七八九十百千0-9]+条|指导性案例|案号|申请材料|办理流程|违约责任"))
    n = F.greatest(F.lit(128), F.when(F.col("pdf"), F.greatest(by_kind, F.when(wide, 224).otherwise(0))).otherwise(0))
    return f.select("doc_id", n.alias("tokens"), F.when(F.col("pdf") & (F.col("large") | k.isNotNull()), "plain").otherwise("layout").alias("reader"))


@query("SELECT doc_id, array_to_string(list_filter([source, lang, split_part(text, ' ', 1)], lambda x, i: x IS NOT NULL AND trim(x) <> '' AND list_position([source, lang, split_part(text, ' ', 1)], x) = i), '|') AS keywords FROM documents")
def merged_keywords(spark, d):
    """Keywords of several fields, trimmed, each once in the order in which they come."""
    words = F.array_compact(F.array("source", "lang", F.split_part("text", F.lit(" "), F.lit(1))))
    return table(spark, d, "documents").select("doc_id", F.array_join(Q.ordered(words), "|").alias("keywords"))


# ---- rankings ----


@query(f"""WITH {_Q}, {_R}, k AS (SELECT q_id, unnest(keys) AS key FROM asked), c AS (SELECT DISTINCT k.q_id, key FROM k JOIN refs ON k.q_id = refs.q_id WHERE contains(regexp_replace(lower(name), '\\s+', '', 'g'), key))
    SELECT a.q_id, len(keys)::INT AS requested, count(c.key)::INT AS covered FROM asked a LEFT JOIN c ON a.q_id = c.q_id WHERE len(keys) > 0 GROUP BY a.q_id, len(keys)""")
def issue_coverage(spark, d):
    """How many of the requested issues the evidence covers."""
    a = asked(spark, d).where(F.size("keys") > 0).select("q_id", "keys")
    names = references(spark, d).groupBy("q_id").agg(F.collect_list(Q.match_key(F.col("name"))).alias("names"))
    covered = F.size(F.filter("keys", lambda k: F.exists(F.coalesce("names", Q.strings()), lambda n: F.contains(n, k))))
    return a.join(names, "q_id", "left").select("q_id", F.size("keys").alias("requested"), covered.alias("covered"))


@query(f"""WITH {_R}, q AS (SELECT o_orderkey AS q_id, list_filter(list_distinct(string_split({_anc(f'trim({_QUESTION})')}, '')), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]') AND NOT contains('{A.COMMON}', x)) AS mine FROM orders)
    SELECT refs.q_id, max(len(list_intersect(mine, list_distinct(string_split({_anc('name')}, '')))))::INT AS best FROM refs JOIN q ON refs.q_id = q.q_id GROUP BY refs.q_id""")
def title_overlap(spark, d):
    """The most letters that a name shares with the question."""
    names = references(spark, d).groupBy("q_id").agg(F.collect_list(A.anchor(F.col("name"))).alias("names"))
    return questions(spark, d).join(names, "q_id").select("q_id", A.best_overlap(F.trim("q"), F.col("names")).alias("best"))


@query(f"""WITH {_Q}, {_R}, x AS (SELECT refs.q_id, i, name, (35 * len(list_filter(titles, lambda t: contains(name, t))) + 12 * len(list_filter(years, lambda y: contains(name, y))) + 50 * len(list_filter(dates, lambda t: contains(name, t)))
        + CASE WHEN contains(question, '公报') AND contains(name, '公报') THEN 20 ELSE 0 END + CASE WHEN contains(question, '实施条例') AND contains(name, '实施条例') THEN 25 ELSE 0 END)::INT AS score FROM refs JOIN asked ON refs.q_id = asked.q_id)
    SELECT q_id, i, name, score FROM x WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY score DESC, i) = 1""")
def title_document(spark, d):
    """The piece of evidence whose name fits the question best, the first of equal ones."""
    x = references(spark, d).join(asked(spark, d).select("q_id", "question", "titles", "years", "dates"), "q_id")
    name, q = F.col("name"), F.col("question")
    held = lambda c: F.size(F.filter(c, lambda t: F.contains(name, t)))
    both = lambda w, n: F.when(F.contains(q, F.lit(w)) & F.contains(name, F.lit(w)), n).otherwise(0)
    x = x.withColumn("score", 35 * held("titles") + 12 * held("years") + 50 * held("dates") + both("公报", 20) + both("实施条例", 25)).where("score > 0")
    best = x.groupBy("q_id").agg(F.max_by(F.struct("i", "name", "score"), F.struct("score", -F.col("i"))).alias("b"))
    return best.select("q_id", "b.i", "b.name", "b.score")


@query(f"""WITH {_R} SELECT q_id, min(i) AS i, arg_min(text, i) AS text FROM refs WHERE regexp_matches(text, '处罚|申请条件|修订') GROUP BY q_id""")
def first_evidence(spark, d):
    """The first piece of evidence that any of the patterns fits."""
    r = references(spark, d).where(F.rlike("text", F.lit("处罚|申请条件|修订")))
    return r.groupBy("q_id").agg(F.min("i").alias("i"), F.min_by("text", "i").alias("text"))


@query(f"""WITH {_Q} SELECT route, count(*) AS cases, sum(wanted)::BIGINT AS documents FROM asked GROUP BY GROUPING SETS ((), (route))""")
def case_types(spark, d):
    """Questions and the documents that they want, for each route and in all."""
    return asked(spark, d).groupingSets([[], ["route"]], "route").agg(F.count("*").alias("cases"), F.sum("wanted").alias("documents"))


@query(f"""WITH {_Q}, sem AS (SELECT *, route IN ('version_diff_lookup', 'version_conflict_lookup') OR regexp_matches(question, '比较|差异|理由|为什么') AS semantic FROM asked)
    SELECT route, count(*) AS cases, count(*) FILTER (WHERE semantic) AS semantic_cases, round(coalesce(avg(wanted) FILTER (WHERE semantic), 0), 6) AS semantic_wanted FROM sem GROUP BY GROUPING SETS ((), (route))""")
def semantic_subsets(spark, d):
    """Measures of a subset of cases, chosen by route or by words, for each route and in all."""
    semantic = F.col("route").isin("version_diff_lookup", "version_conflict_lookup") | Q.any_of(F.col("question"), ("比较", "差异", "理由", "为什么"))
    s = asked(spark, d).select("route", "wanted", semantic.alias("semantic"))
    mean = F.round(F.coalesce(F.avg(F.when(F.col("semantic"), F.col("wanted"))), F.lit(0.0)), 6)
    return s.groupingSets([[], ["route"]], "route").agg(F.count("*").alias("cases"), F.count_if("semantic").alias("semantic_cases"), mean.alias("semantic_wanted"))


@query("""WITH x AS (SELECT user_id, event_type, avg(value) AS mean, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mean DESC NULLS LAST, event_type) AS rank FROM x)
    SELECT user_id, event_type, rank, rank <= 2 AS reranked FROM r WHERE rank <= greatest(2 * 1, 3)""")
def candidate_pool(spark, d):
    """A pool of candidates by the mean of several values, of which the first page is ranked again."""
    x = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("mean"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("mean").desc_nulls_last(), "event_type"))
    return x.withColumn("rank", rank).where("rank <= 3").select("user_id", "event_type", "rank", (F.col("rank") <= 2).alias("reranked"))


# ---- chunks ----

_SQL_TOKENS = "len(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}]'))"


@query(f"""WITH RECURSIVE l AS (SELECT doc_id, list_filter(string_split_regex(replace(replace(replace(replace(text, chr(10), chr(1) || chr(10) || chr(1)), '!', chr(1) || '!' || chr(1)), '?', chr(1) || '?' || chr(1)), ';', chr(1) || ';' || chr(1)), chr(1)), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL AND text <> ''),
    z AS (SELECT doc_id, ps, list_transform(ps, lambda x: {_SQL_TOKENS.format('x')}) AS ns FROM l),
    w AS (SELECT doc_id, 1 AS i, 0 AS chunk, ns[1]::BIGINT AS held FROM z UNION ALL SELECT w.doc_id, i + 1, CASE WHEN held > 128 THEN chunk + 1 ELSE chunk END, CASE WHEN held > 128 THEN 0 ELSE held END + ns[i + 1] FROM w JOIN z ON w.doc_id = z.doc_id WHERE i < len(ps))
    SELECT w.doc_id, chunk, sum(ns[i])::BIGINT AS n_tokens, string_agg(ps[i], '' ORDER BY i) AS text FROM w JOIN z ON w.doc_id = z.doc_id GROUP BY w.doc_id, chunk""")
def token_chunks(spark, d):
    """Texts cut at delimiters, put together until a chunk has more than 128 tokens."""
    docs = table(spark, d, "documents").where("text <> ''").select("doc_id", F.filter(packing.delimited(F.col("text"), "\n!?;"), lambda x: x != "").alias("pieces"))
    return packing.chunked(docs, "doc_id", "pieces", 128, before=False)


@query(f"""WITH RECURSIVE l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL),
    z AS (SELECT doc_id, ps, list_transform(ps, lambda x: {_SQL_TOKENS.format('x')}) AS ns FROM l WHERE len(ps) > 0),
    w AS (SELECT doc_id, 1 AS i, 0 AS chunk, ns[1]::BIGINT AS held FROM z UNION ALL SELECT w.doc_id, i + 1, CASE WHEN held + ns[i + 1] > 200 THEN chunk + 1 ELSE chunk END, CASE WHEN held + ns[i + 1] > 200 THEN 0 ELSE held END + ns[i + 1] FROM w JOIN z ON w.doc_id = z.doc_id WHERE i < len(ps))
    SELECT w.doc_id, chunk, sum(ns[i])::BIGINT AS n_tokens, string_agg(ps[i], '' ORDER BY i) AS text FROM w JOIN z ON w.doc_id = z.doc_id GROUP BY w.doc_id, chunk""")
def section_chunks(spark, d):
    """Lines put together as long as a chunk stays within 200 tokens; a heading opens one (Latin lines hold none)."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", lines.alias("pieces"))
    return packing.chunked(docs, "doc_id", "pieces", 200, before=True)
