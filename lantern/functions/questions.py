"""What a legal question asks for, as Column expressions: slots, routes, intents, weights, constraints and planned queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from lantern.functions.text import chinese_number, half_width

# The words, patterns and numbers that questions are read by.
DOC_TYPES = ("法", "条例", "实施条例", "公报", "指导性案例", "合同", "合同模板", "办事指南", "申请表", "申报表")
INTENT_DOC_TYPES = ("法律", "法典", "条例", "实施条例", "地方性法规", "司法解释", "指导性案例", "裁判文书", "合同范本", "办事指南", "公报")
TYPE_ALIASES = {
    "法律": ("法律", "法典", "法条"), "条例": ("条例", "实施条例", "办法", "规定"), "地方性法规": ("地方性法规", "地方条例", "地方规定"), "司法解释": ("司法解释", "批复", "解释"),
    "指导性案例": ("指导性案例", "典型案例"), "裁判文书": ("裁判文书", "判决书", "裁定书"), "合同范本": ("合同范本", "示范文本", "合同模板"),
    "办事指南": ("办事指南", "申请指南", "办事流程"), "公报": ("公报", "通告", "法规汇编"),
}
FULL_NAMES = (("民法典", "中华人民共和国民法典"), ("刑法", "中华人民共和国刑法"), ("行政处罚法", "中华人民共和国行政处罚法"), ("著作权法", "中华人民共和国著作权法"), ("专利法", "中华人民共和国专利法"), ("劳动合同", "劳动合同法"))
INTENTS = {
    "article_locate": ("第", "条", "款", "项", "怎么规定", "规定是什么"),
    "procedure_extract": ("申请条件", "申请材料", "办理流程", "办理时限", "受理机关", "许可", "怎么办"),
    "penalty_elements": ("处罚", "构成要件", "适用条件", "情形", "违法"),
    "case_holding": ("案例要旨", "裁判要旨", "裁判结论", "指导性案例", "案号"),
    "case_reasoning": ("裁判理由", "争议焦点", "法院认为", "为什么"),
    "contract_clause": ("合同", "违约责任", "解除条件", "争议解决", "权利义务"),
    "doc_precise": ("原文", "全文", "是否包含", "精确定位", "第几条"),
    "version_effect": ("现行", "修订", "生效", "废止", "哪一版", "版本"),
    "comparison": ("比较", "对比", "区别", "哪个更", "差异"),
}
TABLES = ("申请表", "申报表", "表单", "目录", "清单")
CASES = ("指导性案例", "案号", "裁判要旨", "裁判理由", "争议焦点")
DEADLINES = ("期限", "时限", "几日", "几天", "多久", "工作日", "办理时限", "审查时限", "受理时限", "截止", "届满", "起算")
AMOUNTS = ("金额", "罚款", "罚金", "赔偿", "违约金", "数额", "标准", "上限", "下限", "元", "万元", "比例")
SYNONYMS = {"合同解除": ("解除合同",), "解除合同": ("合同解除",), "违约金": ("违约损害赔偿",), "违约损害赔偿": ("违约金",), "生效日期": ("生效时间", "施行日期"), "施行日期": ("生效日期",), "法条": ("条文", "法规条文")}
NUMERAL = "0-9一二两三四五六七八九十百千〇零"
STRONG = ("gazette_issue_lookup", "law_article_lookup", "same_name_disambiguation", "version_conflict_lookup", "version_diff_lookup", "version_lookup")
GAZETTE = "全国人民代表大会常务委员会公报"
LEADING = "^(?:请|给|我|你|帮|返回|定位|检索|提供|回答|并列|同时|不要|只要|答案)+"
TITLE_END = "(?:法典|法律|法|实施条例|条例|规定|办法|公报|合同|指南|申请表|申报表|案例|标准)"
ARTICLE = "第[一二三四五六七八九十百千0-9]+(?:编|章|节|条|款|项)"
CASE = r"指导性案例\s*第?\d+号|\(?\d{4}\)?[\x{4e00}-\x{9fa5}]{1,6}\d{2,8}号"
DATE = r"(?U)(?:19|20)\d{2}年(?:\d{1,2}月(?:\d{1,2}日)?)?|\b(?:19|20)\d{6}\b"


def strings() -> Column:
    """No strings."""
    return F.expr("cast(array() as array<string>)")


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def once(value: Column) -> Column:
    """value as the row of a generator: filters that name its fields stay above it and don't work it out again."""
    return F.explode(F.array(value))


def record(fields: dict[str, Column]) -> Column:
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def any_of(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words))


def held(c: Column, words) -> Column:
    """Those of ``words`` that occur, in the order of ``words``."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))


def every(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def ordered(values: Column) -> Column:
    """Trimmed, not empty, first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""))


def ordered_of(*arrays: Column) -> Column:
    return ordered(F.concat(*arrays))


def arabic(c: Column) -> Column:
    """A number's digits where it is one, above 0, else the text as it is."""
    n = chinese_number(c)
    return F.when(n > 0, n.cast("string")).otherwise(c)


def title(c: Column) -> Column:
    """A title without request words in front and marks around."""
    return F.regexp_replace(F.regexp_replace(c, LEADING, ""), "^[，。；：:、 ]+|[，。；：:、 ]+$", "")


def match_key(c: Column) -> Column:
    """For comparing: half width, lower case, without the state's name and white space, brackets and marks unified."""
    marks = F.translate(half_width(F.coalesce(c, F.lit(""))), "《》【】。；、", "<>[].;,")
    return F.regexp_replace(F.regexp_replace(F.lower(marks), "中华人民共和国", ""), r"(?U)\s+", "")


def titles(q: Column) -> Column:
    unwanted = F.transform(every(q, "不要《([^》]{2,120})》", 1), title)
    quoted = F.filter(F.transform(every(q, "《([^》]{2,120})》", 1), title), lambda t: ~F.array_contains(unwanted, t))
    gazette = F.when(any_of(q, ("全国人大常委会", "全国人民代表大会常务委员会")), F.array(F.lit(GAZETTE))).otherwise(F.array(F.lit("公报")))
    bare = F.filter(
        F.transform(every(q, rf"([\x{{4e00}}-\x{{9fa5}}A-Za-z0-9·（）()、]{{2,90}}?{TITLE_END})", 1), title),
        lambda t: (t != "") & ~F.array_contains(unwanted, t) & ~F.rlike(t, F.lit("^(?:请|给|我要|我只要|我担心)")),
    )
    return ordered(F.when(F.size(quoted) > 0, quoted).when(F.contains(q, F.lit("公报")), gazette).otherwise(bare))


def years(q: Column) -> Column:
    return ordered(every(half_width(q), "(?:19|20)[0-9]{2}"))


def dates(q: Column) -> Column:
    """yyyymmdd: eight digits with no digit beside them, and dates in words with month and day."""
    h = half_width(q)
    said = F.transform(every(h, "(?:19|20)[0-9]{2}年[0-9]{1,2}月[0-9]{1,2}日"), lambda d: F.concat(F.substring(d, 1, 4), F.lpad(F.regexp_extract(d, "年([0-9]+)月", 1), 2, "0"), F.lpad(F.regexp_extract(d, "月([0-9]+)日", 1), 2, "0")))
    return ordered_of(every(h, "(?<![0-9])(?:19|20)[0-9]{6}(?![0-9])"), said)


def refused_issues(q: Column) -> Column:
    return ordered(F.transform(every(half_width(q), rf"不要\s*第\s*([{NUMERAL}]+)\s*期", 1), arabic))


def issues(q: Column) -> Column:
    return F.array_except(ordered(F.transform(every(half_width(q), rf"第\s*([{NUMERAL}]+)\s*期", 1), arabic)), refused_issues(q))


def refusals(q: Column) -> Column:
    """What stands behind each "not wanted", and the kinds of version that are refused."""
    more = F.concat(F.when(F.contains(q, F.lit("不要基础版")), F.array(F.lit("基础版"))).otherwise(strings()), F.when(F.contains(q, F.lit("不要带日期")), F.array(F.lit("带日期后缀"), F.lit("日期后缀"))).otherwise(strings()))
    return ordered_of(every(half_width(q), "不要([^，。；,.]{1,28})", 1), more)


def subjects(q: Column, found: Column) -> Column:
    reserve = F.when(F.contains(q, F.lit("自然保护区")) & ~F.exists(found, lambda t: F.contains(t, F.lit("自然保护区"))), F.array(F.lit("自然保护区"))).otherwise(strings())
    return ordered_of(reserve, F.when(any_of(q, ("全国人大常委会公报", GAZETTE)), F.array(F.lit(GAZETTE))).otherwise(strings()))


def articles(q: Column) -> Column:
    """第n条 and the like, with Arabic numbers."""
    pattern = rf"(?:第)?\s*([{NUMERAL}]+)\s*(?:条|款|项|章|节|编)"
    return ordered(F.transform(every(half_width(q), pattern), lambda m: F.concat(F.lit("第"), arabic(F.regexp_extract(m, rf"([{NUMERAL}]+)", 1)), F.right(m, F.lit(1)))))


def parallel(q: Column) -> Column:
    n = f"[{NUMERAL}]+"
    joint = "(?:与|和|及|以及)"
    return any_of(q, ("同时", "并列", "对比", "比较")) | F.rlike(q, F.lit(rf"》\s*{joint}\s*《|第\s*{n}\s*期\s*{joint}\s*第|基础版\s*{joint}\s*(?:现行版|最新版|(?:19|20)[0-9]{{6}})"))


def slots(q: Column) -> Column:
    """A struct of what the question names; ``routed`` tells what follows from it."""

    def read(q):
        return record({
            "question": q, "titles": titles(q), "years": years(q), "issues": issues(q), "dates": dates(q), "articles": articles(q),
            "cases": ordered(every(half_width(q), r"指导性案例\s*第?\s*([0-9]+)\s*号", 1)), "doc_types": held(q, DOC_TYPES), "refusals": refusals(q), "refused_issues": refused_issues(q),
            "refused_titles": ordered(F.transform(every(q, "不要《([^》]{2,120})》", 1), title)), "refused_dates": ordered(every(half_width(q), "不要[^，。；,.]{0,12}?((?:19|20)[0-9]{6})", 1)),
            "no_base": F.contains(q, F.lit("不要基础版")), "no_dated": F.contains(q, F.lit("不要带日期")), "base": F.contains(q, F.lit("基础版")) & ~F.contains(q, F.lit("不要基础版")),
            "current": any_of(q, ("现行", "最新版")), "parallel": parallel(q),
        })

    return let(F.trim(F.coalesce(q, F.lit(""))), read)


def routed(s: Column) -> Column:
    """A struct of subjects, keys, route, strong and wanted (documents), of the struct that ``slots`` makes."""
    some, q = (lambda n: F.size(s[n]) > 0), s["question"]
    gazette = F.contains(q, F.lit("公报"))
    refused = some("refusals") | F.contains(q, F.lit("同名"))
    first = (
        F.when(gazette & (some("years") | some("issues")), F.when(refused | F.contains(q, F.lit("去歧义")), "same_name_disambiguation").otherwise("gazette_issue_lookup"))
        .when(s["parallel"] & F.contains(q, F.lit("基础版")) & some("dates"), "version_diff_lookup")
        .when(s["parallel"] & ((F.size(s["titles"]) >= 2) | some("dates") | F.contains(q, F.lit("基础版"))), "version_conflict_lookup")
        .when(refused | any_of(q, ("只要", "不要")), "same_name_disambiguation").when(some("dates"), "version_lookup").otherwise("general")
    )
    keys = F.when(gazette, F.flatten(F.transform(s["years"], lambda y: F.transform(s["issues"], lambda i: F.concat(y, F.lit("_"), i, F.lit("_npc")))))).otherwise(strings())

    def counted(x):
        several = F.when((x["route"] == "version_diff_lookup") & some("dates"), 2).when(F.size(s["titles"]) >= 2, F.size(s["titles"])).when(F.size(s["dates"]) >= 2, F.size(s["dates"])).otherwise(2)
        wanted = F.when(F.size(x["keys"]) > 0, F.size(x["keys"])).when(s["parallel"], several).otherwise(1)
        return record({"subjects": x["subjects"], "keys": x["keys"], "route": x["route"], "strong": x["route"].isin(*STRONG), "wanted": wanted})

    def named(x):
        route = F.when((x["first"] != "gazette_issue_lookup") & some("articles") & (some("titles") | (F.size(x["subjects"]) > 0)), "law_article_lookup").otherwise(x["first"])
        return let(record({"subjects": x["subjects"], "keys": x["keys"], "route": route}), counted)

    return let(record({"subjects": subjects(q, s["titles"]), "keys": F.array_distinct(keys), "first": first}), named)


def expanded(q: Column) -> Column:
    """The question with all synonyms of the terms that it holds behind it."""
    groups = [F.when(any_of(q, (k, *v)), F.array(F.lit(k), *map(F.lit, v))).otherwise(strings()) for k, v in SYNONYMS.items()]
    more = F.array_distinct(F.concat(*groups))
    return F.when(F.size(more) > 0, F.concat(q, F.lit(" "), F.array_join(more, " "))).otherwise(q)


def intent(q: Column) -> Column:
    """The first rule that holds, of the expanded question."""
    out = (
        F.when(any_of(q, ("同时", "并列", "对比", "比较", "区别")), "comparison").when(any_of(q, ("版", "生效", "修订", "现行")), "version_effect")
        .when(F.contains(q, F.lit("指导性案例")) | F.rlike(q, F.lit(CASE)), "case_holding").when(F.rlike(q, F.lit(ARTICLE)), "article_locate")
        .when(any_of(q, ("办事指南", "申请条件", "申请材料", "办理流程", "办理时限")), "procedure_extract")
        .when(F.contains(q, F.lit("合同")) & any_of(q, ("条款", "违约责任", "解除条件", "争议解决")), "contract_clause")
    )
    for name, words in INTENTS.items():
        out = out.when(any_of(q, words), name)
    return out.otherwise("doc_precise")


def intent_titles(q: Column) -> Column:
    quoted = every(q, "《([^》]{2,80})》", 1)
    ends = TITLE_END.replace("|标准", "").replace("合同|", "合同|合同法|")
    bare = F.transform(every(q, rf"([\x{{4e00}}-\x{{9fa5}}A-Za-z0-9·（）()、]{{2,80}}?{ends})", 1), lambda t: F.regexp_replace(t, "^[，。；：:、 ]+|[，。；：:、 ]+$", ""))
    return ordered(F.when(F.size(quoted) > 0, quoted).otherwise(F.filter(bare, lambda t: ~F.rlike(t, F.lit(LEADING)))))


def intent_of(q: Column) -> Column:
    return let(expanded(q), intent)


def profile(q: Column) -> Column:
    """A struct of the question's intent and terms; ``flags`` follow from its fields."""

    def read(q):
        return let(expanded(q), lambda text: record({
            "question": q, "text": text, "intent": intent(text), "article_terms": ordered(every(text, ARTICLE)), "case_terms": ordered(every(text, CASE)),
            "date_terms": ordered(every(text, DATE)), "title_terms": intent_titles(text), "type_terms": held(text, INTENT_DOC_TYPES),
            "is_table": any_of(text, TABLES), "is_deadline": any_of(text, DEADLINES), "is_amount": any_of(text, AMOUNTS), "is_case": any_of(text, CASES),
        }))

    return let(F.trim(F.coalesce(q, F.lit(""))), read)


def flags() -> dict[str, Column]:
    named = F.size(F.concat("article_terms", "case_terms", "date_terms", "title_terms")) > 0
    i = F.col("intent")
    first = named | i.isin("article_locate", "doc_precise", "version_effect", "procedure_extract", "contract_clause")
    exact = first | F.col("is_table") | F.col("is_case") | (F.size("case_terms") > 0) | F.col("is_deadline") | F.col("is_amount")
    return {"exact": exact, "sparse": first, "dense": i.isin("case_reasoning", "case_holding", "comparison", "penalty_elements"), "comparison": i == "comparison"}


def _sum(*parts: tuple[str, float]) -> Column:
    return reduce(lambda a, b: a + b, (F.when(F.col(c), w).otherwise(0.0) for c, w in parts))


def fusion_weight(deadline: float = 0.06, amount: float = 0.05) -> Column:
    """Weight of the text beside the vectors, by the columns of ``flags`` and ``profile``."""
    w = 0.12 + _sum(("sparse", 0.12), ("exact", 0.06), ("is_deadline", deadline), ("is_amount", amount), ("comparison", -0.02), ("dense", -0.03))
    return F.round(F.least(F.lit(0.42), F.greatest(F.lit(0.08), w)), 6)


def rerank_weight(start: float = 0.6, deadline: float = 0.06, amount: float = 0.05) -> Column:
    w = F.lit(start) + _sum(("sparse", -0.08), ("exact", -0.04), ("is_deadline", -min(0.08, deadline)), ("is_amount", -min(0.08, amount)), ("dense", 0.06), ("comparison", 0.04))
    return F.round(F.least(F.lit(0.82), F.greatest(F.lit(0.30), w)), 6)


def constraints() -> dict[str, Column]:
    """must, must_not, prefer, avoid, hard_title, wanted: of the columns of ``profile``."""
    q, i, lit = F.col("question"), F.col("intent"), (lambda *w: F.array(*map(F.lit, w)))
    h = half_width(q)
    gazette = F.contains(q, F.lit("公报"))
    numbers = every(h, rf"第\s*([{NUMERAL}]+)\s*期", 1)
    spelled = F.flatten(F.transform(numbers, lambda n: F.array(F.concat(F.lit("第"), n, F.lit("期")), F.concat(F.lit("_"), n, F.lit("_npc")), F.concat(F.lit("_"), n, F.lit(".pdf")))))
    in_years = F.transform(every(h, r"((?:19|20)[0-9]{2})\s*年", 1), lambda y: F.concat(y, F.lit("年")))
    when = lambda c, a: F.when(c, a).otherwise(strings())
    versions = every(q, r"(?U)\b[0-9]{8}\b|[0-9]{4}[_-][0-9]\b|[0-9]{4}版")
    asks = gazette & any_of(F.col("text"), ("第", "期", "并列", "同时"))
    comments = i.isin("case_reasoning", "case_holding", "comparison")
    must = ordered_of(F.col("article_terms"), F.col("case_terms"), F.col("date_terms"), F.col("title_terms"), versions, when(gazette, F.concat(lit(GAZETTE, "公报"), in_years, spelled)))
    refused = F.contains(h, F.lit("不要第")) & F.contains(h, F.lit("期"))
    must_not = ordered_of(every(h, "不要([^，。；,.]{1,24})", 1), when(refused, spelled), when(any_of(h, ("基础版", "不要带日期")), lit("_20", "_19")))
    prefer = F.when(asks, lit("公报", "公告")).when(F.col("is_table"), lit("申请表", "申报表", "办事指南")).when(comments, lit("指导性案例", "裁判文书", "司法解释")).otherwise(strings())
    avoid = F.concat(when(asks, lit("案例", "合同", "申请表")), when(gazette, lit("案例", "合同", "申请表", "办事指南", "裁判文书")))
    hard = ((F.size("title_terms") > 0) & i.isin("article_locate", "version_effect", "doc_precise")) | gazette
    wanted = F.when((i == "comparison") | any_of(q, ("并列", "同时", "对比", "比较")), 2).otherwise(1)
    return {"must": must, "must_not": must_not, "prefer": ordered_of(prefer, when(gazette, lit("公报"))), "avoid": F.array_distinct(avoid), "hard_title": hard, "wanted": wanted}


def planned(most: int = 8) -> Column:
    """Up to ``most`` queries for one question, the question itself first, of the columns of ``profile`` and ``flags``."""
    q, i = F.col("question"), F.col("intent")
    join = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    when = lambda c, *parts: F.when(c, F.array(*parts)).otherwise(strings())
    two = lambda c: F.slice(c, 1, 2)
    each = lambda a, f: F.flatten(F.transform(a, f))
    found = lambda a, c: F.when(c, a).otherwise(strings())
    names = F.concat(F.array(q), *(when(F.contains(q, F.lit(a)) & ~F.contains(q, F.lit(b)), F.replace(q, F.lit(a), F.lit(b))) for a, b in FULL_NAMES))
    names = ordered(names)
    arts, cases = two(every(q, ARTICLE)), two(every(q, CASE))
    said = two(every(q, r"(?:19|20)\d{2}年(?:\d{1,2}月(?:\d{1,2}日)?)?"))
    heads = two(F.col("title_terms"))
    h = half_width(q)
    in_years = two(ordered(F.transform(every(h, r"((?:19|20)[0-9]{2})\s*年", 1), lambda y: F.concat(y, F.lit("年")))))
    spelled = F.flatten(F.transform(every(h, rf"第\s*([{NUMERAL}]+)\s*期", 1), lambda n: F.array(join("第", n, "期"), join("_", n, "_npc"), join("_", n, ".pdf"))))
    numbers = F.slice(ordered(spelled), 1, 4)
    both = each(in_years, lambda y: each(numbers, lambda n: F.array(join(f"{GAZETTE} ", y, " ", n), join(f"{GAZETTE} ", y, " ", n, " npc"))))
    gazette = F.concat(
        F.array(join(q, f" {GAZETTE}")),
        F.when((F.size(in_years) > 0) & (F.size(numbers) > 0), both).when(F.size(in_years) > 0, F.transform(in_years, lambda y: join(f"{GAZETTE} ", y))).otherwise(F.transform(numbers, lambda n: join(f"{GAZETTE} ", n))),
    )
    kinds = F.map_from_arrays(F.array(*map(F.lit, TYPE_ALIASES)), F.array(*(F.array(*map(F.lit, v)) for v in TYPE_ALIASES.values())))
    types = F.slice(ordered(each("type_terms", lambda t: F.coalesce(F.try_element_at(kinds, t), F.array(t)))), 1, 4)
    exact = F.concat(
        each(heads, lambda t: F.concat(F.array(join(t, " 原文")), each(arts, lambda a: F.array(join(t, " ", a), join(t, " ", a, " 条文原文"))))),
        F.transform(cases, lambda c: join(c, " 原文")), F.transform(said, lambda d: join(q, " ", d)),
    )
    located = F.concat(
        each(arts, lambda a: each(two(names), lambda n: F.array(join(n, " ", a, " 条文原文"), join(n, " ", a, " 原文位置")))),
        each(heads, lambda t: each(arts, lambda a: F.array(join("《", t, "》 ", a, " 原文"), join(t, " 全文 ", a, " 条文"), join("中华人民共和国", t, " ", a)))),
    )
    every_one = F.concat(
        names, found(exact, F.col("exact")), found(located, i == "article_locate"),
        when(i == "procedure_extract", join(q, " 申请条件 申请材料 办理流程 办理时限 受理机关"), join(q, " 办事指南 许可目录 申报表")),
        when(i.isin("penalty_elements", "version_effect") & ~F.col("exact"), join(q, " 适用条件 构成要件 处罚"), join(q, " 生效 修订 现行")),
        found(F.concat(F.transform(cases, lambda c: join(c, " 裁判要旨 争议焦点 裁判理由")), F.array(join(q, " 基本案情 裁判理由 结论"))), i.isin("case_holding", "case_reasoning")),
        when(i == "contract_clause", join(q, " 合同目的 权利义务 违约责任 解除条件 争议解决")), when(i == "comparison", join(q, " 对比 差异 适用范围"), join(q, " 法条 比较")),
        found(gazette, F.contains(q, F.lit("公报"))), F.transform(types, lambda t: join(q, " ", t)), F.transform(said, lambda d: join(q, " ", d, " 生效 修订")),
    )
    return F.slice(ordered(every_one), 1, most)
