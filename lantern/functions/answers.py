"""Which way a question is answered, whether the evidence suffices, and what an answer lacks, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lantern.functions.questions import any_of, every, half_width, let, ordered, ordered_of, record, strings

# Words that decide.
CERTAIN = ("文件名", "表格文件名", "完整表名", "表名", "标题", "关键词", "条文编号", "版本", "版次", "版本号", "版本数字", "哪份", "案由关键词", "纠纷性质", "责任类型", "罪名方向", "发布单位", "原文文件", "文件", "文档名", "同时给出", "同时返回", "同时出现", "并列返回")
SEMANTIC = ("解释", "说明", "含义", "理解", "为什么", "理由", "争议焦点", "法院认为", "裁判要旨", "案例要旨", "构成要件", "适用条件", "适用边界", "怎么规定", "如何适用", "归纳", "总结", "提炼", "比较", "对比", "区别", "差异")
MODEL_FIRST = ("case_reasoning", "comparison", "penalty_elements")
PAIRS = ("两个", "两份", "并列", "同时返回", "同时给出", "同时给", "新旧", "可比对", "法律+实施条例", "法律＋实施条例", "与实施条例", "和实施条例")
LOW_BAR = ("文件名", "表格文件名", "完整表名", "表名", "标题", "版本", "版次", "版本号", "版本数字", "哪份", "案由关键词", "纠纷性质", "责任类型", "罪名方向", "发布单位", "命中", "出现")
GENERIC = ("办事指南", "服务指南", "申请表", "申报表", "表单", "合同", "公报", "案例")
PREFIXES = ("请", "请并列", "请同时", "请回答", "请给", "请提供", "给出", "给", "给我", "我要", "答案", "并列", "同时", "如果有", "有没有", "和", "与", "返回", "定位", "检索", "回答", "提供")
NOISE = ("请", "给", "我", "你", "帮", "返回", "定位", "检索", "提供", "回答", "答案", "直接", "精确", "具体", "对应", "文件", "文件名", "版本", "版次", "版本号", "版本数字", "关键词", "需", "需要", "包含", "出现", "命中", "不要", "泛泛解释", "全文", "完整版")
COMMON = "请给我你帮的了和与并或在中对应哪份哪个什么是否有没有如果回答答案直接精确具体文件版本版次数字关键词需要需出现命中包含返回提供定位检索"
ABSTAIN = ("无法回答", "无法确定", "未找到", "缺少直接证据", "无法支持该请求")
SAME = (("村委会", "村民委员会"), ("村民委员会", "村委会"), ("居委会", "城市居民委员会"), ("城市居民委员会", "居委会"), ("全国人大常委会", "全国人民代表大会常务委员会"), ("全国人民代表大会常务委员会", "全国人大常委会"), ("劳动争议法", "劳动合同法"), ("劳动争议", "劳动合同"))
EDGES = "^[，。；：:、（）() ]+|[，。；：:、（）() ]+$"
PREFIX = "^(?:" + "|".join(sorted(PREFIXES, key=len, reverse=True)) + ")*(..+)$"
PAIR = "(20[0-9]{2})年?第?([0-9一二三四五六七八九十]{1,2})期"
BARE = r"[\x{4e00}-\x{9fa5}A-Za-z0-9·（）()、]{2,80}?(?:法典|法律|法|实施条例|条例|规定|办法|公报|合同|指南|申请表|申报表|案例)"
DATE8 = r"(?U)\b(?:19|20)[0-9]{6}\b"


def anchor(c: Column) -> Column:
    """For finding names: half width, without white space."""
    return F.regexp_replace(half_width(F.coalesce(c, F.lit(""))), r"(?U)\s+", "")


def wants_several(q: Column) -> Column:
    return any_of(q, PAIRS) | (F.size(every(q, PAIR)) >= 2) | F.rlike(q, F.lit("第[0-9一二三四五六七八九十]{1,2}期和第[0-9一二三四五六七八九十]{1,2}期"))


def decision(q: Column, intent: Column, plain_intent: Column) -> dict[str, Column]:
    """class, mode, fallback, reason. plain_intent is that of the question without its refusals of explanations (``without_refusals``)."""
    explains = ("解释", "含义", "理由", "比较", "对比", "区别")
    certain = any_of(q, CERTAIN) | (any_of(q, ("只要", "直接给", "精确到", "精确返回")) & ~any_of(q, ("解释", "理由", "差异", "区别")))
    semantic = any_of(without_refusals(q), SEMANTIC) | plain_intent.isin(*MODEL_FIRST)
    exists = any_of(q, ("有没有", "是否有", "是否存在", "找不到", "没有的话"))
    rule = certain | wants_several(q) | any_of(q, ("只输出文件名",)) | ((intent == "article_locate") & ~any_of(q, explains))
    say = lambda text: F.concat(F.lit(f"{text}:"), intent)
    reason = (
        F.when(exists, "abstain_guarded_existence_query").when(rule, say("rule_first_high_certainty")).when(semantic, say("semantic_intent"))
        .when(intent.isin(*MODEL_FIRST), say("model_first_intent")).otherwise(say("high_certainty_or_rule_extract"))
    )
    kind = F.when(exists | rule, "A").when(semantic, "B").when(intent.isin(*MODEL_FIRST), "C").otherwise("A")
    mode = F.when(kind == "A", "rule").otherwise("model")
    fallback = F.when(exists, "none").when(kind == "A", "model").otherwise("rule")
    return {"class": kind, "mode": mode, "fallback": fallback, "reason": reason}


def without_refusals(q: Column) -> Column:
    return F.regexp_replace(q, "不要泛泛解释|不要解释|不需要解释", "")


def clean_title(c: Column) -> Column:
    """Without request words in front, as long as two characters stay, and marks around."""
    bare = F.regexp_replace(anchor(c), EDGES, "")
    cut = F.regexp_extract(bare, PREFIX, 1)
    return F.regexp_replace(F.when(cut != "", cut).otherwise(bare), EDGES, "")


def raw_titles(q: Column) -> Column:
    found = F.concat(F.transform(every(q, "《([^》]{2,80})》", 1), clean_title), F.transform(every(q, BARE), clean_title))
    return ordered(F.filter(found, lambda t: ~t.isin(*NOISE)))


def variants(title: Column) -> Column:
    """Other ways to write a title."""
    t = anchor(title)
    more = [F.when(F.contains(t, F.lit(a)), F.array(F.replace(t, F.lit(a), F.lit(b)))).otherwise(strings()) for a, b in SAME]
    city = F.when(F.contains(t, F.lit("市")) & (F.length(t) >= 6), F.array(F.replace(t, F.lit("市"), F.lit("")))).otherwise(strings())
    return ordered_of(F.array(t), *more, city)


def core(title: Column) -> Column:
    """A title without the state's name and its kind of document."""
    bare = F.replace(title, F.lit("中华人民共和国"), F.lit(""))
    cut = F.regexp_extract(bare, "^(.+?)(?:实施条例|办事指南|服务指南|申请表|申报表|合同|条例|公报|案例|法)$", 1)
    return F.when(cut != "", cut).otherwise(bare)


def letters(c: Column) -> Column:
    return F.filter(F.array_distinct(F.split(c, "")), lambda x: x != "")


def title_covered(title: Column, names: Column) -> Column:
    """Whether a file's name holds a variant of the title or most of its letters. names: array of anchors."""
    all_names = F.array_join(names, "\n")
    forms = variants(title)
    plain = lambda x: F.replace(x, F.lit("市"), F.lit(""))

    def near(name, v):
        v, name = plain(v), plain(name)
        other = F.startswith(v, F.lit("中华人民共和国")) & (core(v) != "") & ~F.contains(name, core(v))
        overlap = F.size(F.array_intersect(letters(v), letters(name)))
        return ~other & (((v != "") & F.contains(name, v)) | (overlap >= F.greatest(F.lit(4), F.floor(F.size(letters(v)) * 0.72))))

    enough = F.size(letters(F.element_at(forms, -1))) >= 4
    return F.exists(forms, lambda v: F.contains(all_names, v)) | (enough & F.exists(names, lambda n: F.exists(forms, lambda v: near(n, v))))


def question_letters(q: Column) -> Column:
    kept = F.filter(letters(anchor(q)), lambda x: F.rlike(x, F.lit(r"(?U)[\x{4e00}-\x{9fff}\p{L}\p{N}]")) & ~F.contains(F.lit(COMMON), x))
    return kept


def best_overlap(q: Column, names: Column) -> Column:
    """The most distinct letters that a name shares with the question."""
    mine = question_letters(q)
    return F.coalesce(F.array_max(F.transform(names, lambda n: F.size(F.array_intersect(mine, letters(n))))), F.lit(0))


def version_covered(q: Column, names: Column) -> Column:
    dates = every(F.replace(q, F.lit(" "), F.lit("")), DATE8)
    all_names = F.array_join(names, "\n")
    return (F.size(names) > 0) & F.when(F.size(dates) > 0, F.exists(dates, lambda d: F.contains(all_names, d))).otherwise(False)


def missing(names: Column, texts: Column) -> Column:
    """What the evidence lacks of what the question names, by the columns of a question's profile and anchors of names and texts."""
    q, docs, body = F.col("question"), F.array_join(names, "\n"), F.array_join(texts, "\n")
    said = lambda head, values: F.transform(values, lambda v: F.concat(F.lit(head), v))
    none = strings()
    arts = F.filter("article_terms", lambda a: ~(F.contains(docs, anchor(a)) | F.contains(body, anchor(a))))
    cases = F.filter("case_terms", lambda a: ~F.contains(docs, anchor(a)))
    dates = F.filter("date_terms", lambda a: ~F.contains(docs, anchor(a)) & ~F.contains(docs, F.regexp_replace(a, "[年月日]", "")))
    several, form = wants_several(q), any_of(q, ("申请表", "申报表", "办事指南", "合同", "公报"))
    explicit = (F.size(every(q, DATE8)) > 0) | any_of(q, ("版本", "现行", "修订", "生效", "第", "期"))

    def of_titles(raw):
        """Titles as they are said and whether a name covers them, each title once."""
        both = F.transform(F.concat("title_terms", raw), lambda t: F.struct(t.alias("t"), clean_title(t).alias("c")))
        return let(F.filter(both, lambda x: x["c"] != ""), lambda all_: F.transform(
            F.array_distinct(F.transform(all_, lambda x: x["c"])),
            lambda c: F.struct(F.get(F.filter(all_, lambda x: x["c"] == c), 0)["t"].alias("t"), title_covered(c, names).alias("ok")),
        ))

    def of_all(x):
        split, overlap, cases, dated = x["split"], x["overlap"], x["cases"], x["dated"]
        held = F.exists(x["raw"], lambda t: F.exists(variants(t), lambda v: F.contains(docs, v)))
        low = (F.size(names) > 0) & any_of(q, LOW_BAR) & (held | ((F.size(every(q, DATE8)) > 0) & dated) | (form & (overlap >= 4)) | (overlap >= 6))
        return let(low, lambda low: told(split, overlap, cases, dated, low))

    def told(split, overlap, cases, dated, low):
        lost = F.transform(F.filter(split, lambda x: ~x["ok"]), lambda x: x["t"])
        lost = F.when(F.exists(split, lambda x: x["ok"]) & ~several, none).when((F.size("case_terms") > 0) & (F.size(cases) == 0), F.filter(lost, lambda t: ~t.isin("需含案例", "案号", "指导性案例"))).otherwise(lost)
        lost = F.filter(lost, lambda t: ~(low & t.isin(*GENERIC)))
        bare = F.col("exact") & (F.size(split) == 0) & (F.size("case_terms") == 0) & (F.size("date_terms") == 0) & (overlap < 4)
        unnamed = bare & ~low & F.when(explicit, ~dated).otherwise(True)
        return F.concat(
            said("缺少条款锚点: ", arts), said("缺少案例锚点: ", cases), said("缺少版本日期锚点: ", dates), said("缺少目标文档标题锚点: ", lost), F.when(unnamed, F.array(F.lit("缺少可验证的目标文档名称锚点"))).otherwise(none),
            F.when(several & (F.size(F.array_distinct(F.filter(names, lambda n: n != ""))) < 2), F.array(F.lit("并列检索证据不足两个文档"))).otherwise(none),
        )

    found = lambda raw: record({"raw": raw, "split": of_titles(raw), "overlap": best_overlap(q, names), "cases": cases, "dated": version_covered(q, names)})
    return let(raw_titles(q), lambda raw: let(found(raw), of_all))


def guard(names: Column, texts: Column) -> Column:
    """A struct of reason ("" where the question can be answered) and missing."""
    empty = F.size(names) == 0
    exists = any_of(F.col("question"), ("有没有", "是否有", "是否存在"))
    return let(missing(names, texts), lambda lacks: record({
        "missing": F.when(empty, F.array(F.lit("未检索到任何参考证据"))).otherwise(lacks),
        "reason": F.when(empty, "no_references").when(F.size(lacks) == 0, "").when(exists, "existence_not_proved").otherwise("anchor_missing"),
    }))


def abstain_text(reason: Column, lacks: Column, documents: Column) -> Column:
    cite = F.when(documents, "##1$$").otherwise("")
    lost = F.when(F.size(lacks) > 0, F.array_join(lacks, "；")).otherwise("缺少目标实体对应证据")
    why = F.when(reason == "", "evidence_insufficient").otherwise(reason)
    return F.concat(F.lit("结论：无法回答，无法依据当前语料作答。\n原因：缺少目标实体对应证据（"), why, F.lit("）"), cite, F.lit("\n缺失信息："), lost)


def year_forms(phrase: Column) -> Column:
    """Other ways to write a year or a year's issue."""
    p = anchor(phrase)
    y, i = F.substring(p, 1, 4), F.regexp_extract(p, "^20[0-9]{2}[_-]([1-9][0-9]?)$", 1)
    year = F.when(F.rlike(p, F.lit("^20[0-9]{2}年$")), F.concat(F.array(y), F.transform(F.array(*map(F.lit, "1234")), lambda n: F.concat(y, F.lit("_"), n)))).otherwise(strings())
    issue = F.when(i != "", F.array(F.concat(y, F.lit("_"), i), F.concat(y, F.lit("年")), y, F.concat(F.lit("第"), i, F.lit("期")))).otherwise(strings())
    return ordered_of(F.array(p), year, issue)


def phrase_hit(text: Column, phrase: Column) -> Column:
    hay = anchor(text)
    return (anchor(phrase) == "") | F.exists(year_forms(phrase), lambda v: F.contains(hay, v))
