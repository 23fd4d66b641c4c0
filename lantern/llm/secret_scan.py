"""Secret scans through a trigram inverted index. DataFrame functions only.

Each rule is a regular expression. From it a Boolean query over trigrams is derived: alternatives (OR) of sets of trigrams
(AND) that any match must hold, in lower case. ``postings`` builds the inverted index (gram, doc_id) for the trigrams that
rules ask for; ``candidates`` intersects the postings; ``scan`` verifies the candidates with the regular expressions, and runs
rules without mandatory trigrams over every text. Of an alternative's trigrams the index holds the ``GRAMS`` rarest.

Nulls, empty texts: no spans. A null doc_id is a value like any other; repeated rows each get their own result. Of the input
only ``doc_id`` and ``text`` are used, so further columns can't clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lantern.llm.common import stored


@dataclass(frozen=True)
class Rule:
    kind: str
    #: In the syntax that Java and Python share.
    pattern: str
    #: This group must be so long.
    group: int = 0
    least: int = 1


#: The first three are the base; their matches are always kept as they are. The others are public formats of keys and tokens.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY( BLOCK)?-----"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}=*"),
    Rule("basic", r"(?i:authorization)\x20*:\x20*(?i:basic)\x20+[A-Za-z0-9+/]{8,}=*"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url", r"[a-z][a-z0-9+]{1,20}://[A-Za-z0-9._~%+-]{1,64}:[A-Za-z0-9._~%+-]{3,64}@[A-Za-z0-9.-]+"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("github_fine", r"github_pat_[A-Za-z0-9_]{50,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("slack_hook", r"hooks\.slack\.com/services/[A-Za-z0-9/_-]{20,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{20,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("google_oauth", r"ya29\.[A-Za-z0-9_-]{20,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("pypi", r"pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{50,}"),
    Rule("mailchimp", r"[0-9a-f]{32}-us[0-9]{1,2}"),
    Rule("telegram", r"[0-9]{8,10}:AA[A-Za-z0-9_-]{33}"),
    Rule("azure", r"AccountKey=[A-Za-z0-9+/]{80,}=*"),
    Rule("digitalocean", r"do[opr]_v1_[0-9a-f]{64}"),
    Rule("shopify", r"shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}"),
    Rule("huggingface", r"hf_[A-Za-z]{34}"),
    Rule("databricks", r"dapi[0-9a-f]{32}"),
    Rule("age", r"AGE-SECRET-KEY-1[0-9A-Z]{58}"),
)
#: More alternatives than this are merged, classes of more characters than this count as any character.
MANY, WIDE = 64, 5
#: Trigrams that the index holds for an alternative: those of the rarest letters.
GRAMS, FREQUENT = 2, "etaoinsrhldcumfpgwybvkxjqz"


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of trigrams, one of which any match holds in full, in lower case; [frozenset()] if nothing is mandatory."""
    ops = re._parser

    def minimal(found: set) -> set:
        return {g for g in found if not any(o < g for o in found)}

    def merged(states: set) -> set:
        if len(states) <= MANY:
            return states
        least = minimal({g for _, g in states})  # without their last characters most alternatives are alike
        return {("", g) for g in (least if len(least) <= MANY else [frozenset.intersection(*least)])}

    def literal(states: set, char: str) -> set:
        out = set()
        for tail, grams in states:
            tail = (tail + char.lower())[-3:]
            out.add((tail, grams | {tail} if len(tail) == 3 else grams))
        return out

    def cut(states: set) -> set:
        return {("", g) for _, g in states}

    def walk(nodes, states: set) -> set:
        for op, arg in nodes:
            if op is ops.LITERAL:
                states = literal(states, chr(arg))
            elif op is ops.IN and all(o is ops.LITERAL for o, _ in arg) and len(arg) <= WIDE:
                states = set().union(*(literal(states, chr(a)) for _, a in arg))
            elif op is ops.SUBPATTERN:
                states = walk(arg[3], states)
            elif op is ops.BRANCH:
                states = set().union(*(walk(x, states) for x in arg[1]))
            elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
                low, high, inner = arg
                for _ in range(min(low, 3)):
                    states = walk(inner, states)
                if low > 3:
                    states = cut(states)
                elif (low, high) == (0, 1):
                    states = states | walk(inner, states)
                elif high != low:
                    states = states | cut(states)
            elif op is not ops.AT:
                states = cut(states)
            states = merged(states)
        return states

    return sorted(minimal({g for _, g in walk(ops.parse(pattern), {("", frozenset())})}), key=sorted)


def _rarest(grams: frozenset[str]) -> list[str]:
    """The few trigrams of an alternative that the index holds: any of them must occur, so fewer only make more candidates."""
    commonness = lambda g: (sum(len(FREQUENT) - FREQUENT.index(c) if c in FREQUENT else 0 for c in g), g)
    return sorted(sorted(grams, key=commonness)[:GRAMS])


def clauses(rules=RULES) -> list[tuple[str, int, str, int]]:
    """(rule, alternative, gram, number of grams in the alternative) of the rules that have mandatory trigrams."""
    out = []
    for rule in rules:
        query = trigram_query(rule.pattern)
        if all(query):
            shared = frozenset.intersection(*query)
            alternatives = [_rarest(grams) for grams in ([shared] if shared else query)]
            out += [(rule.kind, i, gram, len(grams)) for i, grams in enumerate(alternatives) for gram in grams]
    return out


def postings(docs: DataFrame, rules=RULES) -> DataFrame:
    """(gram, doc_id) for each trigram that a rule asks for: the inverted index."""
    grams = sorted({c[2] for c in clauses(rules)})
    low = docs.select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams)))
    return low.select(F.explode(held).alias("gram"), "doc_id")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, rules): rules of which an alternative has all of its trigrams in the document."""
    wanted = index.sparkSession.createDataFrame(clauses(rules), "rule string, alternative int, gram string, n int")
    full = index.join(F.broadcast(wanted), "gram").groupBy("doc_id", "rule", "alternative").agg(F.count_distinct("gram").alias("got"), F.first("n").alias("n")).where("got = n")
    return full.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


_SPANS = "array<struct<start:int,ord:int,end:int,kind:string>>"


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost non-overlapping matches as structs (start, order, end, kind), in code points.

    The text is cut at the matches once; places are running sums of lengths, inside blocks of about the square root of the number of
    matches and then over the blocks, so that no long array is copied for each match.
    """
    p, none = F.lit(rule.pattern), F.expr(f"cast(array() as {_SPANS})")
    found = F.regexp_extract_all(text, p, F.lit(0))
    held = F.regexp_extract_all(text, p, F.lit(rule.group)) if rule.group else found
    cut = F.arrays_zip(found.alias("m"), F.split(text, rule.pattern, -1).alias("gap"), held.alias("h"))
    # what stands after the last match has no match of its own
    steps = F.transform(F.filter(cut, lambda x: x["m"].isNotNull()), lambda x: F.struct(F.length(x["m"]).alias("n"), F.length(x["gap"]).alias("gap"), (F.length(x["h"]) >= rule.least).alias("ok")))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), (start + x["n"]).alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct((start + x["n"]).alias("at"), F.when(x["ok"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def moved(spans, by):
        return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), s["ord"].alias("ord"), (s["end"] + by).alias("end"), s["kind"].alias("kind")))

    def join(acc, x):
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["parts"], F.array(moved(x["spans"], acc["at"]))).alias("parts"))

    def blocks(all_steps, size):
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(all_steps)), size)
        sums = F.transform(starts, lambda i: F.aggregate(F.slice(all_steps, i, size), F.struct(F.lit(0).alias("at"), none.alias("spans")), step))
        first = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{_SPANS}>)").alias("parts"))
        return F.flatten(F.aggregate(sums, first, join, lambda acc: acc["parts"]))

    return _let(steps, lambda s: _let(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(s))).cast("int")), lambda n: blocks(s, n)))


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, spans): spans are structs (start, ord, end, kind), by start and then by the order of the rules.

    Candidates are a written table, so their size is known before the join: few enough are broadcast by Spark, and texts stay where
    they are; else both sides are shuffled.
    """
    index = stored(postings(docs, rules), "postings")
    asked = {c[0] for c in clauses(rules)}
    found = stored(candidates(index, rules).withColumnRenamed("doc_id", "candidate"), "candidates")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    joined = texts.join(found, texts["doc_id"].eqNullSafe(found["candidate"]), "left")
    empty = F.expr(f"cast(array() as {_SPANS})")
    columns = []
    for order, rule in enumerate(rules):
        may = F.array_contains("rules", rule.kind) if rule.kind in asked else F.lit(True)
        columns.append(F.when(may & F.rlike("text", F.lit(rule.pattern)), _spans(F.col("text"), rule, order)).otherwise(empty))
    return joined.select("doc_id", F.sort_array(F.flatten(F.array(*columns))).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, base=RULES[:3]) -> DataFrame:
    """Counts and digests of ``scan``'s result."""
    kinds = [r.kind for r in base]
    mine = F.filter("spans", lambda s: s["kind"].isin(kinds))
    counts = [F.size(F.filter(F.transform("spans", lambda s: s["kind"]), F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(_listed(mine), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
