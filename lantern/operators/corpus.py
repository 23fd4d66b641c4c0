"""Files ranked for questions by their names: candidates by a shared pair of letters, then scores, conflicts and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lantern.functions import questions as Q
from lantern.sources.shared import written

# What a name's signs are worth.
CONFLICT, TITLE, ALL_TITLES, ARTICLE_TITLE, PLAIN, COMMENT, SUBJECT = -200, 35, 20, 70, 45, -55, 18
GAZETTE, NPC, KEY, YEAR, ISSUE, DATE, OTHER_DATE, CURRENT, BASE, NOT_BASE, ARTICLE, NO_ARTICLE, CASE = 40, 15, 160, 25, 35, 55, -15, 35, 60, -45, 15, -10, 35
COMMENTS = ("关于适用", "解释", "批复", "案例", "合同")


#: What of a question the rank of files depends on, besides whether it names the gazette.
ASKED = ("titles", "refused_titles", "subjects", "keys", "dates", "refused_dates", "years", "issues", "refused_issues", "articles", "cases", "route", "wanted", "current", "base", "no_dated", "no_base", "strong")


def profiles(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids, profiles): (q_id, p_id) of the strong questions, and what they ask for, each different one once with p_id as its q_id.

    Many questions ask for the same; files are ranked for each profile once, and only ids go back to the questions.
    """
    p = asked.where("strong").withColumn("question", F.when(F.contains("question", F.lit("公报")), "公报").otherwise(""))
    p = written(p.select("q_id", "question", *ASKED).withColumn("p_id", F.md5(F.to_json(F.struct("question", *ASKED)).cast("binary"))), "asked")
    first = p.groupBy("p_id").agg(*(F.first(c).alias(c) for c in ("question", *ASKED)))
    return p.select("q_id", "p_id"), written(first.withColumnRenamed("p_id", "q_id"), "profiles")


def of_questions(found: DataFrame, ids: DataFrame) -> DataFrame:
    """found, by profile, for each question."""
    return found.withColumnRenamed("q_id", "p_id").join(ids, "p_id").drop("p_id")


def _count(values, test) -> Column:
    return F.size(F.filter(values, test))


def _pairs(c: Column) -> Column:
    """All pairs of letters that follow each other."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 1)), lambda i: F.substring(c, i, F.lit(2))))


def candidates(asked: DataFrame, files: DataFrame) -> DataFrame:
    """Strong questions beside the files that may answer them.

    A file fits only if its name holds a target key, else a title, else a subject of the question, so the two meet on the first two
    letters of one of these. Only questions that name none of them meet every file; what these ask for is a date or a version, and
    such files are looked up by date.
    """
    keyed = lambda names: F.transform(names, Q.match_key)
    a = asked.where("strong").withColumn("tk", keyed("titles")).withColumn("rk", keyed("refused_titles")).withColumn("sk", keyed("subjects"))
    anchors = F.when(F.size("keys") > 0, F.col("keys")).when(F.size("tk") > 0, F.col("tk")).when(F.size("sk") > 0, F.col("sk")).when(F.size("dates") > 0, F.col("dates")).otherwise(F.array(F.lit("")))
    a = a.withColumn("anchor", F.explode(F.array_distinct(F.transform(anchors, lambda t: F.substring(t, 1, 2)))))
    f = files.withColumn("k", Q.match_key(F.col("name"))).withColumn("version", F.coalesce(F.try_element_at(Q.every(F.col("name"), "(?<![0-9])(?:19|20)[0-9]{6}(?![0-9])"), F.lit(1)), F.lit("")))
    f = f.withColumn("pair", F.explode(F.array_append(_pairs(F.col("k")), "")))
    return a.join(f, F.col("anchor") == F.col("pair")).drop("anchor", "pair").dropDuplicates(["q_id", "name"])


def scored(pairs: DataFrame) -> DataFrame:
    """pairs that fit, with score: those that don't conflict with the question, hold what it names and are worth something."""
    k, name, version, q = F.col("k"), F.col("name"), F.col("version"), F.col("question")
    longer = lambda t: F.exists("tk", lambda o: (o != t) & F.contains(o, t) & F.contains(k, o))
    issue = lambda i: F.contains(name, F.concat(F.lit("_"), i, F.lit("_npc"))) | F.contains(name, F.concat(F.lit("_"), i, F.lit(".")))
    dated = version != ""
    worth = lambda c, n: F.when(c, n).otherwise(0)
    total = lambda values, f: F.aggregate(values, F.lit(0), lambda s, x: s + f(x))
    article = F.col("route") == "law_article_lookup"
    gazette = F.contains(q, F.lit("公报")) | (F.col("route") == "gazette_issue_lookup")

    def of_body(got, body):
        """got: titles in the name, none that a longer one of them covers."""
        conflict = (
            (F.contains(name, F.lit("公报")) & F.exists("refused_issues", issue)) | (F.col("no_dated") & dated) | (F.col("no_base") & ~dated) | F.array_contains("refused_dates", version)
            | (F.exists("rk", lambda t: F.contains(k, t)) & (F.size(got) == 0))
        )
        anchored = (
            F.when(F.size("keys") > 0, F.exists("keys", lambda y: F.contains(k, y))).when((F.size("tk") > 0) & (F.size(got) == 0), False)
            .when(F.size("sk") > 0, F.exists("sk", lambda t: F.contains(k, t))).otherwise(True)
        )
        score = (
            F.size(got) * TITLE + worth((F.size("tk") > 0) & (F.size(got) == F.size("tk")), ALL_TITLES)
            + F.when(article & (F.size(got) > 0), F.when(Q.any_of(name, COMMENTS), ARTICLE_TITLE + COMMENT).otherwise(ARTICLE_TITLE + PLAIN)).otherwise(0)
            + SUBJECT * _count("sk", lambda t: F.contains(body, t))
            + F.when(gazette, worth(F.contains(name, F.lit("公报")), GAZETTE) + worth(F.contains(F.lower(name), F.lit("npc")), NPC) + KEY * _count("keys", lambda y: F.contains(k, y)) + YEAR * _count("years", lambda y: F.contains(name, y)) + ISSUE * _count("issues", issue)).otherwise(0)
            + total("dates", lambda t: F.when(F.contains(body, t), DATE).otherwise(worth(dated, OTHER_DATE))) + worth(F.col("current") & dated, CURRENT) + F.when(F.col("base"), F.when(dated, NOT_BASE).otherwise(BASE)).otherwise(0)
            + total("articles", lambda t: F.when(F.contains(body, t), ARTICLE).otherwise(worth(article, NO_ARTICLE))) + CASE * _count("cases", lambda t: F.contains(body, t))
        )
        return F.when(conflict, CONFLICT).when(anchored, score).otherwise(0)

    body = F.concat(k, F.when(dated, version).otherwise(F.lit("基础版")))
    score = Q.let(F.filter("tk", lambda t: F.contains(k, t) & ~longer(t)), lambda got: Q.let(body, lambda b: of_body(got, b)))
    return pairs.withColumn("score", F.explode(F.filter(F.array(score), lambda x: x > 0)))


def ranked(asked: DataFrame, files: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best files of each question, or as many as it wants, that don't conflict with it: with rank."""
    fit = scored(candidates(asked, files))
    best = Window.partitionBy("q_id").orderBy(F.col("score").desc(), "name")
    return fit.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= F.greatest(F.lit(limit), F.col("wanted")))


def covered(found: DataFrame) -> DataFrame:
    """found with coverage (the target that a file stands for) and place: one file of each of the wanted targets first, the others by rank."""
    k = F.col("k")
    version = F.when(F.col("version") == "", "base").otherwise(F.col("version"))
    fits = lambda names: F.filter(names, lambda t: F.contains(k, t))
    longest = F.aggregate(fits("tk"), F.lit(""), lambda a, t: F.when(F.length(t) > F.length(a), t).otherwise(a))
    coverage = (
        F.when(F.size(fits("keys")) > 0, F.get(fits("keys"), 0)).when(F.size(fits("tk")) > 0, F.concat(F.lit("title:"), longest, F.lit(":"), version))
        .when(F.size(fits("sk")) > 0, F.concat(F.lit("subject:"), F.get(fits("sk"), 0), F.lit(":"), version)).otherwise(k)
    )
    c = found.withColumn("coverage", coverage)
    c = c.withColumn("lead", F.row_number().over(Window.partitionBy("q_id", "coverage").orderBy("rank")) == 1)
    c = c.withColumn("nth", F.sum(F.col("lead").cast("int")).over(Window.partitionBy("q_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    later = F.when((F.col("wanted") > 1) & F.col("lead") & (F.col("nth") <= F.col("wanted")), 0).otherwise(1)
    return c.withColumn("place", F.row_number().over(Window.partitionBy("q_id").orderBy(later, "rank")))
