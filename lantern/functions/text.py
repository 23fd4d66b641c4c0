"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Full-width forms stand 0xFEE0 above their ASCII characters; the ideographic space stands for a space.
FULL = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　"
HALF = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
#: Tokens: runs of letters and digits, longer than one character, or a single digit.
SPLIT = r"[^\p{L}\p{N}]+"


def half_width(c: Column) -> Column:
    return F.translate(c, FULL, HALF)


def normalize(c: Column) -> Column:
    """Half width, white space collapsed to single spaces, trimmed."""
    return F.trim(F.regexp_replace(half_width(c), r"(?U)\s+", " "))


def match_key(c: Column) -> Column:
    """For comparing names: half width, lower case, no white space."""
    return F.lower(F.regexp_replace(half_width(c), r"(?U)\s+", ""))


def clip(c: Column, n: int) -> Column:
    """At most n characters, with an ellipsis where cut."""
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n - 3)), F.lit("..."))).otherwise(c)


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), SPLIT), lambda t: (F.length(t) > 1) | F.rlike(t, F.lit("^[0-9]$")))


def number_tokens(c: Column) -> Column:
    """Distinct numbers in the order in which they occur, years left out."""
    found = F.regexp_extract_all(c, F.lit(r"[0-9]+(?:\.[0-9]+)?%?"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: ~F.rlike(t, F.lit(r"^(19|20)[0-9]{2}$"))))


def year_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(r"[0-9]+"), F.lit(0)), lambda t: F.rlike(t, F.lit(r"^(19|20)[0-9]{2}$"))))


#: Fixed patterns of dates: eight digits with no digit beside them, with separators, in words.
_DATE8, _DATE = r"(?<![0-9])20[0-9]{2}[01][0-9][0-3][0-9](?![0-9])", r"(20[0-9]{2})[-./年]([01]?[0-9])[-./月]([0-3]?[0-9])"
_DATE_WORDS = r"(?:19|20)[0-9]{2}年(?:[0-9]{1,2}月(?:[0-9]{1,2}日)?)?"


def version_date(c: Column) -> Column:
    """yyyymmdd of the first date in eight digits, else of the first one with separators; null without one."""
    n = normalize(c)
    parts = F.regexp_substr(n, F.lit(_DATE))
    piece = lambda i: F.lpad(F.regexp_extract(parts, _DATE, i), 2, "0")
    return F.coalesce(F.regexp_substr(n, F.lit(_DATE8)), F.concat(F.regexp_extract(parts, _DATE, 1), piece(2), piece(3)))


def last_date(c: Column) -> Column:
    """The last date in words, year alone or with month and day, as it is written; null without one."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(_DATE_WORDS), F.lit(0)), F.lit(-1))


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"[ \t\r\n]+", " "))


def html_title(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_text(c: Column) -> Column:
    """Text of a page without its scripts, styles, head and navigation."""
    bare = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<head[^>]*>.*?</head>|<nav[^>]*>.*?</nav>", " ")
    return strip_tags(bare)


def html_rows(c: Column) -> Column:
    """Rows of all tables as arrays of cell texts; empty rows are left out."""
    rows = F.regexp_extract_all(c, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), strip_tags))
    return F.filter(cells, lambda r: F.exists(r, lambda x: F.length(x) > 0))


def citations(c: Column) -> Column:
    """Distinct citation numbers of ##n$$ marks, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"##([0-9]{1,6})\$\$"), F.lit(1)), lambda n: n.cast("int")))


def canonical_citations(c: Column) -> Column:
    """[n], 【n】 and [ID:n] as ##n$$, blanks between marks removed."""
    return F.regexp_replace(F.regexp_replace(c, r"[\[【] *(?:ID *[:：] *)?([0-9]{1,6}) *[\]】]", r"##$1\$\$"), r"\$\$ +##", r"\$\$##")


#: Chinese digits and units.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}


def chinese_number(c: Column) -> Column:
    """Value of a Chinese numeral below a hundred million, or of ASCII digits; null for anything else."""
    kind = F.create_map(*[F.lit(x) for k, v in (DIGITS | UNITS).items() for x in (k, v)])
    start = F.struct(F.lit(0).cast("long").alias("all"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("digit"))

    def step(a, ch):
        v = F.try_element_at(kind, ch).cast("long")
        wan = F.struct(((a["all"] + a["part"] + a["digit"]) * 10_000).alias("all"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("digit"))
        unit = F.struct(a["all"].alias("all"), (a["part"] + F.greatest(a["digit"], F.lit(1)) * v).alias("part"), F.lit(0).cast("long").alias("digit"))
        digit = F.struct(a["all"].alias("all"), a["part"].alias("part"), (a["digit"] * 10 + v).alias("digit"))
        return F.when(ch == "万", wan).when(v >= 10, unit).otherwise(digit)

    value = F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), start, step, lambda a: a["all"] + a["part"] + a["digit"])
    numeral = "^[" + "".join([*DIGITS, *UNITS, "万"]) + "]+$"
    return F.when(F.rlike(c, F.lit("^[0-9]{1,18}$")), c.try_cast("long")).when(F.rlike(c, F.lit(numeral)), value)
