"""Encodings of files without a mark of it, by byte and letter statistics."""

from __future__ import annotations

import codecs
import math
import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
CODECS = ("cp1252", "gb18030", "big5", "euc_kr", "shift_jis", "cp1251", "koi8_r")
#: Bits of evidence against Western text.
LEAST = 8.0


#: Runs of characters beyond ASCII, with the letters of ASCII at either side.
_RUN = re.compile(r"([A-Za-z]?)([^\x00-\x7f]+)(?=([A-Za-z]?))")


def _worth(codec: str, text: str) -> float:
    """How usual the text's letters beyond ASCII are for those who write in this encoding, 0 to about 1.

    Western words mix letters of ASCII and beyond, Cyrillic ones don't. Short words wholly beyond ASCII tell little of a text of which
    most letters are of ASCII.
    """
    runs = [(before + after, run) for before, run, after in _RUN.findall(text)]
    n = sum(len(run) for _, run in runs)
    if not n:
        return 1.0
    latin = sum(c.isascii() and c.isalpha() for c in text) > 2 * n
    total = 0.0
    for beside, run in runs:
        if codec == "cp1252":
            total += sum((1.0 if beside else 0.5) if c.isalpha() else 0.2 for c in run)
            continue
        most = 0.1 if beside and codec in ("cp1251", "koi8_r") else 0.4 if latin and len(run) < (5 if codec in ("cp1251", "koi8_r") else 3) else 1.0
        for i, c in enumerate(run):
            if codec in ("cp1251", "koi8_r"):
                alone = len(run) == 1 and c not in "авикосуя"  # no usual word of one letter
                usual = 0.4 if alone else 1.0 if "а" <= c <= "я" or c == "ё" else 0.6 if "А" <= c <= "Я" and not run[max(0, i - 1) : i].isalpha() else 0.1
            elif codec == "shift_jis":
                usual = 1.0 if "぀" <= c <= "ヿ" else 0.6 if "一" <= c <= "鿿" else 0.5 if c in "、。「」ー" else 0.0
            elif codec == "euc_kr":
                usual = float("가" <= c <= "힣")
            elif c in "，。、；：？！「」《》（）":
                usual = 0.9
            else:  # the first planes hold the characters of everyday use
                code = c.encode(codec, "ignore")
                usual = float("一" <= c <= "鿿" and (b"\xb0" <= code[:1] <= b"\xd7" and code[1:] >= b"\xa1" if codec == "gb18030" else b"\xa4" <= code[:1] <= b"\xc6"))
            total += min(usual, most)
    worth = total / n
    if codec == "euc_kr":  # Korean puts spaces between words, Chinese doesn't
        worth *= 1.05 if text.count(" ") * 12 >= n else 0.7
    return worth


def _bits(shares: str, other: float) -> dict[str, float]:
    """log2 of letters' shares, given in percent as ``é16 è5``; the rest have the share ``other`` (under the key '')."""
    return {x[0]: math.log2(float(x[1:]) / 100) for x in shares.split()} | {"": math.log2(other / 100)}


#: How often the letters beyond ASCII are used where Latin letters are written, and those of Russian: percent of them, rounded.
_WESTERN = _bits("é16 ä8 ü8 ö6 à5 è5 á5 í5 ó5 ê3 ç3 ñ3 ã3 ß3 å3 ú2 ø2 â1 î1 ô1 õ1 æ1 û.8 ù.6 ë.5 ò.5 ì.5 ï.4 ’1 “.5 ”.5 –.5 «.5 ».5 °.3 §.3 œ.2 £.2 €.2 ©.2 ®.2 ¿.2 ¡.2 ².1 ³.1 ½.1 ·.1 ±.1 ‘.2 „.2 —.3 •.2 ….3", 0.1)
_RUSSIAN = _bits("о11 е8.5 а8 и7.4 н6.7 т6.3 с5.5 р4.7 в4.5 л4.4 к3.5 м3.2 д3 п2.8 у2.6 я2 ы1.9 ь1.7 г1.7 з1.6 б1.6 ч1.4 й1.2 х1 ж.9 ш.7 ю.6 ц.5 щ.4 э.3 ф.3 ё.5", 0.02)


def _case(before: str, c: str) -> float:
    """What a capital costs in bits: much behind a small letter."""
    return 0.0 if not c.isupper() else 7.0 if before.islower() else 2.0


def _evidence(codec: str, content: bytes) -> float:
    """Bits by which the text is likelier in this encoding than as Western text; each different word counts once.

    A run beside letters of ASCII is usual for Western words only. Where the text has words of ASCII, more is asked of the others.
    """

    def western_bits(before: str, run: str, after: str) -> float:
        told = -3.0 * (len(run) - 1) - (0.0 if before or after else 3.0)
        for last, c in zip(before[-1:] + run if before else " " + run, run, strict=False):
            told += _WESTERN.get(c.lower(), _WESTERN[""] if c.isalpha() else -24.0) - _case(last, c)
        return told

    def russian_bits(before: str, run: str, after: str) -> float:
        told = -7.0 if before or after else 0.0
        for last, c in zip(" " + run, run, strict=False):
            told += _RUSSIAN.get(c.lower(), _RUSSIAN[""]) - _case(last, c)
            if last == " " or last.lower() in "аеиоуыэюяёйьъ":  # й stands behind vowels, signs behind consonants
                told -= 7.0 * (c.lower() in "ьъы") + 5.0 * (c.lower() == "й" and last.lower() not in "аеиоуыэюяё")
            told -= 5.0 * (last.lower() == "й" and c.lower() in "аеиуыэюяё")
        vowels = any(c.lower() in "аеиоуыэюяё" for c in run)
        return told - 4.0 * (not vowels and len(run) > 1) - 5.0 * (run[:1].lower() == run[1:2].lower())

    def eastern_bits(before: str, run: str, after: str) -> float:
        told = sum(4.5 if chr(b).isalpha() else 8.0 for b in run.encode(codec, "ignore") if 64 <= b < 128)  # halves of characters, not letters of ASCII
        for c in run:
            if codec == "shift_jis":
                told -= 6.0 if "\u3040" <= c <= "\u30ff" else 11.0 if "一" <= c <= "鿿" else 7.0 if c in "、。「」ー" else 20.0
            elif codec == "euc_kr":
                told -= 10.0 if "가" <= c <= "힣" else 14.0 if "一" <= c <= "鿿" else 20.0
            elif c in "，。、；：？！「」《》（）":
                told -= 6.0
            else:  # the first planes hold the characters of everyday use
                code = c.encode(codec, "ignore")
                first = b"\xb0" <= code[:1] <= b"\xd7" and code[1:] >= b"\xa1" if codec == "gb18030" else b"\xa4" <= code[:1] <= b"\xc6"
                told -= 20.0 if not "一" <= c <= "鿿" else 10.5 if first else 16.0
        return told

    bits = russian_bits if codec in ("cp1251", "koi8_r") else eastern_bits
    content = b" ".join(dict.fromkeys(content.split()))  # white space is no part of a character in any of them
    text = content.decode(codec)
    there = sum(bits(*run) for run in _RUN.findall(text))
    here = sum(western_bits(*run) for run in _RUN.findall(content.decode("cp1252")))
    return there - here - min(12.0, 3.0 * len(set(re.findall(r"(?<![^\x00-\x7f])[A-Za-z]+(?![^\x00-\x7f])", text))))


def detect(content: bytes) -> str:
    """The codec of a text: its mark, else UTF-8 where it fits, else that in which the letters are most usual; of equals the first.

    A text that isn't likelier than as Western text by ``LEAST`` bits stays Western: a few accented letters are no proof of another script.
    """
    for mark, name in MARKS:
        if content.startswith(mark):
            return name
    try:
        content.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        best = (-1.0, "cp1252")
    for codec in CODECS:
        try:
            worth = _worth(codec, content.decode(codec))
        except UnicodeDecodeError:
            continue
        best = max(best, (worth, codec), key=lambda x: x[0])
    if best[1] != "cp1252":
        try:
            return best[1] if _evidence(best[1], content) >= LEAST else "cp1252"
        except UnicodeDecodeError:  # no Western text
            return best[1]
    return best[1]


@F.pandas_udf(T.StructType([T.StructField("codec", T.StringType()), T.StructField("text", T.StringType())]))
def decoded(content: pd.Series) -> pd.DataFrame:
    """Codec and text of binary files; bytes that the codec doesn't know are left out. Null stays null."""
    names = [None if c is None else detect(bytes(c)) for c in content]
    texts = [None if c is None else bytes(c).decode(n, errors="ignore") for c, n in zip(content, names, strict=True)]
    return pd.DataFrame({"codec": names, "text": texts})


#: Bytes that no text has but for tabs, line ends and form feeds.
_CONTROL = "".join(chr(c) for c in [*range(1, 9), *range(14, 32), 127])


def like_text(content: Column, least: float = 0.9) -> Column:
    """No NUL byte anywhere, and at least this share of bytes that aren't control characters."""
    letters = F.decode(content, "ISO-8859-1")
    plain = F.length(F.translate(letters, _CONTROL, ""))
    return (F.instr(letters, chr(0)) == 0) & (plain >= least * F.length(letters))
