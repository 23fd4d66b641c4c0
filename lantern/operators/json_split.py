"""JSON documents in pieces of bounded size that keep their place in the document."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F


def _length(value) -> int:
    return len(json.dumps(value, ensure_ascii=False))


def indexed(value):
    """Lists as objects whose keys are the places from 0, at any depth."""
    if isinstance(value, dict):
        return {k: indexed(v) for k, v in value.items()}
    return {str(i): indexed(v) for i, v in enumerate(value)} if isinstance(value, list) else value


class _Piece:
    """An object and the length of its text, kept up to date."""

    def __init__(self):
        self.value, self.length = {}, 2

    def put(self, path: tuple, value) -> None:
        at = self.value
        for i, key in enumerate(path):
            last = i + 1 == len(path)
            if last or key not in at:
                self.length += (2 if at else 0) + _length(key) + 2 + (_length(value) if last else 2)
                at[key] = value if last else {}
            at = at[key]


def pieces(document, most: int, least: int) -> list[dict]:
    """Objects of up to ``most`` letters that put together give the document; one is closed from ``least`` letters on.

    A part goes whole into the open piece where it fits, else its own parts do one by one; a single value that is longer than ``most``
    stays whole. A document that isn't an object or a list is the value of the key "".
    """
    document = indexed(document)
    out = [_Piece()]
    waiting = [((k,), v) for k, v in reversed(list(document.items()))] if isinstance(document, dict) else [(("",), document)]
    while waiting:
        path, value = waiting.pop()
        if _length({path[-1]: value}) < most - out[-1].length:
            out[-1].put(path, value)
            continue
        if out[-1].length >= least:
            out.append(_Piece())
        if isinstance(value, dict) and value:
            waiting += [((*path, k), v) for k, v in reversed(list(value.items()))]
        else:
            out[-1].put(path, value)
    return [p.value for p in out if p.value]


def put_together(parts: list[dict]) -> dict:
    """The document, its lists as ``indexed`` gives them, from its pieces."""
    out: dict = {}
    waiting = [(out, p) for p in parts]
    while waiting:
        into, part = waiting.pop()
        for k, v in part.items():
            if isinstance(v, dict) and v:
                waiting.append((into.setdefault(k, {}), v))
            else:
                into[k] = v
    return out


def split(text: Column, most: int = 4000, least: int | None = None) -> Column:
    """The pieces' texts. Null, empty or malformed texts have none, as have those nested deeper than a parser goes."""
    least = max(most // 2 - 200, 50) if least is None else least

    def each(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return [json.dumps(p, ensure_ascii=False) for p in pieces(json.loads(t), most, least)]
            except (TypeError, ValueError, RecursionError):
                return []

        return texts.map(one)

    return F.pandas_udf(each, "array<string>")(text)
