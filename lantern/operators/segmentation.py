"""Words of text that is written without spaces, by a dictionary table.

A run of letters is read forwards and backwards, each time by the longest dictionary word. Where both agree the words stand. A
stretch on which they differ gets the best of all its divisions into dictionary words and single letters; the score of n words is
``SPREAD / n``, plus the share of words longer than a letter, plus the sum of their weights. Weights are whole numbers, so for each n the
best sum is a path through the stretch, and no division need be listed. Stretches longer than ``PIECE`` letters are cut where the
forward reading has a border.

A dictionary is (word, freq, tag). One of up to ``SMALL`` words is sent to all tasks; of a larger one each text gets the words that
it holds, by a join with its substrings.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

# What a frequency is divided by, the weight of a letter that is no word, the score's first term.
DENOMINATOR, UNKNOWN, SPREAD = 1_000_000, -12, 30
#: Letters of a stretch, letters of a word, words of a dictionary that is broadcast.
PIECE, LONGEST, SMALL = 48, 12, 16_000_000
#: The weight of what is no word, in arrays; letters that are read at once, stretches that are divided at once.
NONE, CHUNK, BLOCK = -(1 << 15), 1 << 17, 512
#: Runs that are read one by one, words that are spelled at once.
FEW, SLICE = 64, 500_000


def weight(freq: Column) -> Column:
    """The rounded logarithm of a frequency."""
    return (F.log(freq / DENOMINATOR) + 0.5).cast("int")


def with_user_words(dictionary: DataFrame, more: DataFrame) -> DataFrame:
    """The dictionary with a user's rows, which replace those of the same word; of a user's own repeats the most frequent stays."""
    best = more.groupBy("word").agg(F.max(F.struct("freq", "tag")).alias("best")).select("word", "best.freq", "best.tag")
    return dictionary.join(best.select("word"), "word", "left_anti").select("word", "freq", "tag").unionByName(best)


def looked_up(tokens: DataFrame, dictionary: DataFrame, token: str = "token") -> DataFrame:
    """tokens with freq (0 for what is no word) and tag ('')."""
    found = tokens.join(dictionary.withColumnRenamed("word", token), token, "left")
    return found.withColumn("freq", F.coalesce("freq", F.lit(0))).withColumn("tag", F.coalesce("tag", F.lit("")))


def _best(run: str, words: Mapping[str, int], least: int = 1) -> list[str]:
    """The division of the highest score into at least so many words; of equal scores the one of fewer words, then of longer last ones."""
    m = len(run)
    sums: list[dict[int, tuple]] = [{} for _ in range(m + 1)]
    sums[0][0] = (0, 0, 0)  # by number of words: weights, long words, start of the last
    for p in range(m):
        for n, (total, long, _) in sums[p].items():
            for e in range(p + 1, min(m, p + LONGEST) + 1):
                w = words.get(run[p:e], UNKNOWN if e == p + 1 else None)
                if w is not None and (n + 1 not in sums[e] or (total + w, long + (e > p + 1)) > sums[e][n + 1][:2]):
                    sums[e][n + 1] = (total + w, long + (e > p + 1), p)
    fit = [(round((SPREAD + long) / n + total, 9), -n) for n, (total, long, _) in sums[m].items() if n >= least]
    if not fit:
        return [run]
    n, e, out = -max(fit)[1], m, []
    while e:
        p = sums[e][n][2]
        out.append(run[p:e])
        e, n = p, n - 1
    return out[::-1]


def _forward(run: str, words: Mapping[str, int]) -> list[int]:
    at, out = 0, [0]
    while at < len(run):
        at = next((e for e in range(min(len(run), at + LONGEST), at + 1, -1) if run[at:e] in words), at + 1)
        out.append(at)
    return out


def _backward(run: str, words: Mapping[str, int]) -> set[int]:
    at, out = len(run), {len(run)}
    while at > 0:
        at = next((p for p in range(max(0, at - LONGEST), at - 1) if run[p:at] in words), at - 1)
        out.add(at)
    return out


def divide(run: str, words: Mapping[str, int], best=_best) -> list[str]:
    """The words of a run of letters."""
    forward, backward, out, start = _forward(run, words), _backward(run, words), [], 0
    ahead = set(forward)
    for b in forward[1:]:
        if b in backward or b - start >= PIECE:
            agreed = b in backward and not any(x in ahead or x in backward for x in range(start + 1, b))
            out += [run[start:b]] if agreed else best(run[start:b], words)
            start = b
    return out


def finer(token: str, words: Mapping[str, int]) -> list[str]:
    """The best division of a word of 3 to 10 letters into two parts and more; the word itself if only single letters are left."""
    if not 3 <= len(token) <= 10:
        return [token]
    parts = _best(token, words, 2)
    return [token] if len(parts) == len(token) else parts


class Words:
    """A dictionary as a tree of letters in arrays, some 30 bytes a word; the root is node 0.

    A letter is its rank in the alphabet, in as many digits of 64 as the alphabet needs (the last number is for letters that no word
    has). A node has a bit for each digit that goes on, and its children lie together.
    """

    def __init__(self, words: Mapping[str, int] | pa.Table):
        if not isinstance(words, pa.Table):
            words = pa.table({"word": pa.array(list(words), pa.string()), "weight": pa.array(list(words.values()), pa.int16())})
        texts, size = words["word"], pc.utf8_length(words["word"]).to_numpy()
        order = pc.sort_indices(texts).to_numpy()
        order = order[(size[order] > 0) & (size[order] <= LONGEST)]
        size, weights = size[order], words["weight"].to_numpy().astype(np.int16)[order]
        some = [slice(i, i + SLICE) for i in range(0, len(order), SLICE)]
        spelling = lambda x: _letters("".join(texts.take(order[x]).to_pylist()))
        used = np.zeros(1 << 21, bool)
        for x in some:
            used[spelling(x)] = True
        alphabet = np.flatnonzero(used)
        self.digits = next(d for d in (1, 2, 3, 4) if len(alphabet) < 1 << 6 * d)
        self.rank = np.full(alphabet[-1] + 2 if len(alphabet) else 1, (1 << 6 * self.digits) - 1, np.int32)
        self.rank[alphabet] = np.arange(len(alphabet))
        spelled = np.full((len(size), LONGEST * self.digits + 1), 64, np.uint8)
        for x in some:
            rank, held = self.ranks(spelling(x)), np.arange(LONGEST) < size[x, None]
            for d in range(self.digits):
                spelled[x, d : LONGEST * self.digits : self.digits][held] = rank >> 6 * (self.digits - 1 - d) & 63
        parent, fresh, nodes, level = np.zeros(len(size), np.int32), np.zeros(len(size), bool), 1, 1
        self.weight, self.goes, self.child = [np.full(1, NONE, np.int16)], [], []
        fresh[:1] = True
        for i in range(LONGEST * self.digits):  # words are sorted, so a node's words lie together
            digit = spelled[:, i]
            fresh[1:] |= digit[1:] != digit[:-1]
            new = fresh & (digit < 64)
            rows = np.flatnonzero(new)
            goes, child, above = np.zeros(level, np.uint64), np.zeros(level, np.int32), parent[rows]
            first = np.flatnonzero(np.diff(above, prepend=-1))
            if len(rows):
                goes[above[first]] = np.bitwise_or.reduceat(_BIT[digit[rows]], first)
                child[above[first]] = nodes + first
            parent = np.cumsum(new, dtype=np.int32) - 1
            weight, last = np.full(len(rows), NONE, np.int16), (digit < 64) & (spelled[:, i + 1] == 64)
            weight[parent[last]] = weights[last]
            self.weight.append(weight), self.goes.append(goes), self.child.append(child)
            nodes, level = nodes + len(rows), len(rows)
        self.weight = np.concatenate(self.weight)
        self.goes = np.concatenate([*self.goes, np.zeros(level, np.uint64)])
        self.child = np.concatenate([*self.child, np.zeros(level, np.int32)])

    def ranks(self, letters: np.ndarray) -> np.ndarray:
        return self.rank[np.minimum(letters, len(self.rank) - 1)]

    def step(self, node: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which letters lead on, and the nodes that these lead to."""
        on = None
        for d in range(self.digits)[::-1]:
            goes, bit = self.goes.take(node), _BIT.take(rank if self.digits == 1 else rank >> 6 * d & 63)
            held = np.flatnonzero(goes & bit)
            goes, bit = goes.take(held), bit.take(held)
            node = self.child.take(node.take(held)) + np.bitwise_count(goes & bit - np.uint64(1))
            on, rank = held if on is None else on.take(held), rank if d == 0 else rank.take(held)
        return on, node


#: The bit of each digit.
_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)
_SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()])


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.int32)


def _matches(letters: np.ndarray, left: np.ndarray, words: Words) -> np.ndarray:
    """[n - 1, p]: the weight of the n letters from p on, NONE for what is no word; ``left`` letters remain in p's run."""
    found = np.full((LONGEST, len(letters)), NONE, np.int16)
    at, node, rank, left = np.arange(len(letters)), np.zeros(len(letters), np.int32), words.ranks(letters), np.minimum(left, LONGEST).astype(np.int8)
    for n in range(LONGEST):
        if n:
            inside = np.flatnonzero(left.take(at) > n)
            at, node = at.take(inside), node.take(inside)
        on, node = words.step(node, rank.take(at + n))
        at = at.take(on)
        found[n][at] = words.weight.take(node)
    return found


def _best_borders(found: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """``_best`` for many stretches at once: the places of borders inside them.

    For each number of words, the best path to each place is (weights, long words, length of the last word), packed in an integer in this order,
    as ``found`` is. What lies behind a stretch's end has no path back. Rounds end when no more words can win: their score is at most
    SPREAD / n + 1 and the best sum of any number of words.
    """
    m, cols, lengths = int(sizes.max()), np.arange(len(starts)), np.arange(LONGEST)
    step = np.take(found, starts + np.arange(m)[:, None], axis=1, mode="clip")
    plain = step >> 10
    most = np.zeros((m + 1, len(starts)), np.int32)
    for e in range(1, m + 1):
        n = lengths[: min(LONGEST, e)]
        most[e] = (most[e - 1 - n] + plain[n, e - 1 - n]).max(axis=0)
    now, most = np.full((m + 1, len(starts)), NONE * 1024, np.int32), most[sizes, cols]
    now[0] = 0
    backs, live, score, words = [], cols, np.full(len(starts), -np.inf), np.zeros(len(starts), np.int64)
    for k in range(1, m + 1):
        then = np.full_like(now, NONE * 1024)
        for n in range(1, min(LONGEST, m - k + 1) + 1):
            past = min(m + 1 - n, LONGEST * (k - 1) + 1)  # beyond it no path of k - 1 words comes
            np.maximum(then[k - 1 + n : past + n], now[k - 1 : past] + step[n - 1, k - 1 : past], out=then[k - 1 + n : past + n])
        backs.append((live, (then & 15).astype(np.int8)))
        now = then & ~15
        if k < least:
            continue
        end = now[sizes[live], cols[: len(live)]] >> 4
        new = np.where(end > NONE * 32, np.round((SPREAD + (end & 63)) / k + (end >> 6), 9), -np.inf)
        better = new > score[live]
        score[live[better]], words[live[better]] = new[better], k
        on = np.flatnonzero(SPREAD / (k + 1) + 1 + most[live] > score[live] - 1e-6)
        if not len(on):
            break
        if len(on) < 0.7 * len(live):  # the others are settled
            live, now, step = live[on], now[:, on], step[:, :, on]
    at, borders = sizes.copy(), []
    for k in range(int(words.max()), 1, -1):
        on, (live, back) = np.flatnonzero(words >= k), backs[k - 1]
        at[on] -= back[at[on], np.searchsorted(live, on)]
        borders.append(starts[on] + at[on])
    return np.concatenate(borders) if borders else np.zeros(0, np.int64)


def _reading(step: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places that a reading from ``at`` touches, in all runs at once; the last few runs go on one by one."""
    touched, end = np.zeros(len(step), bool), np.zeros(len(step), bool)
    touched[at], end[ends] = True, True
    while len(at) > FEW:
        at = step[at]
        touched[at] = True
        at = at[~end[at]]
    stop = set(ends.tolist()) if len(at) else ()
    for p in at.tolist():
        borders = []
        while not borders or p not in stop:
            p = step.item(p)
            borders.append(p)
        touched[borders] = True
    return touched


def _borders(letters: np.ndarray, ends: np.ndarray, words: Words, fine: bool) -> np.ndarray:
    """``divide``, or ``finer``, for runs that lie one after the other, none of them empty: whether a word begins or ends at a place."""
    size, starts = len(letters), np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    found = _matches(letters, np.repeat(ends, sizes) - np.arange(size), words)
    found[0][found[0] == NONE] = UNKNOWN
    border = np.zeros(size + 1, bool)
    border[0] = border[ends] = True
    if fine:
        some = (sizes >= 3) & (sizes <= 10)
        a, b = starts[some], ends[some]
    else:
        far, near = np.arange(1, size + 2), np.arange(-1, size)
        for n in range(2, LONGEST + 1):
            p = np.flatnonzero(found[n - 1] != NONE)
            far[p], near[p + n] = p + n, p
        forward, backward = _reading(far, starts, ends), _reading(near, ends, starts)  # no word goes beyond its run
        common = forward & backward
        met = np.flatnonzero(common)
        for i in np.flatnonzero(np.diff(met) >= PIECE):  # long stretches are cut at borders of the forward reading
            start = met[i]
            for b in np.flatnonzero(forward[met[i] + 1 : met[i + 1]]) + met[i] + 1:
                if b - start >= PIECE:
                    common[b], start = True, b
        cuts = np.flatnonzero(common)
        a, b, count = cuts[:-1], cuts[1:], np.cumsum(forward | backward)
        border |= common
        open_ = ~backward[b] | (count[b - 1] > count[a])
        a, b = a[open_], b[open_]
    packed = found.astype(np.int32) * 1024 + (np.arange(1, LONGEST + 1, dtype=np.int32) + 16 * (np.arange(LONGEST, dtype=np.int32) > 0))[:, None]
    order = np.argsort(b - a, kind="stable")
    for i in range(0, len(order), BLOCK):
        block = order[i : i + BLOCK]
        border[_best_borders(packed, a[block], (b - a)[block], 2 if fine else 1)] = True
    if fine:  # a word of which only single letters are left stays
        alone = np.diff(np.cumsum(border)[ends], prepend=1) == sizes
        border[:-1] &= ~np.repeat(alone, sizes)
        border[starts] = True
    return border


def _lists(texts: pa.Array, words: Words, fine: bool) -> pa.Array:
    """The words of each text's runs, which white space parts."""
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    letters, head = _letters(data.tobytes().decode()), (data & 0xC0) != 0x80
    last = np.concatenate([[0], np.cumsum(head)])[offsets - offsets[0]]  # letters before each text's end
    space = np.isin(letters, _SPACES)
    ends = np.concatenate([last, np.flatnonzero(space)])
    if space.any():
        before = np.concatenate([[0], np.cumsum(~space)])
        letters, data, last, ends = letters[~space], data[np.repeat(~space, np.diff(np.flatnonzero(np.append(head, True))))], before[last], before[ends]
        head = (data & 0xC0) != 0x80
    ends = np.unique(ends)
    border = _borders(letters, ends[ends > 0], words, fine) if len(letters) else np.ones(1, bool)
    at = np.flatnonzero(np.append(head, True))[border].astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data.tobytes()))
    return pa.ListArray.from_arrays(pa.array(np.cumsum(border)[last] - 1, pa.int32()), tokens)


def in_lists(texts: pa.Array, words: Words, fine: bool = False) -> pa.Array:
    """The words of each text's runs, some texts at a time."""
    texts, out = texts.cast(pa.large_string()), []
    chunk = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)) // CHUNK
    cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(texts)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        out.append(_lists(texts.slice(i, j - i), words, fine))
    return pa.concat_arrays(out)


def in_chunks(texts: Iterable[str | None], words: Words, fine: bool = False) -> list[list[str]]:
    return in_lists(pa.array(texts, pa.large_string()), words, fine).to_pylist()


def divided(runs: list[str], words: Words, fine: bool = False) -> list[list[str]]:
    """``divide``, or ``finer``, for many runs at once."""
    return in_chunks(runs, words, fine)


def _weights(dictionary: DataFrame) -> DataFrame:
    return dictionary.select("word", weight(F.col("freq")).alias("weight")).where(F.length("word").between(1, LONGEST))


def shared(dictionary: DataFrame, small: int = SMALL) -> Broadcast | None:
    """The dictionary as it is sent to tasks; None if it has over ``small`` words."""
    weights = _weights(dictionary)
    return dictionary.sparkSession.sparkContext.broadcast(Words(weights.toArrow())) if weights.count() <= small else None


def segmented(texts: DataFrame, dictionary: DataFrame, text: str, fine: bool = False, small: int = SMALL, sent: Broadcast | None = None) -> DataFrame:
    """texts with ``tokens``: for each run of letters in a text its words, in order. Null texts have none.

    ``sent`` is the dictionary as ``shared`` gives it, for those who divide several tables.
    """
    sent = sent or shared(dictionary, small)
    if sent is not None:

        def words_of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for part in parts:
                yield in_lists(part, sent.value, fine)

        return texts.withColumn("tokens", F.arrow_udf(words_of, "array<string>")(F.col(text)))
    weights, work = _weights(dictionary), finer if fine else divide
    rows = texts.withColumn("seg_id", F.monotonically_increasing_id())
    distinct = rows.select(F.col(text).alias("seg_text")).where("length(seg_text) > 0").distinct()
    at = distinct.select("seg_text", F.explode(F.sequence(F.lit(1), F.length("seg_text"))).alias("p"))
    pieces = at.select("seg_text", F.explode(F.transform(F.sequence(F.lit(1), F.lit(LONGEST)), lambda n: F.substring("seg_text", F.col("p"), n))).alias("word")).distinct()
    held = pieces.join(weights, "word").groupBy("seg_text").agg(F.map_from_entries(F.collect_list(F.struct("word", "weight"))).alias("held"))

    @F.pandas_udf("array<string>")
    def words_in(text: pd.Series, held: pd.Series) -> pd.Series:
        return pd.Series([[t for run in s.split() for t in work(run, dict(h) if h is not None else {})] for s, h in zip(text, held, strict=True)])

    done = distinct.join(held, "seg_text", "left").select("seg_text", words_in("seg_text", "held").alias("tokens"))
    return rows.join(done, F.col(text) == F.col("seg_text"), "left").drop("seg_id", "seg_text").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
