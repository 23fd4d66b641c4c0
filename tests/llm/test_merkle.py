import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lantern.llm import merkle


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_leaf(row) -> str:
    doc_id, text, lang, source, n_chars = row
    return sha(*map(field, (doc_id, source, lang, n_chars, text)))


def plain_tree(leaves: list[str]) -> tuple[str, list[list[str]]]:
    """The top and the siblings of each leaf, level by level."""
    at, nodes, proofs = list(range(len(leaves))), leaves, [[] for _ in leaves]
    while len(nodes) > 1:
        for i, p in enumerate(at):
            start = p // 8 * 8
            proofs[i].append((nodes[start:p], nodes[p + 1 : start + 8]))
            at[i] = p // 8
        nodes = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], proofs


def plain(rows) -> tuple[list[tuple], str]:
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        members = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[g] = (members, *plain_tree([plain_leaf(r) for r in members]))
    root, upper = plain_tree([trees[g][1] for g in order])
    out = []
    for g, up in zip(order, upper, strict=True):
        members, subroot, proofs = trees[g]
        for r, proof in zip(members, proofs, strict=True):
            path = proof + up
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                changed = (r[0], r[1].translate({c: c + 32 for c in range(65, 91)}), *r[2:])
            h = plain_leaf(changed)
            for left, right in path:
                h = sha(*left, h, *right)
            out.append((r[0], plain_leaf(r), subroot, root, sha(*(x for a, b in path for x in a + b)), h, h == root))
    return sorted(out, key=repr), root


def found(docs) -> list[tuple]:
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = lambda text: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    leaves = docs.select("lang", "doc_id", leaf(F.col("text")).alias("leaf"), F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf(lowered)).alias("changed"))
    rows, root = merkle.manifest(leaves, "lang", "doc_id", "changed")
    path = F.col("path")
    out = rows.select("doc_id", merkle.as_text(F.col("leaf")), merkle.as_text(F.col("subroot")), F.lit(root).cast("string"), merkle.proof_digest(path), merkle.fold(F.coalesce("changed", "leaf"), path))
    return sorted(((*r, r[5] == r[3]) for r in out.collect()), key=repr)


def test_all_rows_as_plainly_hashed(docs, rows):
    assert found(docs) == plain(rows)[0]
    assert {r[6] for r in found(docs)} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 513, 5000])
def test_heights(spark, n):
    rows = [(i * 7 % n, f"Text {i}", "en", "s", i) for i in range(n)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")) == plain(rows)[0]


def test_many_groups_nulls_repeats_and_a_hot_group(spark):
    rows = [(i, "A" * (i % 5), f"g{i}" if i % 3 else None, None, None) for i in range(90)] + [(5, "same", "é", "s", 1)] * 20 + [(None, None, None, None, None)] * 3 + [(None, "x" * 50_000, "", "", 0)]
    rows += [(1000 + i, "b", "hot", "s", i) for i in range(300)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)) == plain(rows)[0]


def test_empty(empty):
    assert found(empty) == []


def test_clashing_columns(docs, rows):
    more = docs.withColumns({c: F.lit(1) for c in ("tree", "idx", "place", "part", "leaf", "root", "path", "key", "held")})
    assert found(more) == plain(rows)[0]
