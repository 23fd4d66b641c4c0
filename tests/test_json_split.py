import json
import random

from lantern.operators import json_split as J


def made(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        return rng.choice([None, True, 1.5, "", "text é 漢", "x" * rng.randint(0, 120), [], {}])
    if kind < 0.6:
        return [made(rng, depth - 1) for _ in range(rng.randint(0, 6))]
    return {f"k{i}é": made(rng, depth - 1) for i in range(rng.randint(0, 6))}


def test_pieces_put_together_give_the_document_and_are_bounded():
    rng = random.Random(1)
    for _ in range(200):
        document, most = made(rng, 5), rng.randint(60, 400)
        whole = J.indexed(document)
        parts = J.pieces(document, most, most // 3)
        if isinstance(whole, dict):
            assert J.put_together(parts) == whole
        else:
            assert parts == [{"": whole}]
        for p in parts:
            one = p
            while isinstance(one, dict) and len(one) == 1:  # longer only where a single value is
                one = next(iter(one.values()))
            assert len(json.dumps(p, ensure_ascii=False)) <= most or not isinstance(one, dict) or len(json.dumps(one, ensure_ascii=False)) < most + 200


def test_lengths_are_those_of_the_texts():
    piece = J._Piece()
    for path, value in [(("a", "b"), 1), (("a", "c", "d"), "é"), (("z",), {}), (("a", "c", "e"), [])]:
        piece.put(path, value)
        assert piece.length == len(json.dumps(piece.value, ensure_ascii=False))


def test_columns(spark):
    deep = "[" * 100_000 + "]" * 100_000
    rows = [("obj", json.dumps({"a": ["x" * 40, "y" * 40], "b": {"c": 1}})), ("list", "[1, 2]"), ("text", '"only"'), ("bad", "{a: 1"), ("null", None), ("empty", ""), ("deep", deep)]
    got = {r["k"]: r["p"] for r in spark.createDataFrame(rows, "k string, t string").select("k", J.split("t", 80, 30).alias("p")).collect()}
    assert got["list"] == ['{"0": 1, "1": 2}'] and got["text"] == ['{"": "only"}'] and got["bad"] == got["null"] == got["empty"] == got["deep"] == []
    assert len(got["obj"]) == 2 and J.put_together([json.loads(p) for p in got["obj"]]) == {"a": {"0": "x" * 40, "1": "y" * 40}, "b": {"c": 1}}
