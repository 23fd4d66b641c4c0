import random

from pyspark.sql import functions as F

from lantern.operators import rerank


def test_a_querys_rows_are_ordered_in_several_tasks(spark, monkeypatch):
    rng, parts, write = random.Random(2), [], rerank.written

    def spy(df, name):
        out = write(df, name)
        if name == "ranges":
            parts.append(out.where("q = 1").select(F.shiftright("_at", 33)).distinct().count())
        return out

    monkeypatch.setattr(rerank, "written", spy)
    rows = [(1, i, rng.choice([True, False, None]), rng.choice([True, False, None]), rng.randint(0, 3)) for i in range(500)]
    rows += [(q, i, q == 2 or i % 2 == 0, i % 3 == 0, i % 4) for q in (2, 3, None) for i in range(20)]
    out = rerank.prefer(spark.createDataFrame(rows, "q int, id int, c boolean, m boolean, n int"), "q", F.col("c"), F.col("m"), F.col("n").desc(), F.col("id"))
    assert out.columns == ["q", "id", "c", "m", "n", "place"]
    want = set()
    for q in (1, 2, 3, None):
        mine = [r for r in rows if r[0] == q]
        kept = [r for r in mine if not r[2]] or mine
        want |= {(q, r[1], i) for i, r in enumerate(sorted(kept, key=lambda r: (not r[3], -r[4], r[1])), 1)}
    got = [(r["q"], r["id"], r["place"]) for r in out.collect()]
    assert set(got) == want and len(got) == len(want) and parts == [4]
