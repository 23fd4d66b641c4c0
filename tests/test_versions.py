import random

import pytest
from pyspark.sql import functions as F

from lantern.sources.versions import Conflict, Table, condition, sink

SCHEMA = "id string, doc string, body string, created long"


@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, f"file://{tmp_path}/t", "id", SCHEMA, ("created",))


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def held(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_upserts_keep_first_values_and_replays_change_nothing(spark, table):
    assert held(table) == []
    assert table.upsert(rows(spark, ("a", "d1", "one", 1), ("b", "d1", "two", 1)), source="s", batch=0)
    assert table.upsert(rows(spark, ("a", "d1", "new", 2), ("a", "d1", "older", 0), ("c", "d2", "x", 2)), order="created", source="s", batch=1)
    want = [("a", "d1", "new", 1), ("b", "d1", "two", 1), ("c", "d2", "x", 2)]
    assert held(table) == want
    assert not table.upsert(rows(spark, ("a", "d1", "again", 3)), source="s", batch=1) and not table.upsert(rows(spark, ("z", "", "", 0)), source="s", batch=0)
    assert table.upsert(rows(spark, ("a", "d1", "other source", 3)), source="other", batch=0)
    assert held(table)[0] == ("a", "d1", "other source", 1)
    with pytest.raises(ValueError):
        table.upsert(rows(spark, (None, "d", "x", 1)))


def test_deletes_by_terms_and_wildcards_and_a_new_life(spark, table):
    table.upsert(rows(spark, *((f"{d}-{i}", f"docs/{d}.pdf", None if i == 3 else f"text {i}", i) for d in ("a", "b", "100%_c") for i in range(4))))
    assert table.delete({"doc": "docs/a*", "body": ["text 0", "text 1"]}) == 2
    assert table.delete({"doc": "*%_c.pdf"}) == 4
    assert table.delete({"body": "*ext 2*", "doc": "docs/b.pdf"}) == 1
    assert table.delete({"body": "nothing"}) == 0
    assert [r[0] for r in held(table)] == ["a-2", "a-3", "b-0", "b-1", "b-3"]
    table.upsert(rows(spark, ("a-0", "docs/a.pdf", "back", 99)))
    assert held(table)[0] == ("a-0", "docs/a.pdf", "back", 99)  # not the first value of its earlier life
    assert spark.range(3).select(condition({"id": "*"}).alias("c")).where("c").count() == 3


def test_a_crash_between_data_and_manifest_leaves_nothing(spark, table, monkeypatch):
    table.upsert(rows(spark, ("a", "d", "one", 1)), source="s", batch=0)

    def broken(manifest):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(table, "_commit", broken)
        with pytest.raises(OSError):
            table.replace(rows(spark, ("b", "d", "two", 2)), {"doc": "d"}, source="s", batch=1)
    assert held(table) == [("a", "d", "one", 1)]
    assert table.replace(rows(spark, ("b", "d", "two", 2)), {"doc": "d"}, source="s", batch=1)
    assert held(table) == [("b", "d", "two", 2)]
    assert len(table.vacuum()) == 1 and held(table) == [("b", "d", "two", 2)]


def test_two_writers_don_t_overwrite_each_other(spark, table):
    other = Table(spark, table.path, "id", SCHEMA, ("created",))
    old = other.manifest()
    table.upsert(rows(spark, ("a", "d", "one", 1)))
    with pytest.raises(Conflict):
        other._write(rows(spark, ("b", "d", "x", 1)).withColumn("_deleted", F.lit(False)), old, None, None, [])
    assert held(other) == [("a", "d", "one", 1)]


def test_random_writes_as_a_dictionary_and_compaction(spark, table):
    rng, want = random.Random(4), {}
    for step in range(8):
        if step % 3 == 2:
            doc = f"d{rng.randint(0, 3)}"
            table.delete({"doc": doc})
            want = {k: v for k, v in want.items() if v[0] != doc}
        else:
            batch = {f"k{rng.randint(0, 15)}": (f"d{rng.randint(0, 3)}", f"b{step}", step) for _ in range(8)}
            table.upsert(rows(spark, *((k, *v) for k, v in batch.items())))
            want |= {k: (v[0], v[1], want[k][2] if k in want else v[2]) for k, v in batch.items()}
        if step == 5:
            table.compact()
            table.vacuum()
    assert held(table) == sorted((k, *v) for k, v in want.items())
    assert len(table.manifest()["folders"]) == 3


def test_a_stream_that_is_run_again_writes_once(spark, table, tmp_path):
    source = tmp_path / "in"
    rows(spark, ("a", "d", "one", 1), ("b", "d", "two", 1)).write.parquet(str(source))
    read = lambda: spark.readStream.schema(SCHEMA).parquet(str(source))
    sink(read(), table, str(tmp_path / "c1"), "s").awaitTermination()
    before = table.manifest()["number"]
    sink(read(), table, str(tmp_path / "c2"), "s").awaitTermination()  # the checkpoint is lost: the same batch again
    assert table.manifest()["number"] == before and len(held(table)) == 2
