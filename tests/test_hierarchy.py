from lantern.operators import hierarchy


def test_nodes_at_their_end_are_not_joined_again(spark, monkeypatch):
    rounds, write = [], hierarchy.written
    monkeypatch.setattr(hierarchy, "written", lambda df, name: rounds.append((name, write(df, name))) or rounds[-1][1])
    edges = [(i, None) for i in range(100)] + [(200, 99), (201, 200), (202, 201), (203, 202), (300, 301), (301, 300), (302, 301), (400, 999)]
    got = {r["node"]: r for r in hierarchy.ancestors(spark.createDataFrame(edges, "node long, up long"), "node", "up").collect()}
    assert len(got) == len(edges) and got[203]["path"] == [202, 201, 200, 99] and got[203]["root"] == 99 and got[5]["depth"] == 0
    assert [got[i]["cyclic"] for i in (300, 301, 302, 400)] == [True, True, True, False] and got[400]["path"] == [999] and got[300]["depth"] is None
    assert all(df.count() <= 8 for name, df in rounds if name == "paths")
