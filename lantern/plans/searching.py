"""Registered queries of text and vector searches, each with its SQL twin."""

from __future__ import annotations

from lantern.operators import dense, phrases
from lantern.plans.catalog import _TOKENS, query, table


@query(rf"""WITH d AS (SELECT doc_id, unnest(t) AS term, unnest(range(0, len(t))) AS pos FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)),
    q AS (SELECT item_id, term, min(pos) AS first FROM (SELECT item_id, unnest(t) AS term, unnest(range(0, len(t))) AS pos FROM (SELECT item_id, {_TOKENS} AS t FROM benchmark)) GROUP BY ALL),
    df AS (SELECT term, count(DISTINCT doc_id) AS df, (SELECT count(*) FROM documents) AS docs FROM d GROUP BY term HAVING df <= 0.25 * docs),
    k AS (SELECT item_id, term, first, ln(1 + (docs - df + 0.5) / (df + 0.5)) AS idf FROM q JOIN df USING (term)),
    w AS (SELECT item_id, term, first, round(idf / sum(idf) OVER (PARTITION BY item_id), 4) AS weight, count(*) OVER (PARTITION BY item_id) AS n FROM k),
    p AS (SELECT * FROM (SELECT item_id, term AS l, lead(term) OVER (PARTITION BY item_id ORDER BY first) AS r, 2 * greatest(weight, lead(weight) OVER (PARTITION BY item_id ORDER BY first)) AS boost FROM w) WHERE r IS NOT NULL),
    near AS (SELECT l, r, doc_id, sum(1 / (1 + dist)) AS f FROM (SELECT l, r, a.doc_id, a.pos, min(CASE WHEN b.pos > a.pos THEN b.pos - a.pos - 1 ELSE a.pos - b.pos + 1 END) AS dist
        FROM (SELECT DISTINCT l, r FROM p) x JOIN d a ON a.term = l JOIN d b ON b.term = r AND a.doc_id = b.doc_id AND b.pos BETWEEN a.pos - 1 AND a.pos + 3 AND b.pos <> a.pos GROUP BY ALL) GROUP BY l, r, doc_id),
    t AS (SELECT item_id, doc_id, n, count(*) AS terms, sum(weight * tf / (tf + 1)) AS s FROM (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL) JOIN w USING (term) GROUP BY item_id, doc_id, n HAVING terms >= greatest(1, floor(n * 0.3))),
    c AS (SELECT item_id, doc_id, count(*) AS phrases, sum(boost * f / (f + 1)) AS s FROM near JOIN p USING (l, r) GROUP BY item_id, doc_id)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score, terms, phrases
    FROM (SELECT item_id, doc_id, round(t.s + coalesce(c.s, 0), 6) AS score, terms, coalesce(phrases, 0) AS phrases FROM t LEFT JOIN c USING (item_id, doc_id)) QUALIFY rank <= 10""")
def phrase_search(spark, d):
    """Weighted terms, phrases within a slop of two and a minimum match of 30%."""
    return phrases.search(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id")


@query()
def knn_near(spark, d):
    """Nearest vectors by an inverted file; approximate, so without SQL: a test holds its recall against the exact search."""
    v = table(spark, d, "embeddings")
    return dense.knn_near(v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), v, "query_id", "vec_id", "embedding", 10)
