"""The registered queries of the reference's operators, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lantern.functions import text as T
from lantern.operators import dense, lexical, metrics, ranking
from lantern.streaming import tasks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_TOKENS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda t: length(t) > 1 OR regexp_full_match(t, '[0-9]'))"
_BM25 = rf"""
    d AS (SELECT doc_id, {_TOKENS} AS t FROM documents), q AS (SELECT item_id, {_TOKENS} AS t FROM benchmark),
    s AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM d),
    p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    r AS (SELECT term, ln(docs - df + 0.5) - ln(df + 0.5) AS raw FROM df, s),
    i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r),
    qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(t) AS term FROM q) GROUP BY ALL),
    sc AS (SELECT item_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))), 6) AS score
           FROM p JOIN i ON p.term = i.term JOIN qt ON p.term = qt.term, s GROUP BY item_id, doc_id),
    top AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM sc QUALIFY rank <= 5)"""


@query(f"WITH {_BM25} SELECT item_id, rank, doc_id, score FROM top")
def bm25_topk(spark, d):
    return lexical.bm25(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id")


_CASES = f"""{_BM25},
    c AS (SELECT b.item_id, CASE WHEN length(b.text) < 200 THEN 'short' ELSE 'long' END AS kind, min(rank) FILTER (WHERE l.quality = 1) AS rank
          FROM benchmark b LEFT JOIN top ON b.item_id = top.item_id LEFT JOIN labels l ON top.doc_id = l.doc_id GROUP BY ALL)"""


def _cases(spark, d) -> DataFrame:
    """For each item the first of its five documents that is labelled good."""
    top = bm25_topk(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    first = top.groupBy("item_id").agg(F.min(F.when(F.col("quality") == 1, F.col("rank"))).alias("rank"))
    items = table(spark, d, "benchmark").select("item_id", F.when(F.length("text") < 200, "short").otherwise("long").alias("kind"))
    return items.join(first, "item_id", "left")


@query(f"""WITH {_CASES} SELECT kind, count(*) AS cases, round(coalesce(avg(coalesce(rank <= 1, false)::INT), 0), 6) AS hit_1, round(coalesce(avg(coalesce(rank <= 3, false)::INT), 0), 6) AS hit_3,
    round(coalesce(avg(coalesce(rank <= 5, false)::INT), 0), 6) AS hit_k, round(coalesce(avg(coalesce(1.0 / rank, 0)), 0), 6) AS mrr FROM c GROUP BY GROUPING SETS ((), (kind))""")
def retrieval_metrics(spark, d):
    return metrics.retrieval(_cases(spark, d), "kind")


@query("""SELECT event_type, n, s[(round_even((n - 1) * 0.95, 0) + 1)::INT] AS percentile FROM (SELECT event_type, count(*) AS n, list_sort(list(value)) AS s FROM events WHERE value IS NOT NULL GROUP BY event_type)""")
def latency_percentile(spark, d):
    return metrics.percentile(table(spark, d, "events"), "event_type", "value", 0.95)


@query(rf"""WITH q AS (SELECT item_id, list_distinct({_TOKENS}) AS t FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct({_TOKENS})) AS term FROM documents)
    SELECT item_id, doc_id, count(*) AS hits, n FROM d JOIN (SELECT item_id, len(t) AS n, unnest(t) AS term FROM q) q ON d.term = q.term GROUP BY item_id, doc_id, n HAVING count(*) >= greatest(1, floor(n * 0.3))""")
def coverage_filter(spark, d):
    return lexical.coverage(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id")


@query(rf"""WITH p AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY ALL),
    df AS (SELECT term, ln(((SELECT count(*) FROM benchmark) + 1) / (count(*) + 1)) + 1 AS idf FROM p GROUP BY term),
    v AS (SELECT item_id, ('0x' || substr(md5(p.term), 1, 8))::BIGINT % 2048 AS bucket, sum(tf * idf) AS w FROM p JOIN df ON p.term = df.term GROUP BY ALL)
    SELECT item_id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM v""")
def hashed_tfidf(spark, d):
    return lexical.tfidf_buckets(table(spark, d, "benchmark"), "item_id")


_KNN = """SELECT q.vec_id AS query_id, d.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 5) AS similarity
    FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id"""


def _knn(spark, d, least=-1.0):
    v = table(spark, d, "embeddings")
    return dense.knn(v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), v, "query_id", "vec_id", "embedding", 10, least)


@query(f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank, vec_id, similarity FROM ({_KNN}) QUALIFY rank <= 10")
def knn_cosine(spark, d):
    return _knn(spark, d)


@query(f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank, vec_id, similarity FROM ({_KNN}) WHERE similarity >= 0.17 QUALIFY rank <= 10")
def min_similarity_filter(spark, d):
    return _knn(spark, d, 0.17)


_LISTS = f"""{_BM25},
    hits AS (SELECT item_id, doc_id, count(*) AS hits FROM (SELECT doc_id, unnest(list_distinct(t)) AS term FROM d) x JOIN (SELECT item_id, unnest(list_distinct(t)) AS term FROM q) y ON x.term = y.term GROUP BY ALL),
    cov AS (SELECT item_id, doc_id, hits, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS rank FROM hits QUALIFY rank <= 5),
    lists AS (SELECT item_id, doc_id, rank FROM top UNION ALL SELECT item_id, doc_id, rank FROM cov)"""


def _coverage_top(spark, d):
    return lexical.coverage_top(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id", 5)


def _lists(spark, d):
    return bm25_topk(spark, d).select("item_id", "doc_id", "rank").unionByName(_coverage_top(spark, d).select("item_id", "doc_id", "rank"))


@query(f"WITH {_LISTS} SELECT item_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score, count(*) AS appearances, min(rank) AS best_rank FROM lists GROUP BY item_id, doc_id")
def rrf_fusion(spark, d):
    return ranking.rrf(_lists(spark, d), "item_id", "doc_id", "rank")


@query(f"WITH {_LISTS} SELECT coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.doc_id, b.doc_id) AS doc_id, round(0.8 * coalesce(score, 0) + 0.2 * coalesce(hits, 0), 6) AS score FROM top a FULL JOIN cov b ON a.item_id = b.item_id AND a.doc_id = b.doc_id")
def weighted_fusion(spark, d):
    cov = _coverage_top(spark, d).withColumn("hits", F.col("hits").cast("double"))
    return ranking.weighted(bm25_topk(spark, d), cov, "item_id", "doc_id", "score", "hits", 0.2)




def _lines(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), (F.col("l_suppkey") % 4).alias("doc"), (F.col("l_linenumber").cast("long") * 10_000_000_000 + F.col("l_partkey") * 10 + F.col("l_suppkey") % 4).alias("pos")).distinct()


_L = "WITH l AS (SELECT DISTINCT l_orderkey AS q, l_suppkey % 4 AS doc, l_linenumber::BIGINT * 10000000000 + l_partkey * 10 + l_suppkey % 4 AS pos FROM lineitem)"


@query(f"""{_L}, x AS (SELECT *, row_number() OVER (PARTITION BY q, doc ORDER BY pos) AS depth, min(pos) OVER (PARTITION BY q, doc) AS first FROM l)
    SELECT q, doc, pos, row_number() OVER (PARTITION BY q ORDER BY depth > 2, CASE WHEN depth > 2 THEN pos ELSE depth END, CASE WHEN depth > 2 THEN 0 ELSE first END, pos) AS place FROM x""")
def doc_round_robin(spark, d):
    return ranking.round_robin(_lines(spark, d), "q", "doc", "pos", 2)


@query(f"""{_L}, x AS (SELECT *, row_number() OVER (PARTITION BY q, doc ORDER BY pos) AS depth, min(pos) OVER (PARTITION BY q, doc) AS first FROM l)
    SELECT q, doc, pos, row_number() OVER (PARTITION BY q ORDER BY depth, first, pos) AS place FROM x""")
def doc_interleave(spark, d):
    return ranking.round_robin(_lines(spark, d), "q", "doc", "pos", None)


@query(f"""{_L}, x AS (SELECT *, (row_number() OVER (PARTITION BY q, doc ORDER BY pos) = 1)::INT AS lead FROM l),
    y AS (SELECT *, sum(lead) OVER (PARTITION BY q ORDER BY pos ROWS UNBOUNDED PRECEDING) AS nth FROM x)
    SELECT q, doc, pos, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN lead = 1 AND nth <= 2 THEN 0 ELSE 1 END, pos) AS place FROM y""")
def doc_diversity(spark, d):
    return ranking.distinct_docs_first(_lines(spark, d), "q", "doc", "pos", 2)


@query(f"""{_L}, x AS (SELECT *, row_number() OVER (PARTITION BY q, doc ORDER BY pos) AS n FROM l) SELECT q, doc, pos, row_number() OVER (PARTITION BY q ORDER BY pos) AS rank FROM x WHERE n = 1""")
def dedupe_documents(spark, d):
    return ranking.keep_first(_lines(spark, d), "q", F.col("doc"), F.col("pos"))


@query(f"""WITH {_LISTS}, b AS (SELECT item_id, doc_id, rank, 0 AS list FROM cov UNION ALL SELECT item_id, doc_id, rank, 1 FROM top),
    o AS (SELECT item_id, doc_id, min((list, rank)) AS best FROM b GROUP BY ALL) SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY best, doc_id) AS place FROM o QUALIFY place <= 6""")
def prepend_unique(spark, d):
    return ranking.prepend(_coverage_top(spark, d), bm25_topk(spark, d), "item_id", "doc_id", "rank", 6)


@query(r"""SELECT doc_id, trim(regexp_replace(text, '[\s\x{3000}\x{00a0}]+', ' ', 'g')) AS normalized FROM documents""")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize(F.col("text")).alias("normalized"))


@query("SELECT doc_id, CASE WHEN length(text) > 320 THEN rtrim(substr(text, 1, 317)) || '...' ELSE text END AS preview FROM documents")
def clip_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clip(F.col("text"), 320).alias("preview"))


@query(r"""SELECT doc_id, n, pos FROM (SELECT doc_id, unnest(l) AS n, unnest(range(0, len(l))) AS pos FROM (
    SELECT doc_id, list_filter(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?%?'), lambda t: NOT regexp_full_match(t, '(19|20)[0-9]{2}')) AS l FROM documents))
    QUALIFY row_number() OVER (PARTITION BY doc_id, n ORDER BY pos) = 1""".replace("SELECT doc_id, n, pos FROM", "SELECT doc_id, n FROM"))
def numeric_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(T.number_tokens(F.col("text"))).alias("n"))


#: The pages hold no tables and hardly a year, so each gets a table of its host and a year, of up to three rows and an empty one.
TABLED = """html || '<table><tr><th>year</th><th>host</th></tr>' || repeat('<tr><td>' || CAST(1985 + page_id % 45 AS STRING) || '</td><td class="h">' || split_part(url, '/', 3) || '</td></tr>', CAST(page_id % 4 AS INT)) || '<tr><td> </td></tr></table>'"""


@query(rf"SELECT DISTINCT page_id, y FROM (SELECT page_id, unnest(regexp_extract_all({TABLED}, '[0-9]+')) AS y FROM pages) WHERE regexp_full_match(y, '(19|20)[0-9]{{2}}')")
def year_tokens(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(T.year_tokens(F.expr(TABLED))).alias("y"))


@query(r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
    trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<head[^>]*>.*?</head>|<nav[^>]*>.*?</nav>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS body FROM pages""")
def html_sections(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_title(F.col("html")).alias("title"), T.html_text(F.col("html")).alias("body"))


@query(rf"""SELECT page_id, len(rows)::INT AS n_rows, coalesce(list_sum(list_transform(rows, lambda r: len(regexp_extract_all(r, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1)))), 0)::INT AS n_cells FROM (
    SELECT page_id, list_filter(regexp_extract_all({TABLED}, '(?is)<tr[^>]*>(.*?)</tr>', 1), lambda r: len(list_filter(regexp_extract_all(r, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1), lambda c: length(trim(regexp_replace(c, '<[^>]*>|[ \t\r\n]', '', 'g'))) > 0)) > 0) AS rows FROM pages)""")
def html_rows(spark, d):
    rows = table(spark, d, "pages").select("page_id", T.html_rows(F.expr(TABLED)).alias("r"))
    return rows.select("page_id", F.size("r").alias("n_rows"), F.aggregate("r", F.lit(0), lambda a, x: a + F.size(x)).alias("n_cells"))


@query("SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]+$') AS name FROM pages")
def url_names(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", F.split_part(F.split_part(url, F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"), F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), "[^/]+$", 0).alias("name"))


@query(r"""SELECT doc_id, line_no, line, chapter FROM (SELECT *, last_value(CASE WHEN length(line) < 40 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS chapter FROM (
    SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))""")
def section_carry_forward(spark, d):
    """Each line with the last short line before it or itself, taken for its heading."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    return lines.withColumn("chapter", F.last(F.when(F.length("line") < 40, F.col("line")), ignorenulls=True).over(w)).select("doc_id", "line_no", "line", "chapter")


@query(r"""SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY line_no) AS text, sha256(doc_id || ':' || chunk) AS chunk_id FROM (SELECT *, ((before) // 800)::INT AS chunk FROM (
    SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM (
    SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))) GROUP BY doc_id, chunk""")
def line_chunks(spark, d):
    """Lines in chunks of about 800 characters, with stable ids."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    before = F.coalesce(F.sum(F.length("line")).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = lines.withColumn("chunk", F.floor(before / 800).cast("int")).groupBy("doc_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return chunks.select("doc_id", "chunk", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"), F.sha2(F.concat_ws(":", "doc_id", "chunk"), 256).alias("chunk_id"))


@query("SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 0 GROUP BY line HAVING count(*) > 1")
def repeated_garbage(spark, d):
    return table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") > 0).groupBy("line").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT conv_id, turn, role, text, place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations) WHERE place <= 3")
def history_window(spark, d):
    """The last three turns of each conversation."""
    return ranking.ranked(table(spark, d, "conversations"), "conv_id", F.col("turn").desc(), name="place").where("place <= 3").select("conv_id", "turn", "role", "text", "place")


@query("""SELECT conv_id, turn, text AS question, CASE WHEN length(text) < 60 AND prev IS NOT NULL THEN prev || ' ' || text ELSE text END AS standalone
    FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations WHERE role = 'user')""")
def followup_rewrite(spark, d):
    """A short question gets the one before it in front."""
    users = table(spark, d, "conversations").where("role = 'user'").withColumn("prev", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    full = F.when((F.length("text") < 60) & F.col("prev").isNotNull(), F.concat_ws(" ", "prev", "text")).otherwise(F.col("text"))
    return users.select("conv_id", "turn", F.col("text").alias("question"), full.alias("standalone"))


@query("SELECT o_orderkey, o_orderdate, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'FURNITURE'")
def session_messages(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'FURNITURE'").select("c_custkey", "c_name")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "c_custkey", "c_name")


@query("SELECT doc_id, source FROM documents WHERE NOT coalesce(source = 'src3' OR source LIKE '%7', false)")
def delete_chunks(spark, d):
    s = F.col("source")
    return table(spark, d, "documents").where(~F.coalesce((s == "src3") | s.endswith("7"), F.lit(False))).select("doc_id", "source")


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def resume_anti_join(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT source, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY source")
def doc_aggs(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


_SHARE = "SELECT event_type, n, round((n + 1) / (sum(n) OVER () + 1000), 9) AS share FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)"


@query(_SHARE)
def tag_share(spark, d):
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round((F.col("n") + 1) / (F.sum("n").over(Window.partitionBy()) + 1000), 9))


@query(f"""WITH s AS ({_SHARE}), u AS (SELECT user_id, event_type, count(*) AS c, sum(count(*)) OVER (PARTITION BY user_id) AS cnt FROM events GROUP BY user_id, event_type),
    x AS (SELECT user_id, u.event_type, round(0.1 * (c + 1) / (cnt + 1000) / greatest(0.000001, share), 6) AS lift FROM u JOIN s ON u.event_type = s.event_type)
    SELECT user_id, event_type, lift, row_number() OVER (PARTITION BY user_id ORDER BY lift DESC, event_type) AS place FROM x QUALIFY place <= 3""")
def tag_lift(spark, d):
    by_user = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("c")).withColumn("cnt", F.sum("c").over(Window.partitionBy("user_id")))
    lift = F.round(0.1 * (F.col("c") + 1) / (F.col("cnt") + 1000) / F.greatest(F.lit(1e-6), F.col("share")), 6)
    x = by_user.join(tag_share(spark, d), "event_type").select("user_id", "event_type", lift.alias("lift"))
    return ranking.ranked(x, "user_id", F.col("lift").desc(), F.col("event_type"), name="place").where("place <= 3")


@query("""WITH e AS (SELECT DISTINCT s_suppkey AS id FROM supplier), i AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'R')
    SELECT count(i.id) AS present, count(*) FILTER (WHERE i.id IS NULL) AS missing, CASE WHEN count(*) FILTER (WHERE i.id IS NULL) = 0 THEN 'skip' WHEN count(i.id) = 0 THEN 'rebuild' ELSE 'resume' END AS action FROM e LEFT JOIN i ON e.id = i.id""")
def corpus_state(spark, d):
    expected = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")).distinct()
    indexed = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("id"), F.lit(1).alias("there")).distinct()
    n = expected.join(indexed, "id", "left").agg(F.count("there").alias("present"), F.count_if(F.col("there").isNull()).alias("missing"))
    return n.withColumn("action", F.when(F.col("missing") == 0, "skip").when(F.col("present") == 0, "rebuild").otherwise("resume"))


@query("SELECT source, text, count(*) AS n FROM documents GROUP BY source, text HAVING count(*) > 1")
def dup_uploads(spark, d):
    """Texts that a source holds more than once. Hashes are grouped; whole texts move only for those that occur again."""
    docs = table(spark, d, "documents").select("source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), F.col("text").isNull().alias("empty"))
    again = docs.groupBy("source", "h", "empty").agg(F.count("*").alias("n")).where("n > 1").select(F.col("source").alias("s"), F.col("h").alias("k"), F.col("empty").alias("e"), "n")
    found = docs.join(again, docs["source"].eqNullSafe(F.col("s")) & (F.col("h") == F.col("k")) & (F.col("empty") == F.col("e")))
    return found.dropDuplicates(["source", "k", "e"]).select("source", "text", "n")


@query("""WITH h AS (SELECT source, octet_length(encode(text)) AS b, sha256(text) AS h FROM documents), p AS (SELECT source, left(h, 4) AS bucket, count(*) AS files, sum(b)::BIGINT AS bytes, sha256(string_agg(h, ',' ORDER BY h)) AS part FROM h GROUP BY ALL)
    SELECT source, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, sha256(string_agg(part, ',' ORDER BY bucket)) AS fingerprint FROM p GROUP BY source""")
def corpus_fingerprint(spark, d):
    """Totals and a hash of all texts by source that no order changes: hashes are sorted and hashed in 65,536 buckets, then these."""
    h = table(spark, d, "documents").select("source", F.octet_length("text").alias("b"), F.sha2("text", 256).alias("h"))
    listed = lambda c: F.sha2(F.array_join(c, ","), 256)
    parts = h.groupBy("source", F.substring("h", 1, 4).alias("bucket")).agg(F.count("*").alias("files"), F.sum("b").alias("bytes"), listed(F.array_sort(F.collect_list("h"))).alias("part"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "part"))), lambda x: x["part"])
    return parts.groupBy("source").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), listed(whole).alias("fingerprint"))


@query("""WITH m AS (SELECT l_returnflag AS k, avg(l_discount) AS a, avg(l_tax) AS b FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), n AS (SELECT l_returnflag AS k, avg(l_discount) AS a, avg(l_tax) AS b FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
    x AS (UNPIVOT m ON a, b INTO NAME metric VALUE v), y AS (UNPIVOT n ON a, b INTO NAME metric VALUE v),
    z AS (SELECT coalesce(x.k, y.k) AS k, coalesce(x.metric, y.metric) AS metric, coalesce(x.v, 0) AS c, coalesce(y.v, 0) AS b FROM x FULL JOIN y ON x.k = y.k AND x.metric = y.metric)
    SELECT k, metric, round(c, 9) AS current, round(b, 9) AS baseline, round(c - b, 6) AS delta, round(CASE WHEN b = 0 THEN 0 ELSE (c - b) / b END, 6) AS relative FROM z""")
def report_delta(spark, d):
    of = lambda s: table(spark, d, "lineitem").where(F.col("l_linestatus") == s).groupBy(F.col("l_returnflag").alias("k")).agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"))
    return metrics.delta(of("O"), of("F"), "k", ["a", "b"]).withColumns({c: F.round(c, 9) for c in ("current", "baseline")})


@query("""SELECT k.kind, count(x.kind) AS n FROM (SELECT unnest(['junk', 'toxic', 'short', 'unlabelled', 'fine']) AS kind) k
    LEFT JOIN (SELECT CASE WHEN quality = 0 THEN 'junk' WHEN toxic = 1 THEN 'toxic' WHEN n_chars < 200 THEN 'short' WHEN quality IS NULL THEN 'unlabelled' ELSE 'fine' END AS kind FROM labels JOIN documents USING (doc_id)) x ON k.kind = x.kind GROUP BY k.kind""")
def failure_taxonomy(spark, d):
    """Counts of all classes, those without rows as 0."""
    kind = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").when(F.col("n_chars") < 200, "short").when(F.col("quality").isNull(), "unlabelled").otherwise("fine")
    found = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, ("junk", "toxic", "short", "unlabelled", "fine")))).alias("kind"))
    return every.join(found, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT trait, count(*) AS n, count(*) FILTER (WHERE quality = 0) AS misses FROM (SELECT quality, unnest(list_filter([CASE WHEN contains(text, '!') THEN 'loud' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'numeric' END, CASE WHEN contains(text, '|') THEN 'table' END], lambda x: x IS NOT NULL)) AS trait
    FROM labels JOIN documents USING (doc_id)) GROUP BY trait""")
def evidence_miss_traits(spark, d):
    t = F.col("text")
    traits = F.array_compact(F.array(F.when(t.contains("!"), "loud"), F.when(F.rlike(t, F.lit("[0-9]")), "numeric"), F.when(t.contains("|"), "table")))
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", traits.alias("traits")), "doc_id").select("quality", F.explode("traits").alias("trait"))
    return x.groupBy("trait").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 0).alias("misses"))


@query("SELECT user_id, arg_max(event_type, (ts, event_type)) AS status, max(ts) AS updated_at, count(*) AS events FROM events GROUP BY user_id")
def task_latest_state(spark, d):
    return tasks.latest_state(table(spark, d, "events"), "user_id", "ts", "event_type")


@query("SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def window_counts(spark, d):
    return tasks.tumbling(table(spark, d, "events"), "ts", "10 minutes", "event_type")


@query("""SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT user_id, ts, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE, true)::INT AS new FROM events)) GROUP BY user_id, s""")
def event_sessions(spark, d):
    return tasks.sessions(table(spark, d, "events"), "ts", "30 minutes", "user_id")
