"""Registered queries on written tables, task states, hierarchies and intervals, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lantern.operators import hierarchy, intervals, json_split
from lantern.plans.catalog import query, table
from lantern.sources.encodings import decoded
from lantern.sources.shared import folder
from lantern.sources.versions import Table
from lantern.streaming import states


_BATCH = "SELECT o_custkey, max(struct_pack(d := o_orderdate, k := o_orderkey, s := o_orderstatus, p := o_orderpriority)) AS r FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey % 3 = {} GROUP BY o_custkey"


@query(f"""WITH a AS ({_BATCH.format(0)}), b AS ({_BATCH.format(1)}), c AS ({_BATCH.format(2)}),
    ab AS (SELECT o_custkey, coalesce(b.r, a.r) AS r, coalesce(a.r.k, b.r.k) AS first FROM a FULL JOIN b USING (o_custkey)),
    kept AS (SELECT * FROM ab WHERE NOT (r.s IN ('F', 'P') AND r.p LIKE '%URGENT%')), abc AS (SELECT o_custkey, coalesce(c.r, kept.r) AS r, coalesce(kept.first, c.r.k) AS first FROM kept FULL JOIN c USING (o_custkey))
    SELECT o_custkey, r.k AS o_orderkey, r.s AS status, r.p AS priority, first AS first_orderkey FROM abc""")
def table_after_batches(spark, d) -> DataFrame:
    """Customers' latest orders in a table by three batches: two upserts, the second of them twice, a delete by terms and wildcard, a third."""
    orders = table(spark, d, "orders").where("o_custkey is not null")
    t = Table(spark, folder(spark, "customers"), "o_custkey", "o_custkey long, o_orderkey long, status string, priority string, first_orderkey long", ("first_orderkey",))
    rows = orders.select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("first_orderkey"), F.struct("o_orderdate", "o_orderkey").alias("order"))
    batch = lambda i: t.upsert(rows.where(F.col("o_orderkey") % 3 == i), "order", "orders", i)
    batch(0), batch(1), batch(1)
    t.delete({"status": ["F", "P"], "priority": "*URGENT*"})
    batch(0), batch(2)
    return t.read()


_EVENT = "CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'succeed' WHEN 'error' THEN 'fail' ELSE 'retry' END"


def task_events(events: DataFrame) -> DataFrame:
    """Events of users as those of tasks."""
    return events.select(F.col("user_id").alias("task"), "ts", "event_id", F.expr(_EVENT).alias("event"))


_THEN = "CASE " + " ".join(f"WHEN s = '{s}' AND event = '{v}' THEN '{n}'" for (s, v), n in states.STEPS.items()) + " END"


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS task, ts, {_EVENT} AS event, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
        coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 21600000000, false) AS late FROM events WHERE user_id IS NOT NULL),
    r AS (SELECT DISTINCT task, 0::BIGINT AS n, '' AS status, 0::BIGINT AS retries, 0::BIGINT AS illegal, 0::BIGINT AS timeouts FROM e
        UNION ALL SELECT task, n, coalesce(t, s), retries + (t IS NOT NULL AND event = 'retry')::INT, illegal + (t IS NULL)::INT, timeouts + o::INT
        FROM (SELECT *, {_THEN} AS t FROM (SELECT e.task, e.n, event, retries, illegal, timeouts, late AND status = 'running' AS o, CASE WHEN late AND status = 'running' THEN 'failed' ELSE status END AS s FROM r JOIN e ON e.task = r.task AND e.n = r.n + 1)))
    SELECT r.task, status, retries, illegal, timeouts, n AS events, updated_at FROM r JOIN (SELECT task, count(*) AS n, max(ts) AS updated_at FROM e GROUP BY task) USING (task, n)""")
def task_states(spark, d) -> DataFrame:
    """The state of each task after all its events: transitions, retries, illegal events, timeouts of six hours."""
    return states.latest(task_events(table(spark, d, "events")), 6 * 3600)


_CHAIN = """e AS (SELECT o_orderkey AS node, CASE WHEN o_custkey % 20 = 0 THEN coalesce(lag(o_orderkey) OVER w, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    ELSE lag(o_orderkey) OVER w END AS up, o_custkey FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))"""


@query(f"""WITH RECURSIVE {_CHAIN}, r AS (SELECT node, up, CASE WHEN up IS NULL THEN [] ELSE [up] END AS path, up IS NOT NULL AND up = node AS cyclic FROM e
        UNION ALL SELECT r.node, e.up, CASE WHEN e.up IS NULL THEN path ELSE path || [e.up] END, e.up IS NOT NULL AND (list_contains(path, e.up) OR e.up = r.node) FROM r JOIN e ON r.up = e.node WHERE NOT r.cyclic),
    l AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY cyclic DESC, len(path) DESC, up NULLS FIRST) AS k FROM r)
    SELECT node, CASE WHEN NOT cyclic THEN len(path) END AS depth, CASE WHEN NOT cyclic THEN coalesce(path[-1], node) END AS root, CASE WHEN NOT cyclic THEN array_to_string(path, '>') END AS path, cyclic FROM l WHERE k = 1""")
def order_chains(spark, d) -> DataFrame:
    """Each order's ancestors, the customer's orders before it; every twentieth customer's chain bites its tail."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    before, last = F.lag("o_orderkey").over(w), F.max("o_orderkey").over(Window.partitionBy("o_custkey"))
    up = F.when(F.col("o_custkey") % 20 == 0, F.coalesce(before, last)).otherwise(before)
    chains = hierarchy.ancestors(table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), up.alias("up")), "node", "up")
    return chains.withColumn("path", F.array_join("path", ">"))


_PERIODS = "p AS (SELECT o_custkey, o_orderdate::DATE AS s, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE + (floor(o_totalprice)::BIGINT % 200)::INT END AS e, o_orderpriority AS label FROM orders), v AS (SELECT o_custkey, s, coalesce(e, DATE '2026-01-01') AS e, e IS NULL AS open, label FROM p WHERE s IS NOT NULL AND coalesce(e, DATE '2026-01-01') >= s)"


@query(f"""WITH {_PERIODS}, f AS (SELECT *, coalesce(s > max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS fresh FROM v),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM f),
    i AS (SELECT o_custkey, island, min(s) AS s, max(e) AS e FROM g GROUP BY ALL), h AS (SELECT *, s - lag(e) OVER (PARTITION BY o_custkey ORDER BY s) AS gap FROM i),
    w AS (SELECT o_custkey, sum(e - s)::BIGINT AS covered_days, coalesce(max(gap), 0) AS longest_gap, count(*) AS islands FROM h GROUP BY o_custkey)
    SELECT o_custkey, count(*) AS jobs, round(avg(e - s), 6) AS mean_days, max(CASE WHEN open THEN e - s END) AS current_days, arg_min(label, (s, label)) AS first, arg_max(label, (s, label)) AS last, any_value(covered_days) AS covered_days, any_value(longest_gap) AS longest_gap, any_value(islands) AS islands
    FROM v JOIN w USING (o_custkey) GROUP BY o_custkey""")
def tenures(spark, d) -> DataFrame:
    """Customers' orders as jobs that last some days or are still held: union of periods, gaps, tenures, first and last."""
    start = F.col("o_orderdate").cast("date")
    end = F.when(F.col("o_orderstatus") != "P", F.date_add(start, (F.floor("o_totalprice") % 200).cast("int")))
    periods = table(spark, d, "orders").select("o_custkey", start.alias("s"), end.alias("e"), F.col("o_orderpriority").alias("label"))
    return intervals.tenure(periods, "o_custkey", "s", "e", F.lit("2026-01-01").cast("date"), "label")


_ONE_BYTE = r"regexp_replace(coalesce(text, ''), '[^\x00-\xFF]', '?', 'g')"


@query(rf"SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND regexp_matches({_ONE_BYTE}, '[\x80-\xFF]') THEN 'cp1252' ELSE 'utf-8' END AS codec, md5(CASE WHEN doc_id % 2 = 0 THEN {_ONE_BYTE} ELSE coalesce(text, '') END) AS text_md5 FROM documents")
def decoded_documents(spark, d) -> DataFrame:
    """Documents as files, every second one in a one-byte encoding: the codec that is found, and the text that is read by it."""
    text = F.coalesce("text", F.lit(""))
    content = F.when(F.col("doc_id") % 2 == 0, F.encode(F.regexp_replace(text, r"[^\x00-\xFF]", "?"), "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    return table(spark, d, "documents").select("doc_id", decoded(content).alias("x")).select("doc_id", "x.codec", F.md5(F.col("x.text").cast("binary")).alias("text_md5"))


@query()
def json_pieces(spark, d) -> DataFrame:
    """Documents as JSON with their lines as a list, in pieces; tests put pieces together again."""
    whole = F.to_json(F.struct("doc_id", "source", "lang", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines")))
    parts = table(spark, d, "documents").select("doc_id", F.posexplode(json_split.split(whole, 1000)).alias("piece", "json"))
    return parts.select("doc_id", "piece", F.length("json").alias("length"), F.md5(F.col("json").cast("binary")).alias("json_md5"))
