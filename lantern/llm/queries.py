"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lantern.llm import chat_format, decontamination, merkle, minhash, mixing, ngram_join, quality_model, quality_rules, ranked_search, secret_scan, sharding, substring_dedup, token_files
from lantern.llm.common import stored, table, work_dir


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rotate(table(spark, sf_dir, "conversations"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality_model.classify(docs, table(spark, sf_dir, "labels"), "doc_id", "source", "lang")
    return out.select("doc_id", "source", "lang", *(F.round(c, 6).alias(c) for c in ("q_good", "q_toxic", "q_host_rate", "q_path_rate", "q_odds")), F.col("q_kept").alias("kept"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{work_dir(spark)}/lantern-{uuid.uuid4().hex}-token-files"
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.checksums(spark, path)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.copies(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = stored(table(spark, sf_dir, "documents").select("doc_id", (F.length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")), "sizes")
    placed = sharding.shard(rows, 24, order=("doc_id", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    leaves = docs.select("lang", "doc_id", merkle.leaf(*(F.col(c) for c in merkle.FIELDS)).alias("leaf"), F.when(tampered, merkle.leaf(*(lowered if c == "text" else F.col(c) for c in merkle.FIELDS))).alias("changed"))
    rows, root = merkle.manifest(leaves, "lang", "doc_id", "changed")
    folded = rows.select("doc_id", merkle.as_text(F.col("leaf")).alias("leaf"), merkle.as_text(F.col("subroot")).alias("subroot"), F.lit(root).cast("string").alias("root"), merkle.proof_digest(F.col("path")).alias("proof_sha256"), merkle.fold(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"), n=5, num=85, den=100)


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_chat_format, op3_quality_model, op4_ngram_join, op5_token_files, op6_mixing, op7_decontamination, op8_sharding, op9_quality_rules, op10_substring_dedup, op11_merkle_manifest, op12_ranked_search, op13_minhash_dedup)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_AZ = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"

_ESCAPED = r"regexp_replace(regexp_replace({}, '<(\\*)\|', '<\1\\|', 'g'), '\|(\\*)>', '|\1\\>', 'g')"

ORACLES = {
    "op2_chat_format": f"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
        p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
        r AS (SELECT t.conv_id, perspective, turn, speaker, speaker = perspective AS masked, text,
                CASE WHEN speaker = 'system' THEN '<|system|>' || chr(10) WHEN speaker = perspective THEN '<|assistant|>' || chr(10)
                     ELSE '<|user name=' || {_ESCAPED.format('speaker')} || '|>' || chr(10) END AS head
              FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
        q AS (SELECT *, head || {_ESCAPED.format('text')} || '<|end|>' || chr(10) AS piece FROM r),
        s AS (SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, piece ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM q)
        SELECT conv_id, perspective, turn, speaker, piece, e - length(piece) AS start, e AS "end", e - length(piece) + length(head) AS body_start, masked FROM s""",
    "op4_ngram_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
        g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        pairs AS (SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id
                  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a)
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(reach.b) AS component_id FROM s JOIN reach ON s.doc_id = reach.a GROUP BY s.doc_id, len(s.s)""",
    "op7_decontamination": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda p: array_to_string(w[p:p + least(10, len(w)) - 1], ' '))) AS g FROM i WHERE len(w) > 0),
        m AS (SELECT DISTINCT m FROM win),
        lists AS (SELECT doc_id, m, list_transform(range(1, len(w) - m + 2), lambda p: array_to_string(w[p:p + m - 1], ' ')) AS gs FROM d, m WHERE len(w) >= m),
        dw AS (SELECT doc_id, m, unnest(gs) AS g, unnest(range(0, len(gs))) AS p FROM lists),
        occ AS (SELECT DISTINCT doc_id, dw.m, p, item_id FROM dw JOIN win ON dw.m = win.m AND dw.g = win.g),
        hit AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM (SELECT doc_id, p, unnest(range(0, m)) AS k FROM occ) GROUP BY doc_id),
        it AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM occ) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items, sha256(coalesce(it.s, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
        FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id""",
    "op10_substring_dedup": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
        lists AS (SELECT doc_id, list_transform(range(1, len(w) - 48), lambda p: md5(array_to_string(w[p:p + 49], ' '))) AS gs FROM d WHERE len(w) >= 50),
        dw AS (SELECT doc_id, unnest(gs) AS g, unnest(range(1, len(gs) + 1)) AS p FROM lists),
        firsts AS (SELECT g, min(doc_id) AS f FROM dw GROUP BY g),
        gone AS (SELECT doc_id, list(DISTINCT p + k) AS cut FROM (SELECT dw.doc_id, p, unnest(range(0, 50)) AS k FROM dw JOIN firsts ON dw.g = firsts.g WHERE f < dw.doc_id) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(cut), 0)::BIGINT AS n_removed,
            sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(coalesce(cut, []), i)), lambda i: w[i]), ' '), '')) AS kept_sha256
        FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id""",
    "op11_merkle_manifest": f"""
        WITH RECURSIVE c AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384)), 4294967295) AS crc FROM documents),
        l AS (SELECT doc_id, lang, crc, sha256({_FIELD.format('doc_id')} || {_FIELD.format('source')} || {_FIELD.format('lang')} || {_FIELD.format('n_chars')} || {_FIELD.format('text')}) AS leaf,
                sha256({_FIELD.format('doc_id')} || {_FIELD.format('source')} || {_FIELD.format('lang')} || {_FIELD.format('n_chars')} || {_FIELD.format(_AZ)}) AS lowered FROM c),
        p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS id FROM l),
        t AS (SELECT lang, 0 AS lvl, pos, leaf AS h, n FROM p UNION ALL SELECT lang, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM t WHERE n > 1 GROUP BY lang, lvl, pos // 8, n),
        s AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
        u AS (SELECT 0 AS lvl, pos, h, n FROM s UNION ALL SELECT lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM u WHERE n > 1 GROUP BY lvl, pos // 8, n),
        f AS (SELECT id, lang, 0 AS lvl, pos, CASE WHEN crc % 3 = 0 THEN lowered ELSE leaf END AS h, '' AS sib FROM p
              UNION ALL SELECT id, f.lang, f.lvl + 1, f.pos // 8, sha256(string_agg(CASE WHEN t.pos = f.pos THEN f.h ELSE t.h END, '' ORDER BY t.pos)), f.sib || coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos <> f.pos), '')
              FROM f JOIN t ON f.lang IS NOT DISTINCT FROM t.lang AND f.lvl = t.lvl AND f.pos // 8 = t.pos // 8 WHERE t.n > 1 GROUP BY id, f.lang, f.lvl, f.pos, f.sib),
        g AS (SELECT id, 0 AS lvl, s.pos, f.h, f.sib FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY lvl DESC) = 1) f JOIN s ON f.lang IS NOT DISTINCT FROM s.lang
              UNION ALL SELECT id, g.lvl + 1, g.pos // 8, sha256(string_agg(CASE WHEN u.pos = g.pos THEN g.h ELSE u.h END, '' ORDER BY u.pos)), g.sib || coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos <> g.pos), '')
              FROM g JOIN u ON g.lvl = u.lvl AND g.pos // 8 = u.pos // 8 WHERE u.n > 1 GROUP BY id, g.lvl, g.pos, g.sib)
        SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(g.sib) AS proof_sha256, g.h AS folded_root, g.h = r.h AS verified
        FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang JOIN (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY lvl DESC) = 1) g ON p.id = g.id, (SELECT h FROM u WHERE n = 1) r""",
    "op12_ranked_search": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS t FROM documents),
        i AS (SELECT row_number() OVER () AS i, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
        q AS (SELECT i, item_id, term, count(*) AS qtf FROM (SELECT i, item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM i) GROUP BY ALL),
        s AS (SELECT count(*) AS docs, sum(len(t))::BIGINT AS length FROM d WHERE len(t) > 0),
        p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, docs),
        sc AS (SELECT i, item_id, r, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))))::BIGINT AS score
               FROM p JOIN w ON p.term = w.term JOIN q ON p.term = q.term, s GROUP BY i, item_id, r, doc_id)
        SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM sc WHERE score > 0 QUALIFY rank <= 10""",
    "op13_minhash_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
        g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        pairs AS (SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id
                  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a)
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(reach.b) AS component_id, min(reach.b) = s.doc_id AS kept FROM s JOIN reach ON s.doc_id = reach.a GROUP BY s.doc_id, len(s.s)""",
}
