"""The registered queries of this package and, where SQL can say the same, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import alignment, chat, exact_dedup, licenses, mixing, ngram_join, packing, prefix_trie, suffix_dedup, superkmers, topk, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select(F.col("mix_doc.doc_id").alias("doc_id"), F.col("mix_doc.source").alias("source"), F.col("mix_copy").cast("int").alias("copy"), F.col("mix_copies").cast("int").alias("copies"), F.round("mix_key", 12).alias("mix_key"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(".txt")))
    return licenses.scan(table(spark, sf_dir, "documents"), path)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.perspectives(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "speaker", "turn", F.col("seq").cast("long").alias("seq"), "role", "name", F.md5("segment").alias("segment_md5"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("train_start").cast("long").alias("train_start"), F.col("train_end").cast("long").alias("train_end"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prefix_trie.numbered(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.with_heads(rows), rows.select("conv_id").distinct())


def op12_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmers.remove_windows(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_suffix_dedup, op3_mixing, op4_topk, op5_warc, op6_packing, op7_licenses, op8_chat, op9_toxicity, op10_exact_dedup, op11_prefix_trie, op12_super_kmers, op13_alignment)}


_NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, [x for x in regexp_split_to_array({_NORMAL}, '[\\x20\\x09-\\x0D]+') if x <> ''] AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS g FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
t AS (SELECT doc_id, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 80 * (a.n + b.n - k)),
d AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT d.v, r.c FROM r JOIN d ON r.doc_id = d.u WHERE r.c < d.v)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY 1, 2
"""

_OP3 = """
WITH sizes AS (SELECT coalesce(source, '') AS source, sum(coalesce(strlen(text), 0)) AS n FROM documents GROUP BY 1),
shares AS (SELECT source, sqrt(n::DOUBLE) / sum(sqrt(n::DOUBLE)) OVER () * sum(n::DOUBLE) OVER () / n::DOUBLE AS rate FROM sizes WHERE n > 0),
ks AS (SELECT source, rate, k FROM shares, LATERAL (SELECT unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT)) AS k)),
cdf AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM ks),
tables AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
drawn AS (
  SELECT doc_id, d.source, len([c for c in cs if c <= u]) AS copies
  FROM (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':17'), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents) d JOIN tables t ON t.source = coalesce(d.source, '')),
many AS (SELECT doc_id, source, copies, unnest(generate_series(1, copies)) AS copy FROM drawn WHERE copies > 0)
SELECT doc_id, source, copy::INTEGER AS copy, copies::INTEGER AS copies,
  round(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || copy || ':18'), 1, 13))::BIGINT / 4503599627370496.0, 12) AS mix_key
FROM many
"""

_OP4 = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([p[1] * p[2] for p in list_zip(q.e, c.e)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 5
"""

_OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS first FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, strlen(p.h) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
"""

_OP8 = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS who, coalesce(text, '') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, who AS speaker FROM t WHERE who <> 'system'),
r AS (SELECT t.conv_id, speaker, turn, who, who = speaker AS own,
    CASE WHEN who = speaker THEN 'assistant' WHEN who = 'system' THEN who ELSE 'user' END AS role,
    CASE WHEN who <> speaker AND who <> 'system' THEN who END AS name, text
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
h AS (SELECT *, '<|im_start|>' || role || CASE WHEN name IS NOT NULL THEN ' name=' || name ELSE '' END || chr(10) AS head FROM r),
g AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM h),
o AS (SELECT *, sum(length(segment)) OVER w AS stop, row_number() OVER w - 1 AS seq FROM g
  WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, who, segment ROWS UNBOUNDED PRECEDING))
SELECT conv_id, speaker, turn, seq, role, name, md5(segment) AS segment_md5, (stop - length(segment))::BIGINT AS start, stop::BIGINT AS "end",
  CASE WHEN own THEN (stop - length(segment) + length(head))::BIGINT END AS train_start, CASE WHEN own THEN stop::BIGINT END AS train_end
FROM o
"""

_OP10 = f"""
WITH t AS (SELECT doc_id, {_NORMAL} AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.x) AS text_sha256 FROM t JOIN g ON t.x = g.x
"""

_OP11 = """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT DISTINCT c, flatten([[ascii(x), 0, 0, 0, 0, 0, 0, 0] for x in string_split(c::VARCHAR, '')]) AS steps FROM t),
crc AS (SELECT c, (xor(list_reduce(list_prepend(4294967295, steps::BIGINT[]), lambda x, y: xor(xor(x, y) >> 1, CASE WHEN xor(x, y) % 2 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 4)::INTEGER AS h FROM bits),
n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
i AS (SELECT crc.c, h, crc.c - crc.c % 20 AS head, least(h, coalesce(n.n, 0)) AS got FROM crc LEFT JOIN n ON n.c = crc.c - crc.c % 20),
r AS (SELECT i.c, t.p, role, text FROM i JOIN t ON t.c = i.head AND t.p <= h UNION ALL SELECT i.c, t.p - h + got, role, text FROM i JOIN t ON t.c = i.c AND t.p > h),
k AS (SELECT role, text, row_number() OVER () AS id, len([x for x in regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+') if x <> '']) AS w FROM (SELECT DISTINCT role, text FROM r)),
s AS (SELECT r.c, list(k.id ORDER BY p) AS ids, list(k.w ORDER BY p) AS ws FROM r JOIN k USING (role, text) GROUP BY r.c),
a AS (SELECT i.c, coalesce(ids, []) AS ids, coalesce(ws, []) AS ws FROM i LEFT JOIN s ON s.c = i.c),
e AS (SELECT c, ids, ws, unnest(range(0, len(ids) + 1)) AS d FROM a),
m AS (SELECT d, ids[1:d] AS p, min(c) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE any_value(ws[d]) END AS w,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(ids) = d), '')) AS ends_sha256 FROM e GROUP BY 1, 2),
ch AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n FROM m WHERE d > 0 GROUP BY 1, 2),
x AS (SELECT m.*, coalesce(ch.n, 0) AS n_children FROM m LEFT JOIN ch ON ch.d = m.d AND ch.p = m.p),
u AS (SELECT unnest(range(0, d + 1)) AS d, p, n_children, (n_convs - 1) * w AS saves FROM x),
v AS (SELECT d, p[1:d] AS p, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saves) AS saved_tokens FROM u GROUP BY 1, 2)
SELECT x.conv_id, x.d AS depth, up.conv_id AS parent_conv_id, x.n_convs, x.n_children, v.n_leaves::BIGINT AS n_leaves, v.saved_tokens::BIGINT AS saved_tokens, x.ends_sha256
FROM x JOIN v ON v.d = x.d AND v.p = x.p LEFT JOIN m up ON up.d = x.d - 1 AND up.p = x.p[1:x.d - 1]
"""

_OP12 = """
WITH w AS (SELECT doc_id, row_number() OVER () AS r, [x for x in regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if x <> ''] AS ws FROM documents),
t AS (SELECT r, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - 11)) AS i FROM w)),
f AS (SELECT g, min(doc_id) AS least FROM t GROUP BY g),
c AS (SELECT DISTINCT r, i + k AS p FROM (SELECT r, i, unnest(range(0, 13)) AS k FROM t JOIN f ON t.g = f.g WHERE t.doc_id > f.least)),
x AS (SELECT r, i, ws[i] AS word FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w)),
k AS (SELECT x.r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM x LEFT JOIN c ON c.r = x.r AND c.p = x.i WHERE c.p IS NULL GROUP BY x.r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.r = w.r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": _OP1, "op3_mixing": _OP3, "op4_topk": _OP4, "op5_warc": _OP5, "op8_chat": _OP8, "op10_exact_dedup": _OP10, "op11_prefix_trie": _OP11, "op12_super_kmers": _OP12}
