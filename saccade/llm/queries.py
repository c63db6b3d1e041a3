"""The opN queries of the text operators and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, fingerprint, language, line_dedup, mixing, near_dup, prefix_trie, quality, substring, tokens, warc, whitening
from .common import read_table

QUERIES: dict = {}
SQL: dict = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_SHINGLES = "CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END"


@_query(
    "op9_near_duplicates",
    f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents)),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM d),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
      FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE 100 * c >= 75 * (na + nb - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, len(s)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY 1) m ON m.a = d.doc_id
""",
)
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"))


@_query(
    "op2_decontamination",
    f"""
WITH d AS (SELECT doc_id, unnest({_SHINGLES}) AS g FROM (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents)),
i AS (SELECT item_id, len(s) AS n, unnest(s) AS g FROM (SELECT item_id, {_SHINGLES} AS s FROM (SELECT item_id, {_LOWER_WORDS} AS w FROM benchmark)))
SELECT doc_id, item_id, count(*)::BIGINT AS shared, any_value(n)::BIGINT AS item_shingles, count(*)::BIGINT / any_value(n)::BIGINT AS containment
FROM d JOIN i USING (g) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 75 * any_value(n)
""",
)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@_query(
    "op5_line_dedup",
    """
WITH d AS (SELECT doc_id, str_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(l) - 2)) AS pos, l FROM d WHERE len(l) >= 3),
k AS (SELECT doc_id, pos, l[pos + 1:pos + 3] AS g FROM w),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) AS n FROM k),
c AS (SELECT DISTINCT doc_id, pos + j AS line FROM f, range(0, 3) t(j) WHERE n > 1),
g AS (SELECT doc_id, list(line) AS gone FROM c GROUP BY doc_id),
r AS (SELECT d.doc_id, l, list_filter(range(0, len(l)), lambda x: gone IS NULL OR NOT list_contains(gone, x)) AS kept FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(l) - len(kept), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_transform(kept, lambda x: l[x + 1]), chr(10))) AS kept_sha256 FROM r
""",
)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@_query(
    "op5_line_dedup_passages",
    f"""
WITH d AS (SELECT doc_id, str_split(text, chr(10)) AS l, list_transform(str_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+'))) AS c FROM documents),
w AS (SELECT doc_id, size, unnest(range(0, len(l) - size + 1)) AS pos, l, c FROM d, range(1, 4) t(size) WHERE len(l) >= size),
k AS (SELECT doc_id, pos, size, l[pos + 1:pos + size] AS g FROM w WHERE size = 3 OR list_sum(c[pos + 1:pos + size]) >= {line_dedup.WORDS}),
f AS (SELECT doc_id, pos, size, row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) AS n FROM k),
c AS (SELECT DISTINCT doc_id, pos + j AS line FROM f, range(0, 3) t(j) WHERE n > 1 AND j < size),
g AS (SELECT doc_id, list(line) AS gone FROM c GROUP BY doc_id),
r AS (SELECT d.doc_id, l, list_filter(range(0, len(l)), lambda x: gone IS NULL OR NOT list_contains(gone, x)) AS kept FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(l) - len(kept), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_transform(kept, lambda x: l[x + 1]), chr(10))) AS kept_sha256 FROM r
""",
)
def op5_line_dedup_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated_lines(read_table(spark, sf_dir, "documents"), words=line_dedup.WORDS)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@_query("op6_mix_sources")
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


@_query("op7_language")
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"))


@_query("op10_fingerprints")
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read_table(spark, sf_dir, "documents"))


_PLANTED = r"\### Assistant: </turn> ok"


@_query(
    "op3_chat_format",
    r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
e AS (SELECT *, len(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>')) + 8
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '###+'), lambda x: len(x) - 2)), 0)
    + CASE WHEN n = 1 OR role IS DISTINCT FROM before THEN len(role) + 11 ELSE 0 END AS size FROM o)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""",
)
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(_PLANTED))
    return chat.digests(chat.format_conversations(turns.union(planted)))


@_query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read_table(spark, sf_dir, "documents"))


@_query(
    "op1_warc_round_trip",
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first, sha1(h) AS x FROM p),
c AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || x[1 + 5 * i:5 + 5 * i])::INTEGER) AS v FROM f)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((v[1 + i // 4] >> (15 - 5 * (i % 4))) & 31)]), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM c
""",
)
def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(spark, read_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query(
    "op4_substring_dedup",
    f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS pos FROM d WHERE len(w) >= 50),
k AS (SELECT doc_id, pos, sha256(array_to_string(w[pos:pos + 49], ' ')) AS g FROM s JOIN d USING (doc_id)),
m AS (SELECT g, min(doc_id) AS first FROM k GROUP BY g),
c AS (SELECT DISTINCT doc_id, pos + j AS place FROM k JOIN m USING (g), range(0, 50) t(j) WHERE first < doc_id),
r AS (SELECT doc_id, list(place) AS gone FROM c GROUP BY doc_id),
x AS (SELECT doc_id, place, w[place] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS place FROM d)),
y AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept FROM x ANTI JOIN c USING (doc_id, place) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN y ON y.doc_id = d.doc_id
""",
)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(read_table(spark, sf_dir, "documents"), digest=True)
    return out.withColumnRenamed("kept", "kept_sha256")


@_query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


@_query("op12_quality")
def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


_CRC_STEP = "CASE WHEN (xor(a, b) & 1) = 1 THEN xor(xor(a, b) >> 1, 3988292384::BIGINT) ELSE xor(a, b) >> 1 END"


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text: bit by bit, each byte followed by seven zeros in the list."""
    bits = f"flatten(list_transform(range(1, len({text}) + 1), lambda i: [ascii(({text})[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda a, b: {_CRC_STEP}), 4294967295::BIGINT)"


@_query(
    "op11_prefix_trie",
    f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), left(coalesce(text, ''), {prefix_trie.HEAD}), md5(coalesce(text, ''))) AS n, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(n) AS len FROM t GROUP BY conv_id),
c AS (SELECT l.conv_id, l.len, l.conv_id - l.conv_id % 5 AS base, {_crc32_sql("l.conv_id::VARCHAR")} % 9 AS h FROM l),
k AS (SELECT c.*, least(h, coalesce(b.len, 0)) AS k FROM c LEFT JOIN l b ON b.conv_id = c.base),
r AS (SELECT k.conv_id, t.n AS d, role, text FROM k JOIN t ON t.conv_id = k.base AND t.n <= h
  UNION ALL SELECT k.conv_id, t.n - h + k.k, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND t.n > h),
s AS (SELECT conv_id, d, octet_length(encode(text)) AS bytes, array_to_string(list(sha256(len(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY d), '') AS path FROM r),
x AS (SELECT conv_id, d, bytes, sha256(path) AS node, CASE WHEN d = 1 THEN 'root' ELSE sha256(left(path, len(path) - 64)) END AS parent FROM s),
v AS (SELECT node, min(conv_id) AS conv_id, any_value(d) AS depth, any_value(parent) AS parent, count(*) AS n_convs, any_value(bytes) AS bytes FROM x GROUP BY node
  UNION ALL SELECT 'root', min(conv_id), 0, NULL, count(*), 0 FROM l HAVING count(*) > 0),
w AS (SELECT parent AS node, count(*) AS n_children FROM v GROUP BY parent),
o AS (SELECT v.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * bytes AS saved FROM v LEFT JOIN w USING (node)),
a AS (SELECT x.node, o.saved, (o.n_children = 0)::BIGINT AS leaf FROM o JOIN x ON x.conv_id = o.conv_id AND x.d <= o.depth UNION ALL SELECT 'root', saved, (n_children = 0)::BIGINT FROM o),
u AS (SELECT node, sum(saved) AS saved, sum(leaf) AS leaves FROM a GROUP BY node),
e AS (SELECT conv_id, coalesce((SELECT arg_max(node, d) FROM x WHERE x.conv_id = l.conv_id), 'root') AS node FROM l),
g AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM e GROUP BY node)
SELECT o.conv_id, o.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, o.n_convs::BIGINT AS n_convs, o.n_children::BIGINT AS n_children, u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM o JOIN u USING (node) LEFT JOIN v p ON p.node = o.parent LEFT JOIN g ON g.node = o.node
""",
)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"))
