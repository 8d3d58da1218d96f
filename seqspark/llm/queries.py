"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.llm import audio, byte_bpe, chat_format, embed_dups, html_text, jaccard, language_id, mixing, prefix_trie, quality, resampling, token_counts, toxicity
from seqspark.llm.common import Scratch, table

#: A conversation whose texts hold the marks of chat templates.
TRAP = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op1_embed_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dups.near_dups(table(spark, sf_dir, "embeddings"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.classify(table(spark, sf_dir, "documents"), trusted)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # constants in the plan: a list of rows would be an RDD of Python rows
    trap = spark.range(1).select(F.inline(F.array(*(F.struct(*map(F.lit, row)) for row in TRAP)))).toDF(*turns.columns)
    return chat_format.digests(chat_format.format_chats(turns.union(trap)))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), Scratch(spark)).drop("times")


def op8_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audio.media(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "n_frames"
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.classify(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>') AS safe,
         replace(replace(replace(replace(role, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>'), ':', '\c') AS safe_role FROM t
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS lost,
         sum(length(safe) + length(safe_role) + 14) AS formatted_chars,
         string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text) AS roles
  FROM e GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(told) AS turns_sha256, CAST(length(lost) AS BIGINT) AS loss_chars, sha256(lost) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars, regexp_full_match(roles, 's?(ua)+') AS valid
FROM g
"""




def _crc_table() -> str:
    """crc(tab): the register that each byte gives, by eight steps of one bit."""
    step = "SELECT k, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM "
    rows = "(SELECT k, k AS v FROM range(256) r(k))"
    for _ in range(8):
        rows = f"({step}{rows})"
    return f"crc AS MATERIALIZED (SELECT list(v ORDER BY k) AS tab FROM {rows})"


#: crc32 in SQL of a list of byte values, by that table.
CRC = "xor(list_reduce({0}, lambda s, b: xor(tab[(xor(s, b) & 255) + 1], s >> 8), 4294967295), 4294967295)"

OP12_SQL = f"""
WITH RECURSIVE {_crc_table()},
own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
        sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, {CRC.format("list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")} % 9 AS h FROM (SELECT DISTINCT c FROM own), crc),
rebuilt AS (SELECT v.c, o.role, o.text, row_number() OVER (PARTITION BY v.c ORDER BY o.c <> v.c - v.c % 5 OR o.k > h, o.k) AS d FROM convs v JOIN own o ON o.c = v.c AND o.k > h OR o.c = v.c - v.c % 5 AND o.k <= h),
told AS (SELECT c, d, octet_length(encode(text)) AS bytes, sha256(string_agg(octet_length(encode(role)) || ':' || role || octet_length(encode(text)) || ':' || text, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS digest FROM rebuilt),
prefixes AS (SELECT c, d, digest, bytes, lag(digest, 1, '') OVER (PARTITION BY c ORDER BY d) AS parent FROM told UNION ALL SELECT c, 0, '', 0, NULL FROM convs),
long AS (SELECT c, max(d) AS n FROM prefixes GROUP BY c),
nodes AS (SELECT p.d, digest, any_value(parent) AS parent, any_value(bytes) AS bytes, min(p.c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (WHERE p.d = n), '')) AS ends_sha256
  FROM prefixes p JOIN long USING (c) GROUP BY p.d, digest),
children AS (SELECT parent AS digest, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY parent),
worth AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * bytes AS own_saved FROM nodes LEFT JOIN children USING (digest)),
up AS (SELECT digest, parent, CASE n_children WHEN 0 THEN 1 ELSE 0 END AS leaf, own_saved FROM worth UNION ALL SELECT n.digest, n.parent, u.leaf, u.own_saved FROM up u JOIN nodes n ON n.digest = u.parent),
sums AS (SELECT digest, sum(leaf) AS n_leaves, sum(own_saved) AS saved_tokens FROM up GROUP BY digest)
SELECT CAST(w.conv_id AS BIGINT) AS conv_id, CAST(w.d AS BIGINT) AS depth, CAST(p.conv_id AS BIGINT) AS parent_conv_id, CAST(w.n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM worth w JOIN sums USING (digest) LEFT JOIN nodes p ON p.digest = w.parent
"""

OP13_SQL = f"""
WITH {_crc_table()},
hex AS MATERIALIZED (SELECT map_from_entries(list((printf('%02X', k), CAST(k AS BIGINT)))) AS m FROM range(256) r(k)),
texts AS (SELECT 0 AS t, doc_id AS id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
split AS (SELECT row_number() OVER () AS r, t, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
each AS (SELECT r, t, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS f FROM split, range(1, 4) x(n)),
per AS (SELECT r, t, f, count(*) AS n FROM each GROUP BY r, t, f),
names AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM per)),
hashed AS MATERIALIZED (SELECT f, {CRC.format("list_transform(range(0, length(x) // 2), lambda k: m[substr(x, 2 * k + 1, 2)])")} % 10000 AS b FROM names, crc, hex),
held AS (SELECT b, sum(n) FILTER (WHERE t = 0) AS s, sum(n) FILTER (WHERE t = 1) AS t FROM per JOIN hashed USING (f) GROUP BY b),
total AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM held),
gain AS (SELECT b, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(ss + 10000 AS DOUBLE) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(tt + 10000 AS DOUBLE)))) AS BIGINT) AS g FROM held, total),
weights AS (SELECT r, sum(n * g) AS weight, sum(n) AS n_features FROM per JOIN hashed USING (f) JOIN gain USING (b) WHERE t = 0 GROUP BY r),
scored AS (SELECT id AS doc_id, len(w) AS words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) AS BIGINT)
    + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('42:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM split LEFT JOIN weights USING (r) WHERE t = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) OVER (PARTITION BY words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN words >= 20 AND k <= 5 * n // 100 THEN k END AS BIGINT) AS rank FROM ranked
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": OP4_SQL, "op12_prefix_trie": OP12_SQL, "op13_resampling": OP13_SQL}
