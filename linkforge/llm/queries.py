"""One query per operator over its whole table, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.llm import bagminhash, chat, decontam, imatch, langid, mixing, pagediff, secrets, sharding, substring


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "is_copy")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(_table(spark, sf_dir, "documents"))


def op3_pagediff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagediff.extract(_table(spark, sf_dir, "pages"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "depth", "shard")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS v(conv_id, turn, role, text)")
    return chat.digests(chat.format_conversations(turns.unionByName(more)))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bagminhash, op2_mix, op3_pagediff, op4_shards, op5_substring, op6_imatch, op7_decontam, op8_chat, op9_langid, op10_secrets)}


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\e')"
    for k, c in enumerate(chat.CHATML.control):
        out = f"replace({out}, '{c}', '\\c{k}.')"
    return out


_WORDS_SQL = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLE_SQL = {
    "op4_shards": """
WITH k AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 8))::BIGINT AS key
  FROM documents),
d AS (SELECT k.*, r.depth, key // (1::BIGINT << (32 - r.depth)) AS head FROM k CROSS JOIN (SELECT unnest(range(0, 33)) AS depth) r),
s AS (SELECT depth, head, sum(n_bytes) AS bytes FROM d GROUP BY depth, head),
f AS (SELECT d.doc_id, d.n_bytes, d.key, min(d.depth) FILTER (s.bytes <= 1000000) AS depth FROM d JOIN s USING (depth, head) GROUP BY d.doc_id, d.n_bytes, d.key),
c AS (
  SELECT f.*, n_bytes > 500000 AS big,
         CASE WHEN n_bytes > 500000 THEN count(*) OVER w ELSE sum(n_bytes) OVER w // 500000 END AS part
  FROM f JOIN documents USING (doc_id) WHERE depth IS NULL WINDOW w AS (PARTITION BY key, n_bytes > 500000 ORDER BY text, doc_id ROWS UNBOUNDED PRECEDING))
SELECT doc_id, n_bytes, depth::INTEGER AS depth, substr(lpad(bin(key), 32, '0'), 1, depth::INTEGER) AS shard FROM f WHERE depth IS NOT NULL
UNION ALL SELECT doc_id, n_bytes, 32, lpad(bin(key), 32, '0') || CASE WHEN big THEN '+b' ELSE '+s' END || part::BIGINT FROM c
""",
    "op5_substring": f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS pos FROM d WHERE len(w) >= 50),
x AS (SELECT doc_id, pos, sha256(array_to_string(w[pos:pos + 49], ' ')) AS h FROM p),
m AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY h) AS least FROM x),
g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS i FROM m WHERE least < doc_id),
c AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(c.gone), 0)::BIGINT AS n_removed,
             CASE WHEN c.gone IS NULL THEN w ELSE list_filter(w, lambda v, i: NOT list_contains(c.gone, i)) END AS kept
      FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
""",
    "op8_chat": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text), 's?(ua)+') AS valid,
         sum(length('<|im_start|>') + length(replace({_escaped_sql('role')}, chr(10), '\\n')) + 1 + length({_escaped_sql('text')}) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, valid FROM g
""",
}
