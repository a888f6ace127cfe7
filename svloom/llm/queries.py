"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svloom.llm import chat, decontamination, line_dedup, quality, sharding, simhash, substring_dedup, token_counts, token_files, tokenizing
from svloom.llm.common import P, documents, saved, shared_dir, table, whole_text

SHARDS = 40


def tokenizer(name: str) -> str:
    """A public tokenizer's file: in SVLOOM_TOKENIZERS, or in the public_tokenizers package."""
    if folder := os.environ.get("SVLOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", (F.octet_length(whole_text()) + 16).cast("long").alias("size"), F.crc32(whole_text().cast("binary")).alias("text_crc32"))
    placed = sharding.shard(docs, SHARDS, ties=("size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    rows = saved(quality.measured(docs, quality.build_model(docs)).drop("text", "lang"), "quality")
    named = quality.judged(rows, saved(quality.bands(rows), "bands"))
    columns = [x.split()[0] for x in quality.MEASURES.split(", ")]
    return named.select("doc_id", *[F.col(P + c).alias(c) for c in [*columns[:5], "base_failed", "kept", columns[5]]])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_digits("fingerprint").alias("fingerprint"), "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", F.col(f"{P}lines").alias("n_lines"), F.col(f"{P}went").alias("n_removed"), F.md5("text").alias("kept_md5"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(documents(spark, sf_dir))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizing.encode_digests(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), shared_dir(spark, "token-counts"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.conversation_digests(chat.format_turns(rows))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_dir(spark, "token-ids")
    parts = token_files.write_ids(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), 1, root)
    return token_files.read_digests(spark, root, parts)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_quality, op3_decontamination, op4_simhash, op5_line_dedup, op6_substring_dedup, op7_bpe, op8_token_counts, op9_chat, op10_token_files)}


#: Words per line, prefixes by document frequency, Jaccard of 0.8: the set-similarity join in SQL.
LINE_DEDUP_SQL = r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM split),
t AS (SELECT DISTINCT doc_id, pos, w FROM (SELECT doc_id, pos, unnest(regexp_extract_all(line, '[^\x09-\x0D ]+')) AS w FROM l) u),
df AS (SELECT w, count(*) AS d FROM t GROUP BY w),
r AS (SELECT t.doc_id, t.pos, t.w, row_number() OVER (PARTITION BY t.doc_id, t.pos ORDER BY df.d, t.w) AS i, count(*) OVER (PARTITION BY t.doc_id, t.pos) AS n FROM t JOIN df ON t.w = df.w),
p AS (SELECT * FROM r WHERE i <= n - ((80 * n + 99) // 100) + 1),
c AS (SELECT DISTINCT a.doc_id AS da, a.pos AS pa, a.n AS na, b.doc_id AS db, b.pos AS pb, b.n AS nb FROM p a JOIN p b ON a.w = b.w
      WHERE (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.pos < a.pos)) AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
s AS (SELECT c.da, c.pa, c.na, c.nb, c.db, c.pb, count(*) AS shared FROM c JOIN t x ON x.doc_id = c.da AND x.pos = c.pa JOIN t y ON y.doc_id = c.db AND y.pos = c.pb AND y.w = x.w GROUP BY ALL),
gone AS (SELECT DISTINCT da AS doc_id, pa AS pos FROM s WHERE 100 * shared >= 80 * (na + nb - shared)),
k AS (SELECT l.doc_id, l.pos, l.line, g.pos IS NOT NULL AS went FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE went) AS n_removed, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT went), '')) AS kept_md5
FROM k GROUP BY doc_id
"""


#: A turn's text is escaped where it wouldn't be read back as it is; 15 characters stand around role and text.
CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, CASE WHEN contains(text, '\###') OR contains(text, '\</turn>') OR strpos(chr(10) || text || chr(10) || '</turn>' || chr(10), chr(10) || '</turn>' || chr(10)) < length(text) + 2
    THEN regexp_replace(text, '(\\*)(###|</turn>)', '\\\1\2', 'g') ELSE text END AS body FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(length(role) + length(body) + 15)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": LINE_DEDUP_SQL, "op9_chat": CHAT_SQL}
