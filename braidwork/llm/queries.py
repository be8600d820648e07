"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import byte_bpe, chat, exact_dedup, jaccard_join, language_id, mixing, neighbours, packing, quality, repeats, sharding, spelling, whitening
from braidwork.llm.common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_counts(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user'), (-1L, 1L, 'assistant') AS t(conv_id, turn, role)").withColumn("text", F.lit(said))
    events = chat.conversation_events(rows.unionByName(own))
    return chat.digests(chat.format_events(events, chat.SEQUENCE))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"), shards=40).drop("source_key")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("bucket", "chain")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    codec = byte_bpe.Codec(tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    rows = codec.decode(encoded.withColumn("ids_sha256", F.sha2(listed, 256)))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.letter_runs(table(spark, sf_dir, "documents"))
    return spelling.variants(spelling.counted(spelling.with_slips(runs)))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.components(vectors, whitening.fit(vectors))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_neighbours": op2_neighbours,
    "op3_mixing": op3_mixing,
    "op4_chat": op4_chat,
    "op5_language_id": op5_language_id,
    "op6_jaccard": op6_jaccard,
    "op7_repeats": op7_repeats,
    "op8_quality": op8_quality,
    "op9_sharding": op9_sharding,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_spelling": op12_spelling,
    "op13_whitening": op13_whitening,
}

ORACLE_CHAT = """
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + length(text) - length(replace(text, chr(92), '')) + length(text) - length(replace(text, '<', ''))
             + length(text) - length(replace(text, '[', '')) + length(text) - length(replace(text, '>', '')) AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(escaped + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 18 + length(role) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLES = {"op4_chat": ORACLE_CHAT, "op6_jaccard": jaccard_join.ORACLE_LINKED, "op10_exact_dedup": exact_dedup.ORACLE_EXACT}
