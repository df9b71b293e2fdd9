"""One query for each operator of this subpackage, over its whole table and with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import byte_bpe, chat, embedding_join, merkle, packing, quality, repair, sharding
from tidewell.llm import simhash, substring_dedup, token_counts, warc, whitening
from tidewell.sources.dataset import Dataset

QueryFn = Callable[[SparkSession, str], DataFrame]

LLM_QUERIES: dict[str, QueryFn] = {}
LLM_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(dataset)``."""

    def register(fn: Callable[[Dataset], DataFrame]):
        LLM_QUERIES[name] = lambda spark, sf_dir: fn(Dataset(spark, sf_dir))
        if oracle is not None:
            LLM_ORACLES[name] = oracle
        return fn

    return register


@query("op1_byte_bpe")
def op1_byte_bpe(data: Dataset) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode_documents(data.table("documents"), path, public_tokenizers.PATTERN)
    return coded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op2_simhash")
def op2_simhash(data: Dataset) -> DataFrame:
    found = simhash.near_duplicates(data.table("documents"), shingle=3, radius=3)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


@query("op3_token_counts")
def op3_token_counts(data: Dataset) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.count_tokens(data.table("documents"), path, limit=4096).withColumnRenamed("id", "doc_id")


@query("op4_warc")
def op4_warc(data: Dataset) -> DataFrame:
    index = warc.archive_index(data.table("pages"), least_bytes=0)
    first = [F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return index.select(*first, "url_key", "date", "position")


@query("op5_merkle_fingerprint")
def op5_merkle_fingerprint(data: Dataset) -> DataFrame:
    return merkle.fingerprint_edits(data.table("documents")).withColumnRenamed("id", "doc_id")


@query("op6_substring_dedup")
def op6_substring_dedup(data: Dataset) -> DataFrame:
    kept = substring_dedup.remove_repeats(data.table("documents"), window=35)
    digest = F.sha2("kept", 256).alias("kept_sha256")
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", digest)


@query("op7_embedding_join")
def op7_embedding_join(data: Dataset) -> DataFrame:
    return embedding_join.near_vectors(data.table("embeddings"), threshold=0.93).withColumnRenamed("id", "vec_id")


@query("op8_chat_format")
def op8_chat_format(data: Dataset) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = data.table("conversations").select("conv_id", "turn", "role", "text")
    own = data.spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    # turn_template renders each turn by itself
    formatted = chat.format_conversations(rows.unionByName(own), chat.turn_template, segment=chat.SEGMENT)
    return chat.conversation_digests(formatted).withColumnRenamed("id", "conv_id").drop("rewrites")


@query("op9_best_fit_packing")
def op9_best_fit_packing(data: Dataset) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(data.table("documents"), path, 2048, 0).withColumnRenamed("id", "doc_id")


@query("op10_quality_classifier")
def op10_quality_classifier(data: Dataset) -> DataFrame:
    docs = data.table("documents")
    model = quality.train(docs, data.table("labels"), positives=3000, unlabelled=6000)
    return quality.classify(docs, model).withColumnRenamed("id", "doc_id")


# crc32 byte by byte over the hexadecimal form of the text, by the usual table of 256 remainders
OP13_SQL = """
WITH RECURSIVE halves(byte, step, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT byte, step + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END FROM halves WHERE step < 8
),
remainders AS (SELECT list(c ORDER BY byte) AS r FROM halves WHERE step = 8),
sized AS (
  SELECT doc_id, source, coalesce(octet_length(encode(text)), 0) + 16 AS size,
    xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(
        regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(r[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS text_crc32
  FROM documents, remainders
),
drawn AS (
  SELECT *, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (
    PARTITION BY source ORDER BY md5('0:' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size, text_crc32) - 1 AS r
  FROM sized
),
placed AS (
  SELECT *, count(*) OVER () AS total,
    row_number() OVER (ORDER BY (2 * r + 1)::DOUBLE / (2 * n)::DOUBLE, source NULLS FIRST, r) - 1 AS p
  FROM drawn
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, ((p * 40) // total)::INTEGER AS shard,
  (p - (((p * 40) // total) * total + 39) // 40)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""


@query("op13_stratified_shards", oracle=OP13_SQL)
def op13_stratified_shards(data: Dataset) -> DataFrame:
    sharded = sharding.shard_rows(data.table("documents"), shards=40)
    return sharded.withColumnRenamed("id", "doc_id").drop("source")


@query("op11_structure_repair")
def op11_structure_repair(data: Dataset) -> DataFrame:
    return repair.repair_conversations(data.table("conversations"), damaged=True).withColumnRenamed("id", "conv_id")


@query("op12_whitening")
def op12_whitening(data: Dataset) -> DataFrame:
    return whitening.whiten_vectors(data.table("embeddings"), components=8).withColumnRenamed("id", "vec_id")
