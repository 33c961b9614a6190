"""Token files and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrow.llm.balanced import pack_balanced
from siftrow.llm.common import read, work_folder
from siftrow.llm.packing import pack_documents
from siftrow.llm.queries.registry import query
from siftrow.llm.tokens import token_digests, write_tokens

WORD_VOCABULARY, BYTE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    """Path of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "tokens")
    shards = write_tokens(read(spark, sf_dir, "documents"), folder, vocabulary(WORD_VOCABULARY), end_id=1)
    return token_digests(spark, folder, shards)


def packed(docs: DataFrame) -> DataFrame:
    out = pack_documents(docs, vocabulary(BYTE_VOCABULARY), end_id=2)
    return out.select(
        "doc_id", F.col("piece").cast("int").alias("piece"), "start", F.col("size").alias("length"), "ids_crc32", F.col("bin").alias("sequence_id"), "offset"
    )


@query()
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))


@query()
def op11_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_balanced(read(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY), end_id=1)
    return out.select("doc_id", "start", F.col("size").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
