"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import oracles
from caseflow.llm.bpe import encode_documents
from caseflow.llm.chunk_dedup import op10_repeated_spans
from caseflow.llm.common import table
from caseflow.llm.licenses import op5_license_scan
from caseflow.llm.line_quality import op4_line_quality
from caseflow.llm.mixing import op1_mix_sources, op1_sql
from caseflow.llm.piece_counts import count_tokens
from caseflow.llm.shingle_links import op7_shingle_components
from caseflow.llm.token_files import op9_token_files as token_files_op9
from caseflow.llm.vector_links import op8_near_vectors
from caseflow.llm.vector_search import op6_exact_top_k

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's tokens and of the text they decode to."""
    tokens = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), round_trip=True)
    return tokens.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and checksums of every document's tokens, read back from packed files."""
    return token_files_op9(spark, sf_dir, public_tokenizers.path(BYTE_BPE))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_token_counts": op3_token_counts,
    "op4_line_quality": op4_line_quality,
    "op5_license_scan": op5_license_scan,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_shingle_components": op7_shingle_components,
    "op8_near_vectors": op8_near_vectors,
    "op9_token_files": op9_token_files,
    "op10_repeated_spans": op10_repeated_spans,
}
ORACLE_SQL = {
    "op1_mix_sources": op1_sql(),
    "op5_license_scan": oracles.licenses(),
    "op6_exact_top_k": oracles.TOP_K,
    "op7_shingle_components": oracles.SHINGLES,
    "op8_near_vectors": oracles.NEAR_VECTORS,
}
