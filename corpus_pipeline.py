"""From raw documents to tokens: five stages, each written as Parquet and read again by the next.

1. ``quality``: documents that the line classifier rejects go.
2. ``near_duplicates``: one document of each group of near copies stays (five-word shingles, Jaccard 0.8).
3. ``repeats``: passages that stand in an earlier document are cut out of the later texts.
4. ``mix``: all rows in the order of the mixed stream of sources.
5. ``tokens``: identifiers, with digests of them and of the text they decode to.

All but the last return the columns of their input.  Nulls, empty texts, repeated rows, empty tables
and extra columns pass as the operators' docstrings say.  The first stage sets the session's rows per Arrow batch to 1,024 where
they are more, since a batch of long texts is held several times at once.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseflow.llm.bpe import encode_documents
from caseflow.llm.chunk_dedup import drop_repeats
from caseflow.llm.common import free_prefix, hide, materialize, may_be_among, new_path, small_batches
from caseflow.llm.line_quality import fit_field, score_documents
from caseflow.llm.mixing import in_mixed_order, mix_sources
from caseflow.llm.shingle_links import shingle_components


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a score of 0.7 or more; nulls, empty and blank texts score 0 and go.  Repeated rows score alike."""
    small_batches(spark)
    field = fit_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    hidden, back = hide(docs, "text")
    return score_documents(hidden, field).where("quality_good").select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without id stay; of rows that repeat the id that stays, the one of the smallest text does."""
    groups, _ = materialize(shingle_components(docs, 5, 80, 100).select("doc_id", "component_id"), "duplicate-groups")
    gone = groups.where("doc_id != component_id").select("doc_id").distinct()
    gone, _ = materialize(gone, "duplicate-ids")
    maybe = may_be_among(F.col("doc_id"), gone)  # other texts are not moved
    kept = docs.where(maybe).join(gone, "doc_id", "left_anti").select(*docs.columns).union(docs.where(~maybe))
    if groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        name = f"{free_prefix(docs.columns)}place"
        place = F.row_number().over(W.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).orderBy("text"))
        kept = kept.withColumn(name, place).where(F.col("doc_id").isNull() | (F.col(name) == 1)).select(*docs.columns)
    return kept


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; texts without what an earlier document, or the same one before, holds.  Rows without id and null texts stay as they are."""
    return drop_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in mixed order, over the partitions; null sources are of the group ``*``."""
    hidden, back = hide(docs, "doc_id", "source")
    return in_mixed_order(mix_sources(hidden), docs.count()).select(*back)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per row, in the same order; nulls and empty texts have no tokens."""
    encoded = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), round_trip=True)
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return encoded.select("doc_id", "n_tokens", digest("token_ids").alias("ids_sha256"), digest("decoded").alias("decoded_sha256"), "token_ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mix", mix), ("tokens", tokens)]
#: A conditional random field is fitted in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
