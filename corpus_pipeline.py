"""The corpus pipeline: what documents keeps after quality, copies and benchmark passages, as token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; the last adds token_ids. Rejected documents go: by the quality
classifier, then all but one of equal texts (the largest doc_id stays), then all but one of each component of near copies
(the smallest stays), then those with a window of the benchmark.

run() deletes what a stage stored on its way, and what the stage before it returned, once the stage's result is written. A stage
that is called by itself leaves its stored tables until the application ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.byte_bpe import encode_documents
from lodestone.llm.common import begun, drop_tables, stored
from lodestone.llm.decontaminate import decontaminate
from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.jaccard_join import dedup_near
from lodestone.llm.quality import keep_good


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects. A null text counts as empty; labels may cover few documents or none (then all stay). Repeated rows are judged
    alike; an empty table stays empty."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for A-Z and a-z, nulls being empty ones, the row with the largest doc_id stays; of repeated rows one."""
    return exact_dedup(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest doc_id stays; of repeated rows one. Texts without words all stay."""
    return dedup_near(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window of the benchmark. A null or empty text has none; a null or empty item has no window."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token_ids. A null or empty text has none; repeated rows are encoded each."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("encode", encode_stage),
]

#: The first stage has no SQL, so the whole has none; tests/llm hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on sf_dir's documents, each written to the shared folder and read again. The last result's files go when the
    application ends."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with begun() as tables:
            step = stage(spark, docs, sf_dir)
        with begun() as written:
            docs = stored(step, f"pipeline-{name}")
        drop_tables(spark, [*tables, *before])
        before = written
    return docs
