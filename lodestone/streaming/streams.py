"""Structured Streaming forms of what batch jobs do: deduplication, usage counters, incremental postings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lexical import postings_of
from ..operators.segments import SegmentStore
from ..sources.corpus import keep_first


def first_seen(stream: DataFrame, key: str = "content_hash", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows whose key hasn't been seen within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str = "ts", by: str = "event_type", size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events and their total value by window and kind; windows close once the watermark has passed them."""
    rows = stream.withWatermark(at, late).groupBy(F.window(at, size), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), by, "n", "total")


def append_new(folder: str):
    """For foreachBatch: appends documents (document_id, content, content_hash) whose hash isn't stored, and their postings, under the name of the
    query and the batch's number. A batch that is repeated replaces itself; a query with a new checkpoint has a name of its own, so it
    adds to what earlier ones have stored."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        name = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId') or 'query'}-{number}"
        new = keep_first(batch, ["content_hash"], ["document_id"])
        try:
            old = spark.read.parquet(f"{folder}/documents").filter(F.col("batch") != name)
            new = new.join(old.select("content_hash"), "content_hash", "left_anti")
        except AnalysisException:  # nothing is stored yet
            pass
        new.write.mode("overwrite").parquet(f"{folder}/documents/batch={name}")
        made = spark.read.parquet(f"{folder}/documents/batch={name}")
        postings_of(made).write.mode("overwrite").parquet(f"{folder}/postings/batch={name}")

    return write


def refresh_segments(store: SegmentStore, most: int = 8):
    """For foreachBatch: puts new and changed documents (document_id, content, content_hash) into a segmented index, the last row of an id first, and
    merges small segments. A batch that is repeated finds nothing changed."""

    def write(batch: DataFrame, number: int) -> None:
        order = [F.col("ts").desc_nulls_last()] if "ts" in batch.columns else []
        store.add(keep_first(batch, ["document_id"], [*order, F.col("content_hash")]))
        store.merge(most)

    return write
