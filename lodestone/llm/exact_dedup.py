"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

Every input partition makes one run: its distinct digests, with the number of rows and the row that would stay. Runs
then merge in rounds. A round maps run r to r >> bits, so 2**bits runs meet and are merged by digest; what goes up is one
row for each digest and run, however many copies there are. After the last round every digest has one row. The winners
then go down the same tree: a row of one level joins the row of its digest and parent run, so no join key ever has more
than 2**bits rows above the leaves, and at the leaves no more than a partition has.

Equality is verified at each level by the whole triple (SHA-256, 64-bit xxHash, length in bytes), never by one of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty, unused

#: Runs that meet in one round: 2 ** ROUND_BITS.
ROUND_BITS = 4
DIGEST = ["d_sha", "d_xx", "d_len"]


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, row (a unique number), run and the digest triple. Stored, so that numbers and runs
    stay as they are when executors are lost."""
    norm = F.encode(ascii_lower(text_or_empty(text_col)), "UTF-8")
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("t")).select(
        "id",
        F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().alias("run"),
        F.unhex(F.sha2("t", 256)).alias("d_sha"),
        F.xxhash64("t").alias("d_xx"),
        F.octet_length("t").alias("d_len"),
    )
    return stored(rows, "digest-runs")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: id, row, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Ids may be of any type that sorts. Of equal
    texts the row with the largest id stays (keep="min": the smallest); a null id loses to any other; of repeated rows with one id, exactly one
    stays. An empty table gives an empty result; other columns of docs are not read.
    """
    best = {"max": F.max, "min": F.min}[keep]
    rows = digest_runs(docs, id_col, text_col)
    runs = rows.agg(F.max("run")).first()[0] or 0
    # a null id loses in either order: its flag comes first
    first_flag = F.col("id").isNotNull() if keep == "max" else F.col("id").isNull()
    candidate = F.struct(first_flag.alias("f"), "id", "row")
    level = rows.groupBy("run", *DIGEST).agg(F.count("*").alias("n"), best(candidate).alias("best"))
    levels, shift = [level], 0
    while runs >> shift:
        shift += ROUND_BITS
        up = levels[-1].withColumn("run", F.shiftright("run", ROUND_BITS))
        levels.append(up.groupBy("run", *DIGEST).agg(F.sum("n").alias("n"), best("best").alias("best")))
    winners = levels[-1].filter("n > 1").select("run", *DIGEST, F.col("n").alias("size"), F.col("best").alias("win"))

    def down(found: DataFrame, below: DataFrame) -> DataFrame:
        at = below.select(F.col("run").alias("own"), F.shiftright("run", ROUND_BITS).alias("run"), *DIGEST)
        return at.join(found, ["run", *DIGEST]).select(F.col("own").alias("run"), *DIGEST, "size", "win")

    winners = reduce(down, reversed(levels[:-1]), winners)
    return rows.join(winners, ["run", *DIGEST], "left").select(
        "id",
        "row",
        F.when(F.col("win").isNull(), F.col("id")).when(F.col("win.f") == F.lit(keep == "max"), F.col("win.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("win").isNull() | (F.col("win.row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("d_sha")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """docs without the rows that lose to an equal text, all columns as they were (see exact_groups). Ids are expected to
    name rows: of rows that share both id and kept state one stays."""
    lost = exact_groups(docs, id_col, text_col, keep)
    own_id, own_sha, kept_id, kept_sha = unused(docs, "own_id", "own_sha", "kept_id", "kept_sha")
    kept = lost.filter("kept").select(F.col("id").alias(kept_id), F.col("text_sha256").alias(kept_sha))
    sha = F.sha2(F.encode(ascii_lower(text_or_empty(text_col)), "UTF-8"), 256)
    got = docs.withColumns({own_id: F.col(id_col), own_sha: sha}).join(kept, F.col(own_id).eqNullSafe(F.col(kept_id)) & (F.col(own_sha) == F.col(kept_sha)), "left_semi")
    return got.dropDuplicates([own_id, own_sha]).select(*docs.columns)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of documents with the row that stands for its text."""
    found = exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


ORACLE = {
    "op3_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
WINDOW g AS (PARTITION BY text_sha256)"""
}
