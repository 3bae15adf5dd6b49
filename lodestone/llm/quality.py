"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (words and pairs of successive words, in BUCKETS buckets): one of the raw corpus,
counted over all documents, and one of the target, fitted on labelled good documents and shrunk towards the raw one where it
has few counts. A document's importance weight is the ratio of its probabilities under the two. Successive n-grams share words
and all share the models' errors, so a text is weighed as at most EFFECTIVE independent n-grams of its own mix: up to that
length the log weight is the whole log ratio, beyond it EFFECTIVE times the mean one.

The k documents with the largest log weight plus Gumbel noise are a sample of size k without replacement in proportion to the
weights; the others are rejected. Unless it is given, k is the number of documents whose weight is above the cut that
best tells labelled good from labelled bad documents, on labelled rows that the target model has not seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, joined_hashes, mixed, split_words, stored, unused, unused_prefix, with_fields

BUCKETS = 1 << 14
#: At most so many labelled ids (those that hash lowest) fit the target model and set the cut; every fifth sets the cut.
MAX_LABELLED, EVERY = 20_000, 5
#: Independent n-grams that a text counts for at most.
EFFECTIVE = 100
#: What losing a good document counts against keeping a bad one, when the cut is set, and the steps of a weight that it is set in.
GOOD_COUNTS, STEPS = 3.0, 64
SEED = 0x5EED
#: A pair of one word with itself is one and the same n-gram for all words: repetition is a trait of its own.
REPEATED = np.uint64(0x9D3F_51C7_0A6B_E245)


def ngrams(raw: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts' n-grams, text by text, and how many each text has. Words: between ASCII white space, A-Z lower-cased."""
    split = split_words(raw)
    n, h = split.counts, split.hashes()
    pairs = joined_hashes(h, 2)
    pairs[h[1:] == h[:-1]] = REPEATED
    within = np.ones(len(pairs), bool)
    ends = np.cumsum(n)
    within[ends[(ends > 0) & (ends < len(h))] - 1] = False
    text = np.repeat(np.arange(len(n)), n)
    order = np.argsort(np.concatenate([text, text[:-1][within]]) if len(h) else text, kind="stable")
    grams = np.concatenate([mixed(h), pairs[within]])[order]
    return (grams % np.uint64(BUCKETS)).astype(np.int64), n + np.maximum(n - 1, 0)


class Model:
    """Log ratio of every bucket, from the counts of target and raw text. The raw model adds one to each count; the target model's
    prior is BUCKETS n-grams of raw text, so with no target text all ratios are 1."""

    def __init__(self, target: np.ndarray, raw: np.ndarray) -> None:
        of_raw = (raw + 1) / (raw.sum() + BUCKETS)
        self.ratio = np.log((target + BUCKETS * of_raw) / (target.sum() + BUCKETS) / of_raw)

    def log_weights(self, raw: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, and its number of n-grams. A text without words has weight 1, so log weight 0."""
        grams, n = ngrams(raw)
        sums = np.bincount(np.repeat(np.arange(len(n)), n), self.ratio[grams], len(n))
        return sums * np.minimum(n, EFFECTIVE) / np.maximum(n, 1), n


def gumbel(hashes: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Noise that a 64-bit hash of an id always gets again; rows that share an id share it."""
    u = ((mixed(mixed(hashes.astype(np.int64).view(np.uint64)) ^ np.uint64(seed)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return -np.log(-np.log(u))


def labelled_sample(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """At most MAX_LABELLED rows (l_id, l_quality, l_fold), one for an id, fold 0 for the cut; a bound that holds for any table of
    labels. Of an id that is labelled twice the lowest quality counts."""
    h = F.xxhash64(id_col)
    rows = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg(F.min("quality").alias("quality"))
    rows = rows.orderBy(h, id_col).limit(MAX_LABELLED)
    return rows.select(F.col(id_col).alias("l_id"), F.col("quality").cast("int").alias("l_quality"), F.pmod(F.shiftright(h, 7), F.lit(EVERY)).cast("int").alias("l_fold"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Counts n-grams over all documents and over the labelled good ones. Only two counts a bucket reach the driver."""
    bound_batches(docs.sparkSession)
    sample = F.broadcast(labelled_sample(labels, id_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).join(sample, F.col("id") == F.col("l_id"), "left")
    rows = rows.select("t", F.coalesce((F.col("l_quality") == 1) & (F.col("l_fold") != 0), F.lit(False)).alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            grams, n = ngrams(b.column(0))
            good = np.repeat(np.array(b.column(1).to_pylist(), bool), n)
            total[0] += np.bincount(grams, minlength=BUCKETS)
            total[1] += np.bincount(grams[good], minlength=BUCKETS)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0][at]), pa.array(total[1][at])], ["b", "raw", "good"])

    counts = np.zeros((2, BUCKETS), np.float64)
    for r in rows.mapInArrow(run, "b int, raw long, good long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toLocalIterator():
        counts[:, r.b] = r.raw, r.good
    return Model(counts[1], counts[0])


def scored(docs: DataFrame, labels: DataFrame, model: Model, id_col: str, text_col: str, keep: list[str], new: list[str]) -> DataFrame:
    """Stored: docs' columns keep, and the columns new: n_grams, log_weight, key (log weight plus Gumbel noise) and label (quality, for
    labelled rows that set the cut)."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text, noise, l_id, l_quality, l_fold = unused(docs, "t", "noise", "l_id", "l_quality", "l_fold")
    sample = labelled_sample(labels, id_col).toDF(l_id, l_quality, l_fold)
    label = F.when(F.col(l_fold) == 0, F.col(l_quality))
    rows = docs.join(F.broadcast(sample), F.col(id_col) == F.col(l_id), "left")  # at most MAX_LABELLED rows
    rows = rows.select(*keep, label.alias(new[3]), F.xxhash64(id_col).alias(noise), F.col(text_col).cast("string").alias(text))
    kept = [*keep, new[3]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weights, n = shared.value.log_weights(b.column(text))
            keys = weights + gumbel(b.column(noise).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(n), pa.array(weights), pa.array(keys)], [*kept, *new[:3]])

    return stored(rows.mapInArrow(run, with_fields(rows.select(*kept), f"`{new[0]}` long, `{new[1]}` double, `{new[2]}` double")), "quality-keys")


def best_cut(steps: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The weight's step from which on documents count as good: steps in ascending order, and how many good and bad rows are at
    each. Minus infinity if either has none. Between two steps that serve equally it lies midway."""
    if not good.sum() or not bad.sum():
        return -math.inf
    kept = 1 - (np.cumsum(good) - good) / good.sum()
    gone = (np.cumsum(bad) - bad) / bad.sum()
    at = int(np.argmax(GOOD_COUNTS * kept + gone))
    return float(steps[at] if at == 0 else (steps[at] + steps[at - 1] + 1) / 2)


def sample_size(table: DataFrame, weight: str, label: str) -> int | None:
    """How many rows are above the cut; None without labelled rows of both kinds. The driver gets two counts for each step that a
    weight can take: some hundred thousand at most, as a text counts for EFFECTIVE n-grams."""
    step = F.floor(F.col(weight) * STEPS).alias("step")
    told = table.filter(F.col(label).isNotNull()).groupBy(step).agg(F.count_if(F.col(label) == 1).alias("good"), F.count_if(F.col(label) != 1).alias("bad"))
    rows = sorted(told.collect())
    cut = best_cut(*(np.array([r[k] for r in rows], np.float64) for k in range(3)))
    return None if cut == -math.inf else table.filter(F.col(weight) * STEPS >= cut).count()


def kth_largest(values: DataFrame, name: str, k: int) -> float:
    """The k-th largest of a double column, exact to 2**-20, by counting 16 bits of the value at a time: four passes that
    each return at most 65,536 counts."""
    if k <= 0:
        return math.inf
    rows = values.filter(F.col(name).isNotNull()).select(F.floor(F.col(name) * (1 << 20)).cast("long").alias("v"))
    prefix, left = 0, k
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("v", shift)
        near = rows if shift == 48 else rows.filter(F.shiftright("v", shift + 16) == prefix)
        counts = sorted(((r.d, r.n) for r in near.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()), reverse=True)
        for d, n in counts:
            if left <= n:
                prefix = d
                break
            left -= n
        else:
            return -math.inf
    return prefix / (1 << 20)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, prefix: str = "q_", keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or those of keep) with <prefix>n_grams, <prefix>log_weight, <prefix>key and <prefix>kept. One row per input
    row; columns of docs that have one of the new names are replaced. An empty table gives an empty result.

    k is the size of the sample; without it the labels tell. Keys are compared in steps of 2**-20; rows that tie with the k-th
    are all kept. A null text counts as empty; a text without words has log weight 0. With neither k nor labels of both kinds
    nothing is rejected. Rows that share an id are judged each by its own text, with the same noise; so are rows without one.
    """
    new = [prefix + x for x in ("n_grams", "log_weight", "key", "kept")]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    (label,) = unused(docs.select(*keep), f"{prefix}label")
    table = scored(docs, labels, fit(docs, labels, id_col, text_col), id_col, text_col, keep, [*new[:3], label])
    k = sample_size(table, new[1], label) if k is None else k
    least = -math.inf if k is None else kth_largest(table, new[2], k)
    return table.select(*keep, *new[:3], (F.floor(F.col(new[2]) * (1 << 20)) / (1 << 20) >= F.lit(least)).alias(new[3]))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rejected ones, columns as they were; see classify."""
    prefix = unused_prefix(docs, "q_")
    return classify(docs, labels, prefix=prefix).filter(F.col(f"{prefix}kept")).select(*docs.columns)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight, key and whether it is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id"])
    return found.select("doc_id", F.col("q_n_grams").alias("n_grams"), F.col("q_log_weight").alias("log_weight"), F.col("q_key").alias("sample_key"), F.col("q_kept").alias("kept"))
