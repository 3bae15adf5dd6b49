"""Merging lexical and semantic candidates: min-max scaling of each, weighted sum, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig, normalized_weights
from ..functions import text as T


def min_max(score: Column, window) -> Column:
    """score scaled to 0 to 1 within the window. NaN and infinities count as 0; if all are (nearly) equal, 1 if they are above 0, else 0."""
    inf = float("inf")
    clean = F.when(F.isnan(score) | score.isin(inf, -inf) | score.isNull(), 0.0).otherwise(score)
    low, high = F.min(clean).over(window), F.max(clean).over(window)
    equal = F.abs(high - low) <= F.greatest(1e-9 * F.greatest(F.abs(high), F.abs(low)), F.lit(1e-9))
    return F.when(equal, F.when(high > 0, 1.0).otherwise(0.0)).otherwise((clean - low) / (high - low))


def id_order(document_id: Column) -> list[Column]:
    """Of equal scores, numbers go first and ascend; other ids descend."""
    return [F.asc_nulls_last(document_id.try_cast("bigint")), F.desc(document_id.cast("string"))]


def merge(bm25: DataFrame, semantic: DataFrame, k: int, bm25_weight: float = DEFAULT.bm25_weight, semantic_weight: float = DEFAULT.semantic_weight) -> DataFrame:
    """query_id, document_id, bm25, semantic, score, rank: both candidate lists (query_id, document_id, score) merged. A document that
    one list lacks has 0 there, which counts in that list's scaling. The order is by the unrounded score (to 9 places)."""
    wb, ws = normalized_weights(bm25_weight, semantic_weight)
    left, right = bm25.select("query_id", "document_id", F.col("score").alias("bm25")), semantic.select("query_id", "document_id", F.col("score").alias("semantic"))
    both = left.join(right, ["query_id", "document_id"], "full_outer").na.fill(0.0, ["bm25", "semantic"])
    whole = W.partitionBy("query_id")
    both = both.withColumns({"nb": min_max(F.col("bm25"), whole), "ns": min_max(F.col("semantic"), whole)})
    both = both.withColumn("hybrid", F.round(wb * F.col("nb") + ws * F.col("ns"), 9))
    order = whole.orderBy(F.desc("hybrid"), *id_order(F.col("document_id")))
    rows = both.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
    return rows.select("query_id", "document_id", "bm25", "semantic", F.round("hybrid", 4).alias("score"), "rank")


def merge_hits(bm25_hits: DataFrame, semantic_hits: DataFrame, queries: DataFrame, k: int, bm25_weight: float = DEFAULT.bm25_weight, semantic_weight: float = DEFAULT.semantic_weight) -> DataFrame:
    """Full hits of both kinds merged: title, source and snippet from the lexical hit where there is one (an empty snippet from the
    other), matched terms of both, the snippet highlighted."""
    ranks = merge(bm25_hits, semantic_hits, k, bm25_weight, semantic_weight)
    key = ["query_id", "document_id"]
    fields = ["title", "source", "snippet", "matched_terms"]
    named = lambda hits, p: hits.select(*key, *[F.col(f).alias(p + f) for f in fields])
    rows = ranks.join(named(bm25_hits, "b_"), key, "left").join(named(semantic_hits, "s_"), key, "left").join(queries.select("query_id", "query"), "query_id")
    none = F.array().cast("array<string>")
    terms = F.array_sort(F.array_union(F.coalesce("b_matched_terms", none), F.coalesce("s_matched_terms", none)))
    asked = T.query_terms(F.col("query"))
    return rows.select(
        "query_id",
        "rank",
        "document_id",
        F.coalesce("b_title", "s_title").alias("title"),
        F.coalesce("b_source", "s_source").alias("source"),
        T.highlight(F.coalesce(F.nullif(F.col("b_snippet"), F.lit("")), F.col("s_snippet"), F.lit("")), F.when(F.size(asked) > 0, F.array_distinct(asked)).otherwise(terms)).alias("snippet"),
        "score",
        F.slice(terms, 1, 8).alias("matched_terms"),
    )


def candidate_widths(limit: int, config: EngineConfig = DEFAULT) -> tuple[int, int]:
    """How many lexical and semantic candidates a hybrid page of limit hits is made from."""
    return min(max(limit, config.bm25_candidates), config.hybrid_max_limit), max(limit, config.semantic_candidates)
