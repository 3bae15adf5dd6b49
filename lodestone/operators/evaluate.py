"""Relevance metrics of ranked results against graded judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def metrics(results: DataFrame, judgements: DataFrame, k: int) -> DataFrame:
    """query_id, precision, recall, mrr, ndcg at k for every judged query. results: query_id, document_id, rank; judgements: query_id,
    document_id, grade. Precision divides by k however few results there are; gains are 2**grade - 1; the ideal order is that of all
    judged documents. Queries without a relevant document have 0 throughout. k must be positive."""
    if k < 1:
        raise ValueError("k must be positive")
    grades = judgements.select("query_id", "document_id", "grade")
    hits = results.filter(F.col("rank") <= k).join(grades, ["query_id", "document_id"]).filter("grade > 0")
    gain = lambda rank: (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col(rank) + 1)
    got = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.min("rank").alias("first"), F.sum(gain("rank")).alias("dcg"))
    ideal = grades.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("grade"))))
    ideal = ideal.groupBy("query_id").agg(F.count_if(F.col("grade") > 0).alias("relevant"), F.sum(F.when(F.col("place") <= k, gain("place"))).alias("idcg"))
    rows = ideal.join(got, "query_id", "left").na.fill(0, ["n", "dcg"])
    return rows.select(
        "query_id",
        F.round(F.col("n") / k, 6).alias("precision"),
        F.round(F.when(F.col("relevant") > 0, F.col("n") / F.col("relevant")).otherwise(0.0), 6).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0), 6).alias("ndcg"),
    )


def macro(per_query: DataFrame) -> DataFrame:
    """One row: the mean of each metric over all queries."""
    return per_query.agg(F.count("*").alias("queries"), *[F.round(F.avg(m), 6).alias(m) for m in ("precision", "recall", "mrr", "ndcg")])
