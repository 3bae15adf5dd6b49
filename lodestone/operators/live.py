"""Live search: requests answered from a cache or by a provider, each distinct one asked once, within an allowance of credits.

A set of requests is taken at once: what the cache holds is joined, of the rest one request of each key goes to the provider on the executors if the
ledger still has credits for it, and all requests of the key share its answer. Answers are kept in a table with the time up to which they count.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..sources.tables import stored
from . import history
from .requests import reported_credits
from .reservations import ReservationLedger

#: What a search costs unless the answer says otherwise, and seconds that an answer counts.
CREDITS, TTL = 1, 300
CACHE = "key string, body string, searched_at timestamp, until timestamp"
RESULTS = "results array<struct<title:string,url:string,content:string,score:double>>"


class SearchProvider(Protocol):
    """What searches the web. It is sent to the executors, so it must pickle; search() gives a JSON text with results, or raises."""

    def search(self, query: str, include: list[str], exclude: list[str], most: int) -> str: ...


class LiveSearch:
    """A cache in a folder, a provider and a ledger of credits."""

    def __init__(self, spark: SparkSession, folder: str, provider: SearchProvider, ledger: ReservationLedger, ttl: int = TTL) -> None:
        self.spark, self.folder, self.provider, self.ledger, self.ttl = spark, folder.rstrip("/"), provider, ledger, ttl

    def _cached(self) -> DataFrame:
        try:
            return self.spark.read.schema(CACHE).parquet(f"{self.folder}/cache")
        except AnalysisException:
            return self.spark.createDataFrame([], CACHE)

    def _asked(self, rows: DataFrame) -> DataFrame:
        """rows (key, query, include, exclude, most) with body, null where the provider failed; stored, so that nothing is asked twice because a plan runs twice."""
        provider = self.provider

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bodies = []
                for query, include, exclude, most in zip(*(b.column(c).to_pylist() for c in ("query", "include", "exclude", "most")), strict=True):
                    try:
                        bodies.append(provider.search(query, include, exclude, most))
                    except Exception:  # noqa: BLE001  whatever a provider raises is its failure
                        bodies.append(None)
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("at"), b.column("reservation_id"), pa.array(bodies, pa.string())], ["key", "at", "reservation_id", "body"])

        return stored(rows.mapInArrow(run, "key string, at timestamp, reservation_id string, body string"), "live-answers")

    def search(self, requests: DataFrame) -> DataFrame:
        """requests (request_id, query, include, exclude, most, at) with key, status (ok, budget_exceeded or provider_error), cached and body.

        Of the requests of one key the first (by time, then id) is asked; null lists are empty and a null number is 5. An answer that was cached counts for requests
        before its end. A search that fails costs a credit and isn't cached. Requests without a query fail as the provider does.
        """
        none = F.array().cast("array<string>")
        rows = requests.select("request_id", T.collapsed(F.coalesce("query", F.lit(""))).alias("query"), F.coalesce("include", none).alias("include"), F.coalesce("exclude", none).alias("exclude"), F.coalesce("most", F.lit(5)).cast("int").alias("most"), "at")
        rows = stored(rows.withColumn("key", history.cache_key(F.col("query"), F.col("include"), F.col("exclude"), F.col("most"))), "live-requests")
        held = rows.select("request_id", "key", "at").join(self._cached(), "key").filter("searched_at <= at AND at < until")
        held = stored(held.groupBy("request_id").agg(F.max_by("body", "searched_at").alias("held")), "live-hits")
        missed = rows.join(held, "request_id", "left_anti")
        first = F.row_number().over(W.partitionBy("key").orderBy("at", "request_id"))
        flights = missed.withColumn("nth", first).filter("nth = 1").drop("nth", "request_id")
        # a flight's name follows from what is asked and when, so asking the ledger again takes nothing more
        flights = stored(flights.withColumn("reservation_id", F.concat_ws("@", "key", F.unix_micros("at"))), "live-flights")
        states = self.ledger.reserve(flights.select("reservation_id", "at"), CREDITS).select("reservation_id", "state")
        flights = flights.join(states, "reservation_id")
        answers = self._asked(flights.filter("state = 'reserved'").select("key", "at", "reservation_id", "query", "include", "exclude", "most"))
        good = F.col("body").isNotNull()
        self.ledger.settle(answers.select("reservation_id", F.coalesce(F.when(good, reported_credits(F.col("body"))), F.lit(CREDITS)).alias("credits"), good.alias("succeeded")))
        kept = answers.filter(good).select("key", "body", F.col("at").alias("searched_at"), F.expr(f"at + INTERVAL {self.ttl} SECONDS").alias("until"))
        kept.write.mode("append").parquet(f"{self.folder}/cache")
        found = rows.join(held, "request_id", "left").join(answers.select("key", "body", F.lit(True).alias("asked")), "key", "left")
        cached = F.col("held").isNotNull()
        status = F.when(cached | F.col("body").isNotNull(), "ok").when(F.col("asked"), "provider_error").otherwise("budget_exceeded")
        return found.select("request_id", "query", "key", status.alias("status"), cached.alias("cached"), F.coalesce("held", "body").alias("body"))

    def evict(self, now) -> int:
        """Rewrites the cache without answers whose time is over: how many are left."""
        left = stored(self._cached().filter(F.col("until") > F.lit(now)), f"live-cache-{uuid.uuid4().hex[:8]}")
        left.write.mode("overwrite").parquet(f"{self.folder}/cache")
        return left.count()


def results(found: DataFrame) -> DataFrame:
    """request_id, rank, title, url, domain, snippet, score: what the answers (see LiveSearch.search) hold, public URLs with a title only, in the answers' order."""
    rows = found.filter("body IS NOT NULL").select("request_id", F.posexplode(F.from_json("body", RESULTS)["results"]).alias("at", "r"))
    rows = rows.select("request_id", "at", F.trim("r.title").alias("title"), F.col("r.url").alias("url"), F.coalesce("r.content", F.lit("")).alias("snippet"), F.col("r.score").alias("score"))
    rows = rows.filter((F.coalesce("title", F.lit("")) != "") & F.coalesce(U.is_public(F.col("url")), F.lit(False)))
    rank = F.row_number().over(W.partitionBy("request_id").orderBy("at")).cast("long")
    return rows.select("request_id", rank.alias("rank"), "title", "url", U.host(F.col("url")).alias("domain"), "snippet", "score")
