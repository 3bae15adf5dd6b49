"""Search history and usage: an append-only table of events per owner, and counters by month or day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Modes that a history entry may have, and how many days a session lasts.
MODES, SESSION_DAYS = ("web", "ai", "research", "code", "live"), 30


def record(events: DataFrame, *arrival: str) -> DataFrame:
    """events (id, owner, query, mode, created_at) as they are kept: the first of each id, with conflict: whether another event of the id
    says something else, and n: how many events have the id. Events of one time are in the order of the columns arrival, if there are any, then
    of owner, query and mode."""
    said = F.count_distinct(F.struct("owner", "query", "mode"))
    first = F.min(F.struct("created_at", *(F.col(c).alias(f"at{i}") for i, c in enumerate(arrival)), "owner", "query", "mode"))
    rows = events.groupBy("id").agg(first.alias("e"), (said > 1).alias("conflict"), F.count("*").alias("n"))
    return rows.select("id", "e.owner", "e.query", "e.mode", "e.created_at", "conflict", "n")


def page(history: DataFrame, owner, limit: int, offset: int = 0, mode: str | None = None, contains: str | None = None) -> DataFrame:
    """An owner's entries, newest first (then id, descending), on demand of one mode or with a literal text in any case; total: how many
    there are on all pages."""
    rows = history.filter(F.col("owner") == F.lit(owner))
    if mode is not None:
        rows = rows.filter(F.col("mode") == mode)
    if contains is not None:
        rows = rows.filter(F.contains(F.lower("query"), F.lit(contains.lower())))
    total = rows.agg(F.count("*")).scalar()
    return rows.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit).withColumn("total", total)


def pages(history: DataFrame, limit: int) -> DataFrame:
    """The first page of every owner at once: all columns, with rank and total."""
    own = W.partitionBy("owner")
    rows = history.withColumn("rank", F.row_number().over(own.orderBy(F.desc("created_at"), F.desc("id"))).cast("long")).filter(F.col("rank") <= limit)
    return rows.join(history.groupBy("owner").agg(F.count("*").alias("total")), "owner")


def without(history: DataFrame, owner, entry=None) -> DataFrame:
    """history without an owner's entry, or without all of theirs."""
    gone = F.col("owner") == F.lit(owner)
    return history.filter(~F.coalesce(gone if entry is None else gone & (F.col("id") == F.lit(entry)), F.lit(False)))


def day_groups(history: DataFrame, today) -> DataFrame:
    """history with label: Today, Yesterday, Previous 7 Days (future days too), else the date."""
    age = F.date_diff(F.to_date(F.lit(today)), F.to_date("created_at"))
    label = F.when(age == 0, "Today").when(age == 1, "Yesterday").when(age <= 7, "Previous 7 Days").otherwise(F.date_format("created_at", "MMMM d, yyyy"))
    return history.withColumn("label", label)


def valid_sessions(sessions: DataFrame, token_hash: str, now) -> DataFrame:
    return sessions.filter((F.col("token_hash") == token_hash) & (F.col("expires_at") > F.lit(now)))


def new_sessions(tokens: DataFrame, now) -> DataFrame:
    """Sessions (token_hash, expires_at) for tokens (token): what is stored of a token is its SHA-256. Blank tokens and those of over 128
    characters get none; a repeated one gets one."""
    rows = tokens.filter((F.col("token") != "") & (F.length("token") <= 128)).distinct()
    return rows.select(F.sha2("token", 256).alias("token_hash"), (F.lit(now).cast("timestamp") + F.expr(f"INTERVAL {SESSION_DAYS} DAYS")).alias("expires_at"))


def with_session(history: DataFrame, sessions: DataFrame, now) -> DataFrame:
    """history of owners (session hashes) whose session is still valid."""
    return history.join(sessions.filter(F.col("expires_at") > F.lit(now)).select(F.col("token_hash").alias("owner")).distinct(), "owner", "left_semi")


def reserve(ledger: DataFrame, requests: DataFrame, allowance: int, credits: int = 1) -> DataFrame:
    """requests (reservation_id, at) with credits and state: reserved, in the order of at and id as far as their month's allowance goes
    beside what the ledger has spent, else refused."""
    spent = usage(ledger, "month", allowance).select("period", "remaining")
    rows = requests.withColumn("period", F.date_format("at", "yyyy-MM")).join(spent, "period", "left")
    place = F.row_number().over(W.partitionBy("period").orderBy("at", "reservation_id"))
    fits = place * credits <= F.coalesce("remaining", F.lit(allowance))
    return rows.select("reservation_id", "at", F.lit(credits).alias("credits"), F.when(fits, "reserved").otherwise("refused").alias("state"))


def settle(ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """ledger (reservation_id, at, credits, state) after outcomes (reservation_id, credits, succeeded): a reservation becomes a success or a
    failure with what it really cost; others stay. An outcome counts once, and only for what is reserved."""
    once = outcomes.groupBy("reservation_id").agg(F.min_by(F.struct("credits", "succeeded"), F.struct("credits", "succeeded")).alias("o"))
    rows = ledger.join(once, "reservation_id", "left")
    open_ = (F.col("state") == "reserved") & F.col("o").isNotNull()
    state = F.when(open_, F.when(F.col("o.succeeded"), "success").otherwise("failed")).otherwise(F.col("state"))
    return rows.select("reservation_id", "at", F.when(open_, F.col("o.credits")).otherwise(F.col("credits")).alias("credits"), state.alias("state"))


def adopt_ownerless(history: DataFrame, quarantine: str) -> DataFrame:
    """Rows from before owners existed go to a quarantined owner whose session has expired."""
    return history.withColumn("owner", F.coalesce("owner", F.lit(quarantine)))


def usage(ledger: DataFrame, period: str, allowance: int) -> DataFrame:
    """ledger (at, credits, state: reserved, success or failed) by period (month or day): consumed (settled and reserved credits),
    remaining (not below 0), successes, failures, last_success."""
    pattern = {"month": "yyyy-MM", "day": "yyyy-MM-dd"}[period]
    spent = F.coalesce(F.sum(F.when(F.col("state").isin("reserved", "success"), F.col("credits"))), F.lit(0)).cast("long")
    rows = ledger.groupBy(F.date_format("at", pattern).alias("period")).agg(
        spent.alias("consumed"), F.count_if(F.col("state") == "success").alias("successes"), F.count_if(F.col("state") == "failed").alias("failures"), F.max(F.when(F.col("state") == "success", F.col("at"))).alias("last_success")
    )
    return rows.select("period", "consumed", F.greatest(F.lit(0).cast("long"), F.lit(allowance) - F.col("consumed")).alias("remaining"), "successes", "failures", "last_success")


def query_fold(query):
    """Case-folded: lower case, and those characters whose folding is more than that."""
    several = [(chr(c), chr(c).casefold()) for c in range(0x80, 0x1E943) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c).lower()]
    for before, after in several:
        if len(after) > 1:
            query = F.replace(query, F.lit(before), F.lit(after))
    single = [(b, a) for b, a in several if len(a) == 1]
    return F.lower(F.translate(query, "".join(b for b, _ in single), "".join(a for _, a in single)))


def cache_key(query, include, exclude, most):
    """The key under which a live answer is cached: SHA-256 over the folded query, both sorted domain lists and the number of results."""
    return F.sha2(F.concat_ws("\0", query_fold(query), F.array_join(F.array_sort(include), ","), F.array_join(F.array_sort(exclude), ","), most.cast("string")), 256)
