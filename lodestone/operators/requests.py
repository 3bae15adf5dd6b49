"""Checks of requests, as columns and over tables of domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DOMAINS, QUERY_CHARS
from ..functions import text as T
from ..functions import urls as U


def checked_query(query: Column) -> Column:
    """A struct query, error: the query with its white space collapsed, or why it isn't one (blank, too_long)."""
    clean = T.collapsed(F.coalesce(query, F.lit("")))
    error = F.when(clean == "", "blank").when(F.length(clean) > QUERY_CHARS, "too_long")
    return F.struct(F.when(error.isNull(), clean).alias("query"), error.alias("error"))


def checked_domains(requests: DataFrame) -> DataFrame:
    """request_id, kind, domains, error of requests (request_id, kind: include or exclude; domains: array): host names in their ASCII form, each once, in order; or too_many,
    or not_a_host. A null array is an empty one; request and kind name a row. Every name is checked in a row of its own."""
    rows = requests.select("request_id", "kind", F.coalesce("domains", F.array().cast("array<string>")).alias("given"))
    names = rows.select("request_id", "kind", F.posexplode("given").alias("at", "name")).withColumn("host", U.host_name("name"))
    found = names.groupBy("request_id", "kind").agg(F.sort_array(F.collect_list(F.struct("at", "host"))).alias("x"), F.count_if(F.col("host").isNull()).alias("wrong"))
    most = F.when(F.col("kind") == "exclude", DOMAINS["exclude"]).otherwise(DOMAINS["include"])
    rows = rows.join(found, ["request_id", "kind"], "left")
    error = F.when(F.size("given") > most, "too_many").when(F.col("wrong") > 0, "not_a_host")
    return rows.select("request_id", "kind", F.when(error.isNull(), F.coalesce(F.array_distinct(F.col("x.host")), F.array().cast("array<string>"))).alias("domains"), error.alias("error"))


#: Where an answer may say what it cost, in this order, and the same inside of what is found there.
CREDIT_NAMES, INNER_NAMES = ("credits_used", "credits", "usage"), ("credits_used", "credits", "api_credits")
#: How deep objects are looked into.
CREDIT_DEPTH = 3
_NUMBERS = r"\A(BIGINT|INT|SMALLINT|TINYINT|FLOAT|DOUBLE|DECIMAL.*)\z"


def reported_credits(body: Column) -> Column:
    """The credits that an answer (a JSON text) reports: the first of the places, all of one depth before those below them, that holds a whole number of at least 0 (no
    text, no truth value); null without one, or where the text is no JSON object."""
    doc = F.try_parse_json(body)
    level = [f"$.{n}" for n in CREDIT_NAMES]
    places = list(level)
    for _ in range(CREDIT_DEPTH - 1):
        level = [f"{p}.{n}" for p in level for n in INNER_NAMES]
        places += level

    def number(place: str) -> Column:
        value = F.try_variant_get(doc, place, "double")
        whole = F.schema_of_variant(F.try_variant_get(doc, place, "variant")).rlike(_NUMBERS) & (value >= 0) & (value < 2.0**63) & (value == F.floor(value).cast("double"))
        return F.when(whole, value.cast("long"))

    return F.coalesce(*map(number, places))
