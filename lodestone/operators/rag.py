"""Grounded answers: passages under a budget, prompts, citations, sources."""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import DEFAULT
from ..functions import text as T
from ..functions import urls as U
from ..sources.tables import bound_batches

NOT_ENOUGH = "The indexed sources don't hold enough relevant information."
RULES = "Answer only from the SOURCES. Cite them as [1], [2] after each statement. If they don't answer the question, say so. Name no other sources."


def enough(hits: DataFrame, least: float = DEFAULT.rag_min_score) -> DataFrame:
    """Hits of those queries whose first hit scores at least `least`."""
    top = hits.filter("rank = 1").filter(F.col("score") >= least).select("query_id")
    return hits.join(top, "query_id", "left_semi")


def passages(hits: DataFrame, most: int = DEFAULT.rag_passages, chars: int = DEFAULT.rag_chars) -> DataFrame:
    """query_id, citation_id, document_id, title, source, content, rank, score: the first hits of distinct documents with a text, at most
    `most`, that fit the budget together; the first one stays whatever its length. Highlighting marks go."""
    clean = F.trim(F.replace(F.replace(F.coalesce("snippet", F.lit("")), F.lit("<mark>"), F.lit("")), F.lit("</mark>"), F.lit("")))
    rows = hits.withColumn("content", clean).filter((F.col("content") != "") & (F.col("document_id").cast("string") != ""))
    first = F.row_number().over(W.partitionBy("query_id", "document_id").orderBy("rank"))
    rows = rows.withColumn("__first", first).filter("__first = 1")
    order = W.partitionBy("query_id").orderBy("rank")
    rows = rows.withColumns({"citation_id": F.row_number().over(order).cast("long"), "__chars": F.sum(F.length("content")).over(order.rowsBetween(W.unboundedPreceding, 0))})
    rows = rows.filter((F.col("citation_id") <= most) & ((F.col("citation_id") == 1) | (F.col("__chars") <= chars)))
    return rows.select("query_id", "citation_id", "document_id", "title", "source", "content", "rank", "score")


def prompts(selected: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, system_prompt, prompt: sources in the order of their citation ids, then the question."""
    part = F.concat(F.lit("--- SOURCE ["), F.col("citation_id").cast("string"), F.lit("] ---\nTitle: "), "title", F.lit("\nDocument ID: "), F.col("document_id").cast("string"), F.lit("\nContent: "), "content")
    block = selected.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("citation_id", part.alias("p")))).alias("s"))
    text = F.concat(F.lit("SOURCES:\n"), F.array_join(F.transform("s", lambda x: x["p"]), "\n\n"), F.lit("\n\nUSER QUESTION:\n"), F.col("query"), F.lit("\n\nANSWER:"))
    return block.join(queries.select("query_id", "query"), "query_id").select("query_id", F.lit(RULES).alias("system_prompt"), text.alias("prompt"))


def stub_answer(query: Column) -> Column:
    """What the built-in provider answers: a fixed sentence that cites the first source."""
    return F.concat(F.lit("The sources cover '"), F.coalesce(F.nullif(F.trim(query), F.lit("")), F.lit("your query")), F.lit("' [1]."))


class Provider(Protocol):
    """What answers prompts. It is sent to the executors, so it must pickle; generate() may raise, which fails the prompts that it got."""

    name: str
    model: str

    def generate(self, prompts: list[tuple[str, str]]) -> list[str | None]:
        """An answer for each (system prompt, prompt); None or a blank one is none."""


class StubProvider:
    """The built-in provider: the fixed sentence of stub_answer, from the question that the prompt ends with."""

    name, model = "built-in", "stub"

    def generate(self, prompts: list[tuple[str, str]]) -> list[str | None]:
        questions = [p.rpartition("USER QUESTION:")[2].removesuffix("ANSWER:").strip() for _, p in prompts]
        return [f"The sources cover '{q or 'your query'}' [1]." for q in questions]


#: Prompts that a provider gets at once.
PROMPTS_AT_ONCE = 16


def generate(asked: DataFrame, provider: Provider, tries: int = 2) -> DataFrame:
    """asked (query_id, system_prompt, prompt) with answer, error (null, or provider_error, empty_answer), provider and model. Prompts go to the provider in lots of
    PROMPTS_AT_ONCE on the executors; a lot that fails is tried again, prompt by prompt at last, so that one can't fail the others."""
    kind = asked.schema["query_id"].dataType.simpleString()
    # where an executor is lost its prompts are asked again; what was answered elsewhere isn't
    rows = asked.select("query_id", "system_prompt", "prompt")

    def ask(lot: list[tuple[str, str]]) -> list[tuple[str | None, str | None]]:
        for _ in range(max(1, tries)):
            try:
                found = provider.generate(lot)
                if len(found) == len(lot):
                    return [(t, None) if t and t.strip() else (None, "empty_answer") for t in found]
            except Exception:  # noqa: BLE001  whatever a provider raises is its failure
                continue
        return [(None, "provider_error")] if len(lot) == 1 else [x for one in lot for x in ask([one])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lots = list(zip(b.column("system_prompt").to_pylist(), b.column("prompt").to_pylist(), strict=True))
            found = [x for i in range(0, len(lots), PROMPTS_AT_ONCE) for x in ask(lots[i : i + PROMPTS_AT_ONCE])]
            cells = [b.column("query_id"), pa.array([t for t, _ in found], pa.string()), pa.array([e for _, e in found], pa.string()), pa.array([provider.name] * len(found)), pa.array([provider.model] * len(found))]
            yield pa.RecordBatch.from_arrays(cells, ["query_id", "answer", "error", "provider", "model"])

    return rows.mapInArrow(run, f"query_id {kind}, answer string, error string, provider string, model string")


def cited(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """Citations (query_id, citation_id, ...) that the answers (query_id, answer) name as [n]; if an answer names none that is there, its
    first citation."""
    ids = answers.select("query_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("bigint")))).alias("citation_id"))
    named = citations.join(ids, ["query_id", "citation_id"], "left_semi")
    others = answers.select("query_id").join(named.select("query_id").distinct(), "query_id", "left_anti")
    return named.unionByName(citations.filter("citation_id = 1").join(others, "query_id", "left_semi"))


def validated(answers: DataFrame) -> DataFrame:
    """For live answers (query_id, answer, available: array of ids): query_id, answer without the ids that aren't there and tidied, cited
    (ids in the order of their first naming), error (null, missing_citations or invalid_citations)."""
    found = F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("bigint"))
    cited_ids = F.array_distinct(F.filter(found, lambda x: F.array_contains("available", x)))
    wrong = F.array_except(F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1))), F.transform("available", lambda x: x.cast("string")))
    text = F.aggregate(wrong, F.col("answer"), lambda acc, x: F.replace(acc, F.concat(F.lit("["), x, F.lit("]")), F.lit("")))
    text = F.regexp_replace(F.regexp_replace(T.strip(text), r"[ \t]{2,}", " "), r" *([,.;:!?])", "$1")
    error = F.when(F.size(cited_ids) > 0, F.lit(None)).when(F.size(found) > 0, F.lit("invalid_citations")).otherwise(F.lit("missing_citations"))
    return answers.select("query_id", text.alias("answer"), cited_ids.alias("cited"), error.alias("error"))


def clean_source(text: Column) -> Column:
    """Markup, scripts and control characters out of a source's text, white space collapsed. Entities are resolved first; texts without
    any don't go through Python's tables."""
    c = F.coalesce(text, F.lit(""))
    marked = F.instr(c, "&") > 0
    c = F.when(marked, _unescaped(F.when(marked, c))).otherwise(c)
    c = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    c = F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    return T.collapsed(c)


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unescape(t))


#: Characters of a source's title and content at most, and what the rest of a source counts for.
TITLE_CHARS, CONTENT_CHARS, OVERHEAD = 500, 3000, 80
SOURCE_FIELDS = ("id", "title", "url", "domain", "content")


def prepare_sources(results: DataFrame, most: int = DEFAULT.rag_passages, chars: int = DEFAULT.rag_chars) -> DataFrame:
    """query_id, id, title, url, domain, content: the sources of each query from results (query_id, rank, url, title, content). In the order
    of rank, public ones with a title and a text, each canonical URL once, at most `most`, as far as they fit the budget together;
    the last that begins within it is cut. If their JSON is longer than the budget, sources go from the end until it fits, and the
    one that is then the last is cut by what is over.

    Both cuts follow from running sums: of what each source would take, and of the lengths of their JSON.
    """
    bound_batches(results.sparkSession)
    by_rank = W.partitionBy("query_id").orderBy("rank")
    so_far = by_rank.rowsBetween(W.unboundedPreceding, 0)
    url = F.coalesce("url", F.lit(""))
    rows = results.select("query_id", "rank", url.alias("url"), F.substring(clean_source(F.col("title")), 1, TITLE_CHARS).alias("title"), clean_source(F.col("content")).alias("content"))
    rows = rows.filter((F.col("title") != "") & (F.col("content") != "") & U.is_public(F.col("url")))
    rows = rows.withColumns({"domain": U.host(F.col("url")), "one": F.row_number().over(W.partitionBy("query_id", U.public_form(F.col("url"))).orderBy("rank"))}).filter("one = 1")
    rows = rows.withColumn("id", F.row_number().over(by_rank).cast("long")).filter(F.col("id") <= most)
    around = F.length("title") + F.length("url") + F.length("domain") + OVERHEAD
    full = F.least(F.length("content"), F.lit(CONTENT_CHARS))
    rows = rows.withColumns({"around": around, "full": full}).withColumn("taken", F.sum(F.col("around") + F.col("full")).over(so_far))
    room = F.least("full", chars - (F.col("taken") - F.col("full")))
    rows = rows.withColumn("room", room.cast("int")).filter("room > 0").withColumn("content", F.substring("content", F.lit(1), F.col("room")))
    # brackets, commas and the sources themselves, up to each of them
    json_chars = 1 + F.sum(1 + F.length(F.to_json(F.struct(*SOURCE_FIELDS)))).over(so_far)
    over = F.greatest(json_chars - chars, F.lit(0))
    rows = rows.withColumn("over", over).withColumn("left", F.when(F.col("over") == 0, F.length("content")).otherwise(F.length("content") - F.col("over") - 1).cast("int"))
    last = F.max(F.when(F.col("left") > 0, F.col("id"))).over(W.partitionBy("query_id"))
    rows = rows.withColumn("last", last).filter(F.col("id") <= F.col("last"))
    return rows.withColumn("content", F.when(F.col("id") == F.col("last"), F.substring("content", F.lit(1), F.col("left"))).otherwise(F.col("content"))).select("query_id", *SOURCE_FIELDS)
