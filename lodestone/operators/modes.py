"""Search modes: what each does, and the steps on hits (query_id, rank, document_id, title, source, snippet, score, ...)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as T
from ..functions.urls import source_host
from ..sources.tables import stored
from .lexical import asked_terms, with_lines

#: What makes a source look like documentation.
PATH_HINTS = "/docs/ /doc/ /documentation/ /reference/ /guide/ /guides/ /dev/ /developer/ /manual/ /wiki/ /tutorial/ /learn/".split()
NAME_HINTS = "readme docs doc/ documentation reference guide manual handbook tutorial howto how-to cheatsheet faq changelog example cookbook api/ /api wiki".split()
SOURCE_ENDINGS = ".md .mdx .rst .txt .adoc .py .js .mjs .ts .tsx .jsx .go .rs .java .c .h .cpp .hpp .cs .rb .php .sh .sql .yaml .yml .toml .ini .json .html".split()
TITLE_HINTS = ("documentation", "reference", "guide", "tutorial", "readme", "manual", "api reference", "changelog", "cookbook", "cheatsheet")
#: Words that are technical by themselves.
TECHNICAL = (
    "api apis async await bool cdk cli cls const cpp css db def dict dns enum false fn func go html http https impl import int io java "
    "js json lambda let list ml none null orm os package py python react rest return rpc sdk sql str struct tcp toml ts tuple ui url var "
    "xml yaml yml"
).split()
#: Modes by name, and those that only rank.
SPECIAL, LEGACY = ("web", "ai", "research", "code"), ("lexical", "bm25", "semantic", "hybrid")
LABELS = {"web": "Web Search", "ai": "AI Answers", "research": "Research", "code": "Code Docs"}


@dataclass(frozen=True)
class ModeSpec:
    mode: str
    label: str
    default_limit: int
    candidate_multiplier: int = 1
    rag: bool = False
    weights: tuple[float, float] | None = None
    host_cap: int | None = None
    snippet_words: int | None = None
    code: bool = False

    def candidates(self, limit: int, config: EngineConfig = DEFAULT) -> int:
        return max(1, min(max(1, limit) * max(1, self.candidate_multiplier), config.max_candidates))


def mode_name(raw: str | None) -> str:
    """The mode meant, in any case; bm25 is lexical. Others are an error that lists the modes."""
    name = str(raw or "").strip().lower()
    if name not in (*LEGACY, *SPECIAL):
        raise ValueError(f"invalid search mode {raw!r}; modes: {', '.join((*LEGACY, *SPECIAL))}")
    return "lexical" if name == "bm25" else name


def mode_spec(raw: str, config: EngineConfig = DEFAULT) -> ModeSpec:
    name = mode_name(raw)
    specs = {
        "web": ModeSpec("web", LABELS["web"], config.web_limit),
        "ai": ModeSpec("ai", LABELS["ai"], config.ai_limit, rag=True),
        "research": ModeSpec("research", LABELS["research"], config.research_limit, config.research_multiplier, True, host_cap=config.research_host_cap, snippet_words=config.research_words),
        "code": ModeSpec("code", LABELS["code"], config.code_limit, config.code_multiplier, weights=(config.code_bm25_weight, config.code_semantic_weight), snippet_words=config.code_words, code=True),
    }
    if name not in specs:
        raise ValueError(f"{name} ranks only; special modes: {', '.join(SPECIAL)}")
    return specs[name]


def mode_catalog(spark: SparkSession, config: EngineConfig = DEFAULT) -> DataFrame:
    """One row a special mode."""
    rows = [(s.mode, s.label, s.default_limit, config.max_limit, s.candidate_multiplier, s.rag, s.host_cap or 0, s.snippet_words or 0, s.code) for s in (mode_spec(m, config) for m in SPECIAL)]
    return spark.createDataFrame(rows, "mode string, label string, default_limit int, max_limit int, candidate_multiplier int, ai_answer boolean, host_cap int, snippet_words int, code_snippets boolean")


def _reranked(hits: DataFrame, *order: Column) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)).cast("long"))


def drop_unmatched(hits: DataFrame, floor: float = DEFAULT.match_floor) -> DataFrame:
    """Hits that score above the floor, ranked anew."""
    return _reranked(hits.filter(F.col("score") > floor), F.col("rank"))


def diversify(hits: DataFrame, cap: int, limit: int | None = None) -> DataFrame:
    """Each document once and each host's first cap hits (0: all), ranked anew and cut to limit. Files have no host and are never
    capped; hits without an id are never duplicates."""
    by_doc = W.partitionBy("query_id", "document_id").orderBy("rank")
    hits = hits.withColumn("__host", source_host(F.coalesce("source", F.lit(""))))
    hits = hits.withColumn("__first", F.row_number().over(by_doc)).filter((F.col("__first") == 1) | (F.coalesce(F.col("document_id").cast("string"), F.lit("")) == ""))
    if cap > 0:
        hits = hits.withColumn("__k", F.row_number().over(W.partitionBy("query_id", "__host").orderBy("rank"))).filter((F.col("__host") == "") | (F.col("__k") <= cap)).drop("__k")
    out = _reranked(hits.drop("__first", "__host"), F.col("rank"))
    return out if limit is None else out.filter(F.col("rank") <= limit)


def diversify_stats(hits: DataFrame, cap: int) -> DataFrame:
    """query_id, considered, returned, duplicates_removed, host_capped, distinct_sources: what diversify() without a limit does. A hit whose
    document was returned before is a duplicate; one whose host had its share is capped, and so are its document's other hits."""
    host = F.nullif(source_host(F.coalesce("source", F.lit(""))), F.lit(""))
    named = F.coalesce(F.col("document_id").cast("string"), F.lit("")) != ""
    by_doc = W.partitionBy("query_id", "document_id").orderBy("rank")
    rows = hits.withColumns({"__host": host, "__first": ~named | (F.row_number().over(by_doc) == 1)})
    rows = rows.withColumn("__k", F.sum(F.col("__first").cast("int")).over(W.partitionBy("query_id", "__host").orderBy("rank")))
    fits = F.col("__host").isNull() | (F.lit(cap) <= 0) | (F.col("__k") <= cap)
    rows = rows.withColumn("__kept", F.col("__first") & fits)
    again = ~F.col("__first") & F.max("__kept").over(W.partitionBy("query_id", "document_id"))
    rows = rows.withColumn("__again", again)
    return rows.groupBy("query_id").agg(
        F.count("*").alias("considered"),
        F.count_if("__kept").alias("returned"),
        F.count_if("__again").alias("duplicates_removed"),
        F.count_if(~F.col("__kept") & ~F.col("__again")).alias("host_capped"),
        F.count_distinct(F.when(F.col("__kept"), F.coalesce("__host", F.concat(F.lit("doc:"), F.col("document_id").cast("string"))))).alias("distinct_sources"),
    )


def documentation_stats(hits: DataFrame) -> DataFrame:
    """query_id, documentation_hits, other_hits, promoted: what documentation_first() puts in front."""
    like = is_documentation(F.col("source"), F.col("title"))
    rows = hits.groupBy("query_id").agg(F.count_if(like).alias("documentation_hits"), F.count_if(~like).alias("other_hits"))
    return rows.withColumn("promoted", F.col("documentation_hits"))


def _any(c: Column, hints) -> Column:
    out = F.lit(False)
    for h in hints:
        out = out | F.contains(c, F.lit(h))
    return out


def is_documentation(source: Column, title: Column) -> Column:
    src, ttl = F.lower(F.trim(F.coalesce(source, F.lit("")))), F.lower(F.trim(F.coalesce(title, F.lit(""))))
    ends = F.lit(False)
    for e in SOURCE_ENDINGS:
        ends = ends | F.endswith(src, F.lit(e))
    return _any(src, PATH_HINTS) | _any(F.substring_index(src, "/", -1), NAME_HINTS) | ends | _any(ttl, TITLE_HINTS)


def documentation_first(hits: DataFrame) -> DataFrame:
    """Hits that look like documentation before the others, each in their order; nothing goes."""
    return _reranked(hits, F.when(is_documentation(F.col("source"), F.col("title")), 0).otherwise(1), F.col("rank"))


def truncate(hits: DataFrame, limit: int) -> DataFrame:
    return _reranked(hits, F.col("rank")).filter(F.col("rank") <= limit)


def with_contents(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """hits, which should be stored, with __content. Only contents of their documents are joined."""
    found = docs.join(hits.select("document_id").distinct(), "document_id", "left_semi")
    return hits.join(found.select("document_id", F.col("content").alias("__content")), "document_id", "left")


def enrich_snippets(hits: DataFrame, docs: DataFrame, queries: DataFrame, words: int) -> DataFrame:
    """Wider snippets from the documents; where that gives none, the old one stays."""
    hits = stored(hits, "hits")
    asked = stored(hits.select("query_id", "document_id", "rank").join(asked_terms(queries), "query_id"), "hits-terms")
    rows = with_lines(asked, docs)
    rows = T.with_snippet(rows, "lines", "terms", words, "wide").select("query_id", "document_id", "rank", F.nullif("wide", F.lit("")).alias("wide"))
    return hits.join(rows, ["query_id", "document_id", "rank"], "left").withColumn("snippet", F.coalesce("wide", "snippet")).drop("wide")


def enrich_stats(hits: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """query_id, enriched (hits whose document gives a snippet) and words, of what enrich_snippets does: any text that isn't blank gives one.
    Only that flag of a document is joined, not its content."""
    has = docs.select("document_id", (T.strip(F.coalesce("content", F.lit(""))) != "").alias("__has"))
    rows = hits.join(has, "document_id", "left")
    return rows.groupBy("query_id").agg(F.count_if("__has").alias("enriched")).withColumn("words", F.lit(words))


def code_stats(hits: DataFrame) -> DataFrame:
    """query_id, hits_with_code: of hits after attach_code."""
    return hits.groupBy("query_id").agg(F.count_if(F.col("code_snippet").isNotNull()).alias("hits_with_code"))


def attach_code(hits: DataFrame, docs: DataFrame, queries: DataFrame, budget: int = DEFAULT.code_chars) -> DataFrame:
    """code_snippet: an excerpt of code from the document, null without one."""
    asked = stored(hits.join(asked_terms(queries).withColumnRenamed("terms", "__terms"), "query_id"), "hits-terms")
    rows = with_contents(asked, docs)
    code = T.code_excerpt(F.coalesce("__content", F.lit("")), F.col("__terms"), budget)
    return rows.withColumn("code_snippet", F.nullif(code, F.lit(""))).drop("__content", "__terms")


def source_entries(hits: DataFrame) -> DataFrame:
    """query_id, document_id, title, source, domain, rank, score: what an answer lists as its sources."""
    return hits.select("query_id", "document_id", "title", "source", source_host(F.coalesce("source", F.lit(""))).alias("domain"), "rank", F.round("score", 4).alias("score"))


def expand_technical(query: Column) -> Column:
    """The query with the parts of its technical identifiers after it: phrases of at least two parts that it doesn't have yet."""
    q = T.strip(F.coalesce(query, F.lit("")))
    chunks = F.filter(F.split(q, r"\s+"), lambda c: c != "")
    keywords = F.array(*[F.lit(w) for w in TECHNICAL])
    technical = F.filter(chunks, lambda c: c.rlike(r"""[_.:/\\()\[\]{}<>=+*&|^%$#@!~`'";,0-9-]""") | F.array_contains(keywords, F.lower(c)) | c.rlike("[a-z0-9][A-Z]"))
    parts = F.transform(technical, lambda c: F.filter(F.split(F.regexp_replace(c, "(?<=[a-z0-9])(?=[A-Z])", " "), "[^A-Za-z0-9]+"), lambda p: p != ""))
    phrases = F.transform(F.filter(parts, lambda p: F.size(p) >= 2), lambda p: F.lower(F.array_join(p, " ")))
    added = F.array_distinct(F.filter(phrases, lambda p: ~F.contains(F.lower(q), p)))
    return F.when(F.size(added) > 0, F.concat(q, F.lit(" "), F.array_join(added, " "))).otherwise(q)


def mode_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """query_id, candidates, returned, dropped, distinct_sources (hosts, or documents without one)."""
    host = F.nullif(source_host(F.coalesce("source", F.lit(""))), F.lit(""))
    left = before.groupBy("query_id").agg(F.count("*").alias("candidates"))
    right = after.groupBy("query_id").agg(F.count("*").alias("returned"), F.count_distinct(F.coalesce(host, F.concat(F.lit("doc:"), F.col("document_id").cast("string")))).alias("distinct_sources"))
    rows = left.join(right, "query_id", "left").na.fill(0, ["returned", "distinct_sources"])
    return rows.select("query_id", "candidates", "returned", (F.col("candidates") - F.col("returned")).alias("dropped"), "distinct_sources")
