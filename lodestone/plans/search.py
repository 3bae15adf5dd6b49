"""Searching: a corpus with its indexes, and what each mode does with a set of queries."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig, clamp_limit
from ..operators import hybrid, lexical, modes, rag, semantic
from ..sources import corpus as sources
from ..sources.tables import stored


@dataclass(frozen=True)
class Corpus:
    """docs (document_id, title, source, content), their lexical index, and vectors (document_id, embedding) if there are any."""

    docs: DataFrame
    index: lexical.LexicalIndex
    vectors: DataFrame | None = None
    config: EngineConfig = DEFAULT


def make_corpus(docs: DataFrame, vectors: DataFrame | None = None, config: EngineConfig = DEFAULT) -> Corpus:
    return Corpus(docs, lexical.build_index(docs, config), vectors, config)


def hybrid_hits(queries: DataFrame, corpus: Corpus, limit: int, weights: tuple[float, float] | None = None) -> DataFrame:
    """queries: query_id, query, embedding. Lexical candidates are padded, as unmatched documents count in the scaling."""
    wide, near = hybrid.candidate_widths(limit, corpus.config)
    queries = stored(queries.select("query_id", "query", "embedding"), "queries")
    weights = weights or (corpus.config.bm25_weight, corpus.config.semantic_weight)
    left = lexical.search(queries, corpus.docs, corpus.index, wide, pad=True, places=6)
    right = semantic.search(queries, corpus.vectors, corpus.docs, near, places=6)
    return stored(hybrid.merge_hits(stored(left, "lexical-hits"), stored(right, "semantic-hits"), queries, limit, *weights), "hybrid-hits")


@dataclass(frozen=True)
class Found:
    """What a search returns: hits, their sources, and for modes that answer also passages, answers and citations. status is ok, degraded
    (lexical instead of hybrid) or unavailable (nothing indexed)."""

    mode: str
    status: str
    hits: DataFrame
    sources: DataFrame
    passages: DataFrame | None = None
    answers: DataFrame | None = None
    citations: DataFrame | None = None


@dataclass(frozen=True)
class PipelineReport:
    """What indexing a corpus did; rows that a store had before aren't persisted again."""

    documents_loaded: int
    indexed: int
    persisted: int


def run_pipeline(docs: DataFrame, known: DataFrame | None = None, config: EngineConfig = DEFAULT) -> tuple[Corpus, PipelineReport]:
    """Indexes docs (document_id, title, source, content, content_hash) and says how many of them a store with the rows known doesn't have."""
    made = make_corpus(docs, None, config)
    new = docs if known is None else sources.new_only(docs, known, ["document_id"])
    return made, PipelineReport(docs.count(), made.index.doc_stats.count(), new.count())


def search(queries: DataFrame, corpus: Corpus, mode: str = "lexical", limit: int | None = None, weights: tuple[float, float] | None = None, provider: rag.Provider | None = None) -> Found:
    """All queries (query_id, query, and embedding where vectors are searched) in one mode. Ranking modes return padded pages; special
    modes only what matched. Modes that answer ask the provider (the built-in one by default)."""
    name = modes.mode_name(mode)
    config = corpus.config
    semantic_ready = corpus.vectors is not None and "embedding" in queries.columns
    if name in modes.LEGACY:
        k = clamp_limit(limit, config)
        if name == "lexical":
            hits = lexical.search(queries, corpus.docs, corpus.index, k)
        elif not semantic_ready:
            return Found(name, "degraded", (none := lexical.search(queries, corpus.docs, corpus.index, k).limit(0)), modes.source_entries(none))
        else:
            hits = semantic.search(queries, corpus.vectors, corpus.docs, k) if name == "semantic" else hybrid_hits(queries, corpus, k, weights)
        return Found(name, "ok", hits, modes.source_entries(hits))
    spec = modes.mode_spec(name, config)
    k = clamp_limit(spec.default_limit if limit is None else limit, config)
    asked = queries.withColumn("query", modes.expand_technical(F.col("query"))) if spec.code else queries
    wide = spec.candidates(k, config)
    if semantic_ready:
        found = hybrid_hits(asked, corpus, wide, weights or spec.weights)
    else:
        found = stored(lexical.search(asked, corpus.docs, corpus.index, min(wide, config.max_limit)), "hits")
    matched = modes.drop_unmatched(found, config.match_floor)
    hits = matched
    if spec.snippet_words:
        hits = modes.enrich_snippets(hits, corpus.docs, asked, spec.snippet_words)
    if spec.code:
        hits = modes.documentation_first(modes.attach_code(hits, corpus.docs, asked, config.code_chars))
    hits = modes.truncate(hits, k) if spec.host_cap is None else modes.diversify(hits, spec.host_cap, k)
    out = Found(name, "ok" if semantic_ready else "degraded", hits, modes.source_entries(hits))
    return _answered(out, matched, queries, k, config, provider) if spec.rag else out


def _answered(out: Found, matched: DataFrame, queries: DataFrame, k: int, config: EngineConfig, provider: rag.Provider | None) -> Found:
    """Adds the answers, each with its status. Their passages come from the matched hits as retrieved: before wider snippets, diversification and limit."""
    chosen = rag.passages(rag.enough(matched, config.rag_min_score), k, config.rag_chars)
    has = chosen.select("query_id").distinct().withColumn("has", F.lit(True))
    if provider is None:
        said = queries.join(has, "query_id").select("query_id", rag.stub_answer(F.col("query")).alias("answer"), F.lit(None).cast("string").alias("error"))
    else:
        chosen = stored(chosen, "passages")
        said = stored(rag.generate(rag.prompts(chosen, queries), provider).select("query_id", "answer", "error"), "answers")
    rows = queries.join(has, "query_id", "left").join(said, "query_id", "left")
    generated = F.col("answer").isNotNull()
    # retrieval that isn't whole counts first; without an answer a query is only ok if the provider was not to blame
    status = F.lit(out.status) if out.status in ("degraded", "unavailable") else F.when(generated | F.col("error").isNull(), "ok").otherwise("unavailable")
    text = F.when(F.col("has"), F.col("answer")).otherwise(rag.NOT_ENOUGH)
    answers = rows.select("query_id", text.alias("answer"), status.alias("status"))
    given = rows.filter(generated).select("query_id", "answer")
    return replace(out, passages=chosen, answers=answers, citations=rag.cited(given, chosen))
