"""Exact vector search: query vectors in bounded blocks against all document vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..config import DEFAULT, EngineConfig
from ..functions import text as T
from ..sources.tables import bound_batches, stored
from .lexical import in_tasks, top_k


def hash_encode(text: str, dim: int) -> np.ndarray:
    """A stand-in for a model, the same everywhere: counts of words in buckets (the first four bytes of their SHA-256, little-endian,
    modulo dim), scaled to length one. A text without words is the zero vector."""
    v = np.zeros(dim, np.float32)
    for w in re.findall(r"[a-z0-9]+", (text or "").lower()):
        v[int.from_bytes(hashlib.sha256(w.encode()).digest()[:4], "little") % dim] += 1
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def encode(rows: DataFrame, text_col: str, out_col: str = "embedding", dim: int = 64, encoder=hash_encode) -> DataFrame:
    """rows with out_col: the encoder's vectors of length one. encoder(text, dim) is called in batches on the executors; any model that
    pickles can stand there."""
    bound_batches(rows.sparkSession)

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: encoder(t or "", dim).tolist())

    return rows.withColumn(out_col, run(T.collapsed(F.col(text_col))))


#: Queries that a task scores at once, against a batch of vectors.
CHUNK = 512


class _Best:
    """The k best documents of each query so far; equal scores in the order of ids."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.q, self.k = queries, k
        self.s: np.ndarray | None = None
        self.d: np.ndarray | None = None

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        k = min(self.k, len(ids))
        found = [self._top(np.round(self.q[i : i + CHUNK] @ vectors.T, 6), k) for i in range(0, len(self.q), CHUNK)]
        s, d = np.concatenate([x[0] for x in found]), ids[np.concatenate([x[1] for x in found])]
        if self.s is not None:
            s, d = np.concatenate([self.s, s], 1), np.concatenate([self.d, d], 1)
            best = np.lexsort((d, -s), axis=-1)[:, : self.k]
            s, d = np.take_along_axis(s, best, 1), np.take_along_axis(d, best, 1)
        self.s, self.d = s, d

    @staticmethod
    def _top(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the k best scores and their places, of equal ones the first places; no row is sorted as a whole."""
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
        above, equal = s > least, s == least
        taken = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(1, keepdims=True)))
        places = np.nonzero(taken)[1].reshape(len(s), k)
        return np.take_along_axis(s, places, 1), places


def vector_scores(queries: DataFrame, vectors: DataFrame, k: int, config: EngineConfig = DEFAULT) -> DataFrame:
    """query_id, document_id, score (6 places), rank: the k nearest documents of each query by dot product, equal scores by id.

    queries (query_id, embedding) go to all tasks in blocks of config.query_bytes, which bounds what is sent; for each block the vectors
    are read once, and a task keeps k rows a query, so what is shuffled grows with the number of tasks and not of documents.
    Vectors of another length match nothing. k is at least 1.
    """
    ids = queries.schema["query_id"].dataType.simpleString()
    doc_ids = vectors.schema["document_id"].dataType.simpleString()
    k = max(1, k)
    found, block = None, []

    def against(block: list) -> DataFrame:
        length = len(block[0][1])
        names = pa.array([q for q, _ in block])
        matrix = vectors.sparkSession.sparkContext.broadcast((names, np.array([v for _, v in block], np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = matrix.value
            best, kind = _Best(q, k), None
            for b in batches:
                right = b.filter(pc.equal(pc.list_value_length(b.column("embedding")), length))
                if right.num_rows:
                    kind = right.column("document_id").type
                    d = right.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, length).astype(np.float64)
                    best.add(np.array(right.column("document_id").to_pylist()), d)
            if best.s is not None:
                width = best.s.shape[1]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(np.arange(len(names)), width))), pa.array(best.d.reshape(-1).tolist(), kind), pa.array(best.s.reshape(-1))], ["query_id", "document_id", "score"])

        return in_tasks(vectors.select("document_id", "embedding").filter("embedding IS NOT NULL AND document_id IS NOT NULL")).mapInArrow(run, f"query_id {ids}, document_id {doc_ids}, score double")

    for row in queries.select("query_id", "embedding").filter("embedding IS NOT NULL").toLocalIterator():
        if block and (len(block) * len(block[0][1]) * 8 >= config.query_bytes or len(block[0][1]) != len(row[1])):
            found = against(block) if found is None else found.union(against(block))
            block = []
        block.append((row[0], row[1]))
    if block:
        found = against(block) if found is None else found.union(against(block))
    if found is None:
        found = vectors.sparkSession.createDataFrame([], f"query_id {ids}, document_id {doc_ids}, score double")
    return top_k(found, k)


def ask(queries: DataFrame, dim: int = 64, encoder=hash_encode) -> DataFrame:
    """queries (query_id, query) with embedding, made of the folded query, as the documents' are of their texts."""
    rows = encode(queries.select("query_id", T.fold(F.coalesce("query", F.lit(""))).alias("folded")), "folded", dim=dim, encoder=encoder)
    return queries.join(rows.select("query_id", "embedding"), "query_id", "left")


def search(queries: DataFrame, vectors: DataFrame, docs: DataFrame, k: int, places: int = 4) -> DataFrame:
    """Full hits; semantic hits report no matched terms, and their snippet is the first tokens of the content."""
    hits = stored(vector_scores(queries, vectors, k), "ranked")
    # the snippet is the same for all hits of a document, so it is made once and contents aren't joined
    found = docs.join(hits.select("document_id").distinct(), "document_id", "left_semi")
    rows = hits.join(found.select("document_id", "title", "source", F.array_join(T.leading(F.col("content")), " ").alias("snippet")), "document_id")
    none = F.array().cast("array<string>")
    return rows.select("query_id", "rank", "document_id", "title", "source", "snippet", F.round("score", places).alias("score"), none.alias("matched_terms"))
