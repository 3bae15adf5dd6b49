"""A stored index of vectors in cells, for exact search that leaves out what can't count.

Every vector lies in the cell of its nearest centre and is stored with its distance from it, in parts of one cell each, nearest first. The product of a
query with a vector is at most its product with the centre plus its length times that distance, so cells and parts whose bound stays below a
query's k-th best score so far hold nothing for it. A first pass gives each query such a score from the cells that promise most, a second one reads
what the bounds leave. Queries travel to cells in a join, as packed blocks; neither queries nor vectors pass the driver.

How much is left out depends on how well the vectors cluster; what comes out does not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import stored
from .lexical import top_k

#: Rows and bytes of the sample that centres are fitted on at most; centres at most; rounds of fitting.
SAMPLE_ROWS, SAMPLE_BYTES, MOST_CELLS, FIT_ROUNDS = 20_000, 32 << 20, 1024, 6
#: Rows of a part, and queries of a block.
PART_ROWS, BLOCK_QUERIES = 1024, 512
#: What rounding to six places may hide, and floating point besides.
SLACK = 2e-6


@dataclass(frozen=True)
class VectorIndex:
    """parts: cell, n, near and far (least and largest distance from the centre), ids (array), vectors (packed). cells: cell, n, far. centres: [cells, dimension]; at
    most MOST_CELLS, so that they can go to every task."""

    parts: DataFrame
    cells: DataFrame
    centres: np.ndarray


def fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres by k-means, from evenly chosen rows of a sample in random order."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(np.int64)].copy() if len(sample) else np.zeros((1, sample.shape[1]))
    for _ in range(FIT_ROUNDS):
        near = _nearest(sample, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None, :] - 2 * rows @ centres.T, axis=1) if len(rows) else np.zeros(0, np.int64)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.float64)


def build(vectors: DataFrame, cells: int | None = None) -> VectorIndex:
    """The index of vectors (document_id, embedding), stored. Rows with a null id, vector or component, or of another length than most, are left out. Centres are
    fitted on SAMPLE_ROWS rows at most, those whose ids hash lowest; every row is indexed."""
    spark = vectors.sparkSession
    whole = ~F.coalesce(F.exists("embedding", lambda x: x.isNull() | F.isnan(x)), F.lit(True))
    rows = vectors.filter("document_id IS NOT NULL AND embedding IS NOT NULL").filter(whole).select("document_id", F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("d")).filter("d > 0")
    sizes = rows.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dimension, n = (sizes[0].d, sizes[0].n) if sizes else (1, 0)
    rows = rows.filter(F.col("d") == dimension).drop("d")
    lot = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dimension)))
    sample = _matrix(rows.orderBy(F.xxhash64("document_id"), "document_id").limit(lot).select("embedding").toArrow().column(0).combine_chunks(), dimension)
    cells = cells or max(1, min(MOST_CELLS, int(n**0.5)))
    centres = fit(sample, max(1, min(cells, len(sample))))
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column("embedding"), dimension)
            cell = _nearest(m, shared.value)
            far = np.sqrt(((m - shared.value[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(far)], [*b.schema.names, "cell", "far"])

    kind = rows.schema["document_id"].dataType.simpleString()
    placed = rows.mapInArrow(assign, f"document_id {kind}, embedding array<double>, cell int, far double")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of one cell, of PART_ROWS rows at most."""
        for b in batches:
            cell, far = b.column("cell").to_numpy(), b.column("far").to_numpy()
            edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), b.num_rows]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                for a in range(start, end, PART_ROWS):
                    z = min(end, a + PART_ROWS)
                    ids = b.column("document_id").slice(a, z - a)
                    packed = _matrix(b.column("embedding").slice(a, z - a), dimension).tobytes()
                    cells = [[int(cell[a])], [z - a], [float(far[a:z].min())], [float(far[a:z].max())]]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)), pa.ListArray.from_arrays([0, z - a], ids), pa.array([packed], pa.binary())], ["cell", "n", "near", "far", "ids", "vectors"])

    ordered = placed.repartitionByRange("cell", "far").sortWithinPartitions("cell", "far")
    parts = stored(ordered.mapInArrow(pack, f"cell int, n int, near double, far double, ids array<{kind}>, vectors binary"), "vector-parts")
    return VectorIndex(parts, stored(parts.groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far")), "vector-cells"), centres)


def save(index: VectorIndex, folder: str) -> None:
    index.parts.write.mode("overwrite").parquet(f"{folder}/parts")
    index.cells.write.mode("overwrite").parquet(f"{folder}/cells")
    rows = [(i, c.tolist()) for i, c in enumerate(index.centres)]
    index.parts.sparkSession.createDataFrame(rows, "cell int, centre array<double>").write.mode("overwrite").parquet(f"{folder}/centres")


def load(spark: SparkSession, folder: str) -> VectorIndex:
    centres = spark.read.parquet(f"{folder}/centres").orderBy("cell").collect()
    return VectorIndex(spark.read.parquet(f"{folder}/parts"), spark.read.parquet(f"{folder}/cells"), np.array([r.centre for r in centres]))


def _blocks(asked: DataFrame, ids: str) -> DataFrame:
    """asked (cell, query_id, q, least) as rows of one cell with BLOCK_QUERIES queries at most or some more: cell, queries (array), qs and leasts (packed)."""

    def pack(table: pa.Table) -> pa.Table:
        out = []
        for a in range(0, table.num_rows, BLOCK_QUERIES):
            t = table.slice(a, BLOCK_QUERIES)
            queries = t.column("query_id").combine_chunks()
            m = t.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            cells = [pa.array([t.column("cell")[0].as_py()], pa.int32()), pa.ListArray.from_arrays([0, len(queries)], queries), pa.array([m.tobytes()], pa.binary()), pa.array([t.column("least").to_numpy().astype(np.float64).tobytes()], pa.binary())]
            out.append(pa.Table.from_arrays(cells, ["cell", "queries", "qs", "leasts"]))
        return pa.concat_tables(out)

    # a cell that many queries ask for is dealt out, so no group holds more than some blocks
    many = asked.groupBy("cell").agg(F.ceil(F.count("*") / (8 * BLOCK_QUERIES)).cast("int").alias("lots"))
    dealt = asked.join(many, "cell").withColumn("lot", F.pmod(F.xxhash64("query_id"), "lots")).drop("lots")
    return dealt.groupBy("cell", "lot").applyInArrow(pack, f"cell int, queries array<{ids}>, qs binary, leasts binary")


def _scored(index: VectorIndex, blocks: DataFrame, k: int, ids: str) -> DataFrame:
    """query_id, document_id, score: each block's queries against the parts of its cell."""
    kind = index.parts.schema["ids"].dataType.elementType.simpleString()
    shared, dimension = index.parts.sparkSession.sparkContext.broadcast(index.centres), index.centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, far = b.column("cell").to_numpy(), b.column("far").to_numpy()
            packed = [b.column(c).to_pylist() for c in ("vectors", "qs", "leasts")]
            for i in range(b.num_rows):
                m = np.frombuffer(packed[0][i]).reshape(-1, dimension)
                q, least = np.frombuffer(packed[1][i]).reshape(-1, dimension), np.frombuffer(packed[2][i])
                open_ = np.flatnonzero(q @ shared.value[cell[i]] + np.sqrt((q**2).sum(1)) * far[i] + SLACK >= least)
                if not len(open_):
                    continue
                s = np.round(q[open_] @ m.T, 6)
                good = s >= least[open_, None] - SLACK
                if s.shape[1] > k:
                    good &= s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
                at, row = np.nonzero(good)
                cells = [b.column("queries")[i].values.take(pa.array(open_[at])), b.column("ids")[i].values.take(pa.array(row)), pa.array(s[at, row])]
                yield pa.RecordBatch.from_arrays(cells, ["query_id", "document_id", "score"])

    joined = blocks.join(index.parts, "cell").select("cell", "far", "vectors", "qs", "leasts", "queries", "ids")
    return joined.mapInArrow(run, f"query_id {ids}, document_id {kind}, score double")


def search(queries: DataFrame, index: VectorIndex, k: int) -> DataFrame:
    """query_id, document_id, score (6 places), rank: the k nearest documents of each query (query_id, embedding) by inner product, equal scores by id; the same
    as scoring everything. Queries without a vector, or of another length, have no hits. k is at least 1."""
    spark, k = queries.sparkSession, max(1, k)
    ids, dimension = queries.schema["query_id"].dataType.simpleString(), index.centres.shape[1]
    rows = queries.filter(F.size("embedding") == dimension).select("query_id", F.col("embedding").cast("array<double>").alias("q"))
    rows = stored(rows, "queries")
    counts = {r.cell: (r.n, r.far) for r in index.cells.collect()}
    n, far = (np.array([counts.get(c, (0, 0.0))[x] for c in range(len(index.centres))], np.float64) for x in (0, 1))
    shared = spark.sparkContext.broadcast((index.centres, n, far))
    asked = f"cell int, query_id {ids}, q array<double>, least double"

    def out(b: pa.RecordBatch, at: np.ndarray, cell: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
        take = pa.array(at)
        return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column("query_id").take(take), b.column("q").take(take), pa.array(least[at])], ["cell", "query_id", "q", "least"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells of the largest products with their centres, as many as hold k rows."""
        centres, n, _ = shared.value
        for b in batches:
            promise = np.where(n > 0, _matrix(b.column("q"), dimension) @ centres.T, -np.inf)
            order = np.argsort(-promise, axis=1, kind="stable")
            before = np.cumsum(n[order], axis=1) - n[order]
            at, place = np.nonzero((before < k) & (n[order] > 0))
            yield out(b, at, order[at, place], np.full(b.num_rows, -np.inf))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells whose bound reaches a query's k-th best score, but for those that it has been to."""
        centres, n, far = shared.value
        for b in batches:
            q, least = _matrix(b.column("q"), dimension), b.column("least").to_numpy()
            bound = q @ centres.T + np.sqrt((q**2).sum(1))[:, None] * far + SLACK
            open_ = (bound >= least[:, None]) & (n > 0)
            seen = b.column("seen").to_pylist()
            open_[np.repeat(np.arange(len(seen)), [len(s) for s in seen]), [c for s in seen for c in s]] = False
            at, cell = np.nonzero(open_)
            yield out(b, at, cell, least)

    begun = stored(rows.mapInArrow(first, asked), "first-cells")
    found = stored(top_k(_scored(index, _blocks(begun, ids), k, ids), k), "first-hits")
    least = found.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("m")).select("query_id", F.when(F.col("m") >= k, F.col("least")).otherwise(float("-inf")).alias("least"))
    seen = begun.groupBy("query_id").agg(F.collect_set("cell").alias("seen"))
    more = rows.join(least, "query_id").join(seen, "query_id").select("query_id", "q", "least", "seen").mapInArrow(rest, asked)
    later = _scored(index, _blocks(stored(more, "other-cells"), ids), k, ids)
    return top_k(found.select("query_id", "document_id", "score").unionByName(later), k)


def share_read(queries: DataFrame, index: VectorIndex, k: int) -> DataFrame:
    """One row: pairs (of a query and a vector), and read, those in cells that the bounds leave once each query's k-th score is known."""
    best = search(queries, index, k).groupBy("query_id").agg(F.min("score").alias("least"))
    counts = {r.cell: (r.n, r.far) for r in index.cells.collect()}
    n, far = (np.array([counts.get(c, (0, 0.0))[x] for c in range(len(index.centres))], np.float64) for x in (0, 1))
    shared, dimension = queries.sparkSession.sparkContext.broadcast((index.centres, n, far)), index.centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, n, far = shared.value
        for b in batches:
            q = _matrix(b.column("q"), dimension)
            bound = q @ centres.T + np.sqrt((q**2).sum(1))[:, None] * far + SLACK
            read = ((bound >= b.column("least").to_numpy()[:, None]) * n).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(read.astype(np.int64)), pa.array(np.full(len(q), int(n.sum())))], ["read", "pairs"])

    rows = queries.join(best, "query_id").select(F.col("embedding").cast("array<double>").alias("q"), "least")
    return rows.mapInArrow(run, "read long, pairs long").agg(F.sum("read").alias("read"), F.sum("pairs").alias("pairs"))
