"""Hard-negative mining by product quantisation with stored residual norms.

Vectors of whole numbers are cut into short pieces, each piece is replaced by the nearest of up to 256 centres, and the length of what
this leaves out is stored beside the codes. An anchor's inner product with the centres is a sum of table look-ups; the true one
differs from it by no more than the anchor's length times the stored length (Cauchy and Schwarz). Rows whose upper bound can't reach an
anchor's worst kept score, or whose lower bound lies above its window, are left out on that proof alone; the rest are scored in whole
numbers, which complete each window. So results are exact, whatever the centres are.

Anchors go in blocks against parts of the index, dealt by (block, lot): blocks are repeated for each lot of parts, parts for each block. A task
gets a block once, before the parts that meet it, and keeps k rows for each anchor and window that it sees, which it sends on. Nothing of
this is broadcast, as a size check takes repeated rows for single ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, stored

#: Components of a piece, and centres for one.
PIECE, CENTRES = 2, 256
#: Rows that the centres are fitted on at most (those whose ids hash lowest), and bytes of them at most.
SAMPLE_ROWS, SAMPLE_BYTES = 4096, 16 << 20
FIT_ROUNDS = 6
#: Anchors of a block, and those that are scored at once; rows of a part.
ANCHORS, AT_ONCE, PART_ROWS = 4096, 256, 2048
#: Pairs that are scored exactly at once.
PAIRS = 100_000
NONE = np.iinfo(np.int64).min


def whole_rows(vectors: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows id, label and v (the vector as doubles) that take part. Rows with a null id, label or vector, or with any null or non-finite component,
    don't. Of rows that share an id the one with the smallest label and then vector does."""
    x = F.col(vector_col).cast("array<double>")
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.exists("v", odd), F.lit(False)))
    order = W.partitionBy("id").orderBy("label", "v")
    return rows.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def whole_numbers(column: pa.Array, dims: int, scale: float) -> np.ndarray:
    """floor(scale * x) of each vector as a row of dims whole numbers; shorter vectors count as ending in zeros."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(flat) and float(np.abs(flat).max()) ** 2 * max(dims, 1) >= 2.0**62:
        raise ValueError("inner products of these vectors don't fit 64 bits")
    out = np.zeros((len(column), dims), np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def fit_centres(sample: np.ndarray) -> np.ndarray:
    """Centres [pieces, CENTRES, PIECE] for rows of whole numbers, by k-means from evenly chosen points. dims is a multiple of PIECE."""
    pieces = sample.shape[1] // PIECE
    found = np.zeros((pieces, CENTRES, PIECE), np.float32)
    for j in range(pieces if len(sample) else 0):
        points = np.unique(sample[:, j * PIECE : (j + 1) * PIECE], axis=0).astype(np.float32)
        every = sample[:, j * PIECE : (j + 1) * PIECE].astype(np.float32)
        centres = points[np.linspace(0, len(points) - 1, CENTRES).astype(np.int64)]
        for _ in range(FIT_ROUNDS if len(points) > CENTRES else 0):
            near = nearest(every, centres)
            n = np.bincount(near, minlength=CENTRES)
            sums = np.stack([np.bincount(near, every[:, d], CENTRES) for d in range(PIECE)], 1)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres).astype(np.float32)
        found[j] = centres
    return found


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None, :] - 2 * points @ centres.T, axis=1)


def quantised(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes [rows, pieces] and the length of each row's residual, rounded up."""
    codes, square = np.empty((len(rows), len(centres)), np.uint8), np.zeros(len(rows))
    for j, own in enumerate(centres):
        points = rows[:, j * PIECE : (j + 1) * PIECE]
        codes[:, j] = nearest(points.astype(np.float32), own)
        square += ((points - own.astype(np.float64)[codes[:, j]]) ** 2).sum(1)
    return codes, np.sqrt(square) * (1 + 1e-9) + 1e-6


class Index(NamedTuple):
    """The stored parts (part, ids, labels, whole, codes, left: numbers packed as bytes), their number, and what the codes mean."""

    parts: DataFrame
    n_parts: int
    dims: int
    centres: np.ndarray
    scale: float


def _bytes(rows: np.ndarray) -> bytes:
    return np.ascontiguousarray(rows).tobytes()


def _narrow(rows: np.ndarray) -> bytes:
    """Whole numbers packed in two, four or eight bytes each, as they need."""
    most = int(np.abs(rows).max()) if rows.size else 0
    return _bytes(rows.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64))


def _wide(packed: bytes, n: int, dims: int) -> np.ndarray:
    """n rows of whole numbers out of _narrow()."""
    width = len(packed) // max(1, n * dims)
    return np.frombuffer(packed, {2: np.int16, 4: np.int32}.get(width, np.int64)).reshape(-1, dims).astype(np.int64)


def build_index(rows: DataFrame, scale: float = 256.0) -> Index:
    """Every row of whole_rows() with its codes, in stored parts of PART_ROWS rows at most. Centres are fitted on a bounded sample."""
    spark = rows.sparkSession
    bound_batches(spark)
    longest = int(rows.agg(F.max(F.size("v"))).first()[0] or 0)
    dims = max(PIECE, -(-longest // PIECE) * PIECE)
    lot = max(CENTRES, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dims)))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(lot).select("v").toArrow().column("v").combine_chunks()
    centres = fit_centres(whole_numbers(sample, dims, scale))
    shared = spark.sparkContext.broadcast(centres)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            for at in range(0, b.num_rows, PART_ROWS):
                piece = b.slice(at, PART_ROWS)
                whole = whole_numbers(piece.column("v"), dims, scale)
                codes, left = quantised(whole, own)
                cells = [*(_bytes(piece.column(c).to_numpy()) for c in ("id", "label")), _narrow(whole), _bytes(codes), _bytes(left)]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in cells], ["ids", "labels", "whole", "codes", "left"])

    parts = rows.select("id", "label", "v").mapInArrow(pack, "ids binary, labels binary, whole binary, codes binary, left binary")
    parts = stored(parts.withColumn("part", F.monotonically_increasing_id()), "pq-index")
    return Index(parts, parts.count(), dims, centres, scale)


class _Kept:
    """The best k (score, id) of each slot: higher scores first, ties by smaller id."""

    def __init__(self, slots: int, k: int) -> None:
        self.scores, self.ids, self.k = np.full((slots, k), NONE), np.zeros((slots, k), np.int64), k

    def least(self) -> np.ndarray:
        """The score that a new row has to reach in each slot, NONE where there is room."""
        return self.scores[:, -1]

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        touched = np.unique(slot)
        old = np.repeat(touched, self.k)
        slot, score, ids = np.concatenate([old, slot]), np.concatenate([self.scores[touched].ravel(), score]), np.concatenate([self.ids[touched].ravel(), ids])
        there = score != NONE
        slot, score, ids = slot[there], score[there], ids[there]
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        starts = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        rank = np.arange(len(slot)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(slot)]))))
        best = rank < self.k
        self.scores[touched], self.ids[touched] = NONE, 0
        self.scores[slot[best], rank[best]], self.ids[slot[best], rank[best]] = score[best], ids[best]


class _Block:
    """A block of anchors: ids, labels, whole vectors, and windows [anchors, w] of scores that are wanted (None: the best of all)."""

    def __init__(self, ids: bytes, labels: bytes, whole: bytes, windows: bytes | None, dims: int, centres: np.ndarray, k: int) -> None:
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.whole = _wide(whole, len(self.ids), dims)
        self.length = np.sqrt((self.whole.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
        self.centres = centres
        self.low = self.high = None
        self.per = 1
        if windows is not None:
            self.low, self.high = np.frombuffer(windows, np.int64).reshape(2, len(self.ids), -1)
            self.per = self.low.shape[1]
        self.kept = _Kept(len(self.ids) * self.per, k)

    def table(self, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
        """Look-up tables [pieces, CENTRES, anchors], and what float sums over them may be off by."""
        q = self.whole[a:z].astype(np.float64).reshape(z - a, len(self.centres), PIECE)
        table = np.einsum("jcd,ajd->jca", self.centres.astype(np.float64), q)
        return table.astype(np.float32), np.abs(table).max(1).sum(0) * (len(self.centres) + 2) * 2.0**-22 + 1e-3

    def wanted(self, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each anchor the least score that any window still takes, and the highest."""
        least = self.kept.least().reshape(-1, self.per)[a:z]
        if self.low is None:
            return least[:, 0].astype(np.float64), np.full(z - a, np.inf)
        low, high = self.low[a:z], self.high[a:z]
        open_ = low <= high
        return np.where(open_, np.maximum(low, least), np.inf).min(1).astype(np.float64), np.where(open_, high, -np.inf).max(1).astype(np.float64)

    def take(self, part: dict[str, np.ndarray], same_label: bool) -> None:
        """Scores one part of the index."""
        for a in range(0, len(self.ids), AT_ONCE):
            z = min(a + AT_ONCE, len(self.ids))
            table, slack = self.table(a, z)
            sums = table[0][part["codes"][:, 0]]
            for j in range(1, len(table)):
                sums += table[j][part["codes"][:, j]]
            off = part["left"][:, None] * self.length[a:z] + slack
            fits = (part["labels"][:, None] == self.labels[a:z]) == same_label
            if same_label:
                fits &= part["ids"][:, None] != self.ids[a:z]
            least, most = self.wanted(a, z)
            if self.low is None and np.isneginf(np.where(least == NONE, -np.inf, least)).any() and len(sums) > self.kept.k:
                # the k-th best lower bound of this part is one that the k best must reach
                bound = np.where(fits, sums - off, -np.inf)
                least = np.maximum(least, np.partition(bound, len(sums) - self.kept.k, axis=0)[len(sums) - self.kept.k])
            fits &= (sums + off >= least) & (sums - off <= most)
            rows, anchors = np.nonzero(fits)
            for at in range(0, len(rows), PAIRS):
                r, c = rows[at : at + PAIRS], anchors[at : at + PAIRS] + a
                score = np.einsum("ij,ij->i", part["whole"][r], self.whole[c])
                if self.low is None:
                    self.kept.add(c, score, part["ids"][r])
                    continue
                inside = (score[:, None] >= self.low[c]) & (score[:, None] <= self.high[c]) & (score[:, None] >= self.kept.least().reshape(-1, self.per)[c])
                pair, w = np.nonzero(inside)
                self.kept.add(c[pair] * self.per + w, score[pair], part["ids"][r[pair]])


def _blocks_of(anchors: DataFrame, dims: int, scale: float, with_windows: bool) -> tuple[DataFrame, int]:
    """Anchors (id, label, v; with windows also low and high: arrays of equal length) in packed rows of some ANCHORS, and the number of blocks."""
    n = max(1, -(-anchors.count() // ANCHORS))

    def pack(table: pa.Table) -> pa.Table:
        windows = None
        if with_windows:
            sides = [table.column(c).to_pylist() for c in ("low", "high")]
            width = max(map(len, sides[0]))
            # a window that isn't there takes nothing: its low end is above its high one
            windows = np.stack([np.array([[*x, *[fill] * (width - len(x))] for x in side], np.int64).reshape(-1, width) for side, fill in zip(sides, (0, -1), strict=True)])
        cells = [*(_bytes(table.column(c).to_numpy()) for c in ("id", "label")), _narrow(whole_numbers(table.column("v").combine_chunks(), dims, scale)), None if windows is None else _bytes(windows)]
        return pa.Table.from_arrays([pa.array([table.column("block")[0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in cells)], ["block", "ids", "labels", "whole", "windows"])

    blocks = anchors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).groupBy("block").applyInArrow(pack, "block int, ids binary, labels binary, whole binary, windows binary")
    return stored(blocks, "pq-anchors"), n


def _search(index: Index, blocks: DataFrame, n_blocks: int, k: int, same_label: bool) -> DataFrame:
    """Rows anchor, w (the window), id and score: the k best of each anchor and window among the rows that a task has seen."""
    spark = index.parts.sparkSession
    bound_batches(spark)
    lots = max(1, min(index.n_parts, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    none = F.lit(None).cast("binary")
    parts = index.parts.withColumn("lot", F.pmod(F.xxhash64("part"), F.lit(lots)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    parts = parts.select("block", "lot", F.lit(1).alias("kind"), "ids", "labels", "whole", "codes", "left", none.alias("windows"))
    anchors = blocks.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    anchors = anchors.select("block", "lot", F.lit(0).alias("kind"), "ids", "labels", "whole", none.alias("codes"), none.alias("left"), "windows")
    shared, dims = spark.sparkContext.broadcast(index.centres), index.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Block] = {}
        for b in batches:
            for row in b.to_pylist():
                if row["kind"] == 0:
                    # a block comes once for each of its lots here
                    if row["block"] not in held:
                        yield from sent(held)
                        held[row["block"]] = _Block(row["ids"], row["labels"], row["whole"], row["windows"], dims, shared.value, k)
                elif row["block"] in held:
                    part = {c: np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("labels", np.int64), ("codes", np.uint8), ("left", np.float64))}
                    part |= {"whole": _wide(row["whole"], len(part["ids"]), dims), "codes": part["codes"].reshape(-1, dims // PIECE)}
                    held[row["block"]].take(part, same_label)
        yield from sent(held)

    def sent(held: dict[int, _Block]) -> Iterator[pa.RecordBatch]:
        for own in held.values():
            slot, rank = np.nonzero(own.kept.scores != NONE)
            cells = [own.ids[slot // own.per], (slot % own.per).astype(np.int32), own.kept.ids[slot, rank], own.kept.scores[slot, rank]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells], ["anchor", "w", "id", "score"])
        held.clear()

    dealt = anchors.unionByName(parts).repartition("block", "lot").sortWithinPartitions("block", "kind")
    found = dealt.mapInArrow(run, "anchor long, w int, id long, score long")
    best = W.partitionBy("anchor", "w").orderBy(F.col("score").desc(), "id")
    return found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, positives: int = 5, negatives: int = 5, low: int = 80) -> DataFrame:
    """One row for each anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor is a condition on `id`; label an expression over vectors (default: its column label). A score is the inner product of floor(scale *
    x). An anchor's positives are the best `positives` other rows of its label; for each of them the best `negatives` rows of other labels count whose score
    is at most the positive's and at least low percent of it. Ties go to the smaller id. Fewer are returned where there are fewer; a negative
    positive score leaves no window. Which rows take part: see whole_rows(). Shorter vectors count as ending in zeros; scores that don't fit
    64 bits are an error. An empty table gives an empty result; other columns are not read.
    """
    rows = stored(whole_rows(vectors, F.col("label") if label is None else label, id_col, vector_col), "pq-rows")
    index = build_index(rows, scale)
    anchors = rows.filter(anchor)
    blocks, n = _blocks_of(anchors, index.dims, scale, False)
    near = stored(_search(index, blocks, n, positives, True).select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("nth") - 1).alias("w")), "pq-positives")
    high = F.col("positive_score")
    # the least whole number that is at least low percent: a quotient of whole numbers, rounded up
    least = F.expr(f"(({low} * positive_score) - pmod({low} * positive_score, 100L)) div 100 + IF(pmod({low} * positive_score, 100L) > 0, 1L, 0L)")
    windows = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("w", least.alias("low"), high.alias("high")))).alias("x")).select(F.col("anchor").alias("id"), F.col("x.low").alias("low"), F.col("x.high").alias("high"))
    blocks, n = _blocks_of(anchors.join(windows, "id"), index.dims, scale, True)
    found = _search(index, blocks, n, negatives, False)
    return found.join(near, ["anchor", "w"]).select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("nth").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every embedding whose id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("id") % 100 == 0, label)


ORACLE = {
    "op12_hard_negatives": """
WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5"""
}
