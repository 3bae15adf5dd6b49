"""Counting keys over the whole corpus, and bringing the counts back to where the keys are needed.

Documents are taken in blocks of bounded size. A block sends each distinct key once, as sorted arrays, to the part of the key
space that the key lies in; a part adds up what all blocks sent and answers each block with the counts of its keys, in
the order of the keys, so the keys need not travel back. A key that a third of all documents share costs one entry for
each block. Blocks and parts grow in number with the corpus, not in size; so do the cells of a block and a part, with the square, and get
smaller. That bounds a corpus to some hundred GB for each exchange; beyond it, keys would have to travel in two steps.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, distinct, places, stored, texts

#: Rows of a block; a text of more than LONG_BYTES is a block of its own, so a block's texts have at most 64 MB, or are one.
BLOCK_ROWS, LONG_BYTES = 2048, 32 << 10
#: Texts that a task gathers before it sends the keys of the blocks that it has begun.
PENDING_BYTES = 16 << 20
#: Bytes of input, as Spark estimates it, that a part of the key space is for at most; a part's keys are merged in one worker.
PART_BYTES = 64 << 20


def with_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """block, id and t (the text): a block stays the same whenever the rows are read again, as it follows from where a row lies in
    its file. What doesn't come straight from files is written to the shared folder first."""

    def placed(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))

    try:
        rows = placed(docs)
    except AnalysisException:
        rows = placed(stored(docs.select(*{id_col: None, text_col: None}), "blocks"))
    long = F.octet_length(F.coalesce("t", F.lit(""))) > LONG_BYTES
    block = F.when(long, F.xxhash64("file", "at", F.lit(1))).otherwise(F.xxhash64("file", F.floor(F.col("at") / BLOCK_ROWS)))
    return rows.select(block.alias("block"), "id", "t")


def with_places(docs: DataFrame, file: str, at: str) -> DataFrame:
    """docs with two more columns that tell its rows apart, whatever they hold, and are the same whenever the rows are read again: a hash of a
    row's file and its place there. What doesn't come straight from files is written to the shared folder first."""
    try:
        return docs.withColumns({file: F.xxhash64("_metadata.file_path"), at: F.col("_metadata.row_index")})
    except AnalysisException:
        return stored(docs, "rows").withColumns({file: F.xxhash64("_metadata.file_path"), at: F.col("_metadata.row_index")})


def part_names(df: DataFrame) -> list[int]:
    """A number for each part of the key space, in its order. There are as many parts as shuffle partitions, or as the input's
    size asks for, if that is more; their numbers are such that a shuffle by them gives each partition as many as any other."""
    spark = df.sparkSession
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    rounds = max(1, -(-min(size, 1 << 50) // (PART_BYTES * partitions)))
    lot = spark.range(partitions * (rounds + 1) * 12).select(F.col("id").cast("int").alias("name"))
    by = lot.groupBy(F.pmod(F.hash("name"), F.lit(partitions)).alias("at")).agg(F.slice(F.sort_array(F.collect_list("name")), 1, rounds).alias("names"))
    names = [n for r in by.orderBy("at").collect() for n in r.names]
    return names if len(names) == partitions * rounds else list(range(partitions * rounds))


def _planes(values: np.ndarray) -> bytes:
    """Byte planes: the first bytes of all values, then the second ones; those that are nearly all zero compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct uint64 keys, as byte planes of their differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    n = len(data) // 8
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, n).T).reshape(-1).view(np.uint64), dtype=np.uint64)


def pack_counts(*columns: np.ndarray) -> bytes:
    """Columns of counts, each as byte planes of the fewest bytes that hold its largest."""
    out = [struct.pack("<B", len(columns))]
    for c in columns:
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(c) or int(c.max()) <= np.iinfo(k).max)
        out += [struct.pack("<BQ", np.dtype(kind).itemsize, len(c)), _planes(c.astype(kind))]
    return b"".join(out)


def unpack_counts(data: bytes) -> list[np.ndarray]:
    out, at = [], 1
    for _ in range(data[0]):
        size, n = struct.unpack_from("<BQ", data, at)
        planes = np.frombuffer(data, np.uint8, size * n, at + 9).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{size}").astype(np.int64))
        at += 9 + size * n
    return out


#: From a part's distinct keys and their summed columns, the columns that go back.
Reply = Callable[[np.ndarray, list[np.ndarray]], list[np.ndarray]]


def send_keys(blocked: DataFrame, cols: list[str], keys_of: Callable[[dict[str, list], list[bytes]], tuple[np.ndarray, list[np.ndarray]]]) -> DataFrame:
    """Rows block, part, name (the part's number among part_names), keys, counts. keys_of gets a block's rows (the columns cols, and the texts), or some of them, and gives
    their distinct keys, sorted, and columns of counts."""
    bound_batches(blocked.sparkSession)
    names = part_names(blocked)
    parts = len(names)
    rows = blocked.select("block", "t", *cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict[int, tuple[dict[str, list], list[bytes]]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for block, (values, raw) in pending.items():
                keys, counts = keys_of(values, raw)
                part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                edges = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
                there = [p for p in range(parts) if edges[p] < edges[p + 1]]
                cells = [
                    pa.array([block] * len(there), pa.int64()),
                    pa.array(there, pa.int32()),
                    pa.array([names[p] for p in there], pa.int32()),
                    pa.array([pack_keys(keys[edges[p] : edges[p + 1]]) for p in there], pa.binary()),
                    pa.array([pack_counts(*(c[edges[p] : edges[p + 1]] for c in counts)) for p in there], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cells, ["block", "part", "name", "keys", "counts"])
            pending.clear()

        size = 0
        for b in batches:
            raw = texts(b.column("t"))
            values = {c: b.column(c).to_pylist() for c in cols}
            for i, block in enumerate(b.column("block").to_pylist()):
                own = pending.setdefault(block, ({c: [] for c in cols}, []))
                own[1].append(raw[i])
                for c in cols:
                    own[0][c].append(values[c][i])
                size += len(raw[i])
            if size >= PENDING_BYTES:
                yield from flush()
                size = 0
        yield from flush()

    return rows.mapInArrow(run, "block long, part int, name int, keys binary, counts binary")


def answer(sent: DataFrame, reply: Reply, stat: Callable[[np.ndarray, list[np.ndarray]], list[int]], name: str, subset: Callable[[list[np.ndarray]], np.ndarray] | None = None, subset_reply: Reply | None = None) -> DataFrame:
    """Stored rows block, part, counts (columns for the block's keys of this part, in their order), some (columns of subset_reply for
    those of them that subset picks by the block's own counts), and one row with a null block for each part, with stats (whole
    numbers about the part's keys). reply, subset_reply and stat get the part's distinct keys and the sums of their columns
    over all blocks."""

    def merge(table: pa.Table) -> pa.Table:
        blocks = np.array(table.column("block").to_pylist(), np.int64)
        lists = [unpack_keys(x) for x in table.column("keys").to_pylist()]
        sent_counts = [unpack_counts(x) for x in table.column("counts").to_pylist()]
        every = np.concatenate(lists)
        index, keys = places(every), distinct(every)
        sums = [np.bincount(index, np.concatenate([c[k] for c in sent_counts]), len(keys)).astype(np.int64) for k in range(len(sent_counts[0]))]
        replies, some_replies = reply(keys, sums), subset_reply(keys, sums) if subset_reply else []
        edges = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        by: dict[int, list[int]] = {}
        for i, block in enumerate(blocks.tolist()):
            by.setdefault(block, []).append(i)
        out, some = [], []
        for cells_of in by.values():
            there = np.concatenate([index[edges[i] : edges[i + 1]] for i in cells_of])
            at, own = there, sent_counts[cells_of[0]]
            if len(cells_of) > 1:
                at, inverse = distinct(there), places(there)
                own = [np.bincount(inverse, np.concatenate([sent_counts[i][k] for i in cells_of]), len(at)) for k in range(len(own))]
            out.append(pack_counts(*(c[at] for c in replies)))
            picked = at[subset(own)] if subset else at[:0]
            some.append(pack_counts(*(c[picked] for c in some_replies)) if len(picked) else None)
        part = table.column("part")[0].as_py()
        n = len(by) + 1
        cells = [pa.array([*by, None], pa.int64()), pa.array([part] * n, pa.int32()), pa.array([*out, None], pa.binary()), pa.array([*some, None], pa.binary()), pa.array([None] * (n - 1) + [stat(keys, sums)], pa.list_(pa.int64()))]
        return pa.Table.from_arrays(cells, ["block", "part", "counts", "some", "stats"])

    return stored(sent.groupBy("name").applyInArrow(merge, "block long, part int, counts binary, some binary, stats array<long>"), name)


def answered(table: pa.Table, column: str = "counts") -> list[np.ndarray]:
    """The columns of counts (or some) for all of a block's distinct keys that they are for, in their order, from its rows of answer()."""
    rows = sorted(zip(table.column("part").to_pylist(), table.column(column).to_pylist(), strict=True))
    return [np.concatenate(c) for c in zip(*(unpack_counts(x) for _, x in rows), strict=True)]
