"""What several operators share: the shared folder, Arrow batches, words and shingle hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bounds of one Arrow batch on its way to Python; one row may be larger.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Pieces of text that a worker keeps at most, in two lots.
CACHE_WORDS = 300_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (as in tests) gets a
    temporary one; on a cluster that would be a folder of the driver alone, so there it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        path = context.getCheckpointDir()
    return path.rstrip("/")


#: The list that collects the paths of stored tables, inside begun().
_BEGUN: ContextVar[list[str] | None] = ContextVar("begun", default=None)


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read back: this cuts its lineage, and lost executors cost
    nothing that was written. The files go when the application ends, or by drop_tables()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, fs = _place(spark, path)
    fs.deleteOnExit(place)
    if (begun_here := _BEGUN.get()) is not None:
        begun_here.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def begun() -> Iterator[list[str]]:
    """Collects the paths of the tables that this thread stores meanwhile; those that are left in the list go on to the list around it."""
    outer = _BEGUN.get()
    token = _BEGUN.set(tables := [])
    try:
        yield tables
    finally:
        _BEGUN.reset(token)
        if outer is not None:
            outer.extend(tables)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes stored tables. No DataFrame that reads them may be run any more."""
    for path in paths:
        place, fs = _place(spark, path)
        fs.delete(place, True)
    paths.clear()


def bound_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker gets at once by bytes and not by rows alone, as texts may be long. These are settings of the
    session, which Spark reads when it plans an action; they only bound the size of batches, never what comes out."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Names for columns that df doesn't have yet, one for each stem; upper and lower case count as the same."""
    taken, names = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def unused_prefix(df: DataFrame, prefix: str) -> str:
    """prefix, longer if columns of df begin with it."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix += "_"
    return prefix


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """df's schema with more fields at its end."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: A-Z in lower case, every other byte as it is.
LOWER = bytes(range(256)).lower()


class Words(NamedTuple):
    """The words of some texts: the distinct ones, of each word in order which of them it is, and how many each text has."""

    distinct: np.ndarray
    codes: np.ndarray
    counts: np.ndarray

    def hashes(self) -> np.ndarray:
        """64-bit hashes of all words in order."""
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.distinct), np.uint64, len(self.distinct))[self.codes]


def split_words(column: pa.Array | pa.ChunkedArray | list[bytes], table: bytes | None = LOWER) -> Words:
    """Words between ASCII white space, after each byte went through table, if any, which must map ASCII to ASCII and leave the
    rest. A null is a text without words. Python handles each distinct word only once."""
    if isinstance(column, list):
        column = pa.array(column, pa.binary())
    elif isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.binary()), b"")
    _, offsets, data = column.buffers()
    if table and data:
        data = pa.py_buffer(data.to_pybytes().translate(table))
    column = pa.Array.from_buffers(pa.string(), len(column), [None, offsets, data], 0, column.offset)
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(column))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # a text without words is split into one empty word
    if len(nothing := np.flatnonzero(distinct == b"")):
        starts = np.cumsum(counts) - counts
        counts[codes[starts] == nothing[0]] = 0
        codes = codes[codes != nothing[0]]
    return Words(distinct, codes, counts)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values. Sorting is several times as fast as numpy's table of integers."""
    ordered = np.sort(values)
    return ordered[np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]))]


def places(values: np.ndarray) -> np.ndarray:
    """Of each value its place among the sorted distinct ones."""
    order = np.argsort(values)
    ordered = values[order]
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(np.concatenate((np.zeros(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1])))
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def joined_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n successive word hashes; empty if there are fewer."""
    if len(h) < n:
        return h[:0]
    out = h[: len(h) - n + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = mixed(out + np.uint64(0x9E3779B97F4A7C15)) + h[k : len(h) - n + 1 + k]
    return mixed(out)
