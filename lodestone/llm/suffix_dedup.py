"""Removing repeated byte strings by suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id. Suffixes of a whole corpus can't meet in one
place, so each window of LENGTH bytes is dealt to the rarest-looking of its grams: the one whose hash is smallest. Equal windows have
the same smallest gram, so they meet; neighbouring windows mostly share it and travel as one stretch of text.

1. Blocks of documents count in how many documents each smallest gram occurs (see blocks.py). A gram of a single document repeats nothing.
2. Blocks send their stretches under shared grams, each distinct one once with its smallest id. A gram of at least twice FINE documents is cut finer:
   every window goes by itself, dealt by all its bytes, so what thousands of documents share, and where they part, is spread.
3. A part joins the stretches of each gram to a text, sorts its suffixes by Lyndon grouping (see suffix_arrays.py) and walks along them: windows
   with the same LENGTH bytes are neighbours there. Every window gets the smallest id that has it, and each block its answers.
4. Blocks cover the bytes of their documents and cut them out.

Grams only bring windows together; what is equal is decided by bytes, so results are exact.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import answer, answered, part_names, send_keys, with_blocks
from .common import bound_batches, distinct, mixed, places, stored, texts
from .suffix_arrays import suffix_arrays

LENGTH = 50
#: A gram of at least twice so many documents has its windows dealt one by one.
FINE = 64
#: Bits of a gram's hash, windows of a stretch, bytes that are hashed at once, and symbols of the texts that are sorted side by side.
KEY_BITS, STRETCH, SLICE, SIDE_BY_SIDE = 52, 64, 128 << 10, 1 << 20
MASK = ~np.uint64((1 << (64 - KEY_BITS)) - 1)
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k bytes, by putting together ever longer ones that may overlap."""
    h, m = _BYTE[x], 1
    with np.errstate(over="ignore"):
        while m < k:
            step = min(m, k - m)
            h = h[:-step] * np.uint64(0x9FB21C651E98DF25) + h[step:]
            h ^= h >> np.uint64(29)
            m += step
    return h


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    m = 1
    while m < width:
        step = min(m, width - m)
        h = np.minimum(h[:-step], h[step:])
        m += step
    return h


class Stretches(NamedTuple):
    """Runs of windows with one smallest gram: its key, where the run starts in the joined texts, its number of windows, and its text's number."""

    key: np.ndarray
    start: np.ndarray
    n: np.ndarray
    text: np.ndarray


def stretches(raw: list[bytes], length: int) -> Stretches:
    gram = max(1, length // 2 - 1)
    found: list[tuple[np.ndarray, ...]] = []
    at = i = 0
    while i < len(raw):
        size, first = len(raw[i]), i
        i += 1
        while i < len(raw) and size + len(raw[i]) <= SLICE:
            size += len(raw[i])
            i += 1
        if size >= length:
            n = np.array([len(r) for r in raw[first:i]])
            low = _smallest(gram_hashes(np.frombuffer(b"".join(raw[first:i]), np.uint8), gram), length - gram + 1)
            text = np.repeat(np.arange(len(n)), n)[: len(low)]
            inside = np.arange(len(low)) + length <= np.cumsum(n)[text]
            new = np.concatenate(([True], (low[1:] != low[:-1]) | (text[1:] != text[:-1]))) & inside
            start = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            count = np.bincount(run[inside], minlength=len(start)) if len(start) else start
            if len(start) and count.max() > STRETCH:
                pieces = -(-count // STRETCH)
                nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                count = np.minimum(np.repeat(count, pieces) - nth * STRETCH, STRETCH)
                start = np.repeat(start, pieces) + nth * STRETCH
            found.append((mixed(low[start]) & MASK, start + at, count, text[start] + first))
        at += size
    if not found:
        return Stretches(np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
    return Stretches(*map(np.concatenate, zip(*found, strict=True)))


def _block_keys(length: int):
    def keys_of(_: dict[str, list], raw: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The distinct grams and the number of texts with each."""
        found = stretches(raw, length)
        order = np.argsort(found.key, kind="stable")
        key, text = found.key[order], found.text[order]
        new = np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))
        starts = np.flatnonzero(new)
        other = new | np.concatenate((np.ones(min(1, len(key)), bool), text[1:] != text[:-1]))
        return key[starts], [np.add.reduceat(other, starts, dtype=np.int64) if len(starts) else starts]

    return keys_of


def _pack(*arrays: object) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, 5))


def _unpack(data: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))  # noqa: S301  written by this module


class _Shared:
    """What a block has under shared grams. items: its distinct strings (stretches, or single windows of frequent grams), in an order that doesn't
    depend on that of the rows, with their part, key and smallest id; and the places that each stretch of the block takes its answers from."""

    def __init__(self, ids: np.ndarray, raw: list[bytes], shared: pa.Table, length: int, parts: int) -> None:
        found = stretches(raw, length)
        joined = b"".join(raw)
        level = np.zeros(0, np.int64)
        if len(found.key):
            (counts,) = answered(shared)
            level = counts[places(found.key)]
        kept = level > 0
        key, start, n, text, level = found.key[kept], found.start[kept], found.n[kept], found.text[kept], level[kept]
        number: dict[bytes, int] = {}
        take = number.setdefault
        which = np.fromiter((take(joined[a:z], len(number)) for a, z in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)), np.int64, len(start))
        strings = list(number)
        first = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(first, which, ids[text])
        key_of, fine = np.zeros(len(strings), np.uint64), np.zeros(len(strings), bool)
        key_of[which], fine[which] = key, level > FINE.bit_length() - 1
        # windows of frequent grams go one by one
        windows: dict[bytes, int] = {}
        took = windows.setdefault
        cut = np.flatnonzero(fine)
        window_of = [[took(s[o : o + length], len(windows)) for o in range(len(s) - length + 1)] for s in (strings[i] for i in cut.tolist())]
        whole = np.flatnonzero(~fine)
        items = [*(strings[i] for i in whole.tolist()), *windows]
        least = np.full(len(windows), np.iinfo(np.int64).max)
        sizes = np.array([len(w) for w in window_of], np.int64)
        window_of = np.array([x for w in window_of for x in w], np.int64)
        np.minimum.at(least, window_of, np.repeat(first[cut], sizes))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, items), np.uint64, len(items))
        keys = mixed(np.concatenate([key_of[whole], hashes[len(whole) :]]))
        order = np.lexsort((hashes, keys))
        self.items, self.keys = [items[i] for i in order.tolist()], keys[order]
        self.part = (((self.keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        self.least = np.concatenate([first[whole], least])[order]
        place = np.empty(len(items), np.int64)
        place[order] = np.arange(len(items))
        # where each distinct string's windows are: all of one item, or each an item of its own
        self.fine, self.item = fine, np.zeros(len(strings), np.int64)
        self.item[whole], self.item[cut] = place[: len(whole)], np.cumsum(sizes) - sizes
        self.single = place[len(whole) + window_of]
        self.which, self.start, self.n, self.text, self.ids = which, start, n, text, ids

    def sent(self) -> Iterator[tuple[int, bytes]]:
        if not self.items:
            return
        edges = np.flatnonzero(np.concatenate((np.ones(min(1, len(self.part)), bool), self.part[1:] != self.part[:-1])))
        for a, z in zip(edges.tolist(), [*edges[1:].tolist(), len(self.part)], strict=True):
            yield int(self.part[a]), _pack((self.keys[a:z] & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.array([len(x) for x in self.items[a:z]], np.uint8), b"".join(self.items[a:z]), self.least[a:z])

    def windows(self, replies: list[tuple[int, bytes]], length: int) -> np.ndarray:
        """Where in the joined texts a window starts that a smaller id has."""
        if not len(self.which):
            return np.empty(0, np.int64)
        runs, spans, values = (np.concatenate(c) for c in zip(*(_unpack(x) for _, x in sorted(replies)), strict=True))
        least = np.repeat(values, spans)
        sizes = np.array([len(x) - length + 1 for x in self.items])
        begin = np.cumsum(sizes) - sizes
        which = np.repeat(self.which, self.n)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        at, fine = self.item[which], self.fine[which]
        window = np.where(fine, 0, begin[np.where(fine, 0, at)] + inner)
        window[fine] = begin[self.single[at[fine] + inner[fine]]]
        smaller = least[window] < np.repeat(self.ids[self.text], self.n)
        return (np.repeat(self.start, self.n) + inner)[smaller]


def window_minima(keys: np.ndarray, items: list[bytes], least: np.ndarray, length: int) -> np.ndarray:
    """Of every window of the distinct items, one after the other, the smallest of the ids (least) of all items of its key that have it."""
    sizes = np.array([len(x) - length + 1 for x in items], np.int64)
    found = np.repeat(least, sizes)
    begin = np.cumsum(sizes) - sizes
    order = np.argsort(keys, kind="stable")
    edges = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), keys[order[1:]] != keys[order[:-1]])))
    groups = [(order[a:z], sum(len(items[i]) + 1 for i in order[a:z].tolist())) for a, z in zip(edges, np.append(edges[1:], len(order)), strict=True) if z - a > 1]
    groups.sort(key=lambda g: g[1])
    batch, size = [], 0
    for k, (group, n) in enumerate(groups):
        batch.append(group)
        size += n
        if size >= SIDE_BY_SIDE or k == len(groups) - 1:
            _sorted_minima(batch, items, begin, sizes, found, length)
            batch, size = [], 0
    return found


def _sorted_minima(groups: list[np.ndarray], items: list[bytes], begin: np.ndarray, sizes: np.ndarray, found: np.ndarray, length: int) -> None:
    own = np.concatenate(groups)
    raw = np.frombuffer(b"\0".join([*(items[i] for i in own.tolist()), b""]), np.uint8)
    lengths = sizes[own] + length  # with the byte behind each item
    stops = np.cumsum(lengths)
    ends = stops[np.cumsum([len(g) for g in groups]) - 1]
    x = raw.astype(np.int64) + 2
    x[stops - 1] = 1
    x[ends - 1] = 0
    suffixes = suffix_arrays(x, ends)
    # which window of found a suffix is; none where it is shorter than a window
    window = np.full(len(x), -1, np.int64)
    inner = np.arange(sizes[own].sum()) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])
    window[np.repeat(stops - lengths, sizes[own]) + inner] = np.repeat(begin[own], sizes[own]) + inner
    suffixes = suffixes[window[suffixes] >= 0]
    same = np.flatnonzero(np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))[suffixes[1:]] == np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))[suffixes[:-1]])
    wide = np.lib.stride_tricks.sliding_window_view(raw, 8) if len(raw) >= 8 else None
    word = np.ascontiguousarray(wide).view(np.uint64).ravel() if wide is not None and length >= 8 else None
    for d in [*range(0, length - 7, 8), length - 8] if word is not None else range(length):
        y = word if word is not None else raw
        same = same[y[suffixes[same] + d] == y[suffixes[same + 1] + d]]
    new = np.ones(len(suffixes), bool)
    new[same + 1] = False
    starts = np.flatnonzero(new)
    at = window[suffixes]
    found[at] = np.repeat(np.minimum.reduceat(found[at], starts), np.diff(np.append(starts, len(at))))


def _answers(table: pa.Table, length: int) -> pa.Table:
    """A part's answers to its blocks: of each item in the order sent, the number of runs of windows with one smallest id, the runs' lengths and ids.
    Keys come with 32 bits; two that share them are sorted as one."""
    number: dict[bytes, int] = {}
    take = number.setdefault
    sent, keys, least = [], [], []
    for data in table.column("payload").to_pylist():
        own_keys, lengths, joined, own_least = _unpack(data)
        stops = np.cumsum(lengths, dtype=np.int64)
        sent.append(np.fromiter((take(joined[a:z], len(number)) for a, z in zip((stops - lengths).tolist(), stops.tolist(), strict=True)), np.int64, len(stops)))
        keys.append(own_keys)
        least.append(own_least)
    items = list(number)
    every = np.concatenate(sent)
    key = np.zeros(len(items), np.uint32)
    key[every] = np.concatenate(keys)
    first = np.full(len(items), np.iinfo(np.int64).max)
    np.minimum.at(first, every, np.concatenate(least))
    minima = window_minima(key, items, first, length)
    sizes = np.array([len(x) - length + 1 for x in items], np.int64)
    begin = np.cumsum(sizes) - sizes
    new = np.concatenate(([True], minima[1:] != minima[:-1]))
    new[begin] = True
    at = np.flatnonzero(new)
    spans = np.diff(np.append(at, len(minima)))
    runs = np.add.reduceat(new, begin, dtype=np.int64)
    run_begin = np.cumsum(runs) - runs
    out = []
    for own in sent:
        n = runs[own]
        flat = np.repeat(run_begin[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out.append(_pack(n.astype(np.uint8), spans[flat].astype(np.uint8), minima[at[flat]]))
    return pa.Table.from_arrays([table.column("block").combine_chunks(), table.column("part").combine_chunks(), pa.array(out, pa.binary())], ["block", "part", "payload"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per input row: id_col, n_bytes, spans (array of start and end: the maximal runs of bytes that go, in UTF-8 bytes) and kept (binary:
    the remaining bytes, joined).

    A byte goes if it is covered by a string of `length` bytes that also starts in a row with a smaller id (a whole number). Matches lie inside one text, and
    are judged on the input. A null text is empty. Rows without id neither lose bytes nor take any from others; rows that share an id don't
    take any from each other. Texts of any length are taken whole. Cuts may lie inside a character, so kept is binary. An empty table
    gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = with_blocks(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col)
    named = rows.withColumn("t", F.when(F.col("id").isNotNull(), F.col("t")))
    log2 = lambda _, sums: [np.where(sums[0] > 1, np.frexp(sums[0].astype(np.float64))[1] - 1, 0)]
    shared = answer(send_keys(named, [], _block_keys(length)), log2, lambda keys, sums: [], "shared-grams").filter("block IS NOT NULL").select("block", "part", "counts")
    names = part_names(rows)

    def read(texts_of: pa.Table, shared_of: pa.Table) -> tuple[list[bytes], _Shared]:
        raw, ids = texts(texts_of.column("t")), texts_of.column("id")
        blank = ids.is_null().to_pylist()
        named_texts = [b"" if no else r for r, no in zip(raw, blank, strict=True)]
        return raw, _Shared(ids.fill_null(0).to_numpy().astype(np.int64), named_texts, shared_of, length, len(names))

    def send(_: tuple, texts_of: pa.Table, shared_of: pa.Table) -> pa.Table:
        sent = list(read(texts_of, shared_of)[1].sent()) if texts_of.num_rows else []
        block = texts_of.column("block")[0].as_py() if sent else None
        cells = [pa.array([block] * len(sent), pa.int64()), pa.array([p for p, _ in sent], pa.int32()), pa.array([names[p] for p, _ in sent], pa.int32()), pa.array([x for _, x in sent], pa.binary())]
        return pa.Table.from_arrays(cells, ["block", "part", "name", "payload"])

    sent = rows.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(send, "block long, part int, name int, payload binary")
    replies = stored(sent.groupBy("name").applyInArrow(lambda t: _answers(t, length), "block long, part int, payload binary"), "window-minima")
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def cut(_: tuple, texts_of: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts_of.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.list_(kind), pa.binary())], [id_col, "n_bytes", "spans", "kept"])
        mine = answers.column("payload").is_null()
        shared_of, replies_of = answers.filter(mine), answers.filter(answers.column("payload").is_valid())
        raw, own = read(texts_of, shared_of)
        windows = own.windows(list(zip(replies_of.column("part").to_pylist(), replies_of.column("payload").to_pylist(), strict=True)), length)
        # rows without an id count as empty there, so places are those of the other texts
        blank = texts_of.column("id").is_null().to_pylist()
        n = np.array([0 if no else len(r) for r, no in zip(raw, blank, strict=True)], np.int64)
        edge = np.zeros(int(n.sum()) + 1, np.int32)
        np.add.at(edge, windows, 1)
        np.add.at(edge, windows + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        spans, kept = [], []
        for r, a, z, no in zip(raw, (np.cumsum(n) - n).tolist(), np.cumsum(n).tolist(), blank, strict=True):
            g = gone[a:z]
            if no or not g.any():
                spans.append([])
                kept.append(r)
                continue
            turns = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0])))).tolist()
            spans.append([{"start": s, "end": e} for s, e in zip(turns[::2], turns[1::2], strict=True)])
            kept.append(b"".join(r[e:s] for e, s in zip([0, *turns[1::2]], [*turns[::2], len(r)], strict=True)))
        cells = [texts_of.column("id").combine_chunks(), pa.array([len(r) for r in raw], pa.int64()), pa.array(spans, pa.list_(kind)), pa.array(kept, pa.binary())]
        return pa.Table.from_arrays(cells, [id_col, "n_bytes", "spans", "kept"])

    none = F.lit(None).cast("binary")
    answers = shared.withColumn("payload", none).unionByName(replies.withColumn("counts", none))
    schema = f"`{id_col}` long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, schema)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what repeats from smaller ids."""
    found = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Windows as runs of two hexadecimal digits a byte, equal when their MD5 is.
ORACLE = {
    "op13_suffix_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, pos, md5_number(substr(h, 2 * pos + 1, {2 * LENGTH})) AS w FROM (SELECT *, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS pos FROM d)),
k AS (SELECT r, doc_id, pos, least FROM w JOIN (SELECT w, min(doc_id) AS least FROM w GROUP BY w) USING (w)),
g AS (SELECT r, pos, max(pos + {LENGTH}) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k WHERE least < doc_id),
n AS (SELECT r, pos, sum((reach IS NULL OR pos > reach)::INTEGER) OVER (PARTITION BY r ORDER BY pos) AS run FROM g),
s AS (SELECT r, run, min(pos) AS a, max(pos) + {LENGTH} AS z FROM n GROUP BY r, run),
o AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS last FROM s),
c AS (SELECT o.r, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM o JOIN d USING (r) GROUP BY o.r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN c USING (r)"""
}
