"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item gives windows: each run of 10 successive words, or the whole item if it has fewer. A window is a set of
shingles (5 successive words; all of a shorter window). Documents are split into words once: what is kept of each is where it
has shingles of the benchmark, and the words there, as far as they run long enough for a window. Ordered by rarity in
the corpus, a window that must be contained whole needs only the first of its shingles as join prefix: a document without
that shingle can't contain the window. Where a document has it, position and length tell the one place where the window
could lie (positional and length bounds); the words there are then compared one by one.

A benchmark of any size is taken in rounds of bounded numbers of windows, with a write to the shared folder in each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import begun, bound_batches, drop_tables, joined_hashes, split_words, stored, unused, unused_prefix, with_fields

WINDOW, SHINGLE = 10, 5
#: Words are ASCII letters (A-Z in lower case) and digits and everything beyond ASCII; other bytes become white space.
WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c > 0x7F or chr(c).isalnum() else 0x20 for c in range(256))
#: So many windows of items go to every task at once (some 500 bytes each, so 100 MB; one of over WINDOW_BYTES counts for
#: as many as it is long); a larger benchmark is taken in rounds, each with a pass over the documents.
WINDOWS_AT_ONCE, WINDOW_BYTES = 200_000, 200
#: Places of the table that tells most shingles of documents from those of the benchmark: 2 ** TABLE_BITS.
TABLE_BITS = 22


class Windows:
    """Distinct windows with their items, and for each shingle size the hashes of all their shingles."""

    def __init__(self, pairs: list[tuple[bytes, str | None]]) -> None:
        at: dict[bytes, set] = {}
        for window, item in pairs:
            at.setdefault(window, set()).add(item)
        joined = sorted(at)
        self.words = [w.split(b" ") for w in joined]
        self.items = [at[w] for w in joined]
        split = split_words(joined, None)
        hashes = np.split(split.hashes(), np.cumsum(split.counts)[:-1]) if joined else []
        rows: dict[int, list] = {}
        self.shortest: dict[int, int] = {}
        for k, h in enumerate(hashes):
            n = min(SHINGLE, len(h))
            rows.setdefault(n, []).extend((x, k, i) for i, x in enumerate(joined_hashes(h, n).tolist()))
            self.shortest[n] = min(self.shortest.get(n, WINDOW), len(h))
        self.rows = rows
        #: Sorted distinct hashes by shingle size; a shingle's number is its place in all of these one after the other.
        self.keys = {n: np.unique(np.array([x[0] for x in r], np.uint64)) for n, r in sorted(rows.items())}
        self.first = dict(zip(self.keys, np.cumsum([0, *map(len, self.keys.values())]).tolist(), strict=False))

    def prefixes(self, counts: dict[int, int]) -> dict[int, dict[int, list[tuple[int, int]]]]:
        """By shingle size: of each window's rarest shingle its hash, and the (window, offset) pairs that it stands for.
        counts: how often the corpus has a shingle, by its number. A window with a shingle that no document has can't occur."""
        out = {}
        for n, rows in self.rows.items():
            best: dict[int, tuple] = {}
            for h, k, i in rows:
                rank = (counts.get(self.first[n] + int(np.searchsorted(self.keys[n], np.uint64(h))), 0), h, i)
                if k not in best or rank < best[k]:
                    best[k] = rank
            by = out[n] = {}
            for k, (count, h, i) in best.items():
                if count:
                    by.setdefault(h, []).append((k, i))
        return out


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Stored: the distinct pairs (window: its words with one space between, item: the item's id as string), and weight."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split, at = split_words(b.column(1), WORD_BYTES), 0
            for item, n in zip(b.column(0).to_pylist(), split.counts.tolist(), strict=True):
                words = split.distinct[split.codes[at : at + n]].tolist()
                at += n
                windows = [b" ".join(words[i : i + WINDOW]) for i in range(max(1, n - WINDOW + 1) if n else 0)]
                yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array([item] * len(windows), pa.string())], ["window", "item"])

    pairs = rows.mapInArrow(run, "window binary, item string").distinct()
    return stored(pairs.withColumn("weight", 1 + F.floor(F.octet_length("window") / WINDOW_BYTES)), "windows")


def _rounds(pairs: DataFrame) -> Iterator[tuple[Windows, bool]]:
    """All windows, some WINDOWS_AT_ONCE at a time by a hash of window and item, so that neither a long item nor a window of many
    items is too much for a round, and whether it is the last; one round at least."""
    weight = pairs.agg(F.sum("weight")).first()[0] or 0
    rounds = max(1, -(-weight // WINDOWS_AT_ONCE))
    for r in range(rounds):
        own = pairs.filter(F.pmod(F.xxhash64("window", "item"), F.lit(rounds)) == r)
        yield Windows([(bytes(x.window), x.item) for x in own.select("window", "item").collect()]), r == rounds - 1


def _runs(covered: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of covered words within one text."""
    edge = np.concatenate(([True], text[1:] != text[:-1], [True]))
    before, after = np.concatenate(([False], covered[:-1])), np.concatenate((covered[1:], [False]))
    return np.flatnonzero(covered & (~before | edge[:-1])), np.flatnonzero(covered & (~after | edge[1:])) + 1


def _probed(docs: DataFrame, text: str, kept: list[str], windows: Windows, names: list[str]) -> DataFrame:
    """docs' columns kept, and the columns names: words (long), found (the numbers of the windows' shingles that a text has,
    each as often as it has it) and pieces (start and words of the runs that may hold a window)."""
    shared = docs.sparkSession.sparkContext.broadcast((windows.keys, windows.first, windows.shortest))
    schema = with_fields(docs.select(*kept), f"`{names[0]}` long, `{names[1]}` array<int>, `{names[2]}` array<struct<start:int,words:binary>>")
    piece = pa.struct([("start", pa.int32()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_keys, first, shortest = shared.value
        tables = {}
        for n, keys in all_keys.items():
            tables[n] = np.zeros(1 << TABLE_BITS, bool)
            tables[n][keys >> np.uint64(64 - TABLE_BITS)] = True
        for b in batches:
            split = split_words(b.column(text), WORD_BYTES)
            h, ends = split.hashes(), np.cumsum(split.counts)
            of = np.repeat(np.arange(len(ends)), split.counts)
            left = ends[of] - np.arange(len(of))
            covered = np.zeros(len(of), bool)
            at_all, number = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for n, keys in all_keys.items():
                grams = joined_hashes(h, n)
                at = np.flatnonzero(tables[n][grams >> np.uint64(64 - TABLE_BITS)] & (left[: len(grams)] >= n))
                key = np.minimum(np.searchsorted(keys, grams[at]), len(keys) - 1)
                same = keys[key] == grams[at]
                at, key = at[same], key[same]
                at_all.append(at)
                number.append(key + first[n])
                mark = np.zeros(len(of) + 1, np.int32)
                np.add.at(mark, at, 1)
                np.add.at(mark, at + n, -1)
                for a, z in zip(*_runs(np.cumsum(mark[:-1]) > 0, of), strict=True):
                    if z - a >= shortest[n]:
                        covered[a:z] = True
            at, number = np.concatenate(at_all), np.concatenate(number)
            order = np.argsort(of[at], kind="stable")
            found = pa.ListArray.from_arrays(pa.array(np.searchsorted(of[at][order], np.arange(len(ends) + 1)), pa.int32()), pa.array(number[order], pa.int32()))
            starts, stops = _runs(covered, of)
            words = [b" ".join(split.distinct[split.codes[a:z]]) for a, z in zip(starts.tolist(), stops.tolist(), strict=True)]
            begin = starts - (ends - split.counts)[of[starts]]
            pieces = pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(words, pa.binary())], fields=list(piece))
            pieces = pa.ListArray.from_arrays(pa.array(np.searchsorted(of[starts], np.arange(len(ends) + 1)), pa.int32()), pieces)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(split.counts), found, pieces], [*kept, *names])

    return docs.mapInArrow(run, schema)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _verified(probed: DataFrame, windows: Windows, prefixes: dict, kept: list[str], pieces_col: str, new: list[str]) -> DataFrame:
    """probed's columns kept, and items and spans (the columns new): what they had from earlier rounds, and what the prefixes find."""
    shared = probed.sparkSession.sparkContext.broadcast((windows.words, windows.items, prefixes))
    schema = with_fields(probed.select(*kept), f"`{new[0]}` array<string>, `{new[1]}` array<struct<start:int,end:int>>")
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_words, all_items, by_size = shared.value
        for b in batches:
            items, spans = b.column(new[0]).to_pylist(), b.column(new[1]).to_pylist()
            for row, pieces in enumerate(b.column(pieces_col).to_pylist()):
                got, inside = set(items[row]), [(s["start"], s["end"]) for s in spans[row]]
                for piece in pieces:
                    words, begin = piece["words"].split(b" "), piece["start"]
                    h = split_words([piece["words"]], None).hashes()
                    for n, places in by_size.items():
                        for at, key in enumerate(joined_hashes(h, n).tolist()):
                            for k, offset in places.get(key, ()):
                                start, window = at - offset, all_words[k]
                                if start >= 0 and words[start : start + len(window)] == window:
                                    inside.append((begin + start, begin + start + len(window)))
                                    got |= all_items[k]
                if pieces:
                    items[row] = sorted(x for x in got if x is not None)
                    spans[row] = [{"start": a, "end": z} for a, z in _merged(inside)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(span))], [*kept, *new])

    return probed.mapInArrow(run, schema)


def find_windows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", prefix: str = "hit_", keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or those of keep) as they are, with the columns <prefix>words (long), <prefix>n (long: words inside an
    occurrence of a window), <prefix>items (array of the items, as sorted strings, that have an occurring window) and
    <prefix>spans (array of start and end words of hit runs, end exclusive). One row per input row.

    A null or empty text has no words. Items with one text, and repeated rows of one item, count once; an item without words, and
    an empty benchmark, hit nothing; a window of an item without id hits, but isn't in the items. Columns of docs that have one of
    the new names are replaced.
    """
    bound_batches(docs.sparkSession)
    new = [prefix + x for x in ("words", "n", "items", "spans")]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    text, n_words, found, pieces, items, spans = unused(docs.select(*keep), "t", "n_words", "found", "pieces", "items", "spans")
    rows = docs.select(*keep, F.col(text_col).cast("string").alias(text), F.array().cast("array<string>").alias(items), F.array().cast("array<struct<start:int,end:int>>").alias(spans))
    before: list[str] = []
    with begun() as tables:
        pairs = benchmark_windows(benchmark, item_col, item_text_col)
    for windows, last in _rounds(pairs):
        carried = [*keep, items, spans] if last else [*keep, text, items, spans]
        with begun() as stored_now:
            probed = stored(_probed(rows.drop(n_words), text, carried, windows, [n_words, found, pieces]), "probed")
        drop_tables(docs.sparkSession, before)
        counts = {r.k: r.c for r in probed.select(F.explode(found).alias("k")).groupBy("k").agg(F.count("*").alias("c")).collect()}  # of the round's shingles at most
        rows = _verified(probed, windows, windows.prefixes(counts), [c for c in carried if c not in (items, spans)] + [n_words], pieces, [items, spans])
        before = stored_now
    drop_tables(docs.sparkSession, tables)
    size = lambda s: (s["end"] - s["start"]).cast("long")
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + size(s))
    return rows.select(*keep, F.col(n_words).alias(new[0]), hit.alias(new[1]), F.col(items).alias(new[2]), F.col(spans).alias(new[3]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without those that have a window of the benchmark, columns as they were. See find_windows for nulls, empty texts and
    tables and repeated rows; each row is judged by its own text."""
    prefix = unused_prefix(docs, "hit_")
    return find_windows(docs, benchmark, text_col, prefix=prefix).filter(F.col(f"{prefix}n") == 0).select(*docs.columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the benchmark every document has."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_windows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return found.select(
        "doc_id",
        F.col("hit_words").alias("n_words"),
        F.col("hit_n").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("hit_n") > 0).alias("contaminated"),
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = {
    "op10_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i : i + least(len(w), {WINDOW}) - 1] AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM win),
pos AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, w[i : i + n - 1] AS g FROM pos) x JOIN win USING (g)),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""
}
