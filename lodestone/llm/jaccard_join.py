"""N-gram Jaccard self-join by grouped prefixes.

A document's set holds its distinct shingles of five words. Shingles are ordered by rarity in the whole corpus. Two sets can
only reach the threshold if their prefixes (in that order) share a shingle, so prefixes are joined; sets with identical
prefix and size act as one group there. Group pairs pass a size and a positional filter, then expand to their members,
which are verified on whole sets.

What is asked for are the components of the links, so pairs whose sets are known to be in one component need no look. First
every group is held against one pivot for each shingle (a star) and the links found are contracted to components; this
repeats with other pivots while it pays. Then all remaining pairs between different components are verified: nothing is
left out, yet a group of thousands of near copies costs thousands of pairs and not their square. Equal sets are one set
throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import answer, answered, pack_keys, send_keys, unpack_keys, with_blocks, with_places
from .common import bound_batches, distinct, joined_hashes, places, split_words, stored, unused
from .components import connected_components

SHINGLE = 5
#: Sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Bits of a shingle's hash that its rarity is counted by (equal bits make shingles seem less rare, no more), and that sets
#: are verified by.
RARITY_BITS, SET_BITS = 40, 56
#: Stars at most before the remaining pairs are all verified, and how many pairs a set that pays another star.
STARS, PAYS = 2, 4
#: Entries of a list that one task holds against the whole list; a longer list is dealt out.
LIST_PART = 2000


def shingle_sets(texts_of: pa.ChunkedArray | list[bytes]) -> list[np.ndarray]:
    """Each text's set as sorted distinct hashes; a text of fewer words has its whole sequence as one; without words it is empty."""
    split = split_words(texts_of)
    h, ends = split.hashes(), np.cumsum(split.counts).tolist()
    grams, out, a = joined_hashes(h, SHINGLE), [], 0
    for z in ends:
        n = z - a
        out.append(distinct(grams[a : z - SHINGLE + 1] if n >= SHINGLE else joined_hashes(h[a:z], n)) if n else h[:0])
        a = z
    return out


def _top(h: np.ndarray, bits: int) -> np.ndarray:
    return h & ~np.uint64((1 << (64 - bits)) - 1)


def least_overlap(n: int) -> int:
    """The least that a set of n must share with any set that it links to."""
    return -(-PERCENT * n // 100)


def _block_shingles(values: dict[str, list], raw: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    every = np.sort(np.concatenate([distinct(_top(x, RARITY_BITS)) for x in shingle_sets(raw)]))
    starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.empty(0, np.int64)
    return every[starts], [np.diff(np.append(starts, len(every)))]


def _levels(keys: np.ndarray, sums: list[np.ndarray]) -> list[np.ndarray]:
    """Rarity in one byte: the count up to 15, then four steps for each doubling."""
    df = sums[0]
    return [np.where(df < 16, df, np.minimum(255, 4 * np.log2(np.maximum(df, 1)))).astype(np.int64)]


def document_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stored, one row per input row: row (a unique number), id, n, and for rows that may link to others set_key (128 bits of hash,
    equal for equal sets); of each block's first row with a set also shingles (packed) and mid (how common its shingles are on average: in
    a family of copies the original's are the most), of its first with a prefix and size group (a hash of both) and prefix (of
    the prefix's shingles that others have too: hash and place)."""
    bound_batches(docs.sparkSession)
    rows = with_blocks(docs, id_col, text_col)
    counts = answer(send_keys(rows, [], _block_shingles), _levels, lambda keys, sums: [], "shingle-counts").filter("block IS NOT NULL").select("block", "part", "counts")
    id_type = docs.schema[id_col].dataType.simpleString()

    def sets(_: tuple, texts_of: pa.Table, counted: pa.Table) -> pa.Table:
        own = shingle_sets(texts_of.column("t")) if texts_of.num_rows else []
        rarities = [np.empty(0, np.int64)] * len(own)
        if counted.num_rows and own:
            rarities = np.split(answered(counted)[0][places(_top(np.concatenate(own), RARITY_BITS))], np.cumsum([len(h) for h in own])[:-1])
        out: list[tuple] = []
        # prefixes as arrays: where each row's begins (null: it has none), and all tokens and places
        begins, tokens, spots, size = [], [np.empty(0, np.int64)], [np.empty(0, np.int32)], 0
        seen_sets, seen_groups = set(), set()
        for h, rarity in zip(own, rarities, strict=True):
            n = len(h)
            begins.append(None)
            if not n or np.count_nonzero(rarity > 1) < least_overlap(n):
                out.append((n, None, None, None, None))
                continue
            set_key = xxhash.xxh3_128_digest(h.tobytes())
            if set_key in seen_sets:
                out.append((n, set_key, None, None, None))
                continue
            seen_sets.add(set_key)
            order = np.lexsort((h, rarity))[: n - least_overlap(n) + 1]
            group = xxhash.xxh3_128_digest(h[order].tobytes(), n)
            if group not in seen_groups:
                seen_groups.add(group)
                at = np.flatnonzero(rarity[order] > 1)
                begins[-1] = size
                tokens.append(h[order][at].view(np.int64))
                spots.append(at.astype(np.int32))
                size += len(at)
            out.append((n, set_key, group, int(1000 * rarity.mean()), pack_keys(distinct(_top(h, SET_BITS) >> np.uint64(64 - SET_BITS)))))
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
        n, set_key, group, mid, shingles = (pa.array(c, k) for c, k in zip(cols, kinds, strict=True))
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(spots))], ["token", "pos"])
        prefix = pa.ListArray.from_arrays(pa.array([*begins, size], pa.int32()), pairs)
        return pa.Table.from_arrays([texts_of.column("id").combine_chunks(), n, set_key, group, prefix, mid, shingles], ["id", "n", "set_key", "group", "prefix", "mid", "shingles"])

    schema = f"id {id_type}, n int, set_key binary, group binary, prefix array<struct<token:long,pos:int>>, mid int, shingles binary"
    found = rows.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(sets, schema)
    return stored(found.select(F.monotonically_increasing_id().alias("row"), "*"), "sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b: rows of sets) that link, by their whole sets. Stored."""
    whole = sets.filter("shingles IS NOT NULL").select("row", "shingles")
    both = pairs.join(whole.select(F.col("row").alias("a"), F.col("shingles").alias("x")), "a").join(whole.select(F.col("row").alias("b"), F.col("shingles").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                x, y = unpack_keys(x), unpack_keys(y)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stored(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


def _fits(a: str, b: str) -> Column:
    """Size and positional filter of two entries that share a token (n and pos are columns with the suffixes a and b): if it is the first
    that they share, no more than what is left of either set can follow. Sets that link always pass at their first shared token."""
    n1, p1, n2, p2 = (F.col(x + y) for y in (a, b) for x in ("n", "pos"))
    return _enough(F.least(n1 - p1, n2 - p2), n1, n2)


def _enough(most: Column, n1: Column, n2: Column) -> Column:
    """Whether sets of these sizes that share at most so many can link."""
    return (100 * F.least(n1, n2) >= PERCENT * F.greatest(n1, n2)) & ((100 + PERCENT) * most >= PERCENT * (n1 + n2))


def linked_sets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, components): members has one row for each distinct set that may link: set_key, group, n, s (the set's number,
    a row of sets); components has v (a set's number) and c (its component's) for sets that link to another."""
    some = sets.filter("shingles IS NOT NULL")
    members = stored(some.groupBy("set_key", "group", "n").agg(F.min("row").alias("s")), "members")
    entries = some.filter("prefix IS NOT NULL").select("group", "n", "mid", F.inline("prefix"))
    # a token may be in a third of all prefixes: what is known of a list is aggregated, stored and joined to it, so that Spark can deal a
    # long list out to several tasks
    lists = stored(entries.groupBy("token", "group").agg(*[F.min(x).alias(x) for x in ("n", "pos")], F.max("mid").alias("mid")), "prefix-entries")
    shared = stored(lists.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1").select("token"), "shared-tokens")
    lists = lists.join(shared, "token").withColumns({"c": F.lit(None).cast("long"), "rest": F.lit(False)})
    leader = members.groupBy("group").agg(F.min("s").alias("leader"), F.count("*").alias("sets"))
    lists = stored(lists, "prefix-lists")
    leader = stored(leader, "leaders")
    none = members.select(F.col("s").alias("a"), F.col("s").alias("b")).limit(0)
    # within a group the first star is that of its leader
    inner = members.join(leader.filter("sets > 1"), "group").filter("s <> leader").select(F.col("leader").alias("a"), F.col("s").alias("b"))
    links, components, remaining = none, None, lists
    for star in range(STARS):
        # at first the most central entry is a list's pivot; then any of its main component, and any outside it, in turn
        order = [F.col("mid")] if star == 0 else [(F.col("rest") == F.lit(star % 2 == 0)).cast("int")]
        pivot = F.max(F.struct(*[x.alias(f"o{i}") for i, x in enumerate([*order, F.xxhash64("group", F.lit(star))])], "group", "n", "pos", "c"))
        held = remaining.join(stored(remaining.groupBy("token").agg(pivot.alias("p")), "pivots"), "token").select("token", "group", "n", "pos", "c", *[F.col(f"p.{x}").alias(f"{x}2") for x in ("group", "n", "pos", "c")])
        held = held.filter("group <> group2 AND (c IS NULL OR c2 IS NULL OR c <> c2)").filter(_fits("", "2"))
        best = held.groupBy("group", "group2").agg(F.count("*").alias("k")).groupBy("group").agg(F.max_by("group2", F.struct("k", "group2")).alias("group2"))
        pairs = best.join(leader.select("group", F.col("leader").alias("b")), "group").join(leader.select(F.col("group").alias("group2"), F.col("leader").alias("a")), "group2").select("a", "b")
        links = links.union(verified(pairs.union(inner) if star == 0 else pairs, sets))
        components = connected_components(links)
        remaining, split, work = _remaining(lists.drop("c", "rest"), members, components)
        if work <= PAYS * max(1, leader.count()):
            break
    if work:
        links = links.union(verified(_all_pairs(remaining, split, members, components), sets))
        components = connected_components(links)
    return members, components


def _of_component(members: DataFrame, components: DataFrame) -> DataFrame:
    return members.join(components.select(F.col("v").alias("s"), "c"), "s", "left").select("s", "group", F.coalesce("c", "s").alias("c"))


def _remaining(lists: DataFrame, members: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The lists whose groups aren't all of one component, with c, each group's component (null: several), and rest, whether the group
    is outside its list's main component; the groups of several components, in a list or not; and how many pairs it takes to hold
    each such entry against its whole list, and the sets of each such group against each other."""
    by = _of_component(members, components).groupBy("group").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("sets"))
    by = stored(by, "group-components")
    split = by.filter("c1 <> c2").select("group", "sets")
    own = lists.join(by.select("group", F.when(F.col("c1") == F.col("c2"), F.col("c1")).alias("c")), "group")
    own = stored(own, "lists-components")
    # a list that is all of one component is done; a group of several components has pairs of its own
    size = own.groupBy("token", "c").agg(F.count("*").alias("in_c"))
    main = F.max_by("c", F.when(F.col("c").isNotNull(), F.struct("in_c", "c"))).alias("main")
    open_lists = size.groupBy("token").agg(main, F.count("*").alias("components"), F.sum("in_c").alias("size")).filter("components > 1 OR main IS NULL").drop("components")
    open_lists = stored(open_lists, "open-lists")
    mixed = own.join(open_lists, "token").withColumn("rest", F.col("c").isNull() | (F.col("c") != F.col("main"))).drop("main")
    mixed = stored(mixed, "mixed-lists")
    work = mixed.groupBy("token").agg((F.count("*") * F.count_if("rest")).alias("w")).agg(F.sum("w")).first()[0]
    inside = split.agg(F.sum(F.col("sets") * F.col("sets"))).first()[0]
    return mixed, split, int(work or 0) + int(inside or 0)


def _all_pairs(mixed: DataFrame, split: DataFrame, members: DataFrame, components: DataFrame) -> DataFrame:
    """All pairs of sets from different components that pass the filters. Sets of one group share its whole prefix and always pass.
    Between groups: every entry outside its list's main component against the whole list, each pair once. Two entries of the
    main component need no look. A pair of groups meets at all tokens that they share early enough in both; up to the last of
    these it is known how many they share, and the rest can't give more than what is left of either."""
    fields = ("group", "n", "pos", "c", "rest")
    # the entries of a long list are dealt to several tasks, and the whole list goes to each of these
    parts = F.ceil(F.col("size") / LIST_PART).cast("int")
    other = mixed.select("token", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), *[F.col(x).alias(f"{x}2") for x in fields])
    outside = mixed.filter("rest").withColumn("part", F.pmod(F.xxhash64("group"), parts).cast("int"))
    once = F.col("rest") & (~F.col("rest2") | (F.col("group") < F.col("group2"))) & (F.col("group") != F.col("group2"))
    apart = F.col("c").isNull() | F.col("c2").isNull() | (F.col("c") != F.col("c2"))
    near = outside.join(other, ["token", "part"]).filter(once & apart).filter(_fits("", "2"))
    low, high = F.col("group") <= F.col("group2"), F.col("group") > F.col("group2")
    of = lambda x: (F.when(low, F.col(x)).otherwise(F.col(f"{x}2")), F.when(high, F.col(x)).otherwise(F.col(f"{x}2")))
    (g, g2), (n, n2), (p, p2) = of("group"), of("n"), of("pos")
    met = near.select("token", g.alias("g"), g2.alias("g2"), n.alias("n"), n2.alias("n2"), p.alias("p"), p2.alias("p2"))
    met = met.groupBy("g", "g2").agg(F.count("*").alias("k"), *[F.max(x).alias(x) for x in ("n", "n2", "p", "p2")])
    groups = met.filter(_enough(F.col("k") + F.least(F.col("n") - F.col("p") - 1, F.col("n2") - F.col("p2") - 1), F.col("n"), F.col("n2"))).select("g", "g2")
    groups = groups.union(split.select(F.col("group").alias("g"), F.col("group").alias("g2")))
    sets = _of_component(members, components)
    left = sets.select(F.col("group").alias("g"), F.col("s").alias("a"), "c")
    right = sets.select(F.col("group").alias("g2"), F.col("s").alias("b"), F.col("c").alias("c2"))
    pairs = groups.join(left, "g").join(right, "g2").filter("c <> c2 AND (g <> g2 OR a < b)")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: row, id, n_shingles, component_id (the smallest id that its links reach, its own included), first
    (whether the row is the one that stands for its component).

    A null or empty text, or one without words, has an empty set, links to nothing and stands for itself. A null id is left out of
    the smallest; a component of such ids alone has a null component_id. Rows that share an id are rows of their own.
    """
    sets = document_sets(docs, id_col, text_col)
    members, components = linked_sets(sets)
    best = F.min(F.struct(F.col("id").isNull().alias("u"), "id", "row"))
    classes = sets.filter("set_key IS NOT NULL").groupBy("set_key").agg(best.alias("best"), F.count("*").alias("k"))
    number = members.groupBy("set_key").agg(F.min("s").alias("v"))
    # one component may have a third of all sets: as both sides of the join are stored, Spark can split it
    joined = stored(classes.join(number, "set_key").join(components, "v", "left").select("set_key", F.coalesce("c", "v").alias("c"), "best", "k"), "set-components")
    whole = stored(joined.groupBy("c").agg(F.min("best").alias("top"), F.sum("k").alias("k")).filter("k > 1"), "whole-components")
    named = stored(joined.select("set_key", "c").join(whole, "c").select("set_key", F.col("top.id").alias("component_id"), F.col("top.row").alias("first")), "named-sets")
    rows = sets.select("row", "id", F.col("n").cast("long").alias("n_shingles"), "set_key").join(named, "set_key", "left")
    return rows.select("row", "id", "n_shingles", F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce(F.col("first") == F.col("row"), F.lit(True)).alias("first"))


def dedup_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component (of the smallest id; a null id loses to any other), columns as they were. Rows are told apart by
    where they lie and not by their ids, so of repeated rows one stays too. Rows with a null or empty text, or one without words, all
    stay; an empty table gives an empty one."""
    key, file, at, lost_file, lost_at = unused(docs, "key", "file_hash", "row_at", "lost_file", "lost_at")
    placed = with_places(docs, file, at)
    # as a type of its own, so that its parts may be null, as those that come back from Python may
    kind = f"struct<u:boolean,id:{docs.schema[id_col].dataType.simpleString()},file:bigint,at:bigint>"
    keyed = placed.withColumn(key, F.struct(F.col(id_col).isNull(), F.col(id_col), F.col(file), F.col(at)).cast(kind))
    lost = jaccard_components(keyed, key, text_col).filter("NOT first").select(F.col("id.file").alias(lost_file), F.col("id.at").alias(lost_at))
    return placed.join(lost, (F.col(file) == F.col(lost_file)) & (F.col(at) == F.col(lost_at)), "left_anti").select(*docs.columns)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its set's size and its component."""
    found = jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


ORACLE = {
    "op6_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + least(len(w), {SHINGLE}) - 1], ' ')) AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE}, 0) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= {PERCENT} * (x.n + y.n - o)),
reach(d, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.d, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT d AS doc_id, min(r) AS component_id FROM reach GROUP BY d) c USING (doc_id)"""
}
