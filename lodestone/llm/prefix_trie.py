"""The trie of all prefixes of conversations.

Every conversation gets a chain of digests, each over the one before and the next turn, so a digest stands for a whole prefix.
Every prefix is a row; those of one (depth, digest) are a node. The smallest conversation of a node owns it. What an owner
has are the last prefixes of its conversation, one below the other: a chain that hangs below a node of another owner.

Sums over subtrees come from exploding to all ancestors. The nodes of a chain all have the chain's outer ancestors in common, so the
chain is summed first and exploded once to those; inside it, running sums from its end up do the same. That keeps
the rows as many as there are prefixes, where a row for each node and ancestor would be the square of a conversation's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, stored

ROOT = hashlib.sha256(b"").digest()
NOTHING = hashlib.sha256(b"").hexdigest()
#: Ids that are joined to one piece before they are hashed.
PIECE_IDS = 20_000


def turn_rows(conversations: DataFrame) -> DataFrame:
    """One row per input row: conv_id, at (0-based place in its conversation), turn_sha (SHA-256 of role and text) and n_bytes (of the text in UTF-8).

    Turns go in the order of turn (nulls first), then role, then text; a null role or text counts as empty. Repeated rows are turns of
    their own. Rows without conv_id belong to no conversation and are left out. Other columns are not read.
    """
    role, text = (F.encode(F.coalesce(F.col(c).cast("string"), F.lit("")), "UTF-8") for c in ("role", "text"))
    # the role's length goes first, so no two pairs of role and text give the same bytes
    sha = F.unhex(F.sha2(F.concat(F.encode(F.octet_length(role).cast("string"), "UTF-8"), F.encode(F.lit(":"), "UTF-8"), role, text), 256))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), sha.alias("turn_sha"), F.octet_length(text).cast("long").alias("n_bytes"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("at"), "turn_sha", "n_bytes")


def prefixes(turns: DataFrame) -> DataFrame:
    """Rows conv_id, depth, digest, above (the digest of the prefix before), n_bytes (of its last text) and ends (the conversation has no more turns): one
    for each prefix of each conversation, the empty one included.

    turns has conv_id, turn_sha, n_bytes and a sortable column at; a row with a null turn_sha only says that the conversation is there.
    A conversation's digests are one task's stream, in constant memory.
    """
    bound_batches(turns.sparkSession)
    names = ["conv_id", "depth", "digest", "above", "n_bytes", "ends"]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        last: list | None = None

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
            for c in out:
                c.clear()
            return batch

        def put(row: list) -> None:
            for c, x in zip(out, row, strict=True):
                c.append(x)

        for b in batches:
            for conv, sha, n in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn_sha", "n_bytes")), strict=True):
                if last is None or last[0] != conv:
                    if last:
                        put([*last[:5], True])
                    last = [conv, 0, ROOT, None, 0]
                if sha is not None:
                    put([*last, False])
                    last = [conv, last[1] + 1, hashlib.sha256(last[2] + sha).digest(), last[2], n]
            yield flush()
        if last:
            put([*last, True])
            yield flush()

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("at").asc_nulls_first())
    return ordered.select("conv_id", "turn_sha", "n_bytes").mapInArrow(run, "conv_id long, depth long, digest binary, above binary, n_bytes long, ends boolean")


def _streamed(spark: SparkSession, df: DataFrame, keys: list[str], value: str, start, add, done, field: str) -> DataFrame:
    """One row for each run of equal keys in df's partitions, which are sorted by them: keys and what done() makes of a state that add() was given the
    values."""
    bound_batches(spark)
    schema = ", ".join(f"{k} {t}" for k, t in df.select(*keys).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, types = None, None, None
        for b in batches:
            types = [b.schema.field(k).type for k in keys]
            found = []
            for *key, x in zip(*(b.column(c).to_pylist() for c in (*keys, value)), strict=True):
                if key != at:
                    if at is not None:
                        found += [(at, y) for y in done(state)]
                    at, state = key, start()
                found += [(at, y) for y in add(state, x)]
            if found:
                yield batch(found, types)
        if at is not None:
            yield batch([(at, y) for y in done(state)], types)

    def batch(found: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
        cols = [pa.array([k[i] for k, _ in found], t) for i, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([*cols, pa.array([x for _, x in found], pa.string())], [*keys, field])

    return df.select(*keys, value).mapInArrow(run, f"{schema}, {field} string")


def ends_hashes(ends: DataFrame) -> DataFrame:
    """From rows depth, digest and conv_id one row for each node: depth, digest, ends_sha256 (of its conv_ids as decimals, ascending, comma-joined).

    A node may have any number of ids: they are sorted over all tasks and joined to pieces there; hashing a node's pieces is one
    task's stream.
    """
    spark, keys = ends.sparkSession, ["depth", "digest"]

    def add(state: list, x: int) -> list[str]:
        state.append(str(x))
        if len(state) < PIECE_IDS:
            return []
        piece = ",".join(state)
        state.clear()
        return [piece]

    at = F.monotonically_increasing_id()
    sorted_ids = ends.repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id")
    pieces = _streamed(spark, sorted_ids, keys, "conv_id", list, add, lambda state: [",".join(state)] if state else [], "piece")
    pieces = stored(pieces.withColumn("at", at), "ends-pieces")

    def more(state: list, x: str) -> list[str]:
        state[0].update(f",{x}".encode() if state[1] else x.encode())
        state[1] = True
        return []

    together = pieces.repartition(*keys).sortWithinPartitions(*keys, "at")
    return _streamed(spark, together, keys, "piece", lambda: [hashlib.sha256(), False], more, lambda state: [state[0].hexdigest()], "ends_sha256")


def trie_nodes(rows: DataFrame) -> DataFrame:
    """One row per node: depth, digest, conv_id (its smallest conversation), parent_conv_id (the parent's; root: null), n_convs (conversations that
    begin with it), n_ends (those that end there), n_children, n_leaves and saved (over its subtree, itself included: nodes
    without children; and the sum of (n_convs - 1) times n_bytes).

    rows: what prefixes() gives, stored, as they are read twice. Equal conversations end at one node. An empty table has no nodes, not
    even a root.
    """
    nodes = rows.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("ends").cast("long")).alias("n_ends"), F.max("above").alias("above"), F.max("n_bytes").alias("n_bytes"))
    # a node has no children where all its conversations end
    own = [(F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("save")]
    nodes = stored(nodes.select("*", *own), "nodes")
    chains = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("leaf").alias("leaves"), F.sum("save").alias("saves"))
    zero = F.lit(0).cast("long")

    def part(df: DataFrame, depth: Column, digest: str, **cols: Column) -> DataFrame:
        named = {c: F.lit(None).cast(t) for c, t in (("conv_id", "long"), ("n_convs", "long"), ("n_ends", "long"), ("above", "binary"))} | {c: zero for c in ("leaf", "save", "children", "leaves", "saves")}
        return df.select(depth.alias("depth"), F.col(digest).alias("digest"), *(c.alias(k) for k, c in (named | cols).items()))

    itself = part(nodes, F.col("depth"), "digest", **{c: F.col(c) for c in ("conv_id", "n_convs", "n_ends", "above", "leaf", "save")})
    child = part(nodes.filter("depth > 0"), F.col("depth") - 1, "above", children=F.lit(1).cast("long"))
    outer = rows.join(chains, "conv_id").filter("depth < top")
    hanging = part(outer, F.col("depth"), "digest", leaves=F.col("leaves"), saves=F.col("saves"))
    sums = itself.unionAll(child).unionAll(hanging).groupBy("depth", "digest")
    summed = sums.agg(*(F.max(c).alias(c) for c in ("conv_id", "n_convs", "n_ends", "above")), *(F.sum(c).alias(c) for c in ("leaf", "save", "children", "leaves", "saves")))
    below = W.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, 0)
    top = F.col("depth") == F.min("depth").over(W.partitionBy("conv_id"))
    found = summed.select(
        "depth", "digest", "conv_id", "above", top.alias("top"), "n_convs", "n_ends", F.col("children").alias("n_children"),
        (F.sum("leaf").over(below) + F.col("leaves")).alias("n_leaves"), (F.sum("save").over(below) + F.col("saves")).alias("saved"),
    )
    # inside a chain the parent has the same owner; only a chain's top looks its parent's owner up
    owner = nodes.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("above"), F.col("conv_id").alias("other"))
    found = stored(found, "trie")
    tops = found.filter("top AND depth > 0").join(owner, ["depth", "above"]).withColumn("parent_conv_id", F.col("other"))
    rest = found.filter("NOT top OR depth = 0").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    names = ["depth", "digest", "conv_id", "parent_conv_id", "n_convs", "n_ends", "n_children", "n_leaves", "saved"]
    return tops.select(*names).unionAll(rest.select(*names))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """trie_nodes() of prefixes(turns), with ends_sha256 (see ends_hashes; of a node where no conversation ends, the hash of nothing)."""
    rows = stored(prefixes(turns), "prefixes")
    hashed = ends_hashes(rows.filter("ends").select("depth", "digest", "conv_id"))
    return trie_nodes(rows).join(hashed, ["depth", "digest"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))


def rebuilt(turns: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """turn_rows() with every conversation c rebuilt: the first h turns of conversation c - c % every, then its own without its first h; h is the unsigned
    crc32 of c as a decimal, modulo most. A conversation that is left without turns stays as one row without digest."""
    turns = stored(turns, "turns")
    c = F.col("conv_id")
    cut = F.pmod(F.crc32(F.encode(c.cast("string"), "UTF-8")), F.lit(most))
    convs = turns.filter("at = 0").select("conv_id", cut.alias("h"), (c - c % every).alias("base"))
    own = turns.withColumns({"h": cut, "base": c - c % every}).filter("base = conv_id OR at >= h").select("conv_id", F.struct(F.lit(1).alias("part"), "at").alias("at"), "turn_sha", "n_bytes")
    first = turns.filter(F.col("at") < most - 1).select(F.col("conv_id").alias("base"), "at", "turn_sha", "n_bytes")
    taken = convs.filter("base <> conv_id").join(first, "base").filter("at < h").select("conv_id", F.struct(F.lit(0).alias("part"), "at").alias("at"), "turn_sha", "n_bytes")
    there = convs.select("conv_id", F.lit(None).cast("struct<part:int,at:bigint>").alias("at"), F.lit(None).cast("binary").alias("turn_sha"), F.lit(None).cast("long").alias("n_bytes"))
    return own.unionAll(taken).unionAll(there)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    nodes = prefix_trie(rebuilt(turn_rows(conversations)))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


#: crc32 bit by bit, as DuckDB has none.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
ORACLE = {
    "op11_prefix_trie": f"""
WITH RECURSIVE t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS part, t.pos, role, text FROM c JOIN t ON t.conv_id = c.base WHERE t.pos < h
  UNION ALL SELECT c.conv_id, 1, t.pos, role, text FROM c JOIN t USING (conv_id) WHERE t.pos >= h),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM r),
p AS (
  SELECT conv_id, 0::BIGINT AS depth, '' AS key, NULL::VARCHAR AS above, 0::BIGINT AS bytes FROM c
  UNION ALL SELECT p.conv_id, n.depth, sha256(p.key || chr(0) || octet_length(encode(n.role)) || ':' || n.role || n.text), p.key, octet_length(encode(n.text))
  FROM p JOIN n ON n.conv_id = p.conv_id AND n.depth = p.depth + 1),
l AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
v AS (
  SELECT depth, key, min(conv_id) AS conv_id, min(above) AS above, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS save, bool_and(ends)::BIGINT AS leaf,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM l GROUP BY depth, key),
s AS (SELECT a.depth, a.key, sum(v.leaf)::BIGINT AS n_leaves, sum(v.save)::BIGINT AS saved_tokens FROM v JOIN l a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY a.depth, a.key),
k AS (SELECT depth - 1 AS depth, above AS key, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY 1, 2)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, v.ends_sha256
FROM v JOIN s USING (depth, key) LEFT JOIN k USING (depth, key) LEFT JOIN v u ON u.depth = v.depth - 1 AND u.key = v.above"""
}
