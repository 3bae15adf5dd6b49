"""A tree of digests over a corpus, by ranges of hashed ids.

A document lies in the leaf that the first hexadecimal digits of its id's SHA-256 name; inner nodes cover the 16 ranges that go on from theirs. A
leaf's digest is over its documents in order, so the rows' own order doesn't matter, and a leaf is small however many documents there
are: the depth follows from their number. Two trees are compared from the root down, and only ranges that differ are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored

#: Documents of a leaf, on average, at most; and levels below the root at most.
LEAF_DOCUMENTS, MOST_LEVELS = 256, 12


@dataclass(frozen=True)
class MerkleTree:
    """nodes: level, prefix, digest, n (documents); leaves: prefix, document_id, content_hash, sorted by prefix in the files, so that a range is read
    without the others. Both are stored."""

    nodes: DataFrame
    leaves: DataFrame
    levels: int


def levels_for(documents: int) -> int:
    levels = 0
    while levels < MOST_LEVELS and documents > LEAF_DOCUMENTS * 16**levels:
        levels += 1
    return levels


def build(docs: DataFrame, levels: int | None = None) -> MerkleTree:
    """The tree of documents (document_id, content_hash; nulls count as empty). Repeated rows count as often as they are there. Trees are comparable
    if they have the same number of levels, which follows from the number of documents unless it is given; an empty corpus has a root."""
    rows = docs.select(F.coalesce(F.col("document_id").cast("string"), F.lit("")).alias("document_id"), F.coalesce("content_hash", F.lit("")).alias("content_hash"))
    levels = levels_for(rows.count()) if levels is None else levels
    rows = rows.withColumn("prefix", F.expr(f"substring(sha2(document_id, 256), 1, {levels})"))
    leaves = stored(rows.repartitionByRange("prefix").sortWithinPartitions("prefix", "document_id"), "merkle-leaves")
    # a leaf's rows are hashed one by one and joined by their order among themselves: lengths of both parts keep them apart
    own = F.sha2(F.concat_ws(":", F.length("document_id").cast("string"), "document_id", "content_hash"), 256)
    counted = leaves.select("prefix", own.alias("h")).groupBy("prefix", "h").agg(F.count("*").alias("k"))
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("h", "k"))), lambda x: F.concat(x["h"], F.lit("*"), x["k"].cast("string")))
    level = counted.groupBy("prefix").agg(F.sha2(F.array_join(pairs, ";"), 256).alias("digest"), F.sum("k").alias("n"))
    level = stored(level.select(F.lit(levels).alias("level"), "prefix", "digest", "n"), "merkle-level")
    nodes = level
    for k in range(levels - 1, -1, -1):
        named = F.struct("prefix", "digest")
        digest = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(named)), lambda x: F.concat(x["prefix"], F.lit("="), x["digest"])), ";"), 256)
        level = stored(level.groupBy(F.expr(f"substring(prefix, 1, {k})").alias("prefix")).agg(digest.alias("digest"), F.sum("n").alias("n")).select(F.lit(k).alias("level"), "prefix", "digest", "n"), "merkle-level")
        nodes = nodes.unionByName(level)
    if level.isEmpty():
        root = docs.sparkSession.range(1).select(F.lit(0).alias("level"), F.lit("").alias("prefix"), F.sha2(F.lit(""), 256).alias("digest"), F.lit(0).cast("long").alias("n"))
        nodes = nodes.unionByName(root)
    return MerkleTree(nodes, leaves, levels)


def root(tree: MerkleTree) -> DataFrame:
    """One row: signature and documents."""
    return tree.nodes.filter("level = 0").select(F.col("digest").alias("signature"), F.col("n").alias("documents"))


def differing(before: MerkleTree, after: MerkleTree) -> DataFrame:
    """level and prefix of the nodes in which two trees of the same levels differ, the root's first. Children are looked at only below nodes that differ."""
    if before.levels != after.levels:
        raise ValueError(f"trees of {before.levels} and {after.levels} levels can't be compared; build one with the other's levels")

    def side(tree: MerkleTree, level: int, name: str) -> DataFrame:
        return tree.nodes.filter(F.col("level") == level).select("prefix", F.col("digest").alias(name))

    found, above = None, None
    for level in range(before.levels + 1):
        a, b = side(before, level, "a"), side(after, level, "b")
        if above is not None:
            below = above.select(F.col("prefix").alias("above"))
            a, b = (x.join(below, F.expr(f"substring(prefix, 1, {level - 1})") == F.col("above"), "left_semi") for x in (a, b))
        above = stored(a.join(b, "prefix", "full_outer").filter("NOT (a <=> b)").select(F.lit(level).alias("level"), "prefix"), "merkle-differing")
        found = above if found is None else found.unionByName(above)
        if above.isEmpty():
            break
    return found


def changes(before: MerkleTree, after: MerkleTree) -> DataFrame:
    """document_id and change (new, modified, deleted) between two trees, from the leaves that differ alone. Of a repeated id the hashes are compared with
    their numbers."""
    leaves = differing(before, after).filter(F.col("level") == before.levels).select("prefix")

    def side(tree: MerkleTree, name: str) -> DataFrame:
        rows = tree.leaves.join(leaves, "prefix", "left_semi")
        rows = rows.groupBy("document_id", "content_hash").agg(F.count("*").alias("k"))
        return rows.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("content_hash", "k"))).alias(name))

    kind = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    return side(before, "a").join(side(after, "b"), "document_id", "full_outer").select("document_id", kind.alias("change")).filter("change IS NOT NULL")
