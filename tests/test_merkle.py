"""Trees of digests: the same for any order of rows, and comparisons that read what differs."""

import random

import pytest

from lodestone.operators import lifecycle, merkle

KIND = "document_id string, content_hash string"


def tree(spark, rows, levels=2):
    return merkle.build(spark.createDataFrame(rows, KIND), levels)


def test_order_does_not_matter_and_changes_do(spark):
    rnd = random.Random(1)
    rows = [(f"d{i}", f"h{i}") for i in range(500)] + [(None, None), ("d7", "h7"), ("d8", "other")]
    one = merkle.root(tree(spark, rows)).first()
    assert one.documents == len(rows)
    mixed = rnd.sample(rows, len(rows))
    assert merkle.root(merkle.build(spark.createDataFrame(mixed, KIND).repartition(7), 2)).first() == one
    for other in (rows[1:], [*rows, ("d7", "h7")], [("d0", "h"), *rows[1:]], [("d", "0h0"), *rows[1:]]):
        assert merkle.root(tree(spark, other)).first().signature != one.signature


def test_changes_read_what_differs(spark):
    before = [(f"d{i}", f"h{i}") for i in range(3000)]
    after = [(i, "new" if i in ("d5", "d77") else h) for i, h in before if i not in ("d9", "d10")] + [("d9999", "x")]
    a, b = tree(spark, before), tree(spark, after)
    assert sorted(map(tuple, merkle.changes(a, b).collect())) == [("d10", "deleted"), ("d5", "modified"), ("d77", "modified"), ("d9", "deleted"), ("d9999", "new")]
    seen = merkle.differing(a, b).groupBy("level").count().collect()
    assert {r.level: r["count"] for r in seen}[2] <= 5 and {r.level: r["count"] for r in seen}[0] == 1
    assert merkle.differing(a, tree(spark, random.Random(2).sample(before, 3000))).count() == 0
    same = lifecycle.changes(spark.createDataFrame(after, KIND), spark.createDataFrame(before, KIND))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, merkle.changes(a, b).collect()))


def test_small_and_odd_trees(spark):
    assert merkle.levels_for(0) == 0 and merkle.levels_for(257) == 1 and merkle.levels_for(10**9) == 6
    none = merkle.build(spark.createDataFrame([], KIND), 1)
    assert merkle.root(none).first().documents == 0
    one = tree(spark, [("a", "x")], 1)
    assert [tuple(r) for r in merkle.changes(none, one).collect()] == [("a", "new")]
    assert [tuple(r) for r in merkle.changes(one, none).collect()] == [("a", "deleted")]
    with pytest.raises(ValueError, match="levels"):
        merkle.differing(one, tree(spark, [("a", "x")], 2))
