"""Search in cells gives what scoring everything gives, and leaves out what the bounds allow."""

import numpy as np
import pytest

from lodestone.operators import vector_index

VECTORS, QUERIES = "document_id string, embedding array<float>", "query_id long, embedding array<double>"


def clustered(rng, n, dimension, groups, spread):
    centres = rng.normal(size=(groups, dimension))
    rows = centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dimension))
    return (rows / np.linalg.norm(rows, axis=1)[:, None]).astype(np.float32)


def brute(queries, rows, k):
    out = []
    for i, q in queries:
        s = sorted((-round(float(np.dot(np.array(q), np.array(v, np.float64))), 6), d) for d, v in rows)[:k]
        out += [(i, d, -x, r) for r, (x, d) in enumerate(s, 1)]
    return sorted(out)


def got(queries, index, k):
    return sorted((r.query_id, r.document_id, round(r.score, 6), r["rank"]) for r in vector_index.search(queries, index, k).collect())


@pytest.mark.parametrize("spread", [0.05, 2.0])
def test_exact(spark, tmp_path, monkeypatch, spread):
    monkeypatch.setattr(vector_index, "PART_ROWS", 16)
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", 4)
    rng = np.random.default_rng(1)
    rows = [(f"d{i:04}", v.tolist()) for i, v in enumerate(clustered(rng, 900, 8, 12, spread))]
    rows += [(f"copy{i}", rows[i][1]) for i in range(60)]
    odd = [(None, rows[0][1]), ("null", None), ("short", [1.0]), ("part", [None] * 8), ("nan", [float("nan")] * 8), ("none", [])]
    queries = [(i, np.array(rows[i * 7][1], np.float64).tolist()) for i in range(40)] + [(100, [0.0] * 8)]
    index = vector_index.build(spark.createDataFrame([*rows, *odd], VECTORS).repartition(3), 30)
    q = spark.createDataFrame([*queries, (101, None), (102, [1.0])], QUERIES)
    for k in (1, 7):
        assert got(q, index, k) == brute(queries, rows, k)
    assert index.cells.agg({"n": "sum"}).first()[0] == len(rows)
    read = vector_index.share_read(q.filter("query_id < 100"), index, 7).first()
    assert read.pairs == 40 * len(rows) and (read.read < read.pairs / 3 if spread < 1 else read.read <= read.pairs)
    vector_index.save(index, str(tmp_path / "v"))
    assert got(q, vector_index.load(spark, str(tmp_path / "v")), 7) == brute(queries, rows, 7)


def test_few_vectors(spark):
    none = vector_index.build(spark.createDataFrame([], VECTORS))
    q = spark.createDataFrame([(1, [1.0, 0.0])], QUERIES)
    assert got(q, none, 3) == []
    one = vector_index.build(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0])], VECTORS))
    assert got(q, one, 5) == [(1, "a", 1.0, 1), (1, "b", 1.0, 2)] and got(q.limit(0), one, 5) == []
