"""A segmented index gives what an index built anew gives, and writes only what changed."""

import random
from collections import Counter

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import lexical
from lodestone.operators.segments import SegmentStore
from lodestone.streaming import streams

KIND = "document_id long, content string"
QUERIES = [(1, "w1 w2 w3"), (2, "w5 w5 rare"), (3, "common w9"), (4, "unknown")]


def frame(spark, docs):
    return spark.createDataFrame(sorted(docs.items()), KIND).withColumn("content_hash", F.sha2(F.coalesce("content", F.lit("")), 256))


def scored(spark, index):
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    return sorted((r.query_id, r.document_id, round(r.score, 5)) for r in lexical.scores(queries, index).collect())


def same_as_rebuilt(spark, store, docs):
    want = lexical.build_index(frame(spark, docs))
    got = store.index()
    key = lambda df, *c: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*c).collect())
    assert key(got.term_stats, "term", "df", "idf") == key(want.term_stats, "term", "df", "idf")
    assert key(got.doc_stats, "document_id", "dl") == key(want.doc_stats, "document_id", "dl")
    assert key(got.postings, "term", "document_id", "tf", "dl") == key(want.postings, "term", "document_id", "tf", "dl")
    assert got.stats.first().asDict() == want.stats.first().asDict() and scored(spark, got) == scored(spark, want)


def text(rnd):
    return " ".join(["common"] * (rnd.random() < 0.8) + [f"w{rnd.randrange(30)}" for _ in range(rnd.randint(1, 12))])


def test_refresh_and_merge(spark, tmp_path):
    rnd = random.Random(6)
    docs = {i: text(rnd) for i in range(60)} | {60: "", 61: "  ...  "}
    store = SegmentStore(spark, str(tmp_path / "index"))
    assert store.refresh(frame(spark, docs)) | {"segment": 0} == {"changed": True, "new": 62, "modified": 0, "deleted": 0, "segment": 0}
    same_as_rebuilt(spark, store, docs)
    assert not store.refresh(frame(spark, docs))["changed"] and store.manifest()["version"] == 1
    docs |= {3: "w1 rare", 7: docs[7] + " rare", 60: "was empty", 100: "brand new rare"}
    del docs[11], docs[12]
    found = store.refresh(frame(spark, docs))
    assert (found["new"], found["modified"], found["deleted"]) == (1, 3, 2)
    # only the four fresh documents' postings were written
    written = spark.read.parquet(f"{tmp_path}/index/{found['segment']}/postings").select("document_id").distinct().collect()
    assert {r.document_id for r in written} == {3, 7, 60, 100}
    same_as_rebuilt(spark, store, docs)
    docs[3] = "w1 changed again"
    del docs[100]
    store.refresh(frame(spark, docs))
    docs |= {11: "w5 is back", 200: text(rnd)}
    assert store.add(frame(spark, {11: docs[11], 200: docs[200]}))["new"] == 2
    same_as_rebuilt(spark, store, docs)
    assert len(store.manifest()["segments"]) == 4 and not store.merge(4) and store.merge(2) and len(store.manifest()["segments"]) == 2
    same_as_rebuilt(spark, store, docs)
    assert store.merge(1) and store.manifest()["tombstones"] == []
    same_as_rebuilt(spark, store, docs)
    assert store.vacuum() > 0
    same_as_rebuilt(spark, store, docs)
    assert store.refresh(frame(spark, {5: docs[5]}))["deleted"] == len(docs) - 1
    same_as_rebuilt(spark, store, {5: docs[5]})


def test_streams_add_to_what_is_there(spark, tmp_path):
    """A query with a new checkpoint begins at batch 0 again and overwrites nothing."""
    schema = "document_id long, content string, content_hash string"
    store = SegmentStore(spark, str(tmp_path / "index"))
    everything = {}
    for run in range(2):
        docs = {10 * run + i: f"w{i} run{run}" for i in range(3)} | {0: f"w0 again {run}"}
        everything |= docs
        frame(spark, docs).write.parquet(str(tmp_path / f"in{run}"))
        for name, write in (("append", streams.append_new(str(tmp_path / "out"))), ("segments", streams.refresh_segments(store))):
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / f"in{run}"))
            stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / f"{name}{run}")).trigger(availableNow=True).start().awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out/documents"))
    assert sorted(r.content for r in out.collect()) == sorted(["w0 again 0", "w1 run0", "w2 run0", "w0 again 1", "w0 run1", "w1 run1", "w2 run1"])
    same_as_rebuilt(spark, store, everything)


def test_a_text_is_read_into_tokens_once(spark):
    """The filter that Spark puts before reading postings out of rows was pushed down and made the tokens anew for every token of a text."""
    docs = spark.createDataFrame([(1, "b a b the", "x"), (2, None, "y"), (3, "Ünder a", "z")], "document_id long, content string, content_hash string")
    postings = lexical.postings_of(docs.filter("document_id > 0"))
    times = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")
    assert times(postings) == times(docs.filter("document_id > 0").select(T.tokens(F.col("content")).alias("t")))
    assert sorted(postings.collect()) == [("b", 1, 2, 2), ("under", 3, 1, 1)]
    assert [(r.document_id, r.dl, r.content_hash, [tuple(x) for x in r.p]) for r in lexical.counted(docs, "content_hash").orderBy("document_id").collect()] == [(1, 2, "x", [("b", 2)]), (2, 0, "y", []), (3, 1, "z", [("under", 1)])]


def test_tokens_of_batches(spark):
    """Tokens that tasks find in batches of texts are those of built-in functions for all characters, and frequencies of terms are sums over batches, for which no posting is read."""
    chars = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x32000), *range(0xE0000, 0xE0200))]
    lots = ["".join(chars[i : i + 50]) for i in range(0, len(chars), 50)]
    texts = [*lots, *("x" + "y ".join(t) for t in lots), "", None, "a A", "-", " The of b", "\u00e9", "e\u0301A", "\u2026x\u2026y", "\u00bd", "\u0130I", "\u03a3\u03c2", "b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id long, content string").repartition(3)
    index, rows = lexical.build_index(docs), sorted(map(tuple, lexical.postings_of(docs).collect()))
    assert sorted(map(tuple, index.postings.collect())) == rows
    df = Counter(term for term, *_ in rows)
    assert {r.term: r.df for r in index.term_stats.collect()} == df
    assert index.stats.first()["n"] == len({r[1] for r in rows}) and "regexp_extract_all" not in lexical.counted(docs)._jdf.queryExecution().optimizedPlan().toString()
