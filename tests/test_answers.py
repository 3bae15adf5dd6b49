"""Providers of answers and their failures, stored documents, rebuilds without a database, counts of enriched hits."""

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import lifecycle, modes, rag
from lodestone.plans import search
from lodestone.sources import corpus

DOCS = [(1, "Rivers", "Rivers carry water. Water flows down.", "http://a.example.com/1"), (2, "Hills", "Hills are high. Water is low.", "b.md"), (3, "Odd", "", "c.md")]


MORE = [*DOCS, *((i, f"Thing {i}", f"Something else of kind {i}.", f"{i}.md") for i in range(20, 30))]
# the executors can't import this file
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Picky:
    """Fails on lots with the word fail, and says nothing to the word nothing."""

    name, model = "picky", "m1"

    def generate(self, prompts):
        if any("fail" in p for _, p in prompts):
            raise RuntimeError("no")
        return [" " if "nothing" in p else f"As [1] and [2] say: {len(s) > 0}" for s, p in prompts]


def frame(spark, docs=DOCS):
    return spark.createDataFrame(docs, "document_id long, title string, content string, source string").withColumn("content_hash", F.sha2("content", 256))


def test_providers(spark):
    queries = spark.createDataFrame([(1, "water"), (2, "water fail"), (3, "water nothing"), (4, "unheard of")], "query_id long, query string")
    made = search.make_corpus(frame(spark, MORE))
    found = search.search(queries, made, "ai", provider=Picky())
    assert found.status == "degraded"  # there are no vectors
    got = {r.query_id: (r.answer, r.status) for r in found.answers.collect()}
    assert got == {1: ("As [1] and [2] say: True", "degraded"), 2: (None, "degraded"), 3: (None, "degraded"), 4: (rag.NOT_ENOUGH, "degraded")}
    assert {(r.query_id, r.citation_id) for r in found.citations.collect()} == {(1, 1), (1, 2)}
    stub = {r.query_id: r.answer for r in search.search(queries, made, "ai").answers.collect()}
    prompts = rag.prompts(search.search(queries, made, "ai").passages, queries)
    same = {r.query_id: r.answer for r in rag.generate(prompts, rag.StubProvider()).collect()}
    assert same == {i: a for i, a in stub.items() if i != 4} and "'water'" in same[1]


def test_status_with_whole_retrieval(spark):
    queries = spark.createDataFrame([(1, "water", [1.0, 0.0]), (2, "water fail", [1.0, 0.0])], "query_id long, query string, embedding array<double>")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1])], "document_id long, embedding array<double>")
    found = search.search(queries, search.make_corpus(frame(spark, MORE), vectors), "ai", provider=Picky())
    assert {r.query_id: r.status for r in found.answers.collect()} == {1: "ok", 2: "unavailable"}


def test_failures_do_not_spread(spark):
    asked = spark.createDataFrame([(i, "s", "fail" if i == 7 else "fine") for i in range(40)], "query_id long, system_prompt string, prompt string").coalesce(1)
    got = {r.query_id: (r.answer, r.error, r.provider, r.model) for r in rag.generate(asked, Picky()).collect()}
    assert got[7] == (None, "provider_error", "picky", "m1") and sum(e is None for _, e, *_ in got.values()) == 39


def test_marks_in_texts(spark):
    texts = ["a water b", " water", "<b></b>", "water", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.highlight(F.col("t"), F.array(F.lit("water"))).alias("x")).collect()
    assert {r.t: r.x for r in got} == {
        texts[0]: "a <mark>water</mark> b", texts[1]: " <mark>water</mark>", texts[2]: "&lt;b&gt;&lt;/b&gt;", "water": "<mark>water</mark>", "": "", None: "",
    }


def test_stored_documents(spark, tmp_path):
    docs = frame(spark, [(i, f"t{i}", f"c{i}", "s") for i in (5, 3, 9, 1)])
    ids = lambda df: [r.document_id for r in df.collect()]
    assert ids(corpus.scan(docs)) == [1, 3, 5, 9] and ids(corpus.scan(docs, 2)) == [1, 3] and ids(corpus.scan(docs, -1)) == []
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    plain = docs.select(F.col("document_id").alias("DOCUMENT_ID"), F.col("title").alias("TITLE"))
    plain.write.format("jdbc").option("url", url).option("dbtable", "DOCUMENTS").option("driver", "org.apache.derby.jdbc.EmbeddedDriver").save()
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    read = corpus.read_database(spark, url, "DOCUMENTS", "DOCUMENT_ID", 3, **driver)
    assert sorted(map(tuple, read.collect())) == [(1, "t1"), (3, "t3"), (5, "t5"), (9, "t9")] and read.rdd.getNumPartitions() == 3
    assert corpus.read_database(spark, url, "DOCUMENTS", **driver).filter("DOCUMENT_ID > 4").count() == 2


def test_rebuild_without_a_database(spark, tmp_path):
    store = lifecycle.IndexStore(spark, str(tmp_path / "i"))
    docs = frame(spark)
    first = lifecycle.rebuild_with_fallback(store, lambda: docs, docs)
    assert first["source"] == "database" and first["documents_indexed"] == 3 and first["index_version"] == 1

    def broken():
        return spark.read.parquet(str(tmp_path / "nowhere"))

    crawled = frame(spark, [(10, "New", "Crawled text", "http://x.example.com/")])
    second = lifecycle.rebuild_with_fallback(store, broken, docs, crawled)
    assert (second["source"], second["documents_indexed"], second["crawled_documents"], second["corpus_documents"], second["index_version"]) == ("legacy_corpus", 3, 1, 2, None)
    assert store.manifest()["index_version"] == 1 and second["index"].doc_stats.count() == 3


def test_enriched_counts(spark):
    hits = spark.createDataFrame([(1, 1, "x"), (1, 3, None), (1, 99, "y"), (2, 3, None)], "query_id long, document_id long, code_snippet string")
    assert sorted(map(tuple, modes.enrich_stats(hits, frame(spark), 56).collect())) == [(1, 1, 56), (2, 0, 56)]
    assert sorted(map(tuple, modes.code_stats(hits).collect())) == [(1, 2), (2, 0)]


def test_pipeline_report(spark):
    docs = frame(spark)
    _, report = search.run_pipeline(docs, docs.filter("document_id = 1"))
    assert (report.documents_loaded, report.indexed, report.persisted) == (3, 2, 2)
