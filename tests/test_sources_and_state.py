"""Corpus files, crawling, index versions, history and streams."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.operators import crawl, history, lifecycle
from lodestone.sources import corpus
from lodestone.streaming import streams


def test_markdown_corpus(spark, tmp_path):
    files = {
        "b/first_guide.md": "---\ntitle: 'The Guide'\ntags: x\n---\n\n# Head\nAlpha beta\n",
        "c_copy.md": "# HEAD\nalpha béta",
        "plain_name.md": "Only text here",
        "README.md": "skipped",
        "empty.md": "---\ntitle: x\n---\n",
        "stop.md": "the and of",
        "open.md": "---\nnever closed words",
        "note.txt": "not markdown",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    rows = {r.document_id: r for r in corpus.read_markdown(spark, str(tmp_path)).collect()}
    assert set(rows) == {"first_guide", "plain_name", "open"}
    assert rows["first_guide"].title == "The Guide" and rows["first_guide"].content == "# Head\nAlpha beta"
    assert rows["plain_name"].title == "Plain Name" and rows["open"].content.startswith("---")
    assert "c_copy" in {r.document_id for r in corpus.read_markdown(spark, str(tmp_path), dedupe=False).collect()}
    assert corpus.read_markdown(spark, str(tmp_path / "missing")).count() == 0


def test_judgements(spark, tmp_path):
    (tmp_path / "j.json").write_text('[{"query": "q", "relevance": {"a": 2, "b": 0}}, {"query": "r", "relevance": {}}]')
    assert sorted(map(tuple, corpus.read_judgements(spark, str(tmp_path / "j.json")).collect())) == [("q", "a", 2), ("q", "b", 0)]


def test_inserts_and_sources(spark):
    old = spark.createDataFrame([("a", "h1")], "document_id string, content_hash string")
    new = spark.createDataFrame([("x", "h1"), ("y", "h2"), ("z", "h2")], "document_id string, content_hash string")
    assert [tuple(r) for r in corpus.new_only(new, old, ["document_id"]).select("document_id", "content_hash").collect()] == [("y", "h2")]
    pages = spark.createDataFrame([("https://h/x", " ", "some text", "ab" * 32), ("https://h/y", "T", "the", "cd" * 32)], "url string, title string, text string, content_hash string")
    row = corpus.crawl_documents(pages).collect()
    assert len(row) == 1 and row[0].document_id == "crawl-" + "ab" * 6 and row[0].title == "https://h/x"
    both = corpus.union_sources(corpus.crawl_documents(pages), spark.createDataFrame([("d", None)], "document_id string, content string"))
    assert both.count() == 1
    assert corpus.crawled_counts(both).first().crawled == 1 and corpus.indexable(both, include_crawled=False).count() == 0


def site(spark):
    page = lambda title, *links: f"<title>{title}</title><p>{title} text</p>" + "".join(f'<a href="{x}">l</a>' for x in links)
    rows = [
        ("https://s.example/", 200, "text/html", page("home", "/page1.html", "/page2.html", "/private.html", "/heavy.pdf", "/missing.html", "mailto:a@b", "https://out.example/", "/page1.html")),
        ("https://s.example/page1.html", 200, "text/html; charset=utf-8", page("one", "/deep.html")),
        ("https://s.example/page2.html", 200, "text/html", page("one", "/deep.html")),
        ("https://s.example/private.html", 200, "text/html", page("secret")),
        ("https://s.example/missing.html", 404, "text/html", ""),
        ("https://s.example/deep.html", 200, "text/html", page("deep", "/deeper.html")),
        ("https://s.example/deeper.html", 200, "text/html", page("deeper")),
    ]
    return spark.createDataFrame(rows, "url string, status int, content_type string, html string")


def test_crawl(spark):
    robots = spark.createDataFrame([("s.example", "User-agent: *\nDisallow: /private.html")], "host string, body string")
    got = crawl.crawl(site(spark), ["HTTPS://s.example/", "http://localhost/"], crawl.CrawlConfig(), robots)
    assert {r.url.rsplit("/", 1)[-1]: r.depth for r in got.pages.collect()} == {"": 0, "page1.html": 1, "deep.html": 2}
    r = got.report.first()
    assert (r.pages_crawled, r.robots_blocked, r.duplicate_content) == (3, 1, 1) and r.out_of_scope == 2
    assert {x.error_code for x in got.failures.collect()} == {"unparsable_seed", "http_status"}
    assert crawl.crawl(site(spark), ["https://s.example/"], crawl.CrawlConfig(max_pages=1)).report.first().pages_crawled == 1
    graph = crawl.link_graph(site(spark).select("url", "html"))
    assert graph.filter("src = 'https://s.example/'").count() == 6


def hashed(spark, rows):
    return spark.createDataFrame([(i, c, f"h{c}") for i, c in rows], "document_id string, content string, content_hash string")


def test_signatures_and_changes(spark):
    a, b = hashed(spark, [("1", "x"), ("2", "y")]), hashed(spark, [("2", "y"), ("1", "x")])
    for signature in (lifecycle.corpus_signature, lifecycle.bucketed_signature):
        assert signature(a).first()[0] == signature(b).first()[0] != signature(hashed(spark, [("1", "x"), ("2", "z")])).first()[0]
    got = {r.document_id: r.change for r in lifecycle.changes(hashed(spark, [("1", "x"), ("2", "z"), ("3", "q")]), hashed(spark, [("1", "x"), ("2", "y"), ("4", "r")])).collect()}
    assert got == {"2": "modified", "3": "new", "4": "deleted"}
    assert lifecycle.max_numeric_id(hashed(spark, [("7", "x"), ("abc", "y")])).first()[0] == 7
    assert lifecycle.max_numeric_id(hashed(spark, [("abc", "y")])).first()[0] == 0


def test_index_versions(spark, tmp_path):
    store = lifecycle.IndexStore(spark, str(tmp_path / "index"))
    assert store.load() is None and store.status()["status"] == "not_built"
    one = hashed(spark, [("1", "alpha beta"), ("2", "gamma")])
    assert store.refresh(one)["rebuilt"] and not store.refresh(one)["rebuilt"]
    assert store.load().postings.count() == 3 and store.status(one)["status"] == "ready"
    two = hashed(spark, [("1", "alpha beta"), ("3", "delta")])
    assert store.status(two)["status"] == "stale"
    assert store.refresh(two) == {"rebuilt": True, "new": 1, "modified": 0, "deleted": 1}
    assert store.manifest()["index_version"] == 2
    (tmp_path / "index" / store.manifest()["version"] / "stats" / "_SUCCESS").unlink()
    assert store.load() is None
    store.rebuild(two)
    store.remove()
    assert store.manifest() is None


T0 = dt.datetime(2024, 3, 10, 12)


def events(spark):
    rows = [("a", "u", "100%_ sure", "web", T0), ("b", "u", "Other", "ai", T0 - dt.timedelta(days=1)), ("c", "u", "old", "web", T0 - dt.timedelta(days=9)), ("d", "v", "x", "web", T0), ("e", "u", "soon", "web", T0 + dt.timedelta(days=2))]
    return spark.createDataFrame(rows, "id string, owner string, query string, mode string, created_at timestamp")


def test_history(spark):
    h = events(spark)
    assert [r.id for r in history.page(h, "u", 2).collect()] == ["e", "a"] and history.page(h, "u", 2, 2).first().total == 4
    assert [r.id for r in history.page(h, "u", 9, mode="ai").collect()] == ["b"]
    assert [r.id for r in history.page(h, "u", 9, contains="%_ S").collect()] == ["a"]
    labels = {r.id: r.label for r in history.day_groups(h, dt.date(2024, 3, 10)).collect()}
    assert labels == {"a": "Today", "b": "Yesterday", "c": "March 1, 2024", "d": "Today", "e": "Previous 7 Days"}
    assert history.without(h, "u").count() == 1 and history.without(h, "u", "a").count() == 4 and history.without(h, "v", "a").count() == 5
    twice = h.union(h.filter("id = 'a'")).union(h.filter("id = 'b'").withColumn("query", F.lit("changed")))
    got = {r.id: r.conflict for r in history.record(twice).collect()}
    assert len(got) == 5 and got["b"] and not got["a"]
    sessions = spark.createDataFrame([("t", T0), ("t2", T0)], "token_hash string, expires_at timestamp")
    assert history.valid_sessions(sessions, "t", T0 - dt.timedelta(1)).count() == 1 and history.valid_sessions(sessions, "t", T0).count() == 0
    assert history.adopt_ownerless(h.withColumn("owner", F.lit(None).cast("string")), "q").first().owner == "q"


def test_usage(spark):
    rows = [(T0, 2, "success"), (T0, 1, "reserved"), (T0, 5, "failed"), (T0 - dt.timedelta(days=40), 9, "success")]
    got = {r.period: r for r in history.usage(spark.createDataFrame(rows, "at timestamp, credits long, state string"), "month", 4).collect()}
    assert got["2024-03"].consumed == 3 and got["2024-03"].remaining == 1 and got["2024-03"].failures == 1 and got["2024-01"].remaining == 0


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(T0 + dt.timedelta(minutes=m), "k", 1.0, f"h{m % 3}", str(m), f"word{m % 3}") for m in range(0, 300, 30)]
    schema = "ts timestamp, event_type string, value double, content_hash string, document_id string, content string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    read = lambda: spark.readStream.schema(schema).parquet(source)
    query = streams.windowed_counts(read()).writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 6
    query = streams.first_seen(read()).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("seen").count() == 1
    folder = str(tmp_path / "out")
    query = read().select("document_id", "content", "content_hash").writeStream.foreachBatch(streams.append_new(folder)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(f"{folder}/documents").count() == 1 and spark.read.parquet(f"{folder}/postings").count() == 1


@pytest.mark.parametrize("size", [0, 1])
def test_empty_tables(spark, size):
    none = hashed(spark, [("1", "")][:size])
    assert lifecycle.changes(none, none).count() == 0 and lifecycle.corpus_signature(none).first()[0]


def test_semantic_versions_and_validation(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"alpha w{i}", f"h{i}", [float(i), 1.0]) for i in range(5)], "document_id long, content string, content_hash string, embedding array<float>")
    for kind in lifecycle.KINDS:
        folder = tmp_path / kind
        store = lifecycle.IndexStore(spark, str(folder), kind=kind)
        assert store.load() is None and store.refresh(docs)["rebuilt"] and not store.refresh(docs)["rebuilt"]
        opened, first = store.load(docs), store.manifest()
        assert store.load(docs.limit(2)) is None
        store.rebuild(docs.limit(4))
        # who has the version before open can go on reading
        assert (opened.doc_stats if kind == "lexical" else opened).count() == 5 and store.manifest()["previous"] == first["version"]
        store.load_or_rebuild(docs)
        assert store.status(docs)["status"] == "ready" and store.manifest()["index_version"] == 3 and not (folder / first["version"]).exists()
        assert not list(folder.glob("*.next"))
        # another kind's store, and one whose documents are gone, are not taken
        other = lifecycle.KINDS[kind == lifecycle.KINDS[0]]
        assert lifecycle.IndexStore(spark, str(folder), kind=other).manifest() is None
        for part in (folder / store.manifest()["version"] / "digests").glob("part-*"):
            part.unlink()
        assert store.load() is None
    assert store.status()["dimension"] == 2


def test_sessions_and_ledger(spark):
    now = dt.datetime(2024, 3, 1)
    tokens = spark.createDataFrame([("a",), ("a",), ("",), ("x" * 129,)], "token string")
    sessions = history.new_sessions(tokens, now)
    assert [(r.token_hash, r.expires_at) for r in sessions.collect()] == [(hashlib.sha256(b"a").hexdigest(), now + dt.timedelta(days=30))]
    entries = spark.createDataFrame([(1, hashlib.sha256(b"a").hexdigest()), (2, "other")], "id long, owner string")
    assert [r.id for r in history.with_session(entries, sessions, now).collect()] == [1] and history.with_session(entries, sessions, now + dt.timedelta(days=31)).count() == 0
    ledger = spark.createDataFrame([("r0", now, 3, "success")], "reservation_id string, at timestamp, credits int, state string")
    asked = spark.createDataFrame([(f"r{i}", now + dt.timedelta(hours=i)) for i in (1, 2, 3)], "reservation_id string, at timestamp")
    made = history.reserve(ledger, asked, 5, 1)
    assert {r.reservation_id: r.state for r in made.collect()} == {"r1": "reserved", "r2": "reserved", "r3": "refused"}
    ends = spark.createDataFrame([("r1", 2, True), ("r1", 9, True), ("r2", 0, False), ("r0", 9, False)], "reservation_id string, credits int, succeeded boolean")
    after = history.settle(ledger.unionByName(made.filter("state = 'reserved'")), ends)
    assert {r.reservation_id: (r.credits, r.state) for r in after.collect()} == {"r0": (3, "success"), "r1": (2, "success"), "r2": (0, "failed")}
    assert crawl.jobs_report(spark.createDataFrame([(1, 3), (2, 4)], "job_id int, pages_crawled int")).first() == (2, 7)
