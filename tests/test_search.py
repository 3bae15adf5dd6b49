"""Ranking, modes and answers on small corpora, against plain Python."""

import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.config import clamp_limit, normalized_weights
from lodestone.functions import text as T
from lodestone.operators import evaluate, hybrid, lexical, modes, rag, semantic
from lodestone.plans import catalog
from lodestone.plans import search as plans

DOCS = [
    (1, "Python", "Python is a programming language. Python runs.", "https://docs.example.com/python"),
    (2, "Docker", "Docker containers run Python and other programs", "https://docs.example.com/docker"),
    (3, "Redis", "An in-memory store\n```\nredis-cli ping\n```", "/srv/redis.md"),
    (4, "Learning", "Machine learning trains models; the models learn", "https://ml.example.org/a"),
    (5, "Empty", "", ""),
    (6, "Stop", "the and of", ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "document_id long, title string, content string, source string").cache()


@pytest.fixture(scope="module")
def index(docs):
    return lexical.build_index(docs)


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def plain_bm25(query):
    toks = {d: [w for w in re.findall(r"[^\W_]+", T.fold_text(c)) if w not in T.STOP_WORDS] for d, _, c, _ in DOCS}
    toks = {d: t for d, t in toks.items() if t}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(w for t in toks.values() for w in set(t))
    idf = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    out = {}
    for d, t in toks.items():
        tf = Counter(t)
        s = [idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in set(query) if w in tf]
        if s:
            out[d] = round(sum(s), 6)
    return out


def test_bm25_by_definition(spark, index):
    for text in ("python programs", "models learn machine learn", "the python"):
        got = {r.document_id: r.score for r in lexical.scores(queries(spark, text), index).collect()}
        want = plain_bm25(text.split())
        assert got.keys() == want.keys() and all(math.isclose(got[d], want[d], abs_tol=2e-6) for d in want)


def test_padded_pages(spark, index):
    rows = lexical.ranked(queries(spark, "kubernetes", "python", "", "the"), index, 10, pad=True).orderBy("query_id", "rank").collect()
    assert [(r.document_id, r.score) for r in rows if r.query_id == 0] == [(d, 0.0) for d in (1, 2, 3, 4)]
    assert [r.document_id for r in rows if r.query_id == 1][:2] == [1, 2] and sum(r.query_id == 1 for r in rows) == 4
    assert not [r for r in rows if r.query_id == 2] and sum(r.query_id == 3 for r in rows) == 4
    assert sum(r.query_id == 0 for r in lexical.ranked(queries(spark, "kubernetes"), index, 2, pad=True).collect()) == 2


def test_query_terms(spark):
    rows = {r.term: (r.weight, r.pos) for r in lexical.weighted_terms(queries(spark, "python python python docker zeta alpha zeta")).collect()}
    assert rows["python"] == (3.0, 0) and rows["docker"][0] == 1.0 and rows["zeta"][1] < rows["alpha"][1]


def test_hits_report_all_query_tokens(spark, docs, index):
    hit = lexical.search(queries(spark, "the Python zebra"), docs, index, 1).first()
    assert hit.matched_terms == ["python", "the", "zebra"] and hit.snippet.startswith("python is a")


def test_stats(docs, index):
    r = lexical.stats_report(docs, index).first()
    assert r.documents == 6 and r.vocabulary == index.term_stats.count() and r.average_document_length == round(r.corpus_tokens / 4, 3)


def test_limits_and_weights():
    assert [clamp_limit(x) for x in (0, -5, 10_000, None)] == [1, 1, 50, 10]
    assert normalized_weights(3, 1) == (0.75, 0.25) and normalized_weights(0, 1) == (0, 1)
    for bad in ((-1, 1), (0, 0)):
        with pytest.raises(ValueError):
            normalized_weights(*bad)


@pytest.mark.parametrize(("scores", "want"), [([3.5], [1]), ([0.0], [0]), ([2.0, 2, 2], [1, 1, 1]), ([-2.0, -2], [0, 0]), ([10.0, 20, 30], [0, 0.5, 1]), ([float("nan"), 1.0, float("inf")], [0, 1, 0])])
def test_min_max(spark, scores, want):
    from pyspark.sql import Window as W

    rows = spark.createDataFrame(list(enumerate(map(float, scores))), "i long, s double")
    got = rows.select("i", hybrid.min_max(F.col("s"), W.partitionBy(F.lit(1))).alias("m")).orderBy("i").collect()
    assert [r.m for r in got] == want


def test_merge_and_ties(spark):
    a = spark.createDataFrame([(0, "a", 2.0), (0, "b", 1.0)], "query_id long, document_id string, score double")
    b = spark.createDataFrame([(0, "b", 3.0), (0, "c", 1.5)], "query_id long, document_id string, score double")
    rows = hybrid.merge(a, b, 10).orderBy("rank").collect()
    assert {r.document_id for r in rows} == {"a", "b", "c"} and rows[0].document_id == "b"
    tied = lambda ids, t: [r.document_id for r in hybrid.merge(spark.createDataFrame([(0, x, 1.0) for x in ids], f"query_id long, document_id {t}, score double"), b.limit(0).withColumn("document_id", F.col("document_id").cast(t)), 9).orderBy("rank").collect()]
    assert tied([2, 10, 1], "long") == [1, 2, 10] and tied(["x", "z", "y"], "string") == ["z", "y", "x"]


def test_vectors_against_numpy(spark):
    rng = np.random.default_rng(1234)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None), (98, [1.0])], "document_id long, embedding array<float>").repartition(5)
    q = rows.filter("document_id < 3").select(F.col("document_id").alias("query_id"), "embedding")
    got = {(r.query_id, r["rank"]): r.document_id for r in semantic.vector_scores(q, rows, 5).collect()}
    for i in range(3):
        s = np.round(v.astype(np.float64) @ v[i].astype(np.float64), 6)
        assert [got[i, k] for k in range(1, 6)] == sorted(range(60), key=lambda j: (-s[j], j))[:5]
    assert semantic.vector_scores(q.limit(0), rows, 5).count() == 0


def test_all_modes(spark, docs):
    encoded = semantic.encode(docs, "content", dim=32)
    corpus = plans.make_corpus(docs, encoded.filter(F.size("embedding") > 0).select("document_id", "embedding"))
    asked = semantic.encode(queries(spark, "python programs", "redis-cli"), "query", dim=32)
    for mode in ("lexical", "bm25", "semantic", "hybrid", "web", "ai", "research", "code"):
        found = plans.search(asked, corpus, mode)
        rows = found.hits.collect()
        assert found.status == "ok" and rows and all(r["rank"] >= 1 for r in rows)
    assert any(r.code_snippet for r in rows)
    ai = plans.search(asked, corpus, "ai")
    answers = {r.query_id: r.answer for r in ai.answers.collect()}
    assert "[1]" in answers[0] and ai.citations.count() == ai.passages.select("query_id").distinct().count()
    lexical_only = plans.Corpus(docs, corpus.index)
    assert plans.search(queries(spark, "python"), lexical_only, "web").status == "degraded"
    assert plans.search(queries(spark, "python"), lexical_only, "hybrid").hits.count() == 0
    with pytest.raises(ValueError):
        plans.search(asked, corpus, "nonsense")


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, rank long, document_id string, title string, source string, snippet string, score double")


def test_diversify_and_documentation(spark):
    rows = [(0, i + 1, f"d{i % 5}", "t", "https://h.example/x" if i < 6 else "/local", "s", 1.0 - i / 10) for i in range(8)]
    rows += [(0, 9, "e", "API Reference", "https://g.example/q", "s", 0.1)]
    got = modes.diversify(hits(spark, rows), 2, 5).orderBy("rank").collect()
    assert [r.document_id for r in got] == ["d0", "d1", "e"] and [r["rank"] for r in got] == [1, 2, 3]
    first = modes.documentation_first(hits(spark, rows)).orderBy("rank").first()
    assert first.document_id == "e"
    assert modes.drop_unmatched(hits(spark, [(0, 1, "a", "", "", "", 0.0), (0, 2, "b", "", "", "", 0.5)])).first()["rank"] == 1


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("faiss_store.SearchEngine", "faiss_store.SearchEngine faiss store search engine"),
        ("plain words", "plain words"),
        ("HTTPServer2 api", "HTTPServer2 api"),
        ("  ", ""),
        ("getName getName", "getName getName get name"),
    ],
)
def test_technical_expansion(spark, query, want):
    assert queries(spark, query).select(modes.expand_technical(F.col("query"))).first()[0] == want


def test_passages_and_prompts(spark):
    rows = hits(spark, [(0, 1, "a", "A", "s", "x" * 100, 1.0), (0, 2, "b", "B", "s", "<mark>y</mark>" * 100, 0.9), (0, 3, "c", "C", "s", "z" * 100, 0.8), (1, 1, "a", "A", "s", "w" * 400, 1.0), (1, 2, "a", "A", "s", "w", 0.9), (2, 1, "q", "Q", "s", " ", 0.9)])
    got = rag.passages(rows, 5, 150).collect()
    assert sorted((r.query_id, r.document_id, r.citation_id) for r in got) == [(0, "a", 1), (1, "a", 1)]
    got = rag.passages(rows, 5, 200).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.document_id) for r in got] == [(0, "a"), (0, "b"), (1, "a")] and got[1].content == "y" * 100
    prompt = rag.prompts(rag.passages(rows, 5, 200), queries(spark, "q0", "q1")).orderBy("query_id").first().prompt
    assert prompt.index("[1]") < prompt.index("[2]") < prompt.index("q0")
    assert rag.enough(hits(spark, [(0, 1, "a", "", "", "", 0.1)])).count() == 0


def test_citations(spark):
    cites = spark.createDataFrame([(q, i) for q in range(4) for i in (1, 2, 3)], "query_id long, citation_id long")
    answers = spark.createDataFrame([(0, "none"), (1, "[2] and [3]"), (2, "[99]"), (3, "[3] [3] [12345678901234567890]")], "query_id long, answer string")
    got = sorted((r.query_id, r.citation_id) for r in rag.cited(answers, cites).collect())
    assert got == [(0, 1), (1, 2), (1, 3), (2, 1), (3, 3)]
    live = spark.createDataFrame([(0, "a [2]  b [9] , c [1]", [1, 2]), (1, "x [7]", [1]), (2, "x", [1])], "query_id long, answer string, available array<long>")
    rows = {r.query_id: r for r in rag.validated(live).collect()}
    assert rows[0].answer == "a [2] b, c [1]" and rows[0].cited == [2, 1] and rows[0].error is None
    assert rows[1].error == "invalid_citations" and rows[2].error == "missing_citations"


def test_sources_fit_the_budget(spark):
    """Every property that makes the result unique: order, one of each page, full texts but the last, and no character to spare."""
    rnd = random.Random(7)
    urls = ["https://a.example/x", "HTTPS://A.example:443/x/", "http://b.example", "ftp://c", "https://u@d.example", "https://f.example/a b", "http://g:x/"]
    results, budget = [], {}
    for q in range(120):
        results += [(q, r, rnd.choice([*urls, *(f"https://e.example/{rnd.random()}" for _ in urls)]), rnd.choice([None, "t" * 20, 'q" ' * 30, "é" * 700]), "é" * rnd.randint(0, 4000) if rnd.random() < 0.8 else 'say "x" \\ ' * 200) for r in range(8)]
        budget[q] = rnd.choice([50, 150, 700, 3000, 6000])
    df = spark.createDataFrame(results, "query_id long, rank long, url string, title string, content string")
    public = re.compile(r"(?i)https?://[^@ /:]+(:[0-9]+)?(/[^ ]*)?$")
    for chars in set(budget.values()):
        got = {}
        for r in rag.prepare_sources(df, 4, chars).orderBy("query_id", "id").collect():
            got.setdefault(r.query_id, []).append(r)
        for q in range(120):
            there, seen = [], set()
            for _, _, url, title, content in results[8 * q : 8 * q + 8]:
                same = url.lower().replace(":443", "").rstrip("/")
                if public.match(url) and title and content and same not in seen:
                    seen.add(same)
                    there.append((url, " ".join(title.split())[:500], " ".join(content.split())))
            there, found = there[:4], got.get(q, [])
            size = lambda xs: len(json.dumps([dict(zip(rag.SOURCE_FIELDS, x, strict=True)) for x in xs], ensure_ascii=False, separators=(",", ":")))
            rows = [(r.id, r.title, r.url, r.domain, r.content) for r in found]
            used = sum(len(r.title) + len(r.url) + len(r.domain) + 80 + len(r.content) for r in found)
            assert (not rows or size(rows) <= chars) and used <= max(chars, 0) or not rows
            for r, (url, title, content) in zip(found, there, strict=False):
                assert (r.url, r.title) == (url, title) and content.startswith(r.content) and r.id == found.index(r) + 1
                assert r is found[-1] or len(r.content) == min(3000, len(content))
            if rows and len(found[-1].content) < min(3000, len(there[len(found) - 1][2])):
                longer = rows[:-1] + [(*rows[-1][:4], there[len(found) - 1][2][: len(rows[-1][4]) + 1])]
                # a cut takes as many characters as the JSON is over, and one more; escapes that go with them count twice
                escapes = size(longer) - sum(map(len, longer[-1][1:])) if '"' in there[len(found) - 1][2] else 0
                assert used == chars or size(longer) + 1 + escapes > chars
            elif len(rows) < len(there):
                url, title, _ = there[len(rows)]
                host = url.split("/")[2].split(":")[0].lower()
                least = len(title) + len(url) + len(host) + 80
                assert used + least + 1 > chars or size([*rows, (len(rows) + 1, title, url, host, "x")]) + 2 > chars - 400


def test_live_sources_read_whole_pages(spark, tmp_path):
    """A body behind a long head is found, and none of its script."""
    page = "<html><head><title>T</title><script>" + "var hidden = 1;\n" * 4000 + "</script></head><body><p>the body</p></body></html>"
    spark.createDataFrame([(0, "https://a.example/x", page)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = catalog.QUERIES["live_sources"](spark, str(tmp_path)).collect()
    assert [(r.url, "the body" in r.content, "hidden" in r.content) for r in got] == [("https://a.example/x", True, False)]


def test_metrics(spark):
    results = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "c", 3), (1, "x", 1)], "query_id long, document_id string, rank long")
    judged = spark.createDataFrame([(0, "a", 2), (0, "b", 1), (1, "y", 1), (2, "z", 0)], "query_id long, document_id string, grade int")
    rows = {r.query_id: r for r in evaluate.metrics(results, judged, 3).collect()}
    assert (rows[0].precision, rows[0].recall, rows[0].mrr, rows[0].ndcg) == (round(2 / 3, 6), 1, 1, 1)
    assert (rows[1].precision, rows[1].mrr, rows[1].ndcg) == (0, 0, 0) and rows[2].recall == 0
    assert evaluate.macro(evaluate.metrics(results, judged, 3)).first().queries == 3
    with pytest.raises(ValueError):
        evaluate.metrics(results, judged, 0)


def test_vectors_with_ties(spark, monkeypatch):
    """Equal scores go by id across batches and tasks; zero vectors tie with everything; ids may be strings."""
    monkeypatch.setattr(semantic, "CHUNK", 3)
    rng = np.random.default_rng(5)
    v = rng.integers(-1, 2, size=(200, 4)).astype(np.float32)
    names = [f"d{i:03d}" for i in range(200)]
    rows = spark.createDataFrame([(n, x.tolist()) for n, x in zip(names, v, strict=True)], "document_id string, embedding array<float>").repartition(4)
    q = rows.filter("document_id < 'd010'").select(F.col("document_id").alias("query_id"), "embedding").unionByName(spark.createDataFrame([("zero", [0.0] * 4)], "query_id string, embedding array<float>"))
    asked = {n: x for n, x in zip(names[:10], v[:10], strict=True)} | {"zero": np.zeros(4)}
    for k in (1, 7, 500):
        got = {}
        for r in semantic.vector_scores(q, rows, k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.document_id, r.score))
        for name, x in asked.items():
            s = v @ x
            assert got[name] == [(names[j], float(s[j])) for j in sorted(range(200), key=lambda j: (-s[j], j))[:k]]


def test_query_vectors_are_of_folded_text(spark):
    q = spark.createDataFrame([(1, "Éclair PIE"), (2, None)], "query_id long, query string")
    got = {r.query_id: np.array(r.embedding) for r in semantic.ask(q, 16).collect()}
    assert np.allclose(got[1], semantic.hash_encode("eclair pie", 16)) and not got[2].any()


def test_diversify_stats(spark):
    rows = [("a", "https://h/1"), ("b", "https://h/2"), ("a", "https://h/1"), ("c", "https://h/3"), ("c", "https://h/3"), ("d", "file.md"), ("d", "file.md"), ("e", "https://g/")]
    hits = spark.createDataFrame([(1, i + 1, d, s, "t", 1.0) for i, (d, s) in enumerate(rows)], "query_id long, rank long, document_id string, source string, title string, score double")
    assert tuple(modes.diversify_stats(hits, 2).first()) == (1, 8, 4, 2, 2, 3)
    assert tuple(modes.diversify_stats(hits, 0).first())[1:5] == (8, 5, 3, 0)
    assert tuple(modes.documentation_stats(hits).first()) == (1, 2, 6, 2)


def test_ranking_keeps_k_a_query(spark, monkeypatch):
    """Pages in lots, passes and with ties are those of scoring every posting, and no pair of query and document is shuffled."""
    from lodestone.operators import lexical

    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} all{'' if i % 4 else ' w1 odd'}") for i in range(200)], "document_id long, content string")
    asked = spark.createDataFrame([(1, "w1 w2 all"), (2, "odd odd"), (3, "nowhere"), (4, ""), (5, "w5"), (6, "all")], "query_id int, query string")
    index = lexical.build_index(docs)
    monkeypatch.setattr(lexical, "QUERIES_AT_ONCE", 2)
    monkeypatch.setattr(lexical, "DOCS_AT_ONCE", 9)
    every = lexical.scores(asked, index)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    assert same(lexical.ranked(asked, index, 5), lexical.top_k(every, 5))
    pairs = asked.filter("query <> ''").select("query_id").crossJoin(docs.select("document_id")).join(every, ["query_id", "document_id"], "left").na.fill(0.0, ["score"])
    page = lexical.ranked(asked, index, 60, pad=True)
    assert same(page, lexical.top_k(pairs, 60))
    assert "postings" not in "".join(page.inputFiles()) and "Join" not in page._jdf.queryExecution().optimizedPlan().toString()


def test_wide_rows_are_joined_last(spark, docs, index, monkeypatch):
    """Lines of documents are not shuffled by query, contents are joined only for documents that are hit, and a task more is no k rows a query more."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        q = spark.createDataFrame([(1, "python", [1.0, 0.0]), (2, "models", [0.0, 1.0])], "query_id long, query string, embedding array<double>")
        vectors = spark.createDataFrame([(1, [1.0, 0.0]), (4, [0.0, 1.0])], "document_id long, embedding array<double>")
        found = lexical.search(q, docs, index, 2)
        assert "hashpartitioning(query_id" not in plan(found) and found.count() == 4
        near = semantic.search(q, vectors, docs, 1)
        assert "LeftSemi" in plan(near) and {(r.query_id, r.document_id) for r in near.collect()} == {(1, 1), (2, 4)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    monkeypatch.setattr(lexical, "DOCS_AT_ONCE", 1)
    many = lexical.build_index(docs.repartition(9))
    assert lexical._pages(q, many, 2, True).rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
