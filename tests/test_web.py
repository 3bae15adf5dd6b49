"""Fetching: gates, codes, redirects, bounds, pace; the data source and the step over a table."""

import pytest

import fake_web
from lodestone.sources import web

A, B = "http://a.example.com", "http://b.example.com"
#: url: (error code, status, final url, html)
WANT = {
    f"{A}/": (None, 200, f"{A}/", "<p>a</p><p>�</p>"),
    "HTTP://A.example.com": (None, 200, f"{A}/", "<p>a</p><p>�</p>"),
    f"{A}/x": (None, 200, f"{A}/x", "x"),
    f"{A}/pdf": ("non_html_content", 0, None, None),
    f"{A}/gone": (None, 404, f"{A}/gone", ""),
    f"{A}/none": (None, 200, f"{A}/none", "no type"),
    f"{A}/zip": ("non_html_content", 0, None, None),
    f"{A}/said": ("content_too_large", 0, None, None),
    f"{A}/odd": (None, 200, f"{A}/odd", "fine"),
    f"{A}/endless": ("content_too_large", 0, None, None),
    f"{A}/slow": ("timeout", 0, None, None),
    "http://nobody.example.com/": ("connection_error", 0, None, None),
    f"{B}/go": (None, 200, f"{A}/", "<p>a</p><p>�</p>"),
    f"{B}/loop": ("too_many_redirects", 0, None, None),
    f"{B}/nowhere": ("too_many_redirects", 0, None, None),
    f"{B}/inside": ("blocked_destination", 0, None, None),
    f"{B}/mail": ("invalid_url", 0, None, None),
    "http://localhost/": ("blocked_destination", 0, None, None),
    "http://x.internal/": ("blocked_destination", 0, None, None),
    "http://10.0.0.1/": ("blocked_destination", 0, None, None),
    "http://[::1]/": ("blocked_destination", 0, None, None),
    "http://u:p@a.example.com/": ("invalid_url", 0, None, None),
    "http://a.example.com:81/": ("invalid_url", 0, None, None),
    "http://a.example.com:99999/": ("invalid_url", 0, None, None),
    "ftp://a.example.com/": ("invalid_url", 0, None, None),
    "no url": ("invalid_url", 0, None, None),
}


def test_every_code():
    for url, want in WANT.items():
        r = web.fetch(url, fake_web.transport)
        assert (r["error_code"], r["status"], r["final_url"], r["html"]) == want, url
    assert web.fetch(None, fake_web.transport)["error_code"] == "invalid_url"
    assert web.fetch(f"{B}/go", fake_web.transport)["hops"] == 2


def test_bodies_are_given_up():
    fake_web.READ.clear()
    assert web.fetch(f"{A}/endless", fake_web.transport)["error_code"] == "content_too_large"
    assert len(fake_web.READ) == 21
    small = web.FetchSettings(max_bytes=8, max_redirects=1)
    assert web.fetch(f"{A}/", fake_web.transport, small)["error_code"] == "content_too_large"
    assert web.fetch(f"{B}/go", fake_web.transport, small)["error_code"] == "too_many_redirects"


def test_gate_sees_each_hop():
    seen = []
    assert web.fetch(f"{B}/go", fake_web.transport, gate=lambda u: seen.append(u))["status"] == 200
    assert seen == [f"{B}/go", f"{B}/there", f"{A}/"]
    assert web.fetch(f"{B}/go", fake_web.transport, gate=lambda u: web.ROBOTS if "there" in u else None)["error_code"] == "robots_disallowed"


def test_pace():
    now, slept = [100.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace = web.Pace(2.0, lambda: now[0], sleep)
    for host in ("a", "b", "a", "a"):
        pace.wait(host)
        now[0] += 0.5
    assert slept == [1.0, 1.5]


def test_data_source(spark):
    web.register(spark)
    df = spark.read.format("web_pages").option("urls", "\n".join(WANT)).option("transport", "tests.fake_web:transport").option("partitions", 3).load()
    got = {r.url: (r.error_code, r.status, r.final_url, r.html) for r in df.collect()}
    assert got == WANT and df.rdd.getNumPartitions() <= 3
    assert spark.read.format("web_pages").option("urls", "").load().count() == 0
    with pytest.raises(Exception, match="fetch_pages"):
        spark.read.format("web_pages").option("urls", "\n".join(f"http://x/{i}" for i in range(web.MOST_URLS + 1))).load().collect()


def test_table_of_urls(spark):
    urls = spark.createDataFrame([(u,) for u in [*WANT, None, f"{A}/"]], "url string")
    got = web.fetch_pages(urls, "tests.fake_web:transport").collect()
    assert len(got) == len(WANT) + 2 and {r.url: (r.error_code, r.status, r.final_url, r.html) for r in got if r.url} == WANT
    assert web.fetch_pages(urls.limit(0), "tests.fake_web:transport").count() == 0


def test_recorded_answers(spark):
    rows = [(1, f"{A}/", 200, "text/html", "b"), (2, f"{A}/", 200, "image/png", "b"), (3, f"{A}/", 500, "text/html", "b"), (4, None, 200, "text/html", "b"), (5, f"{A}/", None, None, None), (6, f"{A}/", 302, None, None), (7, f"{A}/", 200, None, "é" * 5)]
    got = web.gate_recorded(spark.createDataFrame(rows, "n int, url string, status int, content_type string, body string"), web.FetchSettings(max_bytes=9)).orderBy("n").collect()
    assert [(r.n, r.status, r.error_code, r.n_bytes) for r in got] == [(1, 200, None, 1), (2, 0, "non_html_content", 0), (3, 500, None, 0), (4, 0, "invalid_url", 0), (5, 0, "connection_error", 0), (6, 0, "too_many_redirects", 0), (7, 0, "content_too_large", 0)]


def test_python_gets_bounded_batches(spark):
    from lodestone.operators import crawl, rag, semantic
    from lodestone.sources import tables

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    page = spark.createDataFrame([("http://a.example/", "<p>x</p>", 1, 1, "t", "c")], "url string, html string, query_id long, rank long, title string, content string")
    for make in (lambda: crawl.extracted(page.select("url", "html")), lambda: semantic.encode(page, "html"), lambda: rag.prepare_sources(page.drop("html"))):
        spark.conf.unset(name)
        assert make().count() == 1 and int(spark.conf.get(name)) == tables.BATCH_ROWS
