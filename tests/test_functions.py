"""Text, URL and HTML functions against the cases that they must meet."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestone.functions import html as H
from lodestone.functions import text as T
from lodestone.functions import urls as U


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("c")).first()[0]


def test_fold_follows_its_rule(spark):
    texts = ["CAFÉ Crème", "  PyThôn  ", "Straße ŒUVRE ﬁn", "ΑΒΓ ς", "Ǆ ŉ ẞ", "áb", "Ünïcödé"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.fold(F.col("t")), T.fold_exact("t")).collect()
    assert [r[0] for r in rows] == [T.fold_text(t) for t in texts] == [r[1] for r in rows]
    for plane in range(17):
        every = ["".join(map(chr, range(a, a + 0x400))) for a in range(plane << 16, (plane + 1) << 16, 0x400) if not 0xD800 <= a < 0xE000]
        got = spark.createDataFrame(list(enumerate(every)), "i int, t string").select("i", T.fold(F.col("t")).alias("f")).collect()
        assert all(r.f == T.fold_text(every[r.i]) for r in got), plane
    mixed = "한국어 텍스트 각 𝐀𝒷 ﷺ İstanbul ½ ǰ ΐ ﬃ 豈 𝟘"
    assert one(spark, T.words(F.col("t")), t=mixed) == re.findall(r"[^\W_]+", T.fold_text(mixed))


def test_tokens(spark):
    assert one(spark, T.words(F.col("t")), t="a_b c-d e.f") == list("abcdef")
    assert one(spark, T.tokens(F.col("t")), t="The cat and the Cat") == ["cat", "cat"]
    assert one(spark, T.words(F.col("t")), t=None) == []
    assert one(spark, T.leading(F.col("t"), 2), t="The cat sat") == ["the", "cat"]
    assert one(spark, T.leading(F.col("t"), -1), t="The cat sat") == []


def snippet(spark, n, t, q):
    rows = spark.createDataFrame([(t, q)], "t string, terms array<string>").select("terms", T.lines_of(F.col("t")).alias("lines"))
    return T.with_snippet(rows, "lines", "terms", n).first().snippet


def test_snippets(spark):
    text = " ".join(f"tok{i}" for i in range(80))
    got = snippet(spark, 10, t=text, q=["tok40"]).split()
    assert len(got) == 11 and got[5] == "tok40" and got[:2] == ["tok35", "tok36"]
    assert snippet(spark, 26, t="alpha beta\ngamma delta", q=["kubernetes"]) == "alpha beta gamma delta"
    assert snippet(spark, 26, t="alpha beta\nGamma delta", q=["gamma"]) == "gamma delta"
    assert snippet(spark, 26, t="", q=["a"]) == ""


@pytest.mark.parametrize(
    ("text", "terms", "want"),
    [
        ("Docker runs", ["docker"], "<mark>Docker</mark> runs"),
        ("a & b", [], "a &amp; b"),
        ("container", ["cont", "container"], "<mark>container</mark>"),
        ("c++ & <b>", ["c++"], "<mark>c++</mark> &amp; &lt;b&gt;"),
        ("x & y", ["amp"], "x &amp; y"),
        ("", ["a"], ""),
    ],
)
def test_highlight(spark, text, terms, want):
    assert one(spark, T.highlight(F.col("t"), F.col("q")), t=text, q=terms) == want


def test_chunks(spark):
    assert [len(x) for x in one(spark, T.chunks(F.col("t"), 64), t="x" * 200)] == [64, 64, 64, 8]
    assert len(one(spark, T.chunks(F.col("t"), 4), t="x" * 200)) == 4
    assert one(spark, T.chunks(F.col("t")), t="") == []


def test_code_excerpts(spark):
    fenced = "intro\n```py\nimport a\n```\n```\nalpha beta\n```\n"
    take = lambda t, q, n=600: one(spark, T.code_excerpt(F.col("t"), F.col("q"), n), t=t, q=q)
    assert take(fenced, ["beta"]) == "alpha beta"
    assert take(fenced, ["zzz"]) == "import a"
    assert take("text\ndef f():\n  return 1\nimport b\nx\ny\nz", ["nothing"]) == "def f():\n  return 1\nimport b"
    assert take("text\ndef f():\n  pass\n\nclass Query:\n  a\n  b", ["query"]) == "class Query:\n  a\n  b"
    assert take("use `pip install` or `go run`", ["run"]) == "go run pip install"
    assert take("no code here", ["code"]) == "" and take("  ", []) == ""
    assert len(take("```\n" + "x" * 500 + "\n```", [], 10)) == 80


def plain_excerpt(text, terms, budget):
    """code_excerpt in plain Python."""
    hits = lambda x: sum(t in x.lower() for t in set(terms) if t)
    pieces = lambda pattern: [x for m in re.findall(pattern, text) if (x := m.strip())]
    if blocks := pieces(T.FENCE):
        return max(blocks, key=lambda x: (hits(x), -len(x)))[:budget]
    lines = text.splitlines()
    coded = [i for i, x in enumerate(lines) if re.match(rf"(?i)\s*(?:{'|'.join(T.CODE_STARTS)})\b", x)]
    if coded:
        at = max(coded, key=lambda i: (hits(" ".join(lines[i : i + 3])), -i))
        if found := "\n".join(lines[at : at + 3]).strip():
            return found[:budget]
    return " ".join(sorted(pieces(T.INLINE), key=lambda x: -hits(x))[:4])[:budget]


def test_code_excerpts_by_plain_python(spark):
    r = random.Random(4)
    parts = ["`", "```", "```sql\n", "\n```\n", "\n", "\r\n", "\x0b", "\u2028", "\x85", " ", "\t", "def ", "SELECT ", "Import", "#include <x>", "returned", "que", "Thin", "thin que", "émigré", "ab"]
    texts = ["".join(r.choices(parts, weights=[r.choice((0, 1, 4)) for _ in parts[:-1]] + [1], k=r.randint(0, 60))) for _ in range(2000)]
    terms = [r.sample(["que", "thin", "", "ab", "que"], r.randint(0, 5)) for _ in texts]
    rows = spark.createDataFrame(list(enumerate(zip(texts, terms))), "i int, x struct<t: string, q: array<string>>")
    got = rows.select("i", T.code_excerpt(F.col("x.t"), F.col("x.q"), 80).alias("got")).collect()
    assert {x.i: x.got for x in got} == {i: plain_excerpt(t, q, 80) for i, (t, q) in enumerate(zip(texts, terms))}


def test_code_excerpts_split_a_text_once(spark):
    # not once for each of its lines, which took time with their square
    text = "\n".join(["plain words"] * 5000 + ["return it"] + ["def f():", "  que", "end"] + ["import a"] * 5000)
    rows = spark.createDataFrame([(text,)], "t string").select(T.code_excerpt(F.col("t"), F.array(F.lit("que"))).alias("x"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("regexp_extract_all(") == 2
    assert rows.first().x == "return it\ndef f():\n  que"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://Example.COM:80/Path/", "http://example.com/Path"),
        ("http://h//a///b/", "http://h/a/b"),
        ("https://[2001:db8::1]:8443/x", "https://[2001:db8::1]:8443/x"),
        ("https://h/?utm_source=a&q=b%20c&REF=x#f", "https://h/?q=b+c"),
        ("http://h", "http://h"),
        ("http://h/", "http://h/"),
        ("http://h:bad/", "http://h:bad/"),
        ("not a url", "not a url"),
        ("", ""),
    ],
)
def test_normalize_url(spark, url, want):
    assert one(spark, U.normalize(F.col("u")), u=url) == want


def test_normalize_more_urls(spark):
    cases = {
        " http://h/a?b ": "http://h/a?b=",
        "http://U:p@H:0080/": "http://U:p@h/",
        "http://U:@h/?": "http://U@h/",
        "http://@h": "http://h",
        "http://h:99999/": "http://h:99999/",
        "http://h:/x#y": "http://h/x",
        "http://h?a=1&&UTM_Source=2&c=%zz*~&d=%C3%A9+x": "http://h?a=1&c=%25zz%2A~&d=%C3%A9+x",
        "http://h/a//": "http://h/a",
        "https://h:80/a": "https://h:80/a",
        "mailto:x@y": "mailto:x@y",
        "//h/x": "//h/x",
        "http://a:b:80/": "http://a:b:80/",
    }
    rows = spark.createDataFrame(list(cases.items()), "u string, want string").select("u", "want", U.normalize("u").alias("got")).collect()
    assert {r.u: r.got for r in rows} == cases


def test_resolve_url(spark):
    assert one(spark, U.resolve("b", "l"), b="https://h/docs/guide/index.html", l="../api") == "https://h/docs/api"
    assert one(spark, U.resolve("b", "l"), b="https://h/docs/", l="http://[bad") == "http://[bad"


def test_raw_links(spark):
    html = """<a href="/a">x</a><A class='k>' HREF = '/b' >y</A><a id=z href=/c>z</a><a href="#t">t</a><abbr href="/no"><a title="href=/q" href="/d">"""
    assert one(spark, H.raw_links(F.col("h")), h=html) == ["/a", "/b", "/c", "/d"]


@pytest.mark.parametrize(
    ("url", "crawlable"),
    [
        ("https://example.com/a", True),
        ("ftp://example.com/a", False),
        ("https://u:p@example.com/", False),
        ("https://example.com/a.PDF", False),
        ("http://localhost/", False),
        ("http://x.internal/", False),
        ("http://127.0.0.1/", False),
        ("http://10.1.2.3/", False),
        ("http://8.8.8.8/", True),
        ("http://[::1]/", False),
        ("https://example.com:443/", True),
        ("https://example.com:8443/", False),
        ("http://example.com:443/", False),
        ("https:///nohost", False),
        (None, False),
    ],
)
def test_url_gate(spark, url, crawlable):
    assert one(spark, U.is_crawlable(F.col("u")), u=url) is crawlable


def test_hosts_and_scope(spark):
    assert one(spark, U.host(F.col("u")), u="HTTP://U@[2001:DB8::1]:80/x") == "2001:db8::1"
    assert one(spark, U.source_host(F.col("u")), u="https://Example.com:8080/x") == "example.com:8080"
    assert one(spark, U.source_host(F.col("u")), u="/local/file.md") == ""
    assert one(spark, U.in_scope(F.col("u"), [".Example.com"]), u="docs.example.com.")
    assert not one(spark, U.in_scope(F.col("u"), ["example.com", ""]), u="badexample.com")


def test_robots():
    body = "User-agent: *\nDisallow: /private.html\nCrawl-delay: 3"
    assert U.robots_allows(body, "bot", "https://h/private.html") == (False, 3.0)
    assert U.robots_allows(body, "bot", "https://h/x")[0] and U.robots_allows("", "bot", "https://h/x") == (True, 0.0)
    assert not U.robots_allows("Disallow: /", "bot", "https://h/x")[0]


PAGE = """<html><head><title> A &amp; B </title><meta property="article:published_time" content="2025-01-02T03:04:05Z"></head><body><nav>menu</nav>
<article><h1>Head</h1><p>First  <b>bold</b></p><ul><li>First</li><li>Second</li></ul><script>x()</script><img src="/i.png" alt="pic">
<img src="https://other.example/j.png"><a href="/a">a</a><a href="#x">x</a><a href="mailto:m">m</a><a href=" b ">b</a></article></body></html>"""


def test_html():
    root = H.parse(PAGE)
    assert H.title_text(root, "") == "A & B" and H.link_texts(root) == ["/a", "b"] and H.published(root) == "2025-01-02"
    lines = H.main_text(root).split("\n")
    assert lines[0] == "A & B" and "menu" not in lines and "x()" not in lines and "Head" in lines
    blocks = H.reader_blocks(PAGE, "https://h.example/p")
    assert [b["type"] for b in blocks] == ["heading", "paragraph", "list", "image"]
    assert blocks[2]["items"] == ["First", "Second"] and blocks[3]["src"] == "https://h.example/i.png" and blocks[1]["text"] == "First bold"
    assert H.title_text(H.parse("<h1>only</h1>"), "") == "only" and H.title_text(H.parse(""), "https://H.example/x") == "h.example"
    assert H.main_text(H.parse("")) == "" and H.reader_blocks("", "") == []


def test_strip_takes_the_class_of_spaces(spark):
    every = [chr(x) for x in range(0x3100) if re.match(T.SPACE.replace(r"\s", r" \t\n\x0b\f\r"), chr(x))]
    assert sorted(every) == sorted(T.SPACES)
    rows = [(T.SPACES + "a" + T.SPACES + "b" + T.SPACES,), (T.SPACES,), ("",), ("\u200b x",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(T.strip(F.col("x"))).collect()]
    assert got == ["a" + T.SPACES + "b", "", "", "\u200b x", None]


def test_a_fold_is_short_in_a_plan(spark):
    folded = spark.createDataFrame([("x",)], "x string").select(T.fold(F.col("x")).alias("f"))
    assert len(folded._jdf.queryExecution().executedPlan().toString()) < 60_000
