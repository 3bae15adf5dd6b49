"""Redirect chains and robots rules against plain Python."""

import random

from lodestone.functions import urls as U
from lodestone.operators import crawl


def test_redirects(spark):
    a = "http://a.example.com"
    responses = [(f"{a}/{i}", 302, f"/{i + 1}") for i in range(8)] + [(f"{a}/8", 200, None), (f"{a}/self", 301, "self"), (f"{a}/p", 302, "q"), (f"{a}/q", 302, "p#x")]
    responses += [(f"{a}/in", 302, "http://10.1.1.1/"), (f"{a}/name", 302, "http://x.local/"), (f"{a}/bad", 302, "ftp://a.example.com/"), (f"{a}/none", 302, None), (f"{a}/b", 302, "http://b.example.com/no/1"), (f"{a}/gone", 404, None), (f"{a}/", 200, None)]
    asked = [f"{a}/3", f"{a}/2", f"{a}/8", f"{a}/self", f"{a}/p", f"{a}/in", f"{a}/name", f"{a}/bad", f"{a}/none", f"{a}/b", f"{a}/gone", "HTTP://A.example.com#top", f"{a}/unknown", None, ""]
    robots = spark.createDataFrame([("b.example.com", "User-agent: *\nDisallow: /no/")], "host string, body string")
    got = crawl.redirects(spark.createDataFrame([(u,) for u in [*asked, asked[0]]], "url string"), spark.createDataFrame(responses, "url string, status int, location string"), robots)
    found = {r.url: (r.final_url, r.status, r.hops, r.looped, r.error_code) for r in got.collect()}
    assert found == {
        f"{a}/3": (f"{a}/8", 200, 5, False, None),
        f"{a}/2": (None, 0, 5, False, "too_many_redirects"),
        f"{a}/8": (f"{a}/8", 200, 0, False, None),
        f"{a}/self": (None, 0, 1, True, "too_many_redirects"),
        f"{a}/p": (None, 0, 2, True, "too_many_redirects"),
        f"{a}/in": (None, 0, 1, False, "blocked_destination"),
        f"{a}/name": (None, 0, 1, False, "blocked_destination"),
        f"{a}/bad": (None, 0, 1, False, "invalid_url"),
        f"{a}/none": (None, 0, 0, False, "too_many_redirects"),
        f"{a}/b": (None, 0, 1, False, "robots_disallowed"),
        f"{a}/gone": (f"{a}/gone", 404, 0, False, None),
        "HTTP://A.example.com#top": (f"{a}/", 200, 0, False, None),
        f"{a}/unknown": (None, 0, 0, False, "connection_error"),
        None: (None, 0, 0, False, "invalid_url"),
        "": (None, 0, 0, False, "invalid_url"),
    }


def test_robots_rules_as_the_standard_parser_reads_them(spark):
    rnd = random.Random(5)
    paths = ["/", "/a", "/a/", "/a/b", "/é x", "/a%2Fb", "*", "", "/a?q=1", "/b;c"]
    bodies = ["", "Disallow: /", "# none", "User-agent: other\nDisallow: /"]
    for _ in range(40):
        lines = []
        for _ in range(rnd.randint(1, 3)):
            lines.append(f"User-agent: {rnd.choice(['*', 'lodestone', 'Lode', 'other'])}")
            lines += [f"{rnd.choice(['Allow', 'Disallow'])}: {rnd.choice(paths)}" for _ in range(rnd.randint(0, 4))]
            lines += [f"Crawl-delay: {rnd.randint(0, 9)}"] * rnd.randint(0, 1) + [""]
        bodies.append("\n".join(lines))
    robots = spark.createDataFrame([(f"h{i}.example.com", b) for i, b in enumerate(bodies)] + [("null.example.com", None)], "host string, body string")
    hosts = [f"h{i}.example.com" for i in range(len(bodies))] + ["null.example.com", "unknown.example.com"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/a", "/a/b?q=1", "/%C3%A9%20x", "/a%2Fb/c", "/b;c#d", "/zz")]
    got = {r.url: (r.allowed, r.delay) for r in crawl.with_robots(spark.createDataFrame([(u,) for u in urls], "url string"), robots, "lodestone/1.0").collect()}
    body = dict(zip(hosts, [*bodies, None, None], strict=True))
    assert got == {u: U.robots_allows(body[u.split("/")[2]], "lodestone/1.0", u) for u in urls}
