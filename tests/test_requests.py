"""Checks of requests and what answers report, against plain Python."""

import json
import math

from pyspark.sql import functions as F

from lodestone.functions import urls as U
from lodestone.operators import requests


def test_queries(spark):
    rows = {"  a \n b ": ("a b", None), "": (None, "blank"), " \t ": (None, "blank"), None: (None, "blank"), "x" * 500: ("x" * 500, None), "x" * 501: (None, "too_long")}
    got = spark.createDataFrame([(q,) for q in rows], "q string").select("q", requests.checked_query(F.col("q")).alias("x")).collect()
    assert {r.q: (r.x.query, r.x.error) for r in got} == rows


def test_host_names(spark):
    names = {" Example.com.": "example.com", "bücher.example": "xn--bcher-kva.example", "x" * 63 + ".de": "x" * 63 + ".de", "a-b.c1": "a-b.c1", "localhost": "localhost"}
    names |= dict.fromkeys(["http://x.example", "a b", "", ".", "a..b", "-a.de", "a-.de", "x" * 64 + ".de", ".".join(["x" * 60] * 5), "a_b.de", "a.de:80", "ü" * 80 + ".de", None])
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", U.host_name("n").alias("x")).collect()
    assert {r.n: r.x for r in got} == names


def test_domain_lists(spark):
    rows = [(1, "include", ["b.de", " A.de", "b.de.", "a.de"]), (1, "exclude", ["x y"]), (2, "include", []), (2, "exclude", None), (3, "include", ["a.de"] * 300), (4, "include", ["a.de"] * 301), (3, "exclude", ["a.de"] * 151), (5, "include", [None])]
    got = requests.checked_domains(spark.createDataFrame(rows, "request_id long, kind string, domains array<string>")).collect()
    assert {(r.request_id, r.kind): (r.domains, r.error) for r in got} == {
        (1, "include"): (["b.de", "a.de"], None), (1, "exclude"): (None, "not_a_host"), (2, "include"): ([], None), (2, "exclude"): ([], None),
        (3, "include"): (["a.de"], None), (4, "include"): (None, "too_many"), (3, "exclude"): (None, "too_many"), (5, "include"): (None, "not_a_host"),
    }


def plain_credits(text):
    """Breadth first, to three levels."""
    try:
        body = json.loads(text)
    except (TypeError, ValueError):
        return None
    level = [body.get(n) for n in requests.CREDIT_NAMES] if isinstance(body, dict) else []
    for _ in range(requests.CREDIT_DEPTH):
        for x in level:
            if isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) and x >= 0 and float(x).is_integer():
                return int(x)
        level = [x.get(n) if isinstance(x, dict) else None for x in level for n in requests.INNER_NAMES]
    return None


def test_reported_credits(spark):
    bodies = ['{"credits_used": 3}', '{"credits": 4.0}', '{"usage": 1e2}', '{"credits_used": 1.5, "credits": 2}', '{"credits_used": -1, "usage": {"credits": 0}}', '{"credits_used": {"credits": 7}, "usage": 5}', '{"credits": true}', '{"credits": "3"}']
    bodies += ['{"usage": {"api_credits": {"credits_used": 9}}}', '{"credits": {"usage": 5}}', '{"credits": null}', "[]", "3", "", "no json", None, '{"credits": [1]}', '{"usage": {"credits_used": false, "credits": 8}}', "{}", '{"credits": 1e300}']
    got = spark.createDataFrame([(b,) for b in bodies], "b string").select("b", requests.reported_credits(F.col("b")).alias("x")).collect()
    want = {b: plain_credits(b) for b in bodies} | {'{"credits": 1e300}': None}  # beyond 64 bits
    assert {r.b: r.x for r in got} == want and sum(x is not None for x in want.values()) == 8
