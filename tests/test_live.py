"""Live search: one flight for equal requests, the cache and its end, failures, and the allowance."""

import json
import os
import sys
from datetime import datetime, timedelta

import pytest
from pyspark import cloudpickle

from lodestone.operators.live import LiveSearch, results
from lodestone.operators.reservations import ReservationLedger

cloudpickle.register_pickle_by_value(sys.modules[__name__])
START = datetime(2024, 3, 1)
KIND = "request_id string, query string, include array<string>, exclude array<string>, most int, at timestamp"


class Web:
    """Writes down each call; fails on the word fail."""

    def __init__(self, folder):
        self.folder = folder

    def search(self, query, include, exclude, most):
        with open(os.path.join(self.folder, "calls"), "a") as f:
            f.write(f"{query}|{','.join(include)}|{most}\n")
        if "fail" in query:
            raise RuntimeError
        rows = [{"title": f"About {query}", "url": "https://a.example.com/x", "content": "c", "score": 0.5}, {"title": "", "url": "https://b.example.com/"}, {"title": "no", "url": "ftp://x"}, {"title": "two", "url": "http://B.example.com/y"}]
        return json.dumps({"results": rows, "usage": {"credits": 2 if "dear" in query else 1}})


@pytest.fixture
def live(spark, tmp_path):
    return LiveSearch(spark, str(tmp_path / "live"), Web(str(tmp_path)), ReservationLedger(spark, str(tmp_path / "ledger"), 6), 100)


def ask(spark, live, rows):
    frame = spark.createDataFrame([(i, q, inc, None, most, START + timedelta(seconds=s)) for i, q, inc, most, s in rows], KIND)
    found = live.search(frame)
    return found, {r.request_id: (r.status, r.cached) for r in found.collect()}


def test_live_search(spark, live, tmp_path):
    calls = lambda: sorted(open(tmp_path / "calls").read().split("\n")[:-1])
    found, got = ask(spark, live, [("1", "Rivers  of", None, None, 0), ("2", "rivers of", [], 5, 1), ("3", "rivers of", ["b.de", "a.de"], 5, 2), ("4", "fail", None, None, 3)])
    assert got == {"1": ("ok", False), "2": ("ok", False), "3": ("ok", False), "4": ("provider_error", False)}
    assert calls() == ["Rivers of||5", "fail||5", "rivers of|b.de,a.de|5"]
    rows = sorted((r.request_id, r.rank, r.title, r.domain) for r in results(found).collect())
    assert rows[:2] == [("1", 1, "About Rivers of", "a.example.com"), ("1", 2, "two", "b.example.com")] and len(rows) == 6
    assert ask(spark, live, [("5", "RIVERS OF", None, 5, 99), ("6", "rivers of", ["a.de", "b.de"], None, 50), ("7", "fail again", None, None, 60)])[1] == {"5": ("ok", True), "6": ("ok", True), "7": ("provider_error", False)}
    assert len(calls()) == 4
    # the time of the first answer is over: it is asked again, and costs more than it was to
    assert ask(spark, live, [("8", "rivers of", None, 5, 100), ("9", "dear", None, None, 101)])[1] == {"8": ("ok", False), "9": ("ok", False)}
    usage = live.ledger.usage().first()
    assert (usage.successes, usage.failures, usage.consumed) == (4, 2, 5)
    assert ask(spark, live, [("10", "one more", None, None, 110), ("11", "too many", None, None, 111), ("12", "dear", None, None, 112)])[1] == {"10": ("ok", False), "11": ("budget_exceeded", False), "12": ("ok", True)}
    assert live.evict(START + timedelta(seconds=200)) == 2
