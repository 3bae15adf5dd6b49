"""Streams with keyed state, batch by batch, with a restart between batches."""

from datetime import datetime, timedelta

import pytest

from lodestone.streaming import state

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


@pytest.fixture(autouse=True)
def store(spark):
    state.use_state_store(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


class Runs:
    """Batches of rows through a stream that is stopped and started anew for each of them."""

    def __init__(self, spark, folder, schema, make):
        self.spark, self.folder, self.schema, self.make, self.n = spark, folder, schema, make, 0

    def __call__(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        query = self.make(stream).writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/check").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return self

    def out(self):
        return self.spark.read.parquet(f"{self.folder}/out").collect()


def test_paced_frontier(spark, tmp_path):
    run = Runs(spark, str(tmp_path), "url string, ts timestamp, delay double", lambda s: state.paced(s, "0 seconds"))
    a, b = "http://a.example.com/", "http://b.example.com/"
    run([(f"{a}{i}", at(0), 10.0) for i in range(4)] + [(f"{b}0", at(1), None), (f"{b}1", at(1), None), (None, at(1), 1.0)])
    run([(f"{a}late", at(2), 10.0), ("http://c.example.com/", at(25), 1.0)])
    assert sorted((r.url, r.released_at) for r in run.out() if r.host == "a.example.com") == [(f"{a}{i}", at(10 * i)) for i in range(3)]
    run([("http://c.example.com/", at(500), 1.0)])
    run([("http://c.example.com/", at(900), 1.0)])
    got = sorted((r.released_at, r.url) for r in run.out() if r.host == "a.example.com")
    assert got == [(at(0), f"{a}0"), (at(10), f"{a}1"), (at(20), f"{a}2"), (at(30), f"{a}3"), (at(40), f"{a}late")]
    assert sorted((r.url, r.released_at) for r in run.out() if r.host == "b.example.com") == [(f"{b}0", at(1)), (f"{b}1", at(1))]


def test_cache_with_one_flight(spark, tmp_path):
    schema = "key string, request_id string, response string, ts timestamp"

    def make(stream):
        return state.cached_results(stream.filter("request_id IS NOT NULL"), stream.filter("request_id IS NULL"), 100.0, "0 seconds")

    run = Runs(spark, str(tmp_path), schema, make)
    run([("k", "r1", None, at(0)), ("k", "r2", None, at(1)), ("j", "r3", None, at(1)), (None, "r4", None, at(1))])
    run([("k", None, "A", at(5)), ("k", "r5", None, at(6)), ("j", None, None, at(6)), ("j", "r6", None, at(7)), ("x", None, "unasked", at(7))])
    run([("k", "r7", None, at(104)), ("k", "r8", None, at(105)), ("z", "r9", None, at(106))])
    run([("z", "r10", None, at(300)), ("k", None, "B", at(301))])
    got = sorted((r.ts, r.request_id, r.outcome, r.response) for r in run.out())
    assert got == sorted([
        (at(0), "r1", "fetch", None), (at(1), "r3", "fetch", None),
        (at(5), "r1", "answered", "A"), (at(5), "r2", "answered", "A"), (at(6), "r5", "hit", "A"), (at(6), "r3", "failed", None), (at(7), "r6", "fetch", None),
        (at(104), "r7", "hit", "A"), (at(105), "r8", "fetch", None), (at(106), "r9", "fetch", None), (at(301), "r8", "answered", "B"),
    ], key=lambda x: (x[0], x[1]))


def test_sessions_close_once(spark, tmp_path):
    run = Runs(spark, str(tmp_path), "token_hash string, ts timestamp", lambda s: state.session_events(s, 100.0, "20 seconds"))
    run([("a", at(0)), ("b", at(0)), ("a", at(50)), (None, at(1)), ("c", None)])
    run([("clock", at(115))])  # b ends at 100, but the watermark is at 95
    run([("b", at(99)), ("clock", at(116))])  # late, but within the watermark: renewed to 199
    run([("a", at(400)), ("clock", at(401))])
    run([("a", at(10)), ("clock", at(900))])  # far too late: dropped
    run([("clock", at(901))])
    got = sorted((r.token_hash, r.at, r.event, r.n_seen) for r in run.out() if r.token_hash != "clock")
    assert got == [("a", at(0), "opened", 1), ("a", at(150), "closed", 2), ("a", at(400), "opened", 1), ("a", at(500), "closed", 1), ("b", at(0), "opened", 1), ("b", at(199), "closed", 2)]
