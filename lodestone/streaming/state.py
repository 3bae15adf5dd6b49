"""Keyed state with event-time timers: a paced frontier, a cache with one flight for equal keys, and sessions that close once.

All three need the RocksDB state store (spark.sql.streaming.stateStore.providerClass) and a watermark on the stream. Time is that of the
events, so what comes out depends on the rows and not on when they were read; after a restart from the checkpoint a stream goes on where
it was. State is a few values for a key and one entry for each row that waits; an entry is written and deleted by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import urls as U

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark) -> None:
    """Sets the state store that these streams need, for streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _ms(at: datetime) -> int:
    return round(at.timestamp() * 1000)


def _time(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, UTC)


class _Timed(StatefulProcessor):
    """One timer at a time, moved when it has to."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "ms long")

    def _get(self, state, other=None):
        return state.get() if state.exists() else other

    def _set_timer(self, ms: int) -> None:
        old = self._get(self.due)
        if old and old[0] == ms:
            return
        if old:
            self.handle.deleteTimer(old[0])
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def close(self) -> None:
        pass


class _Frontier(_Timed):
    """A host's waiting URLs by number, the numbers of the first and of the next one, and when the last one left."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getMapState("waiting", "n long", "url string, ms long, delay long")
        self.ends = handle.getValueState("ends", "first long, next long")
        self.left = handle.getValueState("left", "ms long")

    def _plan(self, first: int, last: int | None) -> tuple[int, tuple]:
        url, ms, delay = self.waiting.getValue((first,))
        return (ms if last is None else max(ms, last + delay)), (url, ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        first, after = self._get(self.ends, (0, 0))
        for ms, url, delay in sorted((_ms(r.ts), r.url, round(1000 * (r.delay or 0.0))) for r in rows):
            self.waiting.updateValue((after,), (url, ms, delay))
            after += 1
        self.ends.update((first, after))
        last = self._get(self.left)
        self._set_timer(self._plan(first, last and last[0])[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        first, after = self.ends.get()
        last = self._get(self.left)
        last = last and last[0]
        while first < after:
            due, (url, ms) = self._plan(first, last)
            if due > now:
                break
            yield Row(host=key[0], url=url, ts=_time(ms), released_at=_time(due))
            self.waiting.removeKey((first,))
            first, last = first + 1, due
        self.ends.update((first, after))
        self.left.update((last,))
        self.due.clear()
        if first < after:
            self._set_timer(self._plan(first, last)[0])


def paced(stream: DataFrame, late: str = "10 seconds") -> DataFrame:
    """host, url, ts and released_at of a stream of URLs (url, ts, delay in seconds): each host's URLs in the order of their times, the next no earlier than its
    delay after the one before. A URL comes out once the watermark has passed its time of release. Rows without url are left out; a null
    delay is none.

    A host that waits long costs state for each URL and nothing else; times of release are those of a host that is asked all the time.
    """
    rows = stream.filter("url IS NOT NULL AND ts IS NOT NULL").select(U.host(F.col("url")).alias("host"), "url", "ts", "delay").withWatermark("ts", late)
    return rows.groupBy("host").transformWithState(_Frontier(), "host string, url string, ts timestamp, released_at timestamp", "Append", "eventTime")


class _Cache(_Timed):
    """A key's answer, those that wait for one, and whether one is on its way."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.answer = handle.getValueState("answer", "until long, response string")
        self.flight = handle.getValueState("flight", "since long")
        self.waiters = handle.getListState("waiters", "request_id string, ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        def out(request: str, outcome: str, response: str | None, ms: int) -> Row:
            return Row(key=key[0], request_id=request, outcome=outcome, response=response, ts=_time(ms))

        for ms, is_request, request, response in sorted(((_ms(r.ts), r.request_id is not None, r.request_id, r.response) for r in rows), key=lambda x: (x[0], x[1], x[2] or "", x[3] or "")):
            if is_request:
                held = self._get(self.answer)
                if held and ms < held[0]:
                    yield out(request, "hit", held[1], ms)
                elif self.flight.exists():
                    self.waiters.appendValue((request, ms))
                else:
                    self.flight.update((ms,))
                    self.waiters.appendValue((request, ms))
                    yield out(request, "fetch", None, ms)
                continue
            if not self.flight.exists():
                continue  # nobody has asked, or the flight has ended
            for waiter, _ in list(self.waiters.get()):
                yield out(waiter, "failed" if response is None else "answered", response, ms)
            self.waiters.clear()
            self.flight.clear()
            if response is not None:
                self.answer.update((ms + self.ttl, response))
                self._set_timer(ms + self.ttl)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.answer.clear()
        self.due.clear()
        return iter(())


def cached_results(requests: DataFrame, responses: DataFrame, ttl: float = 300.0, late: str = "10 seconds") -> DataFrame:
    """key, request_id, outcome, response and ts, from streams of requests (key, request_id, ts) and responses (key, response, ts; a null response is a failure).

    The first request of a key goes out (fetch); those that come while it is on its way wait for the same answer. A response answers all that
    wait (answered, or failed) and is kept for ttl seconds, failures aren't; a request in that time is a hit. State goes when an answer's
    time is over. Rows of a batch are taken in the order of their times, responses before requests of the same time.
    """
    none = F.lit(None).cast("string")
    both = requests.filter("request_id IS NOT NULL").select("key", "request_id", none.alias("response"), "ts").unionByName(responses.select("key", none.alias("request_id"), "response", "ts"))
    rows = both.filter("key IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    return rows.groupBy("key").transformWithState(_Cache(round(1000 * ttl)), "key string, request_id string, outcome string, response string, ts timestamp", "Append", "eventTime")


class _Session(_Timed):
    """When a session began and when it ends."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "start long, until long, seen long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        now = self._get(self.open)
        for ms in sorted(_ms(r.ts) for r in rows):
            if now and ms >= now[1]:
                yield self._row(key, now, True)
                now = None
            if now is None:
                now = (ms, ms + self.ttl, 1)
                yield self._row(key, now, False)
            else:
                now = (min(now[0], ms), max(now[1], ms + self.ttl), now[2] + 1)
        self.open.update(now)
        self._set_timer(now[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = self._get(self.open)
        self.due.clear()
        if now and now[1] <= timerValues.getCurrentWatermarkInMs():
            self.open.clear()
            yield self._row(key, now, True)

    @staticmethod
    def _row(key, now: tuple, closed: bool) -> Row:
        return Row(token_hash=key[0], event="closed" if closed else "opened", at=_time(now[1] if closed else now[0]), n_seen=now[2])


def session_events(stream: DataFrame, ttl: float = 30 * 24 * 3600.0, late: str = "1 hour") -> DataFrame:
    """token_hash, event (opened or closed), at and n_seen (rows so far) of a stream of uses (token_hash, ts): a session ends ttl seconds after its last use, and is
    closed once, when the watermark has passed that or a use after its end begins the next one. Late uses within the watermark renew a
    session; later ones are dropped. Rows without token or time are left out."""
    rows = stream.filter("token_hash IS NOT NULL AND ts IS NOT NULL").select("token_hash", "ts").withWatermark("ts", late)
    return rows.groupBy("token_hash").transformWithState(_Session(round(1000 * ttl)), "token_hash string, event string, at timestamp, n_seen long", "Append", "eventTime")
