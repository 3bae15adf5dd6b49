"""Pages from the web, as a data source and as a step over a table of URLs.

A fetch never raises: what goes wrong is a code in the row. Each hop of a redirect is checked before it is asked for; bodies are read piece
by piece and given up beyond a bound. How bytes come in is a transport, so tests and recorded responses go through the same gates as
the network.
"""

from __future__ import annotations

import http.client
import importlib
import ipaddress
import socket
import ssl
import time
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from typing import NamedTuple
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import urls as U

#: Codes of what can go wrong.
TIMEOUT, REDIRECTS, TRANSPORT, TOO_LARGE, NON_HTML, BLOCKED, INVALID, ROBOTS = (
    "timeout", "too_many_redirects", "connection_error", "content_too_large", "non_html_content", "blocked_destination", "invalid_url", "robots_disallowed"
)
#: The types that count as pages (and every +html), and the statuses that lead on.
PAGE_TYPES, LEADS_ON = ("text/html", "application/xhtml+xml", ""), (301, 302, 303, 307, 308)
SCHEMA = "url string, final_url string, status int, content_type string, html string, n_bytes long, hops int, error_code string"
#: URLs that one read of the data source takes at most: they pass the driver. A table of any number goes through fetch_pages.
MOST_URLS = 10_000


@dataclass(frozen=True)
class FetchSettings:
    timeout: float = 10.0
    max_redirects: int = 5
    max_bytes: int = 2_000_000
    types: tuple[str, ...] = PAGE_TYPES
    agent: str = "lodestone/1.0"
    #: Seconds between two requests to one host.
    delay: float = 0.0


class Response(NamedTuple):
    """An answer whose body is still to come. Names of headers are in lower case."""

    status: int
    headers: dict[str, str]
    body: Iterable[bytes]


#: From a URL, headers and seconds to wait an answer; raises TimeoutError or another OSError.
Transport = Callable[[str, dict[str, str], float], Response]


class Refused(Exception):
    """A fetch that ends with a code."""

    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = code


def target(url: str) -> str:
    """The form of a URL in which it is asked for; Refused if it may not be."""
    text = (url or "").strip()
    try:
        parts = urlsplit(text)
        port = parts.port
    except ValueError:
        raise Refused(INVALID) from None
    name = (parts.hostname or "").rstrip(".")
    own = {"http": 80, "https": 443}.get(parts.scheme.lower())
    if own is None or not name or len(url) > U.READER_URL_CHARS or "@" in parts.netloc or port not in (None, own) or any(ord(c) < 32 or ord(c) == 127 for c in url):
        raise Refused(INVALID)
    if name in U.LOCAL_NAMES or name.endswith(tuple(U.LOCAL_ENDINGS)) or not U.is_global_name(name):
        raise Refused(BLOCKED)
    place = f"[{name}]" if ":" in name else name
    return f"{parts.scheme.lower()}://{place}{'' if port is None else f':{port}'}{parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def network(url: str, headers: dict[str, str], timeout: float) -> Response:
    """The transport of the network. The host is looked up once, every address that it has must be public, and the connection goes to one of
    those, so a name can't lead elsewhere between check and use."""
    parts = urlsplit(url)
    port = parts.port or (443 if parts.scheme == "https" else 80)
    found = socket.getaddrinfo(parts.hostname, port, type=socket.SOCK_STREAM)
    if not found or not all(ipaddress.ip_address(x[4][0]).is_global for x in found):
        raise Refused(BLOCKED)
    plain = socket.create_connection((found[0][4][0], port), min(3.0, timeout))
    try:
        plain.settimeout(timeout)
        used = ssl.create_default_context().wrap_socket(plain, server_hostname=parts.hostname) if parts.scheme == "https" else plain
        connection = http.client.HTTPConnection(parts.hostname, port, timeout=timeout)
        connection.sock = used
        connection.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers=headers | {"Host": parts.netloc})
        answer = connection.getresponse()
    except http.client.HTTPException as error:
        plain.close()
        raise OSError(str(error)) from error
    except BaseException:
        plain.close()
        raise

    def body() -> Iterator[bytes]:
        try:
            while piece := answer.read(1 << 16):
                yield piece
        except http.client.HTTPException as error:
            raise OSError(str(error)) from error
        finally:
            connection.close()

    return Response(answer.status, {k.lower(): v for k, v in answer.getheaders()}, body())


def read_body(answer: Response, settings: FetchSettings) -> tuple[str, bytes]:
    """Type and body of an answer that is neither an error nor a redirect; Refused if it is no page, encoded, or too large, as soon as that
    is known."""
    kind = answer.headers.get("content-type", "").split(";", 1)[0].strip().lower()
    if kind not in settings.types and not kind.endswith("+html"):
        raise Refused(NON_HTML)
    if answer.headers.get("content-encoding", "identity").lower() not in ("", "identity"):
        raise Refused(NON_HTML)
    stated = answer.headers.get("content-length", "")
    if stated.strip().isascii() and stated.strip().isdigit() and int(stated) > settings.max_bytes:
        raise Refused(TOO_LARGE)
    pieces, size = [], 0
    for piece in answer.body:
        size += len(piece)
        if size > settings.max_bytes:
            raise Refused(TOO_LARGE)
        pieces.append(piece)
    return kind, b"".join(pieces)


def fetch(url: str | None, transport: Transport = network, settings: FetchSettings = FetchSettings(), gate: Callable[[str], str | None] | None = None) -> dict:
    """A row of SCHEMA. gate gets each URL before it is asked for, the redirects' too, and may give a code that ends the fetch. Statuses from 400 on are no
    errors of the fetch; their body is empty. Bytes that aren't UTF-8 are replaced."""
    row = {"url": url, "final_url": None, "status": 0, "content_type": None, "html": None, "n_bytes": 0, "hops": 0, "error_code": None}
    headers = {"User-Agent": settings.agent, "Accept": "text/html,application/xhtml+xml;q=0.9,*/*;q=0.8", "Accept-Encoding": "identity"}
    try:
        here = target(url or "")
        for hop in range(settings.max_redirects + 1):
            row["hops"] = hop
            if gate and (code := gate(here)):
                raise Refused(code)
            answer = transport(here, headers, settings.timeout)
            close = getattr(answer.body, "close", lambda: None)
            try:
                if answer.status in LEADS_ON:
                    place = answer.headers.get("location", "")
                    if hop == settings.max_redirects or not place:
                        raise Refused(REDIRECTS)
                    here = target(urljoin(here, place))
                    continue
                kind = answer.headers.get("content-type", "").split(";", 1)[0].strip().lower()
                kind, body = (kind, b"") if answer.status >= 400 else read_body(answer, settings)
            finally:
                close()
            return row | {"final_url": here, "status": answer.status, "content_type": kind, "html": body.decode("utf-8", "replace"), "n_bytes": len(body)}
    except Refused as refused:
        return row | {"error_code": refused.code}
    except TimeoutError:
        return row | {"error_code": TIMEOUT}
    except (OSError, ValueError):
        return row | {"error_code": TRANSPORT}
    return row | {"error_code": REDIRECTS}


class Pace:
    """Waits between two requests to one host."""

    def __init__(self, delay: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.delay, self.clock, self.sleep, self.last = delay, clock, sleep, {}

    def wait(self, host: str) -> None:
        if self.delay > 0:
            if host in self.last and (left := self.delay - (self.clock() - self.last[host])) > 0:
                self.sleep(left)
            # hosts that have waited long enough need not be known any more
            if len(self.last) >= 1000:
                self.last = {h: t for h, t in self.last.items() if self.clock() - t < self.delay}
            self.last[host] = self.clock()


def _named(name: str) -> Transport:
    """A transport by module:function."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def fetch_pages(urls: DataFrame, transport: Transport | str = network, settings: FetchSettings = FetchSettings()) -> DataFrame:
    """SCHEMA, one row for each row of urls (url): a host's URLs are one task's, one after the other, no faster than settings.delay.

    A null URL is invalid, repeated ones are asked for again, and an empty table gives an empty one. Pages stream through, so what a task
    holds is one page and a batch of results.
    """
    host = F.coalesce(U.host(F.col("url")), F.lit(""))
    rows = urls.select("url", host.alias("host")).repartition("host").sortWithinPartitions("host", "url").select("url")
    types = {"url": pa.string(), "final_url": pa.string(), "status": pa.int32(), "content_type": pa.string(), "html": pa.string(), "n_bytes": pa.int64(), "hops": pa.int32(), "error_code": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = _named(transport) if isinstance(transport, str) else transport
        pace = Pace(settings.delay)
        held, size = [], 0
        for b in batches:
            for url in b.column(0).to_pylist():
                held.append(fetch(url, ask, settings, lambda here: pace.wait(urlsplit(here).hostname or "")))
                size += held[-1]["n_bytes"]
                if size >= 8 << 20 or len(held) >= 500:
                    yield pa.RecordBatch.from_pylist(held, pa.schema(types))
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, pa.schema(types))

    return rows.mapInArrow(run, SCHEMA)


def gate_recorded(responses: DataFrame, settings: FetchSettings = FetchSettings()) -> DataFrame:
    """What a fetch makes of answers that are there: responses (url, status, content_type, body: string) with final_url, html, n_bytes and error_code, by the
    same gates. A null body is empty; a null status stands for no answer. Other columns stay."""
    own = ("final_url", "status", "content_type", "html", "n_bytes", "error_code")
    keep = [c for c in responses.columns if c not in (*own, "body")]
    kind = responses.select(*keep).schema.add("final_url", "string").add("status", "integer").add("content_type", "string").add("html", "string").add("n_bytes", "long").add("error_code", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for url, status, content_type, body in zip(*(b.column(c).to_pylist() for c in ("url", "status", "content_type", "body")), strict=True):

                def ask(_: str, __: dict, ___: float, status=status, content_type=content_type, body=body) -> Response:
                    if status is None:
                        raise OSError("no answer")
                    return Response(status, {"content-type": content_type or ""}, [(body or "").encode()])

                rows.append(fetch(url, ask, replace(settings, max_redirects=0)))
            made = [pa.array([r[c] for r in rows], t) for c, t in zip(own, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *made], [*keep, *own])

    return responses.mapInArrow(run, kind)


class _Hosts(InputPartition):
    def __init__(self, value: list[str]) -> None:
        super().__init__(value)


class _PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.urls = [u for u in (x.strip() for x in options.get("urls", "").split("\n")) if u]
        if len(self.urls) > MOST_URLS:
            raise ValueError(f"at most {MOST_URLS} urls; use fetch_pages for a table of them")
        self.parts = int(options.get("partitions", "8"))
        self.transport = options.get("transport", "lodestone.sources.web:network")
        number = lambda name, kind, other: kind(options.get(name.lower(), options.get(name, other)))
        self.settings = FetchSettings(timeout=number("timeout", float, 10.0), max_redirects=number("maxRedirects", int, 5), max_bytes=number("maxBytes", int, 2_000_000), delay=number("delay", float, 0.0))

    def partitions(self) -> list[InputPartition]:
        """A host's URLs are in one partition, in the order given."""
        dealt: dict[int, list[str]] = {}
        for url in self.urls:
            try:
                host = urlsplit(url).hostname or ""
            except ValueError:
                host = ""
            dealt.setdefault(zlib.crc32(host.encode()) % self.parts, []).append(url)
        return [_Hosts(x) for x in dealt.values()] or [_Hosts([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        ask, pace = _named(self.transport), Pace(self.settings.delay)
        for url in partition.value:
            yield tuple(fetch(url, ask, self.settings, lambda here: pace.wait(urlsplit(here).hostname or "")).values())


class PageSource(DataSource):
    """spark.read.format("web_pages").option("urls", newline-separated).load() after register(spark). Options: partitions, timeout, maxRedirects,
    maxBytes, delay (seconds for a host) and transport (module:function)."""

    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)
