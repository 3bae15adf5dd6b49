"""A web of a few pages, in place of the network."""

from lodestone.sources.web import Response

PAGES = {
    "http://a.example.com/": (200, {"content-type": "text/html; charset=utf-8"}, [b"<p>a</p>", b"<p>\xff</p>"]),
    "http://a.example.com/x": (200, {"content-type": "application/vnd.x+html"}, [b"x"]),
    "http://a.example.com/pdf": (200, {"content-type": "application/pdf"}, [b"%PDF"]),
    "http://a.example.com/gone": (404, {"content-type": "text/html"}, [b"not here"]),
    "http://a.example.com/none": (200, {}, [b"no type"]),
    "http://a.example.com/zip": (200, {"content-type": "text/html", "content-encoding": "gzip"}, [b"z"]),
    "http://a.example.com/said": (200, {"content-type": "text/html", "content-length": "2000001"}, [b"never read"]),
    "http://a.example.com/odd": (200, {"content-type": "text/html", "content-length": "many"}, [b"fine"]),
    "http://b.example.com/go": (302, {"location": "/there"}, []),
    "http://b.example.com/there": (301, {"location": "http://a.example.com/"}, []),
    "http://b.example.com/loop": (307, {"location": "/loop"}, []),
    "http://b.example.com/nowhere": (303, {}, []),
    "http://b.example.com/inside": (308, {"location": "http://127.0.0.1/secret"}, []),
    "http://b.example.com/mail": (302, {"location": "mailto:x@y"}, []),
}
READ: list[int] = []


def endless():
    while True:
        READ.append(1)
        yield b"x" * 100_000


def transport(url, headers, timeout):
    assert headers["Accept-Encoding"] == "identity" and timeout > 0
    if url.endswith("/slow"):
        raise TimeoutError
    if url.endswith("/endless"):
        return Response(200, {"content-type": "text/html"}, endless())
    if url not in PAGES:
        raise ConnectionRefusedError
    return Response(*PAGES[url])
