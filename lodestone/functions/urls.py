"""URLs: canonical form, resolution, safety gate, scope, robots rules.

Splitting, gating and canonical forms are column expressions. Only the resolution of relative links and robots rules go through
Arrow batches and the standard library.
"""

from __future__ import annotations

import ipaddress
import urllib.robotparser
from collections.abc import Iterator
from urllib.parse import quote, unquote, urljoin, urlparse, urlunparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType

#: Query parameters that canonical URLs drop.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content gclid fbclid mc_cid mc_eid ref ref_src spm".split()
#: Endings of paths that aren't pages.
NOT_PAGES = (
    ".7z .aac .avi .bmp .bz2 .css .csv .doc .docx .eot .exe .flac .gif .gz .ico .jpeg .jpg .js .json .m4a .mkv .mov .mp3 .mp4 .mpeg "
    ".mpg .ogg .ogv .pdf .png .ppt .pptx .rar .svg .tar .tif .tiff .ttf .txt .wav .webm .webp .woff .woff2 .xls .xlsx .xml .zip"
).split()
#: Names and endings of hosts that aren't public.
LOCAL_NAMES = "localhost localhost.localdomain metadata metadata.google.internal".split()
LOCAL_ENDINGS = ".localhost .local .localdomain .internal".split()
#: What a link may not begin with.
NO_LINKS = ("#", "javascript:", "mailto:", "tel:")

_SPLIT = r"(?s)\A([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?\z"


def _piece(url: Column, k: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, k)


def scheme(url: Column) -> Column:
    return F.lower(_piece(url, 1))


def _user(url: Column) -> Column:
    return F.regexp_extract(_piece(url, 2), r"(?s)\A(.*)@", 1)


def _host_port(url: Column) -> Column:
    return F.regexp_replace(_piece(url, 2), r"(?s)\A.*@", "")


def host(url: Column) -> Column:
    """Lower-cased, without port and brackets; empty if there is none."""
    return F.lower(F.regexp_replace(F.regexp_replace(_host_port(url), r":[0-9]*\z", ""), r"[\[\]]", ""))


def source_host(source: Column) -> Column:
    """Host with its port of an http(s) source, else empty: files have no host."""
    return F.when(scheme(F.trim(source)).isin("http", "https"), F.lower(_piece(F.trim(source), 2))).otherwise(F.lit(""))


def is_global_name(name: str) -> bool:
    """Whether a host that is an IP literal is public; a name counts as public."""
    try:
        return ipaddress.ip_address(name).is_global
    except ValueError:
        return True


@F.pandas_udf(BooleanType())
def is_global(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: is_global_name(x or ""))


def is_private_name(name: Column) -> Column:
    """By name alone; IP literals are judged by is_global."""
    ends = F.lit(False)
    for x in LOCAL_ENDINGS:
        ends = ends | F.endswith(name, F.lit(x))
    return (name == "") | name.isin(LOCAL_NAMES) | ends


def is_dangerous(url: Column) -> Column:
    return ~scheme(url).isin("http", "https") | F.contains(_piece(url, 2), F.lit("@")) | (host(url) == "")


def is_crawlable(url: Column) -> Column:
    """http(s) without credentials, a public host, the default port, and a path that may be a page."""
    path, port = F.lower(_piece(url, 3)), F.regexp_extract(_host_port(url), r":([^:\]]*)\z", 1)
    unwanted = F.lit(False)
    for x in NOT_PAGES:
        unwanted = unwanted | F.endswith(path, F.lit(x))
    standard = (port == "") | ((scheme(url) == "http") & (port == "80")) | ((scheme(url) == "https") & (port == "443"))
    name = host(url)
    literal = name.rlike(r"\A[0-9a-f:.]*[0-9a-f:]\z")
    return ~is_dangerous(url) & ~unwanted & ~is_private_name(name) & standard & F.when(literal, is_global(name)).otherwise(F.lit(True))


_AUTHORITY = r"(?s)\A(?:([^:]*)(:.*)?@)?(\[[^\]@]*\]|[^:\[\]@]*)(?::([0-9]*))?\z"


def _requoted(word: Column) -> Column:
    """A name or value of a query as forms write it: decoded, then encoded anew. A percent sign that begins no escape stands for itself."""
    decoded = F.url_decode(F.regexp_replace(word, "%(?![0-9A-Fa-f]{2})", "%25"))
    return F.replace(F.replace(F.url_encode(decoded), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _canonical_query(query: Column) -> Column:
    """Without tracking parameters and empty pairs; each of the others as name=value."""
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    named = F.transform(pairs, lambda x: F.struct(_requoted(F.substring_index(x, "=", 1)).alias("name"), _requoted(F.when(F.instr(x, "=") > 0, F.regexp_replace(x, r"(?s)\A[^=]*=", "")).otherwise("")).alias("value")))
    kept = F.filter(named, lambda p: ~F.lower(p["name"]).isin(TRACKING))
    return F.array_join(F.transform(kept, lambda p: F.concat(p["name"], F.lit("="), p["value"])), "&")


def normalize(url: Column | str, drop_tracking: bool = True) -> Column:
    """The canonical form: scheme and host lower-cased, no default port, no fragment, single slashes, no slash at the end of a longer
    path, no tracking parameters, the others encoded anew. What has no scheme and host, or no valid port, stays as it is, but for
    white space around it; null is empty."""
    raw = F.regexp_replace(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"\A[\s\x00-\x20\x85\xa0]+|[\s\x85\xa0]+\z", "")
    whole = F.translate(raw, "\t\r\n", "")
    place = _piece(whole, 2)
    part = lambda k: F.regexp_extract(place, _AUTHORITY, k)
    port = F.regexp_replace(part(4), "^0+(?=[0-9])", "")
    valid = (place != "") & place.rlike(_AUTHORITY) & (F.length(port) <= 5) & ((port == "") | (port.cast("int") <= 65535))
    standard = (port == "") | ((scheme(whole) == "http") & (port == "80")) | ((scheme(whole) == "https") & (port == "443"))
    password = F.when(F.length(part(2)) > 1, part(2)).otherwise("")
    user = F.when(part(1) != "", F.concat(part(1), password, F.lit("@"))).otherwise("")
    single = F.regexp_replace(_piece(whole, 3), "/+", "/")
    path = F.when(single == "/", single).otherwise(F.regexp_replace(single, "/$", ""))
    query = _canonical_query(_piece(whole, 4)) if drop_tracking else _piece(whole, 4)
    return F.when(valid, F.concat(scheme(whole), F.lit("://"), user, F.lower(part(3)), F.when(standard, "").otherwise(F.concat(F.lit(":"), port)), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))).otherwise(raw)


@F.pandas_udf(StringType())
def joined(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    def one(base: str, link: str) -> str:
        try:
            return urljoin(base or "", link or "")
        except ValueError:
            return link or ""

    for bases, links in batches:
        yield pd.Series([one(b, x) for b, x in zip(bases, links, strict=True)], dtype=object)


def resolve(base: Column | str, link: Column | str) -> Column:
    """A link against its base, in canonical form. Joining is the standard library's, in Arrow batches."""
    return normalize(joined(base, link))


def is_public(url: Column) -> Column:
    """An http(s) URL with a host and a valid port, without credentials or white space."""
    port = F.regexp_extract(_host_port(url), r":([^:\]]*)\z", 1)
    return scheme(url).isin("http", "https") & (host(url) != "") & (_user(url) == "") & ~url.rlike(r"[\s\x85\xa0]") & (port.rlike(r"\A[0-9]{0,5}\z")) & (F.coalesce(port.try_cast("int"), F.lit(0)) <= 65535)


#: Fixed value: the longest URL that a reader takes.
READER_URL_CHARS = 2048


def reader_url(url: Column) -> Column:
    """A struct url, error: what a reader would fetch (scheme and host lower-cased, no fragment, a path at least), or why it doesn't:
    invalid_url (no public form of http or https, another port than the scheme's, control characters, too long) or
    blocked_destination (a local name)."""
    clean = F.trim(F.coalesce(url, F.lit("")))
    port = F.regexp_extract(_host_port(clean), r":([^:\]]*)\z", 1)
    own = (port == "") | ((scheme(clean) == "http") & (port == "80")) | ((scheme(clean) == "https") & (port == "443"))
    valid = (F.length(url) <= READER_URL_CHARS) & scheme(clean).isin("http", "https") & (host(clean) != "") & ~F.contains(_piece(clean, 2), F.lit("@")) & own & ~url.rlike(r"[\x00-\x1f\x7f]")
    name = F.regexp_replace(host(clean), r"\.+$", "")
    place = F.concat(F.when(F.contains(name, F.lit(":")), F.concat(F.lit("["), name, F.lit("]"))).otherwise(name), F.when(port == "", "").otherwise(F.concat(F.lit(":"), port)))
    path, query = _piece(clean, 3), _piece(clean, 4)
    form = F.concat(scheme(clean), F.lit("://"), place, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    error = F.when(~F.coalesce(valid, F.lit(False)), "invalid_url").when(is_private_name(name), "blocked_destination")
    return F.struct(F.when(error.isNull(), form).alias("url"), error.alias("error"))


def public_form(url: Column) -> Column:
    """By what public URLs count as the same: scheme and host lower-cased, no default port, no slash at the end, no fragment."""
    port = F.regexp_extract(_host_port(url), r":([0-9]+)\z", 1)
    standard = (port == "") | ((scheme(url) == "https") & (port == "443")) | ((scheme(url) != "https") & (port == "80"))
    path = F.regexp_replace(_piece(url, 3), "/+$", "")
    query = _piece(url, 4)
    return F.concat(scheme(url), F.lit("://"), host(url), F.when(standard, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


#: What the labels of a host name are made of, and how long they and the name are at most.
LABEL_LETTERS, LABEL_CHARS, NAME_CHARS = "abcdefghijklmnopqrstuvwxyz0123456789-", 63, 253


@F.pandas_udf(StringType())
def _ascii_form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Names with other letters in the ASCII form of domain names; null where there is none."""

    def one(name: str | None) -> str | None:
        if not name or name.isascii():
            return name
        try:
            return name.encode("idna").decode("ascii")
        except UnicodeError:
            return None

    for s in batches:
        yield s.map(one)


def host_name(name: Column | str) -> Column:
    """A name in its ASCII form, lower-cased, without white space around it and dots at its end; null if it is no host name: labels between dots, each of
    letters, digits and inner hyphens."""
    clean = F.regexp_replace(F.regexp_replace(F.col(name) if isinstance(name, str) else name, r"\A\s+|\s+\z", ""), r"\.+\z", "")
    ascii_name = F.lower(_ascii_form(clean))
    fits = F.forall(F.split(ascii_name, r"\."), lambda x: F.length(x).between(1, LABEL_CHARS) & (F.translate(x, LABEL_LETTERS, "") == "") & ~F.startswith(x, F.lit("-")) & ~F.endswith(x, F.lit("-")))
    return F.when(fits & (F.length(ascii_name) <= NAME_CHARS), ascii_name)


def in_scope(name: Column, domains: list[str]) -> Column:
    """The host is one of the domains or below one; no domains match nothing."""
    clean = F.regexp_replace(F.lower(name), r"\.+\z", "")
    out = F.lit(False)
    for d in {d.lower().strip(".") for d in domains} - {""}:
        out = out | (clean == d) | F.endswith(clean, F.lit("." + d))
    return out


def suffixes(name: Column) -> Column:
    """The host and each of its parent domains: scope as an equi-join when the domains are a table."""
    parts = F.split(F.regexp_replace(F.lower(name), r"\.+\z", ""), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def _parsed_robots(body: str) -> urllib.robotparser.RobotFileParser:
    """A body that says "deny" by a bare Disallow (as a 401 or 403 answer is stored) denies: rules before any User-agent line hold for all
    agents."""
    lines = (body or "").splitlines()
    if next((x for x in lines if x.split("#")[0].strip()), "").lower().startswith("disallow"):
        lines = ["User-agent: *", *lines]
    rules = urllib.robotparser.RobotFileParser()
    rules.parse(lines)
    return rules


def robots_allows(body: str, agent: str, url: str) -> tuple[bool, float]:
    """Whether agent may read url by a robots.txt body, and its crawl delay."""
    rules = _parsed_robots(body)
    return rules.can_fetch(agent, url), max(0.0, float(rules.crawl_delay(agent) or 0))


def robots_rows(agent: str):
    """A function of bodies: struct of delay and rules, an array of (path, allow) in their order; the first whose path begins a URL's path
    decides. A body is parsed once for all its host's URLs."""
    rule = StructType([StructField("path", StringType()), StructField("allow", BooleanType())])

    def one(body: str) -> tuple[float, list[tuple[str, bool]]]:
        parsed = _parsed_robots(body)
        entry = next((e for e in [*parsed.entries, parsed.default_entry] if e and (e is parsed.default_entry or e.applies_to(agent))), None)
        rules = [(r.path, r.allowance) for r in entry.rulelines] if entry else []
        return max(0.0, float(parsed.crawl_delay(agent) or 0)), rules

    @F.pandas_udf(StructType([StructField("delay", DoubleType()), StructField("rules", ArrayType(rule))]))
    def run(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in bodies], columns=["delay", "rules"])

    return run


@F.pandas_udf(StringType())
def robots_path(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """What the paths of rules are held against: a URL's path, query and fragment, decoded and quoted anew."""

    def one(url: str) -> str:
        try:
            parts = urlparse(unquote(url or ""))
        except ValueError:
            return "/"
        return quote(urlunparse(("", "", *parts[2:]))) or "/"

    for s in batches:
        yield s.map(one)
