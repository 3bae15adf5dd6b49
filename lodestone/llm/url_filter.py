"""URL filtering by rules and by a list of canonical URLs, in DataFrame operations only.

Rules are few (a contract's); the longest that fits decides. Where none does, the list decides, which is a table of any size:
every listed URL is brought to its canonical form and covers the page of that form, or all below it if it ends in a
slash, on its host and all subdomains. A URL gives a bounded set of keys: each suffix of its canonical host with each directory
of its canonical path, as deep as the list goes, and the path itself. A blocked Bloom filter of the listed hosts and URLs
lets possible hits through; an exact hash join on the key then removes false positives. The longest listed key wins.

A key's block is one 64-bit word; four bits in it are set, all from one hash, so a probe reads a single word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, unused
from .exact_dedup import ascii_lower

#: Keys per 64-bit block: 16 bits a key, about 1 % false positives.
KEYS_PER_BLOCK = 4
#: Blocks up to which the filter, as a table of (block, word), goes to every task: some 50 MB there. A larger one is joined as it is.
BROADCAST_BLOCKS = 1 << 20


@dataclass(frozen=True)
class Listed:
    """host covers its subdomains, path every path that starts with it."""

    host: str
    path: str
    verdict: str


#: The rules that op7 applies, fixed by its contract.
RULES = (
    Listed("com", "/", "allow"),
    Listed("example.com", "/en/", "block"),
    Listed("www.example.com", "/en/", "allow"),
    Listed("net", "/es/", "block"),
    Listed("net", "/fr/", "block"),
)
#: URLs that are blocked where no rule fits: the list that op7 gives to the filter. Any table of URLs may take its place.
LISTED_URLS = tuple(f"http://{name}.example.{end}/" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_host(host: Column) -> Column:
    """host without user, port and the root's dot."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$|\.+$|\.+(?=:[0-9]*$)", "")


def canonical_path(path: Column) -> Column:
    """path with escapes in capitals, or as the character where that needs none, without empty, . and .. parts; at least a slash."""
    parts = F.split(path, "%")
    hexadecimal = lambda p: F.upper(F.substring(p, 1, 2))
    plain = lambda p: F.decode(F.unhex(hexadecimal(p)), "UTF-8")
    valid = lambda p: F.substring(p, 1, 2).rlike("^[0-9A-Fa-f]{2}$")
    free = lambda p: hexadecimal(p).rlike("^(2[DE]|3[0-9]|4[1-9A-F]|5[0-9AF]|6[1-9A-F]|7[0-9AE])$")
    escaped = F.transform(
        F.slice(parts, 2, F.size(parts)),
        lambda p: F.when(valid(p) & free(p), F.concat(plain(p), F.substring(p, F.lit(3), F.length(p)))).when(valid(p), F.concat(F.lit("%"), hexadecimal(p), F.substring(p, F.lit(3), F.length(p)))).otherwise(F.concat(F.lit("%"), p)),
    )
    path = F.when(F.instr(path, "%") > 0, F.concat(F.element_at(parts, 1), F.array_join(escaped, ""))).otherwise(path)
    parts = F.split(path, "/")
    up = lambda seen: F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(0)))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda seen, p: F.when(p.isin("", "."), seen).when(p == "..", up(seen)).otherwise(F.concat(seen, F.array(p))))
    directory = F.element_at(parts, -1).isin("", ".", "..") & (F.size(walked) > 0)
    straight = F.concat(F.lit("/"), F.array_join(walked, "/"), F.when(directory, "/").otherwise(""))
    return F.when(path == "", "/").when(path.rlike(r"//|/\.{1,2}(/|$)"), straight).otherwise(path)


def _mask(h: Column) -> Column:
    """Four bits of a word, chosen by bits 0-23 of the hash; the block comes from those above."""
    bit = lambda k: F.expr(f"shiftleft(1L, cast(shiftright(h, {6 * k}) & 63 as int))")
    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))


def blocked_bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter of keys' column key, stored: block and word, for the blocks that have bits."""
    hashed = keys.select(F.xxhash64("key").alias("h"))
    return stored(hashed.select(F.pmod(F.shiftright("h", 24), F.lit(blocks)).alias("block"), _mask(F.col("h")).alias("word")).groupBy("block").agg(F.bit_or("word").alias("word")), "url-filter")


def probed(rows: DataFrame, key: str, bloom: DataFrame, blocks: int, out: str) -> DataFrame:
    """rows with out: whether the filter lets their key through; a null key doesn't pass. The filter is joined by the key's block, so a row carries one
    word of it, however large it is."""
    h, block, word = unused(rows, "h_", "block_", "word_")
    held = bloom.select(F.col("block").alias(block), F.col("word").alias(word))
    if blocks <= BROADCAST_BLOCKS:
        held = F.broadcast(held)
    rows = rows.withColumn(h, F.when(F.col(key).isNotNull(), F.xxhash64(key)))
    rows = rows.withColumn(block, F.pmod(F.shiftright(h, 24), F.lit(blocks))).join(held, block, "left")
    bits = [F.call_function("getbit", F.col(word), F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) == 1 for k in range(4)]
    return rows.withColumn(out, F.coalesce(bits[0] & bits[1] & bits[2] & bits[3], F.lit(False))).drop(h, block, word)


def listed_keys(listed: DataFrame) -> DataFrame:
    """From a list (url, verdict) its distinct keys: key, host, depth (parts of the path) and key_verdict; of a key with both verdicts
    block counts. Rows without a host are left out."""
    url = listed.select(F.col("url").cast("string").alias("u"), "verdict")
    rows = url.select(canonical_host(host_of(F.col("u"))).alias("host"), canonical_path(path_of(F.col("u"))).alias("path"), "verdict").filter("host <> ''")
    rows = rows.select(F.concat("host", "path").alias("key"), "host", (F.size(F.split("path", "/")) - 1).alias("depth"), "verdict")
    return rows.groupBy("key", "host", "depth").agg(F.max("verdict").alias("key_verdict"))


def url_verdicts(pages: DataFrame, listed: DataFrame, rules: tuple[Listed, ...] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: id_col, host, path, rule, verdict, listed.

    rule is the longest (in characters; equal ones: the greater string) of the rules that fit, null if none does. Where none
    does, listed is the longest listed canonical URL (a row of listed: url, verdict) that covers the page, and decides; else the
    verdict is default. A null or empty url, or one without ://, has empty host and path, fits nothing and is on no list. Repeated rows
    are each judged; an empty table of pages or an empty list is fine. Other columns of pages are not read.
    """
    host, path = F.col("host"), F.col("path")
    entries = stored(listed_keys(listed), "listed-keys")
    labels_of = F.max(F.size(F.split("host", r"\.")))
    n, hosts, depth, most_labels = entries.agg(F.count("*"), F.count_distinct("host"), F.max("depth"), labels_of).first()
    blocks = max(1, -(-(n + hosts) // KEYS_PER_BLOCK))
    bloom = blocked_bloom(entries.select("key").union(entries.select("host").distinct()), blocks)
    rule, rule_verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for x in sorted(rules, key=lambda x: (len(x.host + x.path), x.host + x.path)):
        fits = ((host == x.host) | F.endswith(host, F.lit("." + x.host))) & F.startswith(path, F.lit(x.path))
        rule, rule_verdict = F.when(fits, x.host + x.path).otherwise(rule), F.when(fits, x.verdict).otherwise(rule_verdict)
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("u")).select("id", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    base = base.select(F.monotonically_increasing_id().alias("row"), "id", "host", "path", rule.alias("rule"), rule_verdict.alias("rule_verdict"), canonical_host(host).alias("h"), canonical_path(path).alias("p"))
    kept = ("row", "id", "host", "path", "rule", "rule_verdict")
    nothing = F.array().cast("array<string>")
    labels, parts = F.split("h", r"\."), F.split("p", "/")
    # no suffix of more labels, and no directory of more parts, than any that is listed
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most_labels or 1))), lambda i: F.array_join(F.slice(labels, F.size(labels) - i + 1, i), "."))
    suffixes = F.when((F.col("h") != "") & F.col("rule").isNull() & F.lit(n > 0), suffixes).otherwise(nothing)
    deep = F.least(F.size(parts) - 1, F.lit(depth or 0))
    directories = F.transform(F.when(deep > 0, F.sequence(F.lit(1), deep)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    own = F.when(F.size(parts) - 1 <= F.lit(depth or 0), F.array("p")).otherwise(nothing)
    paths = F.array_distinct(F.concat(directories, own))
    # of the suffixes, and then of the keys, those that pass go on; a row without any keeps its first one, which the exact join ignores
    on_list = probed(base.select(*kept, "p", F.posexplode_outer(suffixes).alias("at", "suffix")), "suffix", bloom, blocks, "passes").filter("passes OR at IS NULL OR at = 0")
    keys = F.when(F.col("passes"), F.transform(paths, lambda p: F.concat(F.col("suffix"), p))).otherwise(nothing)
    possible = probed(on_list.select(*kept, F.posexplode_outer(keys).alias("at", "key")), "key", bloom, blocks, "passes").filter("passes OR at IS NULL OR at = 0")
    # a row without possible hits gets a key of its own that nothing has, so such rows don't meet in one task
    possible = possible.withColumn("key", F.when(F.col("passes"), F.col("key")).otherwise(F.concat(F.lit("\n"), F.col("row").cast("string"))))
    found = possible.join(entries.select("key", "key_verdict"), "key", "left")
    best = F.max(F.when(F.col("key_verdict").isNotNull(), F.struct(F.length("key").alias("n"), "key", "key_verdict"))).alias("best")
    return found.groupBy(*kept).agg(best).select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", "best.key_verdict", F.lit(default)).alias("verdict"),
        F.col("best.key").alias("listed"),
    )


def list_of(spark: SparkSession, urls: tuple[str, ...], verdict: str = "block") -> DataFrame:
    """A short list as a table."""
    rows = F.array(*[F.struct(F.lit(u).alias("url"), F.lit(verdict).alias("verdict")) for u in urls])
    return spark.range(1).select(F.inline(rows if urls else F.array().cast("array<struct<url:string,verdict:string>>")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every page's url by RULES, then the list, else allow."""
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), list_of(spark, LISTED_URLS))


_RULES = " UNION ALL ".join(f"SELECT '{x.host}' AS h, '{x.path}' AS p, '{x.verdict}' AS v" for x in RULES)
_LIST = " UNION ALL ".join(f"SELECT '{u.removeprefix('http://').removesuffix('/')}' AS l" for u in LISTED_URLS)
ORACLE = {
    "op7_url_filter": f"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN NULL ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
cut AS (
  SELECT page_id, row_number() OVER () AS rn,
    translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
named AS (SELECT *, rtrim(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS name FROM cut),
rules AS ({_RULES}),
listed AS ({_LIST}),
ruled AS (SELECT rn, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v FROM named JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rn),
found AS (SELECT rn, max_by(l, length(l)) || '/' AS listed FROM named JOIN listed ON name = l OR ends_with(name, '.' || l) WHERE rn NOT IN (SELECT rn FROM ruled) GROUP BY rn)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN listed IS NOT NULL THEN 'block' END, 'allow') AS verdict, listed
FROM named LEFT JOIN ruled USING (rn) LEFT JOIN found USING (rn)"""
}
