"""Crawling over a table of fetched pages: extraction, gates, and breadth-first levels as joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U
from ..sources.tables import bound_batches, stored


def extracted(pages: DataFrame, chars: int = DEFAULT.crawl_chars) -> DataFrame:
    """pages (url, html) with title, text, content_hash (of the text as extracted), chunks, links and published."""
    bound_batches(pages.sparkSession)
    rows = pages.withColumn("x", H.extract(F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))))
    rows = rows.select(*pages.columns, "x.title", F.substring("x.text", 1, chars).alias("text"), "x.links", F.to_date("x.published").alias("published"))
    return rows.withColumns({"content_hash": F.sha2("text", 256), "chunks": T.chunks(F.col("text"), DEFAULT.chunk_chars)})


def link_graph(pages: DataFrame) -> DataFrame:
    """src, dst: canonical URLs of each page and the pages that it links to, once each."""
    links = pages.select("url", F.explode("links" if "links" in pages.columns else H.raw_links(F.col("html"))).alias("link"))
    return links.select(U.normalize("url").alias("src"), U.resolve("url", "link").alias("dst")).distinct()


def jobs_report(jobs: DataFrame) -> DataFrame:
    """One row, jobs and documents: how many crawls (job_id, pages_crawled) there were, and pages that they kept."""
    return jobs.agg(F.count("*").alias("jobs"), F.coalesce(F.sum("pages_crawled"), F.lit(0)).cast("long").alias("documents"))


@dataclass(frozen=True)
class RobotsRules:
    """hosts: host, delay and lengths (of its rules' paths); rules: host, path, pos and allow, each path once."""

    hosts: DataFrame
    rules: DataFrame


def robots_rules(robots: DataFrame, agent: str) -> RobotsRules:
    """The rules for an agent in robots.txt files (host, body; one for each host), stored. Every body is parsed once."""
    parsed = robots.select("host", U.robots_rows(agent)(F.coalesce("body", F.lit(""))).alias("r"))
    parsed = stored(parsed.select("host", "r.delay", "r.rules"), "robots")
    hosts = parsed.select("host", "delay", F.array_distinct(F.transform("rules", lambda r: F.length(r["path"]))).alias("lengths"))
    rules = parsed.select("host", F.posexplode("rules").alias("pos", "r")).groupBy("host", F.col("r.path").alias("path")).agg(F.min("pos").alias("pos"), F.min_by("r.allow", "pos").alias("allow"))
    return RobotsRules(hosts, rules)


def with_robots(rows: DataFrame, robots: DataFrame | RobotsRules, agent: str) -> DataFrame:
    """rows (url, ...) with allowed and delay, by the robots.txt (robots: host, body, or the rules made of them) of each url's host; a host without
    one allows all.

    A path meets the rules that begin it in an equi-join: it is cut to each length that rules of its host have, so a host with many
    URLs or rules is spread over tasks, and no file is parsed for a URL.
    """
    found = robots if isinstance(robots, RobotsRules) else robots_rules(robots, agent)
    rows = rows.withColumns({"__h": U.host(F.col("url")), "__p": U.robots_path("url")})
    asked = rows.select("__h", "__p").distinct().join(found.hosts.select(F.col("host").alias("__h"), "lengths"), "__h")
    heads = asked.select("__h", "__p", F.explode("lengths").alias("n")).filter("n <= length(__p)").withColumn("path", F.expr("substring(__p, 1, n)"))
    hits = heads.join(found.rules.withColumnRenamed("host", "__h"), ["__h", "path"]).groupBy("__h", "__p").agg(F.min_by("allow", "pos").alias("__ok"))
    rows = rows.join(hits, ["__h", "__p"], "left").join(found.hosts.select(F.col("host").alias("__h"), F.col("delay").alias("__d")), "__h", "left")
    return rows.withColumns({"allowed": F.coalesce("__ok", F.lit(True)), "delay": F.coalesce("__d", F.lit(0.0))}).drop("__h", "__p", "__ok", "__d")


#: Fixed value: redirects that a reader follows at most.
MOST_REDIRECTS = 5


def redirects(requests: DataFrame, responses: DataFrame, robots: DataFrame | None = None, agent: str = "lodestone", most: int = MOST_REDIRECTS) -> DataFrame:
    """One row for each distinct url of requests: url, final_url, status, hops, looped and error_code, by following recorded responses (url, in the form that a
    reader asks for; status; location).

    Every hop is brought to that form and checked (invalid_url; blocked_destination: a local name or address), held against its host's robots.txt
    (robots_disallowed), and looked up (connection_error without a response). What leads on without a place, or after most hops, is
    too_many_redirects, and so is a place that was visited before, which is also looped. All URLs go hop by hop, in a join each.
    """
    rules = robots_rules(robots, agent) if robots is not None else None
    answers = stored(responses.select(F.col("url").alias("at"), "status", "location").dropDuplicates(["at"]), "responses")
    nothing = F.lit(None).cast("string")
    at = requests.select("url").distinct().select("url", F.col("url").alias("to"), F.array().cast("array<string>").alias("seen"))
    done = None
    for hop in range(most + 1):
        checked = at.withColumn("x", U.reader_url(F.col("to"))).select("url", F.col("x.url").alias("at"), F.col("x.error").alias("error"), "seen")
        inside = F.col("at").isNotNull() & ~U.is_global(U.host(F.col("at")))
        checked = checked.withColumn("error", F.coalesce("error", F.when(inside, "blocked_destination")))
        if rules is not None:
            checked = with_robots(checked.withColumnRenamed("url", "__from").withColumn("url", F.coalesce("at", F.lit(""))), rules, agent).drop("url", "delay").withColumnRenamed("__from", "url")
        else:
            checked = checked.withColumn("allowed", F.lit(True))
        looped = F.array_contains("seen", F.coalesce("at", F.lit("")))
        error = F.coalesce(F.col("error"), F.when(looped, "too_many_redirects"), F.when(~F.col("allowed"), "robots_disallowed"))
        met = checked.select("url", "at", error.alias("error"), "seen", looped.alias("looped")).join(answers, "at", "left")
        leads = F.col("status").isin(301, 302, 303, 307, 308)
        stuck = leads & ((F.coalesce("location", F.lit("")) == "") | F.lit(hop == most))
        error = F.coalesce(F.col("error"), F.when(F.col("status").isNull(), "connection_error"), F.when(stuck, "too_many_redirects"))
        met = stored(met.withColumns({"error": error, "on": error.isNull() & leads}), "hop")
        ended = met.filter("NOT on").select("url", F.when(F.col("error").isNull(), F.col("at")).otherwise(nothing).alias("final_url"), F.when(F.col("error").isNull(), F.col("status")).otherwise(0).cast("int").alias("status"), F.lit(hop).alias("hops"), "looped", F.col("error").alias("error_code"))
        done = ended if done is None else done.unionByName(ended)
        at = met.filter("on").select("url", U.joined("at", "location").alias("to"), F.array_append("seen", F.col("at")).alias("seen"))
        if hop == most or at.isEmpty():
            return done


def with_scope(rows: DataFrame, url_col: str, domains: DataFrame) -> DataFrame:
    """rows with in_scope: whether the url's host is one of domains (domain) or below one. An equi-join on the hosts' suffixes, so the
    domains may be many; null hosts are in none."""
    hosts = rows.select(U.host(F.col(url_col)).alias("__host")).distinct()
    inside = hosts.select("__host", F.explode(U.suffixes(F.col("__host"))).alias("domain")).join(domains.select("domain").distinct(), "domain").select(F.col("__host").alias("__in")).distinct()
    return rows.join(inside, U.host(F.col(url_col)) == F.col("__in"), "left").withColumn("in_scope", F.col("__in").isNotNull()).drop("__in")


@dataclass(frozen=True)
class Crawl:
    pages: DataFrame
    failures: DataFrame
    report: DataFrame


@dataclass(frozen=True)
class CrawlConfig:
    max_depth: int = DEFAULT.crawl_depth
    max_pages: int = DEFAULT.crawl_pages
    frontier_cap: int = DEFAULT.frontier_cap
    allowed: tuple[str, ...] = ()
    agent: str = "lodestone"
    respect_robots: bool = True


def crawl(fetched: DataFrame, seeds: list[str] | DataFrame, config: CrawlConfig = CrawlConfig(), robots: DataFrame | None = None) -> Crawl:
    """Follows links from seeds (urls, or a table pos, url) through a table of fetched pages (url, status, content_type, html), level by
    level; robots has host and body. Of a level the first URLs in their order of discovery are read until max_pages pages are kept; a page that has the text of an
    earlier one isn't kept and its links aren't followed. The order within a level is fixed, so results don't depend on timing.

    Visited URLs and text hashes are tables, so each level is a few joins; what reaches the driver are counts.
    """
    spark = fetched.sparkSession
    store = fetched.withColumn("url", U.normalize("url")).dropDuplicates(["url"])
    table = seeds if isinstance(seeds, DataFrame) else spark.createDataFrame(list(enumerate(seeds)), "pos long, url string")
    # a page's place in the order of discovery: its seed's number, then the number of each link on the way to it
    place = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    seed_rows = table.select(place("pos").alias("pos"), F.col("url").alias("raw"), U.normalize("url").alias("url"))
    hosts = seed_rows.select(U.host(F.col("url")).alias("domain"))
    allowed = spark.createDataFrame([(d.lower().strip("."),) for d in config.allowed], "domain string") if config.allowed else hosts
    allowed = stored(allowed.filter("domain <> ''").distinct(), "allowed")
    gate = F.when(~U.is_crawlable(F.col("url")), "unparsable_seed").when(~F.col("in_scope"), "out_of_scope")
    seed_rows = stored(with_scope(seed_rows, "url", allowed).withColumn("error", gate).drop("in_scope"), "seeds")
    failures = seed_rows.filter("error IS NOT NULL").select(F.col("raw").alias("url"), F.lit(0).alias("status"), F.col("error").alias("error_code"))
    counts = dict.fromkeys(("robots_blocked", "urls_seen", "duplicate_urls", "duplicate_content"), 0)
    counts["out_of_scope"] = failures.filter("error_code = 'out_of_scope'").count()
    level = seed_rows.filter("error IS NULL").groupBy("url").agg(F.min("pos").alias("pos"))
    visited, pages, kept = level.select("url"), None, 0
    rules = robots_rules(robots, config.agent) if config.respect_robots and robots is not None else None
    for depth in range(config.max_depth + 1):
        if kept >= config.max_pages:
            break
        read = level.join(store, "url", "left")
        if rules is not None:
            read = with_robots(read, rules, config.agent).withColumnRenamed("allowed", "__ok").drop("delay")
        else:
            read = read.withColumn("__ok", F.lit(True))
        is_html = F.coalesce("content_type", F.lit("")).rlike(r"\A(text/html|application/xhtml\+xml|[^;]*\+html|)(;|\z)")
        state = F.when(~F.col("__ok"), "robots").when(F.col("status").isNull(), "unreachable").when(F.col("status") >= 400, "http_status").when(~is_html, "not_html").otherwise("ok")
        read = stored(read.withColumn("state", state), "level")
        counts["urls_seen"] += read.count()
        counts["robots_blocked"] += read.filter("state = 'robots'").count()
        failures = failures.unionByName(read.filter("state IN ('unreachable', 'http_status')").select("url", F.coalesce("status", F.lit(0)).alias("status"), F.col("state").alias("error_code")))
        fresh = extracted(read.filter("state = 'ok'").select("url", "pos", "status", "html")).filter("text <> ''").drop("html")
        first = F.row_number().over(W.partitionBy("content_hash").orderBy("pos"))
        fresh = stored(fresh.withColumn("depth", F.lit(depth)).withColumn("__n", first), "fresh")
        new = fresh.filter("__n = 1").drop("__n")
        if pages is not None:
            new = new.join(pages.select("content_hash"), "content_hash", "left_anti")
        new = stored(new, "pages")
        added = new.count()
        if added > config.max_pages - kept:
            added = config.max_pages - kept
            new = stored(new.orderBy("pos").limit(added), "pages")
        counts["duplicate_content"] += fresh.count() - added
        kept += added
        pages = new if pages is None else pages.unionByName(new)
        if depth == config.max_depth or not added:
            break
        links = new.select("pos", "url", F.posexplode("links").alias("at", "link")).select(F.concat_ws(".", "pos", place("at")).alias("pos"), U.resolve("url", "link").alias("to"))
        links = stored(with_scope(links, "to", allowed).withColumn("ok", U.is_crawlable(F.col("to")) & F.col("in_scope")), "links")
        counts["out_of_scope"] += links.filter("NOT ok").count()
        inside = links.filter("ok")
        found = stored(inside.groupBy(F.col("to").alias("url")).agg(F.min("pos").alias("pos")).join(visited, "url", "left_anti"), "frontier")
        room = max(0, config.frontier_cap - visited.count())
        if found.count() > room:
            found = stored(found.orderBy("pos").limit(room), "frontier")
        counts["duplicate_urls"] += inside.count() - found.count()
        visited = stored(visited.union(found.select("url")), "visited")
        level = found
        if level.isEmpty():
            break
    report = spark.createDataFrame([(kept, failures.count(), *counts.values())], "pages_crawled long, pages_failed long, robots_blocked long, urls_seen long, duplicate_urls long, duplicate_content long, out_of_scope long")
    return Crawl(pages, failures, report)
