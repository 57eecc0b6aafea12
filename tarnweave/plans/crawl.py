"""Crawling without a network: extraction from stored pages, and the frontier."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.functions.hashing import hash_key
from tarnweave.functions.text import page_description, page_links, page_text, page_title
from tarnweave.functions.urls import DENIED, WAIT, host_key_name, is_ascii, is_blacklisted, normalized, normalized_absolute, robots_decisions, url_parts
from tarnweave.session import materialise

MOST_DEPTH = 3


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """key, url, title, description, page and urls of fetched pages: the part of crawling that needs no network."""
    base = pages.select(F.col(url).alias("url"), F.col(html).alias("html"))
    links = F.array_distinct(page_links("html"))
    one = base.select("url", "html", F.explode_outer(links).alias("link"))
    resolved = one.where("link is not null").select("url", normalized("link", "url").alias("to")).where("to is not null")
    out = resolved.groupBy("url").agg(F.sort_array(F.collect_set("to")).alias("urls"))
    text = base.select(hash_key("url").alias("key"), "url", page_title("html").alias("title"), page_description("html").alias("description"), page_text("html").alias("page"))
    return text.join(out, "url", "left")


def next_frontier(frontier: DataFrame, links: DataFrame, known: DataFrame, blacklist: tuple[str, ...] = (), most_depth: int = MOST_DEPTH) -> DataFrame:
    """url, depth of the urls to fetch next: links of fetched urls one level deeper, each once at its least depth.

    frontier: url, depth (null is 0) that were fetched now; links: url, to; known: url that was crawled. Urls that are
    not plain ASCII, blacklisted, no web pages, too deep or known are left out.
    """
    # Depths are settled before any link is parsed: a url of the frontier has one, its least, and a link is parsed once.
    shallow = frontier.groupBy("url").agg((F.min(F.coalesce("depth", F.lit(0))) + 1).alias("depth")).where(F.col("depth") < most_depth)
    deeper = links.where("to is not null").join(shallow, "url").groupBy("to").agg(F.min("depth").alias("depth"))
    named = deeper.where(is_ascii("to")).select(normalized_absolute("to").alias("url"), "depth")
    fit = named.where(F.col("url").isNotNull() & ~is_blacklisted("url", blacklist))
    return fit.groupBy("url").agg(F.min("depth").alias("depth")).join(known.select("url"), "url", "left_anti")


#: What comes of a url of the frontier, in the order in which it is asked.
OUTCOMES = ("too deep", "not ascii", "known", "no host", "blacklisted", "denied", "wait", "no answer", "no length", "other language", "redirect", "no page", "fetched")
_REDIRECTS = (301, 302, 303, 307, 308)


def outcomes(frontier: DataFrame, known: DataFrame, hosts: DataFrame, answers: DataFrame, now_ms: int, agent: str, blacklist: tuple[str, ...] = (), most_depth: int = MOST_DEPTH) -> DataFrame:
    """url, depth, outcome (one of OUTCOMES) and location of every url of the frontier, each once at its least depth.

    known: url. hosts: key (hash of the host as spelt, in lower case without www.), robots, lastaccessedms. answers: what
    the servers said, url, responsecode, contenttype, length and, where given, language and location. A page is one of
    code 200 whose type holds text/html; a length must be above 0; a language that is given must hold "en". Redirects give
    their location, absolute. Robots rules and delays are judged by row over Arrow batches, each text parsed once a task.
    """
    for name in ("language", "location"):
        if name not in answers.columns:
            answers = answers.withColumn(name, F.lit(None).cast("string"))
    asked = frontier.where("url is not null").groupBy("url").agg(F.min(F.coalesce("depth", F.lit(0))).alias("depth"))
    part = url_parts("url")
    asked = asked.withColumn("_host", host_key_name("url")).withColumn("_path", F.regexp_replace(part["path"], r"[?#].*$", ""))
    of_host = hosts.where("key is not null").groupBy("key").agg(F.max(F.struct("lastaccessedms", "robots")).alias("_h"))
    rows = asked.withColumn("key", hash_key("_host")).join(of_host, "key", "left")
    rows = rows.withColumn("_robots", robots_decisions(agent)("_h.robots", "_path", F.lit(now_ms).cast("bigint"), "_h.lastaccessedms"))
    # Of several answers the one of the largest code, type and length counts; nulls lie before all others.
    told = [F.coalesce("responsecode", F.lit(0)).alias("responsecode"), F.coalesce("contenttype", F.lit("")).alias("contenttype"), F.coalesce("length", F.lit(0)).alias("length")]
    said = answers.groupBy("url").agg(F.max(F.struct(*told, "language", "location")).alias("_a"))
    rows = rows.join(known.select("url").distinct().withColumn("_known", F.lit(True)), "url", "left").join(said, "url", "left")
    code = F.col("_a.responsecode")
    outcome = (
        F.when(F.col("depth") >= most_depth, "too deep")
        .when(~is_ascii("url"), "not ascii")
        .when(F.col("_known"), "known")
        .when(F.coalesce("_host", F.lit("")) == "", "no host")
        .when(is_blacklisted("url", blacklist), "blacklisted")
        .when(F.col("_robots") == DENIED, "denied")
        .when(F.col("_robots") == WAIT, "wait")
        .when(F.col("_a").isNull(), "no answer")
        .when(F.col("_a.length") <= 0, "no length")
        .when(~F.coalesce("_a.language", F.lit("en")).contains("en"), "other language")
        .when(code.isin(*_REDIRECTS), "redirect")
        .when((code != 200) | ~F.col("_a.contenttype").contains("text/html"), "no page")
        .otherwise("fetched")
    )
    there = F.when(outcome == "redirect", normalized("_a.location", "url"))
    return rows.select("url", "depth", outcome.alias("outcome"), there.alias("location"))


def crawl(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], blacklist: tuple[str, ...] = (), most_depth: int = MOST_DEPTH) -> DataFrame:
    """Breadth-first crawl with a pluggable fetcher from url to url, html; ends when nothing new is found.

    Every round is one job over the whole frontier; what was crawled so far, and the urls that were asked for, are tables
    in the shared folder, so that a round reads the urls alone of earlier ones.
    """
    frontier = materialise(seeds.select(normalized_absolute("url").alias("url"), F.lit(0).alias("depth")).where("url is not null").distinct(), "frontier")
    found: DataFrame | None = None
    known = frontier.select("url")
    while not frontier.isEmpty():
        rows = materialise(extract(fetch(frontier.select("url"))), "crawled")
        found = rows if found is None else found.unionByName(rows)
        known = materialise(known.unionByName(rows.select("url")).unionByName(frontier.select("url")).distinct(), "known")
        links = rows.where("urls is not null").select("url", F.explode("urls").alias("to"))
        frontier = materialise(next_frontier(frontier, links, known, blacklist, most_depth), "frontier")
    return found if found is not None else extract(fetch(frontier.select("url")))
