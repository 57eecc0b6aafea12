"""Problem 6: lines that a site repeats over its documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.llm.common import host_of, table, with_small
from tarnweave.session import materialise

#: A line of fewer letters is never counted.
LEAST_LETTERS = 3


def line_keys(page: Column | str) -> Column:
    """Array of the lines' letters in lower case, by line feed, one entry a line, blank ones included; null for null."""
    page = F.col(page) if isinstance(page, str) else page
    return F.split(F.regexp_replace(F.lower(page), r"[^\p{L}\n]+", ""), "\n")


def hashed(key: Column) -> Column:
    """96 bits of two hash functions stand for a line in shuffles."""
    return F.struct(F.xxhash64(key).alias("a"), F.hash(key).alias("b"))


def counted_lines(pages: DataFrame, group: str, document: str, page: str, date: str | None = None, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """g (hash of the group), a, b (of the line), documents and, with `date`, dates: where each line of a group stands.

    Copies collapse first: whatever shares a `document` is one, so a page that is stored again, or republished where
    `document` names the text, gives each of its lines once; of it the earliest day of `date` counts, and `dates` are the
    different days. Then lines are counted by (group, line, document) and by (group, line), each pre-aggregated, so that
    a site of any size is counted in many tasks. Null groups, documents and pages give nothing.
    """
    rows = pages.where(F.col(group).isNotNull() & F.col(document).isNotNull() & F.col(page).isNotNull())
    keys = F.filter(F.array_distinct(line_keys(page)), lambda k: F.length(k) >= least_letters)
    day = [F.to_date(date).alias("day")] if date else []
    lines = rows.select(F.xxhash64(group).alias("g"), F.xxhash64(document).alias("d"), *day, F.explode(keys).alias("key"))
    lines = lines.select("g", "d", *(["day"] if date else []), F.xxhash64("key").alias("a"), F.hash("key").alias("b"))
    once = lines.groupBy("g", "a", "b", "d").agg(F.min("day").alias("day")) if date else lines.distinct()
    return once.groupBy("g", "a", "b").agg(F.count("*").alias("documents"), *([F.count_distinct("day").alias("dates")] if date else []))


def repeated_lines(pages: DataFrame, group: str, document: str, page: str, least: int = 5, share: float = 0.15, date: str | None = None, least_dates: int = 1) -> DataFrame:
    """g and lines (array of hashed lines): the lines of each group that stand in at least `least` of its documents and
    in at least `share` of them (documents without page count too), and on `least_dates` days where `date` is given.

    A group has at most 1 / share times as many such lines as a document has on average, so the arrays stay short.
    """
    lines = counted_lines(pages, group, document, page, date).where(F.col("documents") >= least)
    if date:
        lines = lines.where(F.col("dates") >= least_dates)
    sizes = pages.where(F.col(group).isNotNull() & F.col(document).isNotNull()).select(F.xxhash64(group).alias("g"), F.xxhash64(document).alias("d")).distinct().groupBy("g").agg(F.count("*").alias("size"))
    many = lines.join(sizes.where(F.col("size") >= least), "g").where(F.col("documents") >= F.col("size") * share)
    return many.groupBy("g").agg(F.collect_list(F.struct("a", "b")).alias("lines"))


def with_shares(pages: DataFrame, group: str, document: str, page: str, least: int = 3, share: float = 0.15) -> DataFrame:
    """The pages with column _shares: for each line, the share of its group's documents that hold it; 0 below the bounds."""
    lines = counted_lines(pages, group, document, page).where(F.col("documents") >= least)
    sizes = pages.where(F.col(group).isNotNull() & F.col(document).isNotNull()).select(F.xxhash64(group).alias("g"), F.xxhash64(document).alias("d")).distinct().groupBy("g").agg(F.count("*").alias("size"))
    shares = lines.join(sizes.where(F.col("size") >= least), "g").select("g", "a", (F.col("documents") / F.col("size")).cast("float").alias("share")).where(F.col("share") >= share)
    # Of lines that share their 64 bits, which next to never happens, the larger share counts.
    found = materialise(shares.groupBy("g", "a").agg(F.max("share").alias("share")).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("a", "share"))).alias("known")), "shares")
    found = found.select(F.col("g").alias("_site"), F.col("known").alias("_known"))
    joined = with_small(pages.withColumn("_site", F.xxhash64(group)), found, ["_site"], "left")
    of_line = F.transform(line_keys(page), lambda k: F.when(F.length(k) >= LEAST_LETTERS, F.coalesce(F.try_element_at(F.col("_known"), F.xxhash64(k)), F.lit(0.0).cast("float"))).otherwise(F.lit(0.0).cast("float")))
    none = F.array().cast("array<float>")
    return joined.withColumn("_shares", F.coalesce(F.when(F.col("_known").isNotNull(), of_line), none)).drop("_site", "_known")


def with_repeated(pages: DataFrame, group: str, document: str, page: str, **rule) -> DataFrame:
    """The pages with column _numbers: the numbers of their lines, from 1, that `repeated_lines` finds in their group."""
    found = materialise(repeated_lines(pages, group, document, page, **rule), "repeated")
    found = found.select(F.col("g").alias("_site"), F.col("lines").alias("_lines"))
    joined = with_small(pages.withColumn("_site", F.xxhash64(group)), found, ["_site"], "left")
    numbered = F.transform(line_keys(page), lambda k, i: F.struct((i + 1).alias("n"), k.alias("k")))
    at = F.filter(numbered, lambda x: (F.length(x["k"]) >= LEAST_LETTERS) & F.array_contains(F.col("_lines"), hashed(x["k"])))
    at = F.when(F.col(group).isNotNull() & F.col("_lines").isNotNull() & F.col(page).isNotNull(), F.transform(at, lambda x: x["n"]))
    return joined.withColumn("_numbers", F.coalesce(at, F.array().cast("array<int>"))).drop("_site", "_lines")


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "crawl").select("fetch_id", "url", "page", "fetched_at", host_of("url").alias("host"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines on at least five urls of their host and 15 percent of them."""
    lines = with_repeated(_pages(spark, folder), "host", "url", "page")
    return lines.select("fetch_id", F.explode("_numbers").alias("line_no")).distinct()


def p6_clean(spark: SparkSession, folder: str) -> DataFrame:
    """fetch_id and its page without those lines; null pages stay null. Rows delivered twice count once."""
    lines = with_repeated(_pages(spark, folder), "host", "url", "page").dropDuplicates(["fetch_id"])
    kept = F.filter(F.split("page", "\n"), lambda line, i: ~F.array_contains(F.col("_numbers"), i + 1))
    return lines.select("fetch_id", F.when(F.size("_numbers") == 0, F.col("page")).otherwise(F.array_join(kept, "\n")).alias("page"))


def p6_republished(spark: SparkSession, folder: str) -> DataFrame:
    """The stricter count: lines over clusters of documents of the same letters and over days, at least five of each."""
    pages = _pages(spark, folder).withColumn("cluster", F.when(F.col("page").isNotNull(), F.xxhash64(F.regexp_replace(F.lower("page"), r"[^\p{L}]+", ""))))
    lines = with_repeated(pages, "host", "cluster", "page", date="fetched_at", least_dates=5)
    return lines.select("fetch_id", F.explode("_numbers").alias("line_no")).distinct()


_HOST_SQL = r"nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', ''), '')"


def _lines_sql(document: str, extra: str = "", having: str = "") -> str:
    return rf"""
    WITH pages AS (SELECT fetch_id, url, page, fetched_at, {_HOST_SQL} AS host, regexp_replace(lower(page), '[^\p{{L}}]+', '', 'g') AS letters FROM crawl),
    lines AS (SELECT fetch_id, host, {document} AS document, day, unnest(list_zip(keys, range(1, len(keys) + 1)), recursive := false) AS line
      FROM (SELECT *, fetched_at::DATE AS day, string_split(regexp_replace(lower(page), '[^\p{{L}}\n]+', '', 'g'), chr(10)) AS keys FROM pages WHERE page IS NOT NULL AND host IS NOT NULL)),
    keyed AS (SELECT fetch_id, host, document, day, line[1] AS key, line[2]::INT AS line_no FROM lines WHERE length(line[1]) >= 3),
    once AS (SELECT host, key, document, min(day) AS day FROM keyed GROUP BY ALL),
    counted AS (SELECT host, key, count(*) AS n, count(DISTINCT day) AS days FROM once GROUP BY ALL),
    sizes AS (SELECT host, count(DISTINCT {document}) AS size FROM pages GROUP BY ALL)
    SELECT DISTINCT fetch_id, line_no FROM keyed JOIN counted USING (host, key) JOIN sizes USING (host) WHERE n >= 5 AND n >= size * 0.15 {having}"""


SQL = {"p6_found": _lines_sql("url"), "p6_republished": _lines_sql("letters", having="AND days >= 5")}
QUERIES = {"p6_found": p6_found, "p6_clean": p6_clean, "p6_republished": p6_republished}
