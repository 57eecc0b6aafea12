"""Inverted index, term weights and combined scores over crawled pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnweave.functions.similarity import harmonic_mean
from tarnweave.functions.text import index_tokens, term_tokens
from tarnweave.session import materialise
from tarnweave.sources.tables import latest_rows


def current_pages(crawl: DataFrame, columns: Sequence[str] = ("url", "page", "urls")) -> DataFrame:
    """key and the asked columns of each crawled key: the row stored last holds, as the store replaces rows by key.

    Only what is asked for is read, sorted and shuffled.
    """
    rows = crawl.where("key is not null").select("key", *columns, "stored_at", "fetched_at", "fetch_id")
    return latest_rows(rows, ["key"], ["stored_at", "fetched_at", "fetch_id"]).select("key", *columns)


def indexable(pages: DataFrame) -> DataFrame:
    return pages.where("url is not null and page is not null")


def postings(pages: DataFrame, text: str = "page") -> DataFrame:
    """word, key: each different word of each page that has url and page. Rows, not lists: a word of all pages is no big row.

    A null text gives no word, so it is not asked for: a test would clean each page twice where the text is an expression.
    """
    return pages.where("url is not null").select("key", F.explode(index_tokens(text)).alias("word")).select("word", "key")


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("word").agg(F.count("*").alias("documents"))


def packed_index(index: DataFrame, part: int = 100_000) -> DataFrame:
    """word, part, value: the keys of a word, sorted, with commas between, in parts of about `part` keys.

    A word of few pages has the one part 0; those of a common word are told by a hash of the key, so no list is unbounded.
    """
    sized = index.join(document_frequency(index), "word")
    parts = F.ceil(F.col("documents") / part)
    number = F.pmod(F.xxhash64("key"), parts).cast("int").alias("part")
    return sized.groupBy("word", number).agg(F.array_join(F.sort_array(F.collect_list("key")), ",").alias("value"))


def tf_idf(pages: DataFrame, text: str = "page", total: int | None = None) -> DataFrame:
    """word, key, tf, idf, weight = ln(1 + tf * idf).

    tf = 0.4 + 0.6 * count / count of the page's commonest word; idf = ln(N / n) with N all crawled rows, also those
    without a page, and n the pages of the word in the index. Only words that both tokenisers know remain. `total` gives
    N where `pages` are only those with a page.
    """
    if total is None:
        total = pages.agg(F.count("*")).first()[0]
    # Cleaning a page is dearer than storing its text, and two branches read it.
    rows = materialise(pages.where("url is not null").select("key", "url", F.col(text).alias("page")), "texts")
    frequency = document_frequency(postings(rows))
    counts = rows.select("key", F.explode(term_tokens("page")).alias("word")).groupBy("key", "word").agg(F.count("*").alias("n"))
    # The words of one page: bounded by its length.
    most = Window.partitionBy("key")
    tf = counts.select("word", "key", (0.4 + 0.6 * F.col("n") / F.max("n").over(most)).alias("tf"))
    weighed = tf.join(frequency, "word").withColumn("idf", F.ln(F.lit(total) / F.col("documents")))
    return weighed.select("word", "key", "tf", "idf", F.log1p(F.col("tf") * F.col("idf")).alias("weight"))


def combined_scores(pages: DataFrame, weights: DataFrame, ranks: DataFrame) -> DataFrame:
    """word, url, score: the harmonic mean of a page's weight and ln(1 + rank).

    Pages without rank drop out, as do urls with "..." and rows without url or page.
    """
    # Keys without a page have no weights.
    named = pages.where("url is not null").where(~F.col("url").contains("...")).select("key", "url")
    ranked = named.join(ranks.where(F.col("rank").isNotNull() & ~F.isnan("rank")).select("key", "rank"), "key")
    scored = weights.join(ranked, "key")
    return scored.select("word", "url", harmonic_mean(F.col("weight"), F.log1p("rank")).alias("score"))


def latest_ranks(ranks: DataFrame) -> DataFrame:
    """key, rank: of the ranks saved for a key the latest."""
    return ranks.where("key is not null").groupBy("key").agg(F.max_by("rank", F.struct("saved_at", "rank")).alias("rank"))
