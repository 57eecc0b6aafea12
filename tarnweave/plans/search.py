"""Ranked search over word, url, score rows."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tarnweave.functions.similarity import suggest

PER_PAGE = 10
NO_DESCRIPTION = "No description available"


def hits(scores: DataFrame, query: str) -> DataFrame:
    """url, score: the sum of the scores of the query's words, each counted as often as it is asked."""
    words: dict[str, int] = {}
    for w in query.split(" "):
        if w:
            words[w] = words.get(w, 0) + 1
    if not words:
        return scores.where("false").select("url", "score")
    weight = F.coalesce(*(F.when(F.col("word") == w, F.lit(n)) for w, n in words.items()))
    return scores.where(F.col("word").isin(*words)).groupBy("url").agg(F.sum(F.col("score") * weight).alias("score"))


def search(scores: DataFrame, query: str, page: int = 1, per_page: int = PER_PAGE) -> DataFrame:
    """One page of hits, the best first, of equal scores the smaller url; an unknown word adds nothing."""
    ordered = hits(scores, query).orderBy(F.round("score", 9).desc(), "url")
    return ordered.offset((page - 1) * per_page).limit(per_page)


def has_next(scores: DataFrame, query: str, page: int, per_page: int = PER_PAGE) -> bool:
    return bool(hits(scores, query).offset(page * per_page).limit(1).count())


def hydrate(found: DataFrame, pages: DataFrame) -> DataFrame:
    """url, score, title, description: the url stands for an empty title, and a text for an empty description."""
    described = F.coalesce(F.nullif(F.regexp_replace("description", r"^[^\]]*\]", ""), F.lit("")), F.lit(NO_DESCRIPTION))
    shown = found.join(pages.select("url", "title", "description"), "url", "left")
    return shown.select("url", "score", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("url")).alias("title"), described.alias("description"))


def search_or_suggest(scores: DataFrame, query: str, page: int = 1) -> tuple[DataFrame, str]:
    """The hits, and the query they are of: where there are none, that of the likest known words."""
    first = search(scores, query, page)
    if not first.isEmpty():
        return first, query
    likest = {r["word"]: r["suggestion"] for r in suggest(scores.select("word"), [w for w in query.split(" ") if w]).collect()}
    better = " ".join(likest.get(w, w) for w in query.split(" "))
    return search(scores, better, page), better


@dataclass
class Answer:
    """A page of results as shown: rows, the query they are of, whether another page follows, and the milliseconds it took."""

    rows: list[Row]
    query: str
    more: bool
    milliseconds: float


def answer(scores: DataFrame, pages: DataFrame, query: str, page: int = 1) -> Answer:
    """Hits or those of the suggested query, with titles and descriptions, in order; a page of them reaches the driver."""
    start = time.perf_counter()
    found, asked = search_or_suggest(scores, query, page)
    rows = hydrate(found, pages).orderBy(F.round("score", 9).desc(), "url").collect()
    return Answer(rows, asked, has_next(scores, asked, page), 1000 * (time.perf_counter() - start))
