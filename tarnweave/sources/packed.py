"""Packed lists of postings: `url,score;url,score;…`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decimal numbers, with or without exponent; names of infinities and type letters are none.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def unpack(rows: DataFrame, value: str = "value") -> DataFrame:
    """The rows, once for each posting, with `url` and `score` for `value`.

    The last comma of a posting stands before its score, as urls may hold commas. Null and empty values give none, nor do
    postings whose score is missing or not finite.
    """
    rest = [c for c in rows.columns if c != value]
    parts = rows.select(*rest, F.explode(F.split(value, ";")).alias("_part")).where(F.col("_part").contains(","))
    number = F.trim(F.substring_index("_part", ",", -1))
    url = F.trim(F.expr("substring(_part, 1, length(_part) - length(substring_index(_part, ',', -1)) - 1)"))
    found = parts.select(*rest, url.alias("url"), F.when(number.rlike(NUMBER), number.try_cast("double")).alias("score"))
    return found.where((F.abs("score") < float("inf")) & (F.col("url") != ""))


def latest_scores(rows: DataFrame) -> DataFrame:
    """word, url, score: of each word and url the posting saved last, then of the larger put_id, then the higher score.

    rows: put_id, word, value, saved_at. Null words do not count; null saved_at and put_id lie before all others.
    """
    found = unpack(rows.where("word is not null").select("word", "saved_at", "put_id", "value"))
    last = F.max(F.struct("saved_at", "put_id", "score")).alias("_last")
    return found.groupBy("word", "url").agg(last).select("word", "url", F.col("_last.score").alias("score"))


def pack(url: Column, score: Column) -> Column:
    """An aggregate that packs a group's postings, the best first. A result row holds the whole group."""
    items = F.array_sort(F.collect_list(F.struct((-score).alias("s"), url.alias("u"))))
    return F.array_join(F.transform(items, lambda x: F.concat(x["u"], F.lit(","), (-x["s"]).cast("string"))), ";")
