"""Likeness of words, suggestions and completion."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by the whole common prefix: min(0.1, 1 / len(a)) for each letter of it.

    0 if either is empty or nothing matches. Letters match within max(len) // 2 - 1 places, so words of one letter never do.
    """
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken = [False] * len(b)
    left: list[str] = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, t in zip(b, taken, strict=True) if t]
    crossed = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - crossed) / m) / 3
    prefix = 0
    while prefix < min(len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + min(0.1, 1 / len(a)) * prefix * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def suggest(vocabulary: DataFrame, words: Iterable[str], column: str = "word") -> DataFrame:
    """word and suggestion: for each asked word the likest of the vocabulary, of equal ones the smallest.

    The few asked words travel in the plan; the vocabulary is scanned once, with a partial best in each task.
    """
    asked = F.explode(F.array(*(F.lit(w) for w in dict.fromkeys(words)))).alias("asked")
    pairs = vocabulary.where(F.col(column).isNotNull()).select(F.col(column).alias("term")).distinct().select("term", asked)
    scored = pairs.withColumn("likeness", jaro_winkler_column("asked", "term"))
    best = F.min(F.struct((-F.col("likeness")).alias("order"), "term")).alias("best")
    return scored.groupBy(F.col("asked").alias("word")).agg(best).select("word", F.col("best.term").alias("suggestion"), (-F.col("best.order")).alias("likeness"))


def complete(vocabulary: DataFrame, prefix: str, column: str = "word", limit: int | None = 10) -> DataFrame:
    """Terms that begin with a prefix, whatever the case, in order."""
    found = vocabulary.where(F.lower(F.col(column)).startswith(prefix.lower())).select(column).distinct().orderBy(column)
    return found if limit is None else found.limit(limit)


def harmonic_mean(a: Column, b: Column) -> Column:
    """2ab / (a + b); null where the sum is zero."""
    return F.try_divide(2 * a * b, a + b)
