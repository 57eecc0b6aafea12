"""Bags of strings and of string pairs as thin, lazy wrappers of DataFrames.

Functions are Column expressions where possible: `lambda value: F.upper(value)`. Plain Python functions go through the
`*_py` variants, over Arrow batches. Rows of null never enter a flow. No order is promised anywhere; where a result
packs several rows into one (group_by, fold_by_key with a join, cogroup) the members come sorted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.session import materialise

Expression = Callable[..., Column]


class Dropped(RuntimeError):
    """A flow was used after destroy()."""


class _Base:
    columns: tuple[str, ...] = ()

    def __init__(self, df: DataFrame) -> None:
        kept = df.select(*(F.col(a).cast("string").alias(b) for a, b in zip(df.columns, self.columns, strict=False)))
        self._df: DataFrame | None = kept.dropna()
        self._name: str | None = None

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            raise Dropped("this flow was destroyed")
        return self._df

    def count(self) -> int:
        return self.df.count()

    def table_name(self) -> str:
        """The name of a temporary view of the flow."""
        if self._name is None:
            self._name = f"flow_{uuid.uuid4().hex}"
            self.df.createOrReplaceTempView(self._name)
        return self._name

    def destroy(self) -> None:
        """Forget the data; any later use raises Dropped."""
        if self._name:
            self.df.sparkSession.catalog.dropTempView(self._name)
        self.df.unpersist()
        self._df = None

    def hint_partitions(self, n: int):
        return type(self)(self.df.repartition(n))


class Flow(_Base):
    """A bag of strings: column `value`."""

    columns = ("value",)

    @classmethod
    def from_table(cls, df: DataFrame, to_string: Expression) -> Flow:
        """One string a row, rows that give null left out. `to_string` gets the DataFrame's columns by name."""
        return cls(df.select(to_string(F.col).alias("value")))

    @classmethod
    def parallelize(cls, spark: SparkSession, values: Iterable[str]) -> Flow:
        return cls(spark.createDataFrame([(v,) for v in values], "value string"))

    def save_as_table(self, name: str) -> None:
        self.df.write.mode("overwrite").saveAsTable(name)

    def collect(self) -> list[str]:
        return [r[0] for r in self.df.collect()]

    def take(self, n: int) -> list[str]:
        return [r[0] for r in self.df.limit(n).collect()]

    def distinct(self) -> Flow:
        return Flow(self.df.distinct())

    def filter(self, test: Expression) -> Flow:
        return Flow(self.df.where(test(F.col("value"))))

    def map(self, f: Expression) -> Flow:
        return Flow(self.df.select(f(F.col("value")).alias("value")))

    def flat_map(self, f: Expression) -> Flow:
        """`f` gives an array; null and empty ones give nothing."""
        return Flow(self.df.select(F.explode(f(F.col("value"))).alias("value")))

    def flat_map_to_pair(self, f: Expression) -> PairFlow:
        """`f` gives an array of structs of key and value."""
        return PairFlow(self.df.select(F.inline(f(F.col("value")))))

    def map_to_pair(self, key: Expression, value: Expression) -> PairFlow:
        return PairFlow(self.df.select(key(F.col("value")).alias("key"), value(F.col("value")).alias("value")))

    def flat_map_py(self, f: Callable[[str], Iterable[str] | None]) -> Flow:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield pd.DataFrame({"value": [x for v in frame["value"] for x in (f(v) or ())]}, dtype=object)

        return Flow(self.df.mapInPandas(run, "value string"))

    def map_partitions(self, f: Callable[[Iterator[str]], Iterable[str]], batch: int = 10_000) -> Flow:
        """`f` is called once a partition with an iterator over its values; results are streamed."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            some: list[str] = []
            for x in f(v for frame in frames for v in frame["value"]):
                some.append(x)
                if len(some) >= batch:
                    yield pd.DataFrame({"value": some}, dtype=object)
                    some = []
            yield pd.DataFrame({"value": some}, dtype=object)

        return Flow(self.df.mapInPandas(run, "value string"))

    def intersection(self, other: Flow) -> Flow:
        """Each element that both hold, once."""
        return Flow(self.df.intersect(other.df))

    def sample(self, fraction: float, seed: int | None = None) -> Flow:
        return Flow(self.df.sample(False, fraction, seed))

    def sample_by_hash(self, fraction: float) -> Flow:
        """A sample that keeps equal strings together and is the same on every run."""
        bucket = F.conv(F.substring(F.md5("value"), 1, 8), 16, 10).cast("bigint")
        return Flow(self.df.where(bucket < int(fraction * 2**32)))

    def group_by(self, key: Expression) -> PairFlow:
        """Key and its members, sorted, with commas between. A result row holds all members of its key."""
        pairs = self.map_to_pair(key, lambda v: v)
        return pairs.join_values(",")

    def fold(self, zero: str, f: Callable[[str, str], str]) -> str:
        """f over all values, starting with zero. Each partition is folded alone with `f` from its first value on, then
        the few partial results in the order of the partitions: f must be associative."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            got: str | None = None
            for frame in frames:
                for v in frame["value"]:
                    got = v if got is None else f(got, v)
            yield pd.DataFrame({"value": [] if got is None else [got]}, dtype=object)

        result = zero
        for row in self.df.mapInPandas(run, "value string").collect():
            result = f(result, row[0])
        return result

    def sum(self) -> DataFrame:
        """One row with the sum of the values that are numbers."""
        return self.df.agg(F.sum(F.col("value").try_cast("double")).alias("value"))


class PairFlow(_Base):
    """A bag of pairs: columns `key` and `value`."""

    columns = ("key", "value")

    def collect(self) -> list[tuple[str, str]]:
        return [(r[0], r[1]) for r in self.df.collect()]

    def save_as_table(self, name: str, path: str | None = None) -> None:
        """A row for each key with the array of its values; `path` is where the table lies, by default in the warehouse."""
        writer = self.df.groupBy("key").agg(F.sort_array(F.collect_list("value")).alias("values")).write.mode("overwrite")
        (writer.option("path", path) if path else writer).saveAsTable(name)

    def flat_map(self, f: Expression) -> Flow:
        return Flow(self.df.select(F.explode(f(F.col("key"), F.col("value"))).alias("value")))

    def flat_map_to_pair(self, f: Expression) -> PairFlow:
        return PairFlow(self.df.select(F.inline(f(F.col("key"), F.col("value")))))

    def map(self, f: Expression) -> Flow:
        return Flow(self.df.select(f(F.col("key"), F.col("value")).alias("value")))

    def fold_by_key(self, aggregate: Expression) -> PairFlow:
        """`aggregate` is an aggregate expression of `value`, as F.sum; partial sums are made before the shuffle."""
        return PairFlow(self.df.groupBy("key").agg(aggregate(F.col("value")).alias("value")))

    def join_values(self, separator: str) -> PairFlow:
        """The sorted values of each key as one string."""
        return self.fold_by_key(lambda v: F.array_join(F.sort_array(F.collect_list(v)), separator))

    def fold_by_key_py(self, zero: str, f: Callable[[str, str], str]) -> PairFlow:
        """Left fold of the sorted values of each key; a key's values stand in one Python call, so keys must be of bounded size."""

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            got = zero
            for v in sorted(frame["value"]):
                got = f(got, v)
            return pd.DataFrame({"key": [frame["key"].iloc[0]], "value": [got]})

        return PairFlow(self.df.groupBy("key").applyInPandas(run, "key string, value string"))

    def join(self, other: PairFlow) -> PairFlow:
        """Inner join: (key, a + "," + b) for all combinations of a key's values."""
        right = other.df.withColumnRenamed("value", "other")
        return PairFlow(self.df.join(right, "key").select("key", F.concat_ws(",", "value", "other").alias("value")))

    def cogroup(self, other: PairFlow) -> PairFlow:
        """Keys of either side with `[values],[values]`, each sorted."""
        tagged = self.df.withColumn("side", F.lit(0)).unionByName(other.df.withColumn("side", F.lit(1)))
        sides = [F.array_join(F.sort_array(F.collect_list(F.when(F.col("side") == k, F.col("value")))), ",") for k in (0, 1)]
        return PairFlow(tagged.groupBy("key").agg(F.concat(F.lit("["), sides[0], F.lit("],["), sides[1], F.lit("]")).alias("value")))

    def materialised(self) -> PairFlow:
        return PairFlow(materialise(self.df, "pairs"))


class Job:
    """Runs a function and gathers what it puts out, as a text."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._parts: list[str] = []

    def output(self, text: str) -> None:
        self._parts.append(text)

    def run(self, function: Callable[[Job, list[str]], None], arguments: Iterable[str] = ()) -> str:
        function(self, list(arguments))
        return "".join(self._parts) or "The job did not invoke output()"
