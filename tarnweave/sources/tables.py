"""A façade of keyed tables over Parquet folders: scans, look-ups, upserts and a catalogue."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TableExists(RuntimeError):
    pass


class TableMissing(RuntimeError):
    pass


class TableStore:
    """Tables below one folder of any file system Spark knows. A table has a `key` and string columns.

    Every write is a folder of its own, which appears when it is whole, with a number from the clock; readers keep the
    last of each cell. Nothing is read to write. `compact` folds the writes that it finds into one, sorted by key, so that
    range scans and look-ups skip row groups; a marker, which also appears whole, says which folders it stands for.
    What is written meanwhile stays. Folded cells keep their numbers, so where both count for a moment, they agree.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._last = 0

    _LOG = "key string, name string, value string, seq bigint, whole boolean"

    def _at(self, table: str) -> str:
        if not table or "/" in table:
            raise ValueError(f"no name of a table: {table!r}")
        return f"{self.root}/{table}"

    def exists(self, table: str) -> bool:
        return self._fs.exists(self._path(self._at(table)))

    def _next(self) -> int:
        """A number above all that this store gave, and above those of other writers with a clock that agrees."""
        self._last = max(self._last + 1, time.time_ns())
        return self._last

    def _names(self, table: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(self._at(table)))]

    def _live(self, table: str) -> list[str]:
        """The folders that count: all writes but those that a marker says are folded."""
        if not self.exists(table):
            raise TableMissing(table)
        names = self._names(table)
        folded: set[str] = set()
        for name in names:
            if name.startswith("_folded-"):
                folded |= {r["value"] for r in self.spark.read.text(f"{self._at(table)}/{name}").collect()}
        return sorted(n for n in names if n.startswith("w-") and n not in folded)

    def _log(self, table: str) -> DataFrame:
        live = [f"{self._at(table)}/{n}" for n in self._live(table)]
        return self.spark.read.schema(self._LOG).parquet(*live) if live else self.spark.createDataFrame([], self._LOG)

    def _append(self, table: str, log: DataFrame) -> str:
        name = uuid.uuid4().hex
        part = f"{self._at(table)}/.w-{name}"
        log.write.parquet(part)
        self._fs.rename(self._path(part), self._path(f"{self._at(table)}/w-{name}"))
        return f"w-{name}"

    def put_many(self, table: str, cells: DataFrame) -> None:
        """Merge cells (key, name, value) into their rows."""
        self._append(table, cells.select("key", "name", "value", F.lit(self._next()).cast("bigint").alias("seq"), F.lit(False).alias("whole")))

    def put(self, table: str, key: str, name: str, value: str) -> None:
        self.put_many(table, self.spark.createDataFrame([(key, name, value)], "key string, name string, value string"))

    post = put

    def put_rows(self, table: str, rows: DataFrame) -> None:
        """Replace whole rows: `key` and any string columns; a null column is absent."""
        names = [c for c in rows.columns if c != "key"]
        cells = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names), F.struct(F.lit("").alias("name"), F.lit("").alias("value"))))
        log = rows.select("key", cells.alias("c")).select("key", "c.name", "c.value", F.lit(self._next()).cast("bigint").alias("seq"), F.lit(True).alias("whole"))
        self._append(table, log.where("value is not null"))

    batch_put = put_rows

    def _cells(self, log: DataFrame) -> DataFrame:
        """key, name, value, seq, whole of the cells that hold."""
        bounds = log.groupBy("key").agg(F.max(F.when(F.col("whole"), F.col("seq"))).alias("since"))
        live = log.join(bounds, "key").where(F.col("since").isNull() | (F.col("seq") >= F.col("since")))
        last = live.groupBy("key", "name").agg(F.max(F.struct("seq", "value", "whole")).alias("c"))
        return last.select("key", "name", "c.value", "c.seq", "c.whole")

    def cells(self, table: str) -> DataFrame:
        """key, name, value: the cells that hold."""
        return self._cells(self._log(table)).select("key", "name", "value")

    def rows(self, table: str) -> DataFrame:
        """key and columns (map of name to value)."""
        pairs = F.collect_list(F.when(F.col("name") != "", F.struct("name", "value")))
        return self.cells(table).groupBy("key").agg(F.map_from_entries(pairs).alias("columns"))

    def scan(self, table: str, start: str | None = None, end: str | None = None) -> DataFrame:
        """Rows with start <= key < end; None is open."""
        rows = self.rows(table)
        if start is not None:
            rows = rows.where(F.col("key") >= start)
        return rows if end is None else rows.where(F.col("key") < end)

    def get_row(self, table: str, key: str) -> dict[str, str] | None:
        got = self.rows(table).where(F.col("key") == key).first()
        return None if got is None else dict(got["columns"])

    def get(self, table: str, key: str, name: str) -> str | None:
        return (self.get_row(table, key) or {}).get(name)

    def exists_row(self, table: str, key: str) -> bool:
        return bool(self._log(table).where(F.col("key") == key).limit(1).count())

    def count(self, table: str) -> int:
        return self._log(table).select("key").distinct().count()

    def compact(self, table: str) -> None:
        """Fold the writes that are there now into one, sorted by key."""
        old = self._live(table)
        if not old:
            return
        log = self.spark.read.schema(self._LOG).parquet(*(f"{self._at(table)}/{n}" for n in old))
        state = self._cells(log).repartitionByRange("key").sortWithinPartitions("key")
        fresh, marker = uuid.uuid4().hex, f"{self._at(table)}/_folded-{uuid.uuid4().hex}"
        # The folded cells lie ready under a name that does not count yet; the marker makes them count instead of the old.
        state.write.parquet(f"{self._at(table)}/.w-{fresh}")
        names = self.spark.createDataFrame([(n,) for n in old], "value string").coalesce(1)
        names.write.text(f"{marker.rpartition('/')[0]}/.{marker.rpartition('/')[2]}")
        self._fs.rename(self._path(f"{self._at(table)}/.w-{fresh}"), self._path(f"{self._at(table)}/w-{fresh}"))
        self._fs.rename(self._path(f"{marker.rpartition('/')[0]}/.{marker.rpartition('/')[2]}"), self._path(marker))
        for name in old:
            self._fs.delete(self._path(f"{self._at(table)}/{name}"), True)
        self._fs.delete(self._path(marker), True)

    def rename(self, old: str, new: str) -> None:
        if not self.exists(old):
            raise TableMissing(old)
        if self.exists(new):
            raise TableExists(new)
        self._fs.rename(self._path(self._at(old)), self._path(self._at(new)))

    def delete(self, table: str) -> None:
        self._fs.delete(self._path(self._at(table)), True)

    def tables(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if not s.getPath().getName().startswith("."))

    def counts(self) -> list[tuple[str, int]]:
        return [(t, self.count(t)) for t in self.tables()]

    def view(self, table: str, from_key: str | None = None, size: int = 10) -> tuple[list[dict], str | None]:
        """A page of rows by key, and the key that the next page begins with."""
        page = self.scan(table, from_key).orderBy("key").limit(size + 1).collect()
        return [{"key": r["key"], **r["columns"]} for r in page[:size]], page[size]["key"] if len(page) > size else None


def latest_rows(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last whole row of each key, by `order`; a pre-aggregated max instead of a sorted window."""
    rest = [c for c in df.columns if c not in key]
    best = F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("_row")
    return df.groupBy(*key).agg(best).select(*key, *(F.col("_row")[c].alias(c) for c in rest))


def page_of(df: DataFrame, key: str, start: str | int | None = None, size: int = 10) -> DataFrame:
    """Keyset pagination: `size` rows from a key on, by key."""
    return (df if start is None else df.where(F.col(key) >= start)).orderBy(key).limit(size)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The non-blank lines of text files (seeds, stop words, patterns), trimmed: column value."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")
