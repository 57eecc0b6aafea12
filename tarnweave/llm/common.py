"""What several operators here share: tables, hosts, distributed prefix sums and size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnweave.session import materialise

#: A side of a join is broadcast only below this many bytes, as measured; beyond it both sides are shuffled.
BROADCAST_BYTES = 24 << 20
#: A range partition, which one Python worker reads in a stream, has about so many rows at most.
ROWS_IN_RANGE = 2_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def host_of(url: Column | str) -> Column:
    """Host of a url in lower case without user, port and one leading `www.`; null where there is none."""
    url = F.col(url) if isinstance(url, str) else url
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def behind_host(url: Column | str) -> Column:
    """What stands behind host and port of a url; the whole of a string without scheme."""
    return F.regexp_replace(F.col(url) if isinstance(url, str) else url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")


def size_in_bytes(side: DataFrame) -> int:
    """What the rows of a table hold, by the length of each as text, with 32 bytes a row for its frame."""
    row = side.select((F.octet_length(F.to_json(F.struct("*"))) + 32).cast("bigint").alias("n")).agg(F.sum("n")).first()
    return row[0] or 0


def with_small(df: DataFrame, side: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a side, which should be a written table: broadcast if its measured size is below BROADCAST_BYTES, else
    both are shuffled, where AQE splits hot keys."""
    return df.join(F.broadcast(side) if size_in_bytes(side) <= BROADCAST_BYTES else side, list(on), how)


def ranges_for(df: DataFrame) -> int:
    """How many range partitions a table gets: as many as shuffles have, and more where they would hold over ROWS_IN_RANGE rows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_IN_RANGE))


def codes_of(column: pa.Array) -> np.ndarray:
    """A number for each value of a column, alike for alike values; nulls are alike."""
    codes = column.dictionary_encode().indices
    return codes.fill_null(-1).to_numpy(zero_copy_only=False)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of _value before each row of its group, within a partition that is sorted by group; one batch at a time."""
    group, carried, seen = None, 0, False
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column, value = batch.column("_group"), batch.column("_value").to_numpy(zero_copy_only=False)
        codes = codes_of(column)
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        sums = np.cumsum(value) - value
        segment = np.searchsorted(starts, np.arange(n), side="right") - 1
        inside = sums - sums[starts][segment]
        if seen and column[0].as_py() == group:
            inside = inside + np.where(segment == 0, carried, 0)
        group, seen, carried = column[n - 1].as_py(), True, int(inside[-1] + value[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inside.astype(np.int64))], [*batch.schema.names, "_inside"])


def grouped_prefix_sum(df: DataFrame, group: str, order: Sequence[str], value: str, into: str, partitions: int | None = None) -> DataFrame:
    """Sum of the whole numbers `value` over the rows before each row of its group, in ascending `order`, a total one in a group.

    A group of any size is spread: rows are range-partitioned by group and order, each range is summed where it lies, in
    one pass, and the sums of the ranges before it are added, of which a group has at most one for each partition.
    Nulls of `value` count 0. An empty table gives an empty one.
    """
    amount = F.coalesce(F.col(value), F.lit(0)).cast("bigint")
    rows = df.withColumns({"_group": F.col(group), "_value": amount})
    ranged = rows.repartitionByRange(partitions or ranges_for(df), group, *order).withColumn("_range", F.spark_partition_id()).sortWithinPartitions(group, *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    running = materialise(ranged.mapInArrow(_running, f"{schema}, _inside bigint"), "running")
    key = F.struct(F.col("_group").alias("v")).alias("_key_of_group")  # a struct, so that null groups meet
    before = Window.partitionBy("_key_of_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = running.groupBy(key, "_range").agg(F.sum("_value").alias("_sum"))
    offsets = materialise(sums.select("_key_of_group", "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")), "offsets")
    joined = with_small(running.withColumn("_key_of_group", key), offsets, ["_key_of_group", "_range"])
    return joined.select(*(c for c in df.columns), (F.col("_inside") + F.col("_offset")).alias(into))
