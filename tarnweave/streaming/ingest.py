"""Continuous ingestion of crawl rows into a table store, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tarnweave.sources.tables import TableStore, latest_rows


def stream_rows(spark: SparkSession, folder: str, schema: T.StructType, per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def ingest(stream: DataFrame, root: str, table: str, checkpoint: str, key: str = "key", order: tuple[str, ...] = ()) -> StreamingQuery:
    """Put each micro-batch's rows, the last of each key by `order`, into a table. Replays of a batch put the same rows again."""

    def put(batch: DataFrame, _: int) -> None:
        rows = batch.withColumnRenamed(key, "key").where("key is not null")
        if order:
            rows = latest_rows(rows, ["key"], list(order))
        TableStore(batch.sparkSession, root).put_rows(table, rows)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
