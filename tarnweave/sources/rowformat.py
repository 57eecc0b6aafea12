"""The wire format of a row: `key column length bytes column length bytes … `, and a file source for it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def encode_row(key: str, columns: dict[str, bytes]) -> bytes:
    """One row. Key and column names hold no blanks."""
    if any(c.isspace() for name in (key, *columns) for c in name):
        raise ValueError("keys and column names hold no blanks")
    out = bytearray(key.encode() + b" ")
    for name, value in columns.items():
        out += name.encode() + b" " + str(len(value)).encode() + b" " + value + b" "
    return bytes(out)


def decode_rows(data: bytes) -> Iterator[tuple[str, dict[str, bytes]]]:
    """The rows of a file; a row ends at a line feed, or the end, where a column name would stand."""
    at, end = 0, len(data)

    def token() -> str:
        nonlocal at
        stop = data.index(b" ", at)
        got = data[at:stop].decode()
        at = stop + 1
        return got

    while at < end:
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        key, columns = token(), {}
        while at < end and data[at : at + 1] != b"\n":
            name, size = token(), int(token())
            columns[name] = data[at : at + size]
            at += size + 1
        yield key, columns


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """key and columns (map of name to bytes) of all files below a path; one file is read by one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows = list(decode_rows(bytes(content)))
                yield pd.DataFrame({"key": [k for k, _ in rows], "columns": [c for _, c in rows]})

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInPandas(run, "key string, columns map<string, binary>")
