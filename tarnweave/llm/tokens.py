"""Problem 8: texts as token ids of a public byte-level tokenizer, with offsets and exact decoding."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.llm.common import table

#: Folder of the tokenizers' files on the driver; each executor gets the one file (1.5 MB) by broadcast.
FOLDER = os.environ.get("TARNWEAVE_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k"
#: Entries of a worker's memory of encoded pieces, which is emptied when full; it changes the speed alone.
REMEMBERED = 400_000
#: Rows that are encoded together.
ROWS = 512
_AFTER_BLANK = re.compile(r"(?= [^\s\x1c-\x1f])")
_UNEVEN = re.compile(r" (?:[\s\x1c-\x1f]|\Z)")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: visible ones for themselves, the rest from 256 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Encoder:
    """Encodes with the tokenizers library, piece by piece.

    A token of this kind of vocabulary never reaches over a blank that a non-blank follows: the pre-tokenizer takes such
    a blank as the start of a word. So texts are cut there, each different piece is encoded once by the library, and its
    ids are put together, which gives what the library gives for the whole text.
    """

    _kept: dict[int, Encoder] = {}

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        #: The number of each known piece, whose ids are table[begin[number]:begin[number + 1]].
        self.memory: dict[str, int] = {}
        self.table, self.begin = np.empty(0, np.int32), np.zeros(1, np.int64)
        back = {letter: b for b, letter in enumerate(byte_letters())}
        size = self.tokenizer.get_vocab_size()
        self.bytes = [b""] * size
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        for token, k in self.tokenizer.get_vocab().items():
            self.bytes[k] = token.encode() if token in special else bytes(back[c] for c in token)
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)

    @classmethod
    def of(cls, definition: str) -> Encoder:
        """One encoder a worker and tokenizer."""
        key = hash(definition)
        if key not in cls._kept:
            cls._kept[key] = cls(definition)
        return cls._kept[key]

    @staticmethod
    def pieces(text: str) -> list[str]:
        if _UNEVEN.search(text):
            return [p for p in _AFTER_BLANK.split(text) if p]
        first, *rest = text.split(" ")
        return [first, *[" " + r for r in rest]] if first else [" " + r for r in rest]

    def _learn(self, pieces: list[str]) -> None:
        """Encode the pieces that are new and add their ids to the table."""
        new = [p for p in dict.fromkeys(pieces) if p not in self.memory]
        if len(self.memory) + len(new) > REMEMBERED:
            self.memory.clear()
            self.table, self.begin = np.empty(0, np.int32), np.zeros(1, np.int64)
            new = list(dict.fromkeys(pieces))
        ids: list[int] = []
        ends = []
        for k in range(0, len(new), 4096):
            for got in self.tokenizer.encode_batch_fast(new[k : k + 4096], add_special_tokens=False):
                ids += got.ids
                ends.append(len(ids))
        self.memory.update(zip(new, range(len(self.memory), len(self.memory) + len(new)), strict=True))
        self.begin = np.concatenate([self.begin, np.array(ends, np.int64) + len(self.table)])
        self.table = np.concatenate([self.table, np.array(ids, np.int32)])

    def _look_up(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the texts' pieces in the table, and where each text's pieces begin."""
        per_text = [self.pieces(t) if t else [] for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(p) for p in per_text])]).astype(np.int64)
        pieces = [p for ps in per_text for p in ps]
        try:
            at = np.fromiter(map(self.memory.__getitem__, pieces), np.int64, len(pieces))
        except KeyError:
            self._learn(pieces)
            at = np.fromiter(map(self.memory.__getitem__, pieces), np.int64, len(pieces))
        return at, starts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text begins; none for null and empty texts."""
        at, starts = self._look_up(texts)
        lengths = np.diff(self.begin)[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        take = np.repeat(self.begin[at] - ends[:-1], lengths) + np.arange(ends[-1])
        return self.table[take], ends[starts]

    def count(self, texts: list[str | None]) -> np.ndarray:
        at, starts = self._look_up(texts)
        return np.diff(np.concatenate([[0], np.cumsum(np.diff(self.begin)[at])])[starts])

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no whole character, as at a cut through one, become U+FFFD."""
        return b"".join([self.bytes[k] for k in ids]).decode("utf-8", "replace")

    def offsets(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """Start and end of each token in characters; tokens that share a character both cover it."""
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        begins = np.concatenate([np.cumsum((raw & 0xC0) != 0x80), [len(text) + 1]])
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        return list(zip((begins[starts] - 1).tolist(), begins[ends - 1].tolist(), strict=True))


def definition(name: str = TOKENIZER, folder: str | None = None) -> str:
    with open(os.path.join(folder or FOLDER, f"{name}.json"), encoding="utf-8") as f:
        return f.read()


def _with_encoder(df: DataFrame, keep: list[str], text: str, schema: str, of, tokenizer: str, folder: str | None) -> DataFrame:
    """Map Arrow batches: columns `keep`, then the arrays that `of(encoder, texts)` gives."""
    shared = df.sparkSession.sparkContext.broadcast(definition(tokenizer, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                made = of(encoder, part.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made.values()], [*part.schema.names[:-1], *made])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{kept}, {schema}" if keep else schema)


def encode(df: DataFrame, text: str, keep: list[str], into: str = "ids", tokenizer: str = TOKENIZER, folder: str | None = None) -> DataFrame:
    """Columns `keep` and the token ids of `text`, without special tokens; null and empty texts have an empty list.

    Strings that look like special tokens are ordinary text. Each row once, repeated rows as often as they occur; whole
    texts of any length, no shuffle. `keep` must not name `into`.
    """

    def ids(encoder: Encoder, texts: list[str | None]) -> dict[str, pa.Array]:
        flat, starts = encoder.encode(texts)
        return {into: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat, pa.int32()))}

    return _with_encoder(df, keep, text, f"`{into}` array<int>", ids, tokenizer, folder)


def count_tokens(df: DataFrame, text: str, keep: list[str], into: str = "n_tokens", tokenizer: str = TOKENIZER, folder: str | None = None) -> DataFrame:
    """Like `encode`, with the number of ids alone: 0 for null and empty texts."""
    return _with_encoder(df, keep, text, f"`{into}` bigint", lambda e, texts: {into: pa.array(e.count(texts), pa.int64())}, tokenizer, folder)


def encode_with_offsets(df: DataFrame, text: str, keep: list[str], tokenizer: str = TOKENIZER, folder: str | None = None) -> DataFrame:
    """ids, and starts and ends of each token in characters of the text (code points)."""

    def spans(encoder: Encoder, texts: list[str | None]) -> dict[str, pa.Array]:
        flat, begin = encoder.encode(texts)
        ids = [flat[a:b].tolist() for a, b in zip(begin, begin[1:])]
        pairs = [encoder.offsets(t, i) if i else [] for t, i in zip(texts, ids, strict=True)]
        kind = pa.list_(pa.int32())
        return {"ids": pa.array(ids, kind), "starts": pa.array([[a for a, _ in p] for p in pairs], kind), "ends": pa.array([[b for _, b in p] for p in pairs], kind)}

    return _with_encoder(df, keep, text, "ids array<int>, starts array<int>, ends array<int>", spans, tokenizer, folder)


def decode(df: DataFrame, ids: str, keep: list[str], into: str = "text", tokenizer: str = TOKENIZER, folder: str | None = None) -> DataFrame:
    """Columns `keep` and the text of the ids; null for null, empty for an empty list. Bytes of a split character become U+FFFD."""
    return _with_encoder(df, keep, ids, f"`{into}` string", lambda e, lists: {into: pa.array([None if x is None else e.decode(x) for x in lists], pa.string())}, tokenizer, folder)


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode(table(spark, folder, "documents"), "text", ["doc_id"])


def p8_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and whether decoding the ids gives the text again, null and empty texts the empty one."""
    docs = table(spark, folder, "documents")
    back = decode(encode(docs, "text", ["doc_id", "text"]), "ids", ["doc_id", "text"], "back")
    return back.select("doc_id", (F.coalesce("text", F.lit("")) == F.col("back")).alias("same"))


SQL = {"p8_round_trip": "SELECT doc_id, true AS same FROM documents"}
QUERIES = {"p8_ids": p8_ids, "p8_round_trip": p8_round_trip}
