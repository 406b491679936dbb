"""Problem 8: encode a corpus with a public tokenizer, and back.

The ``tokenizers`` library encodes Arrow batches. A byte-level BPE never merges across the pieces its
pre-tokenizer cuts, so a worker asks the library once per distinct piece and remembers the answer (up to
``CACHE_ENTRIES`` pieces, then it starts afresh); texts with letters that are newer than some Unicode tables
go to the library whole, as the two pre-tokenizers could cut them differently. Results are those of
``Tokenizer.encode(text, add_special_tokens=False)`` with special tokens read as ordinary text.

Defined results: a null or empty text has an empty list; repeated rows give repeated rows; an empty table gives
an empty table; further columns are ignored, whatever their names; a text of any length is encoded whole.
"""

from __future__ import annotations

import functools
import os
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("SPANLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
CACHE_ENTRIES = 200_000
CACHED_PIECE_CHARS = 48

#: The published pre-tokenizer pattern of byte-level BPE (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and digits that Unicode tables of different ages classify differently, in whole ranges.
UNSETTLED = "[՘֋֌࢏౜೜₏₝-₟꟎꟏꟒꟔꟝꟢꟱꭬꭭\U00010000-\U0001d3ff\U0001d6a6\U0001d800-\U0001efff\U00020000-\U0010ffff]"


_shipped: dict[str, set[str]] = {}


def byte_table() -> dict[int, str]:
    """The printable character that byte-level BPE vocabularies write for each byte: printable Latin-1 bytes stand for
    themselves, the others are numbered upwards from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


class Codec:
    """Encoder and decoder of one vocabulary file, loaded once per worker by ``codec``."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.pieces = regex.compile(PIECES).findall
        self.unsettled = regex.compile(UNSETTLED).search
        self.known: dict[str, tuple[int, ...]] = {}

    def _library_ids(self, text: str) -> tuple[int, ...]:
        return tuple(self.library.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> array:
        ids = array("i")
        if not text:
            return ids
        if not text.isascii() and self.unsettled(text):
            ids.extend(self._library_ids(text))
            return ids
        known, add = self.known, ids.extend
        for piece in self.pieces(text):
            found = known.get(piece)
            if found is None:
                found = self._library_ids(piece)
                if len(piece) <= CACHED_PIECE_CHARS:
                    if len(known) >= CACHE_ENTRIES:
                        known.clear()
                    known[piece] = found
            add(found)
        return ids

    @functools.cached_property
    def token_bytes(self) -> list[bytes]:
        """The bytes of each id: the vocabulary's characters mapped back through the byte table."""
        back = {c: b for b, c in byte_table().items()}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocabulary.values()) + 1)
        for token, at in vocabulary.items():
            out[at] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ``ids``; bytes are joined before they are decoded, so characters split over tokens come back whole."""
        table = self.token_bytes
        return b"".join(table[i] for i in ids).decode("utf-8", errors="replace")

    def offsets(self, text: str, ids: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
        """Start and end code point of each token; tokens that share a split character all cover it."""
        lengths = np.fromiter((len(self.token_bytes[i]) for i in ids), dtype=np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80)
        return (char[starts] - 1).astype(np.int32), char[ends - 1].astype(np.int32)


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def ship(spark: SparkSession, path: str) -> str:
    """A name under which every worker finds the vocabulary: Spark copies the file to all of them, once for a session."""
    name = os.path.basename(path)
    if path not in _shipped.get(spark.sparkContext.applicationId, ()):
        spark.sparkContext.addFile(path)
        _shipped.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return name


def shipped(name: str, path: str) -> Codec:
    """The codec of a shipped vocabulary, on a worker; from its own path where that is there and the copy isn't."""
    try:
        copy = SparkFiles.get(name)
    except Exception:  # noqa: BLE001 - no Spark around
        copy = path
    return codec(copy if os.path.exists(copy) else path)


def vocabulary_path(name: str = VOCABULARY, folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZER_DIR, name)


def _lists(rows: list[array]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.concatenate([np.frombuffer(r, dtype=np.int32) for r in rows if len(r)] or [np.empty(0, dtype=np.int32)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=pa.int32()))


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(id_col, ids)`` of every row: a map over Arrow batches, without a shuffle."""
    path = vocabulary or vocabulary_path()
    name = ship(df.sparkSession, path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped(name, path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = _lists([own.encode(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["key", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encode, f"key {kind}, ids array<int>").withColumnRenamed("key", id_col)


def token_counts(df: DataFrame, keys: list[str], text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``keys`` and ``n_tokens`` of every row (0 for null and empty texts); the ids stay in the worker."""
    path = vocabulary or vocabulary_path()
    name = ship(df.sparkSession, path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped(name, path)
        for batch in batches:
            n = pa.array([len(own.encode(t)) for t in batch.column(batch.num_columns - 1).to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*batch.schema.names[:-1], "n_tokens"])

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, F.col(text_col).cast("string").alias("_text")).mapInArrow(count, f"{fields}, n_tokens bigint")


def encode_with_offsets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(id_col, ids, starts, ends, restored)``: ids, their code-point spans, and whether decoding gives the text back."""
    path = vocabulary or vocabulary_path()
    name = ship(df.sparkSession, path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped(name, path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, starts, ends, back = [], [], [], []
                for text in part.column(1).to_pylist():
                    found = own.encode(text)
                    a, b = own.offsets(text, found) if len(found) else (np.empty(0, np.int32),) * 2
                    ids.append(found)
                    starts.append(array("i", a.tobytes()))
                    ends.append(array("i", b.tobytes()))
                    back.append(own.decode(found) == (text or ""))
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids), _lists(starts), _lists(ends), pa.array(back)], names=["key", "ids", "starts", "ends", "restored"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encode, f"key {kind}, ids array<int>, starts array<int>, ends array<int>, restored boolean").withColumnRenamed("key", id_col)


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``(id_col, text)``: the texts of id lists; a null list gives an empty text."""
    path = vocabulary or vocabulary_path()
    name = ship(df.sparkSession, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped(name, path)
        for batch in batches:
            texts = pa.array([own.decode(x or ()) for x in batch.column(1).to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["key", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("key"), F.col(ids_col).alias("ids")).mapInArrow(decode, f"key {kind}, text string").withColumnRenamed("key", id_col)
