"""Byte-level helpers shared by the operators: words, keys and Arrow maps.

Texts are handled as UTF-8 bytes. Lower-casing touches A-Z only and splitting follows the ASCII white
space ``[\\x20\\x09-\\x0D]``; both are what Python's ``bytes`` methods do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitwright.operators.checks import require_columns

BATCH_BYTES = 8_000_000
SPACES = "[\\x20\\x09-\\x0D]"
#: A-Z to a-z, everything that is neither an ASCII letter or digit nor above 0x7F to a space.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return text.translate(ALNUM).split()


def space_words(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+``."""
    return text.lower().split()


def remainder(doc_id: Column, modulus: int) -> Column:
    """``crc32`` of the id's text modulo ``modulus``; a null id gives null."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus))


def row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """``_key1, _key2``: two independent hashes of id and text, the same in every plan over the rows.

    Rows that share them are copies in both columns and get the same result. Text stays out of the
    shuffles that carry the key.
    """
    return [
        F.xxhash64(id_col, text_col).alias("_key1"),
        F.xxhash64(F.lit(1), text_col, id_col).alias("_key2"),
    ]


class WordHashes(dict):
    """64-bit hash of a word, computed once per worker; emptied when it has grown to ``limit`` words."""

    def __init__(self, limit: int = 100_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x if x is not None else b"" for x in column.cast(pa.large_binary()).to_pylist()]


def text_slices(column: pa.Array) -> Iterator[list[bytes]]:
    """The bytes of a column in slices of some megabytes, so that numpy temporaries stay small."""
    part: list[bytes] = []
    size = 0
    for x in texts_of(column):
        part.append(x)
        size += len(x)
        if size >= 2_000_000:
            yield part
            part, size = [], 0
    if part:
        yield part


def arrow_map(
    df: DataFrame, work: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: str | T.StructType, rows: int = 1
) -> DataFrame:
    """``mapInArrow`` with per-worker set-up: ``work()`` runs once per task and returns the batch function.

    Batches are joined until they have ``rows`` rows, for work that gains from many rows at once. Texts
    differ in length by orders of magnitude, so the session's Arrow batches are
    limited to ``BATCH_BYTES``.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= rows:
                yield from step(_joined(held))
                held = []
                pa.default_memory_pool().release_unused()
        if sum(b.num_rows for b in held):
            yield from step(_joined(held))

    return df.mapInArrow(run, schema)


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches of the session to ``BATCH_BYTES``, unless its limit is lower."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    limit = int(spark.conf.get(name).rstrip("b"))
    if not 0 < limit <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def with_column(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with columns added or replaced."""
    names, arrays = list(batch.schema.names), list(batch.columns)
    for name, array in columns.items():
        if name in names:
            arrays[names.index(name)] = array
        else:
            names.append(name)
            arrays.append(array)
    return pa.RecordBatch.from_arrays(arrays, names)


def documents(df: DataFrame, *more: str) -> DataFrame:
    """``doc_id, text`` and ``more`` of a document table; other columns, whatever their names, stay out."""
    require_columns(df, ["doc_id", "text", *more], "documents")
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
