"""Shared helpers: reading tables, row keys, words and their hashes inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word of the plain word rule: no space, tab, line feed, vertical tab, form feed or return.
WORD = r"[^\x20\x09-\x0D]+"
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str = "text") -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two longs without nulls that tell rows apart: the id, and the hash of the text.

    Rows alike in both are the same document twice.
    """
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(F.col(text), F.lit("")))]


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class Hashes(dict):
    """Word -> 64-bit hash, kept for words seen before; starts anew when large."""

    LIMIT = 500_000

    def __missing__(self, word: bytes | str) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = found
        return found

    def of(self, words: list[bytes] | list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for each ``width`` consecutive word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += hashes[i : n + i]
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


Batches = Iterator[pa.RecordBatch]
