"""Helpers that the corpus operators share: inputs, shared files, Arrow batches and word splitting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tubula.functions.runtime import discard, shared_dir, stored  # noqa: F401

#: White space between words, as Java and Python regular expressions write it.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one step of a Python worker handles at once.
SLICE_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the named string column holds about ``limit`` bytes at most; a longer value
    stays whole in a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        end = np.cumsum(size, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = end[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(end, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space, A-Z lower-cased, of all texts in a row, and where each text's
    words start and end (one more offset than texts). Null counts as empty."""
    texts = pc.fill_null(texts, "")
    listed = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, offsets = listed.flatten(), listed.offsets.to_numpy()
    real = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return flat.filter(real), kept[offsets - offsets[0]]


def word_codes(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each word and the distinct words that the numbers stand for."""
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each row; rows without values give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (the finaliser of a common 64-bit hash)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
