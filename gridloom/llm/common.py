"""Shared helpers: vectorised words, tables in the shared folder (``saved``, ``forget``), row keys, workers' memory."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut, forget

#: Characters that end a word: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: Text handed to one vectorised step, so that a worker's memory does not follow the batch size.
SLICE_BYTES = 4 << 20
#: The word hash: an odd multiplier, and a random value for each byte.
POWER = np.uint64(0x9E3779B97F4A7C15)
BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage."""
    return cut(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*cols: str | Column) -> Column:
    """A 64-bit key of a row's own columns; rows equal in them get one key, nulls included."""
    return F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols])


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about SLICE_BYTES of text each; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at, n = 0, len(sizes)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        yield at, to
        at = to


def as_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text, A-Z lower-cased if asked.

    Returns the bounds (one more than texts), each word's code, and the words by code; lower-casing
    may leave equal words under several codes.  A null text has no words.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    bounds = lists.offsets.to_numpy()
    words = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
    bounds = (bounds - bounds[0]).astype(np.int64)
    mask = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy()
    if not mask.all():  # leading or trailing white space leaves empty pieces
        bounds, codes = np.append(0, np.cumsum(mask))[bounds], codes[mask]
    # Lower-cased by code: cheaper, and free of offsets that a slice of texts would carry along.
    return bounds, codes, pc.ascii_lower(coded.dictionary) if lower else coded.dictionary


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string's bytes: a polynomial over random byte values, scrambled."""
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    n = np.diff(at)
    out = n.astype(np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
        starts = (at[:-1] - at[0])[some]
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(n.max()), POWER, np.uint64))
            place = np.arange(len(raw)) - np.repeat(starts, n[some])
            out[some] += np.add.reduceat(BYTES[raw] * powers[place], starts)
    with np.errstate(over="ignore"):
        return mix(out)


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and the 64-bit hash of each word; see ``split_words``."""
    bounds, codes, words = split_words(texts, lower)
    return bounds, hashes(words)[codes]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def release() -> None:
    """Hand memory that this process's allocators hold unused back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with a release of memory at the end of each task.

    Spark keeps Python workers for later tasks, so what one leaves in its allocators would add to
    the memory of an executor in every later stage.
    """

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def partitions_for(df: DataFrame, least: int = 1) -> int:
    """The number of shuffle partitions that the session asks for."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


__all__ = [
    "POWER", "SPACES", "as_array", "forget", "hashes", "mix", "partitions_for", "release", "row_key", "saved", "slices", "split_words", "table",
    "tidy", "word_hashes",
]
