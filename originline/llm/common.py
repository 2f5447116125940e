"""Pieces that several of the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from originline.session import configure, shared_folder

#: Fixed value: the white space that separates words, one byte each.
SPACES = b" \t\n\x0b\x0c\r"
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings for texts: Arrow batches bounded by bytes, not rows alone."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def folder_of(spark: SparkSession) -> str:
    return shared_folder(spark)


def n_words(text) -> F.Column:
    """Number of runs of ``[^\\x20\\x09-\\x0D]``; 0 for null. Counts without keeping words."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "w")
    return F.length(F.regexp_replace(trimmed, WORD_SPLIT, "")).cast("long")


def draw(seed: int, *keys) -> F.Column:
    """A seeded uniform number in [0, 1), from the first 13 hex digits of an MD5."""
    text = F.concat_ws("\x1f", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("\x00")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def free_name(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def extended(rows: DataFrame, ddl: str) -> StructType:
    """The schema of ``rows`` with further columns."""
    return StructType([*rows.schema.fields, *StructType.fromDDL(ddl).fields])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch as one byte array, and their n + 1 offsets; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words, so that sums of words do not cancel."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MUL
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray, chunk: int = 2 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a batch, and the n + 1 word offsets of its texts.

    A-Z are lower-cased; a word is a run of bytes other than :data:`SPACES`. The hash
    is a sum over the bytes of a word, each scrambled with its position. Long data
    are taken in chunks that end at white space.
    """
    hashes, starts, low, n = [], [], 0, len(data)
    while low < n:
        high = min(low + chunk, n)
        while high < n:
            space = np.flatnonzero(_IS_SPACE[data[high : high + 65536]])
            if len(space):
                high += int(space[0])
                break
            high = min(high + 65536, n)
        own, first = _words_of_chunk(data[low:high], offsets[(offsets > low) & (offsets < high)] - low)
        hashes.append(own)
        starts.append(first + low)
        low = high
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    begins = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(begins, offsets).astype(np.int64)


def _words_of_chunk(data: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word; ``inner`` are the bounds of texts inside the chunk."""
    space = _IS_SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    first[inner] = ~space[inner]
    starts = np.flatnonzero(first)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), starts
    position = np.arange(len(data), dtype=np.int64)
    begin = np.zeros(len(data), np.int64)
    begin[starts] = starts
    position -= np.maximum.accumulate(begin)
    with np.errstate(over="ignore"):
        scaled = mix((position.astype(np.uint64) << np.uint64(8)) + _LOWER[data] + np.uint64(1))
        scaled[space] = 0
        return mix(np.add.reduceat(scaled, starts) + _MIX), starts


def shingle_hashes(
    words: np.ndarray, bounds: np.ndarray, width: int = 5,
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, by text; a shorter text is one run, an empty one none."""
    counts = np.diff(bounds)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(n)])
    total = int(out[-1])
    if total == 0:
        return np.zeros(0, np.uint64), out
    at = np.arange(total, dtype=np.int64) - np.repeat(out[:-1], n) + np.repeat(bounds[:-1], n)
    length = np.minimum(np.repeat(counts, n), width)
    with np.errstate(over="ignore"):
        value = np.full(total, 0x1F, np.uint64)
        for k in range(width):
            inside = k < length
            word = words[np.minimum(at + k, len(words) - 1)]
            value = np.where(inside, mix(value * np.uint64(0x100000001B3) + word), value)
    return value, out


def slices(data: np.ndarray, offsets: np.ndarray, size: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` bytes; one longer text is a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1)
        yield start, min(end, n)
        start = end
