"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import WorkArea

#: The white space of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"

_MASK = (1 << 64) - 1


def read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def work_area(spark: SparkSession) -> WorkArea:
    """A fresh folder under the shared checkpoint folder for written tables."""
    return WorkArea(spark)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batches, text: str = "text", most: int = 16 << 20):
    """Arrow record batches cut so that the texts of one slice have at most
    ``most`` bytes (a single longer text is a slice of its own). Bounds the
    memory of whatever is computed per slice."""
    for b in batches:
        if b.num_rows == 0:
            continue
        col = b.column(b.schema.get_field_index(text))
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        i = 0
        while i < b.num_rows:
            base = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield b.slice(i, j - i)
            i = j


def release() -> None:
    """Hand freed memory back to the system: Spark reuses its Python workers for
    other work, and keeps them while they idle."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass


def tidy(per_partition):
    """A function of batches that releases its memory when its partition ends."""

    def run(batches):
        try:
            yield from per_partition(batches)
        finally:
            release()

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit numbers (splitmix64's finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts, one after another, and
    the number of words of each text (null: none)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy()
    keep = pc.greater(pc.binary_length(flat), 0)
    flags = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
    at = offsets - offsets[0]
    return flat.filter(keep), (flags[at[1:]] - flags[at[:-1]]).astype(np.int64)


def hash_strings(values: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hash of every string; equal strings are hashed once."""
    if len(values) == 0:
        return np.empty(0, np.uint64)
    coded = values.dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    h = xxhash.xxh3_64_intdigest
    own = np.fromiter((h(w, seed) for w in strings(coded.dictionary)), np.uint64, len(coded.dictionary))
    return own[coded.indices.to_numpy()]


def strings(values: pa.Array) -> list[str]:
    """The strings of an array without nulls (several times faster than to_pylist)."""
    return values.to_numpy(zero_copy_only=False).tolist()


def gram_hashes(words: np.ndarray, n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of the n words from every position on (polynomial modulo 2^64 of
    the words' own hashes, then mixed); the last n - 1 positions have none."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    mul = np.uint64(base | 1)
    for j in range(n):
        out *= mul
        out += words[j : j + m]
    return mix64(out)


def int64(x: np.ndarray) -> np.ndarray:
    """The same bits as signed numbers, as Spark's long holds them."""
    return np.ascontiguousarray(x).view(np.int64)


def one_row_per(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For consecutive groups of these sizes: group number and position in the
    group of every element."""
    owner = np.repeat(np.arange(len(counts)), counts)
    starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    return owner, np.arange(len(owner)) - starts[owner]


def utf8_size(col) -> "F.Column":
    return F.octet_length(F.coalesce(col, F.lit("")))
