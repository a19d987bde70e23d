"""Shared helpers: run folders on shared storage, packed arrays, word splitting and byte-bounded batches."""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voucherflow.session import ensure_checkpoint_dir

# Text held at once by a Python task; a longer single text is still taken whole.
SLICE_BYTES = 8 << 20


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder name inside the shared folder that spark.checkpoint.dir names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, uri: str) -> None:
    """Remove an intermediate table that no later step reads; Spark's own file system client does it on any store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows of `df` written to shared storage, so that nothing upstream runs again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_of(column: str):
    """crc32 of a column's text form, as the contracts use it to hold rows out; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def written(df: DataFrame, uri: str) -> DataFrame:
    """The rows of `df` written as a table of a run folder; its caller removes it when no later step reads it."""
    df.write.parquet(uri)
    return df.sparkSession.read.parquet(uri)


# ---- text ------------------------------------------------------------------

def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of each batch whose `column` holds about `limit` bytes; a row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = (np.cumsum(size) - size) // limit
        starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """ASCII-lower-cased words between ASCII white space (space, 0x09 to 0x0D) of all texts, and where each text starts in them.

    A null text has no word."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        offsets = np.r_[0, np.cumsum(full)][offsets]
        flat = flat.filter(pa.array(full))
    return flat, offsets


def coded_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word codes of all texts, the distinct words the codes point to, and where each text starts."""
    flat, offsets = words_of(texts)
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, offsets


# ---- packed arrays ---------------------------------------------------------

def pack(values: np.ndarray) -> bytes:
    """An integer array as compressed bytes; the differences of a sorted array take few of them."""
    v = np.ascontiguousarray(values)
    d = np.r_[v[:1], v[1:] - v[:-1]]
    planes = d.view(np.uint8).reshape(-1, v.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return np.cumsum(np.ascontiguousarray(planes).view(dtype).ravel(), dtype=dtype)


def pieces(total: float, each: float) -> int:
    """How many pieces of about `each` hold `total`; at least one."""
    return max(1, math.ceil(total / each))


# ---- arrays on shared storage ----------------------------------------------

def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def write_array(uri: str, values: np.ndarray) -> None:
    """Write one array file; a repeated task attempt replaces it by the same bytes."""
    path = _local(uri)
    if path is None:
        from pyarrow import fs
        store, inner = fs.FileSystem.from_uri(uri)
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        with store.open_output_stream(inner) as out:
            out.write(np.ascontiguousarray(values).tobytes())
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        np.ascontiguousarray(values).tofile(out)
    os.replace(part, path)


def map_array(uri: str, dtype) -> np.ndarray:
    """An array file, memory-mapped where the shared folder is mounted, else read through the store's own client."""
    path = _local(uri)
    if path is None:
        from pyarrow import fs
        store, inner = fs.FileSystem.from_uri(uri)
        with store.open_input_file(inner) as src:
            return np.frombuffer(src.read(), dtype)
    return np.memmap(path, dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)


# ---- sets of hashes --------------------------------------------------------

ARRAY_KEYS = 1 << 21    # hashes in one file


class KeySet:
    """Hashes in sorted files by range, mapped by the workers that look them up."""

    def __init__(self, folder: str, buckets: int, present: frozenset[int]):
        self.folder, self.buckets, self.present = folder, buckets, present

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        bucket = dealt(keys, self.buckets)
        for b in np.unique(bucket).tolist() if self.buckets > 1 else [0]:
            if b in self.present:
                stored = mapped(f"{self.folder}/{b}")
                here = np.flatnonzero(bucket == b) if self.buckets > 1 else slice(None)
                at = np.minimum(np.searchsorted(stored, keys[here]), len(stored) - 1)
                out[here] = stored[at] == keys[here]
        return out


@lru_cache(maxsize=1_000)
def mapped(uri: str) -> np.ndarray:
    """An array file of hashes, kept mapped by the worker."""
    return map_array(uri, np.uint64)


def dealt(keys: np.ndarray, parts: int) -> np.ndarray:
    """Hash partition of each key, in the order of the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def store_keys(keys: DataFrame, folder: str) -> KeySet:
    """The distinct longs of column `key` as a KeySet."""
    buckets = pieces(keys.count(), ARRAY_KEYS)

    def write(group):
        b = group.column("bucket")[0].as_py()
        write_array(f"{folder}/{b}", np.unique(np.asarray(group.column("key").combine_chunks()).view(np.uint64)))
        return pa.table({"bucket": pa.array([b], pa.int64())})
    ranged = keys.select("key").distinct().select(F.expr(f"shiftright(shiftrightunsigned(key, 32) * {buckets}L, 32)").alias("bucket"), "key")
    return KeySet(folder, buckets, frozenset(r["bucket"] for r in ranged.groupBy("bucket").applyInArrow(write, "bucket long").collect()))
