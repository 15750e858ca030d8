"""Helpers of the training-data operators: scratch tables, Arrow slices, word and chunk arrays.

Text arrives in Arrow batches. A batch is cut into slices of bounded bytes, so
the NumPy temporaries stay small however long the batch is; one text is never
cut. Words and tokenizer chunks are found on the byte buffer of a whole slice
and dictionary encoded, so per-string work runs once for each distinct string.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tessera.session import shared_folder

#: A word is a longest run of bytes outside space and tab to carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"
SLICE_BYTES = 4 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate data below the shared folder of the session."""
    return f"{shared_folder(spark).rstrip('/')}/tessera-scratch/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; lineage ends there.

    The shuffle files behind the table are of no more use once it is written, so Spark
    is told to drop them with the write.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch | pa.Table, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """Row ranges of ``batch`` whose texts hold about ``limit`` bytes; a longer text makes a slice of its own."""
    table = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
    if table.num_rows == 0:
        return
    ends = np.cumsum(lengths(table[column]))
    start = 0
    pa.default_memory_pool().release_unused()
    while start < table.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield table.slice(start, stop - start)
        start = stop


def lengths(column: pa.ChunkedArray) -> np.ndarray:
    """Bytes of each string, 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def byte_buffer(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all strings end to end, and their offsets (rows + 1); null is empty."""
    texts = column.cast(pa.large_binary()).combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def cut(data: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Dictionary of the pieces of ``data`` that begin at ``starts`` and the index of each piece in it."""
    if len(starts) == 0:
        return [], np.zeros(0, np.int64)
    bounds = np.append(starts, len(data)).astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _spaces(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


def kept_by_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """An object that a Python worker keeps between tasks, made on first use; a worker keeps one.

    The package travels to workers by value, with each task anew; what is to stay (loaded
    vocabularies, bounded caches) hangs on a module of the worker's own.
    """
    module = sys.modules.setdefault("_tessera_worker", types.ModuleType("_tessera_worker"))
    held = module.__dict__.setdefault("held", {})
    if key not in held:
        held.clear()
        held[key] = make()
    return held[key]


class Words:
    """Words of a slice: ``distinct`` byte strings, ``codes`` by position, ``bounds`` by text (rows + 1)."""

    def __init__(self, column: pa.ChunkedArray):
        data, offsets = byte_buffer(column)
        inside = ~_spaces(data)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = offsets[:-1][np.diff(offsets) > 0]
        first[heads] = inside[heads]
        starts = np.flatnonzero(first)
        pieces, self.codes = cut(data, starts)
        self.distinct = [p.rstrip(b" \t\n\x0b\x0c\r") for p in pieces]
        self.bounds = np.searchsorted(starts, offsets).astype(np.int64)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of the word at each position."""
        table = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.distinct), np.uint64, len(self.distinct))
        return table[self.codes]


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive 64-bit combination of two hash arrays."""
    x = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` (``counts[i]`` of them) for all i, end to end."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - ends + counts, counts)
