"""Shared plumbing of the training-data operators: table access, durable intermediates, Arrow text buffers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.plans.durable import durable, passing, shared_dir  # noqa: F401

#: Bytes of text that one vectorised step works on; a longer single text is a step of its own.
STEP_BYTES = 1 << 19

#: The white space of the word definition used by every contract: \x20 and \x09-\x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: local ones from where the driver found it, those of a cluster from an
    archive that the driver sends them, once an application."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    context = spark.sparkContext
    env = context.environment
    if context.master.startswith("local"):
        if root not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    elif context.applicationId not in _SENT:
        _SENT.add(context.applicationId)
        context.addPyFile(archive(root))


_SENT: set[str] = set()


def archive(root: str) -> str:
    """A zip file of the package in a folder of the driver that goes with this process."""
    folder = tempfile.mkdtemp(prefix="orebody-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return shutil.make_archive(os.path.join(folder, "orebody"), "zip", root, "orebody")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


materialize = durable


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's text modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without gaps and the n+1 offsets of its rows; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if len(column) and column.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each piece hold at most limit bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
            yield batch.slice(a, b - a)
            a = b
    _give_back()


def _give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task should hold little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lanes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans data[start:end] as little-endian words of 8 bytes, filled up with zeros: the words (one at least for
    each span), each word's span, and each span's first word. Spans are equal if their lengths and words are."""
    count = np.maximum(1, (end - start + 7) >> 3)
    first = np.cumsum(count) - count
    span = np.repeat(np.arange(len(start)), count)
    at = start[span] + 8 * (np.arange(len(span)) - first[span])
    padded = np.append(data, np.zeros(8, np.uint8))
    word = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))[at]
    rest = end[span] - at
    short = np.flatnonzero(rest < 8)
    word[short] &= (np.uint64(1) << (8 * rest[short]).astype(np.uint64)) - np.uint64(1)
    return word, span, first


def lane_hash(word: np.ndarray, span: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans given as lanes(), equal for equal bytes wherever they stand: every word is mixed before
    and after its place in the span is added, so that no arithmetic of the text survives."""
    if not len(first):
        return np.zeros(0, np.uint64)
    place = (np.arange(len(span)) - first[span] + 1).astype(np.uint64)
    total = np.add.reduceat(mix64(mix64(word) + place * np.uint64(0xA24BAED4963EE407)), first)
    return mix64(total + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]."""
    return lane_hash(*lanes(data, start, end), end - start)


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run without white space; words don't cross rows."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, byte by byte."""
    return _LOWER[data]
