"""Token-id output: flat files of unsigned integers with 64-bit document offsets.

A data set is a folder of shards in ascending doc_id order. Shard i has `i.ids` (flat little-endian unsigned 16- or
32-bit ids), `i.off` (64-bit offsets, one more than documents) and `i.doc` (64-bit document ids). `bases.json` holds
each shard's first document and first id: prefix sums over the shards' own counts.

Edge cases: null texts are empty (one end id); null doc_ids come first and are stored as -2**63; equal doc_ids follow
each other in the order of their texts' hash; an empty table gives a data set without shards.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.llm.common import passing, shared_dir, ship, steps, utf8
from orebody.llm.encoder import encoder

NULL_ID = -(1 << 63)


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    path = path.replace("s3a://", "s3://").replace("s3n://", "s3://")
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def write_dataset(docs: DataFrame, folder: str, vocabulary: str, end_id: int, text: str = "text", width: int = 0) -> list[dict]:
    """Encode every whole text, append end_id and write the data set; returns the shards with their bases.

    width: bytes an id (2 or 4); 0 takes 2 where the vocabulary allows it. A shard is written under another name
    and renamed when whole, so that a repeated task replaces it.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        size = width or (2 if max(encode.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4)
        task = TaskContext.get()
        shard, mark = task.partitionId(), f"{task.stageId()}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        store, root = _open(folder)
        n, total, files = 0, 0, {}
        for batch in steps(batches):
            if not files:
                store.create_dir(root, recursive=True)
                files = {k: store.open_output_stream(f"{root}/{shard:06d}.{k}.{mark}") for k in ("ids", "off", "doc")}
                files["off"].write(np.zeros(1, "<u8").tobytes())
            flat, offsets = encode(*utf8(batch.column(1)))
            flat = np.insert(flat, offsets[1:], end_id)
            files["ids"].write(flat.astype(f"<u{size}").tobytes())
            ends = total + offsets[1:] + np.arange(1, batch.num_rows + 1)
            files["off"].write(ends.astype("<u8").tobytes())
            files["doc"].write(np.array([NULL_ID if x is None else x for x in batch.column(0).to_pylist()], "<i8").tobytes())
            n, total = n + batch.num_rows, int(ends[-1])
        for k, f in files.items():
            f.close()
            store.move(f"{root}/{shard:06d}.{k}.{mark}", f"{root}/{shard:06d}.{k}")
        if files:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard]), "docs": pa.array([n]), "ids": pa.array([total]), "width": pa.array([size])})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    found = sorted(rows.mapInArrow(run, "shard long, docs long, ids long, width long").collect())
    shards, doc, first = [], 0, 0
    for shard, n, total, size in found:
        shards.append({"shard": shard, "docs": n, "ids": total, "width": size, "first_doc": doc, "first_id": first})
        doc, first = doc + n, first + total
    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/bases.json") as f:
        f.write(json.dumps(shards).encode())
    return shards


class _Ranges:
    """A file of numbers in a store that can't be mapped: slices are read where they stand."""

    def __init__(self, store: pa.fs.FileSystem, path: str, kind: str):
        self.file, self.kind = store.open_input_file(path), np.dtype(kind)

    def __len__(self) -> int:
        return self.file.size() // self.kind.itemsize

    def __getitem__(self, part: slice) -> np.ndarray:
        a, b, _ = part.indices(len(self))
        return np.frombuffer(self.file.read_at(max(0, b - a) * self.kind.itemsize, a * self.kind.itemsize), self.kind)


def _map(store: pa.fs.FileSystem, path: str, kind: str) -> np.ndarray | _Ranges:
    """The file as an array: memory-mapped where the store is a local or mounted folder, else read by ranges."""
    if isinstance(store, pa.fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if store.get_file_info(path).size else np.zeros(0, kind)
    return _Ranges(store, path, kind)


def read_dataset(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row a document, from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids."""
    ship(spark)
    store, root = _open(folder)
    with store.open_input_file(f"{root}/bases.json") as f:
        shards = json.loads(f.readall())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    if not shards:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        for batch in batches:
            for x in batch.to_pylist():
                ids, off, doc = (_map(store, f"{root}/{x['shard']:06d}.{k}", t) for k, t in (("ids", f"<u{x['width']}"), ("off", "<u8"), ("doc", "<i8")))
                for a in range(0, len(doc), 4096):
                    o = np.asarray(off[a : a + 4097]).astype(np.int64)
                    name = np.asarray(doc[a : a + 4096])
                    part = np.asarray(ids[o[0] : o[-1]]).astype("<u4").tobytes()
                    at = (o - o[0]) * 4
                    crc = [zlib.crc32(part[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    cols = [pa.array(name, mask=name == NULL_ID), pa.array(o[:-1] + x["first_id"]), pa.array(np.diff(o)), pa.array(crc, pa.int64())]
                    if with_ids:
                        cols.append(pa.array([np.frombuffer(part[i:j], "<u4").astype(np.int64) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    rows = spark.createDataFrame([(x["shard"], x["width"], x["first_id"]) for x in shards], "shard long, width long, first_id long")
    return rows.repartitionByRange(len(shards), "shard").mapInArrow(run, schema)


def dataset_digests(docs: DataFrame, vocabulary: str, end_id: int = 0, text: str = "text") -> DataFrame:
    """Write docs as a data set in the shared folder and describe each document from the files read back."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/orebody/{uuid.uuid4().hex}-ids"
    write_dataset(docs, folder, vocabulary, end_id, text)
    passing(spark, folder)
    return read_dataset(spark, folder)
