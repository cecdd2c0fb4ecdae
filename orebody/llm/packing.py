"""Packing: vector bin packing of examples into sequences under limits on tokens, segments and loss-bearing tokens.

A sequence is filled by the dot-product rule: of the waiting examples that fit, the one whose vector (tokens, one
segment, loss-bearing tokens), each as a share of its limit, has the largest dot product with the sequence's
remaining room. When none fits, the one with the largest product is cut to fill the room; its rest waits on. A sequence
that another limit than tokens stops is cut back to a power of two, which needs no padding, and what is cut off waits on.
Each task packs its own rows, a bounded number of examples waiting at a time; what is left at a task's end is cut
into sequences whose sizes are powers of two.

Edge cases: null texts are empty and have the end id alone; null or negative counts are 0, and examples without tokens
have no piece; null and repeated ids stay apart as rows; equal products tie for the example that waits longest; texts
have no limit of length (a task holds the ids of those that wait); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.llm.common import ship, steps, utf8
from orebody.llm.encoder import encoder

#: Examples that wait at a time, and those that stay waiting for the next rows.
WAITING, KEPT = 1024, 128


class Packer:
    """Places pieces; collects rows (example, start, length, sequence, offset). Examples may be cut anywhere.

    loss[i]: whether of example i only the last loss[i] tokens bear loss (all but the prompt).
    """

    def __init__(self, tokens: int, segments: int, loss: int):
        if min(tokens, segments, loss) < 1:
            raise ValueError("limits must be positive")
        self.limits = np.array([tokens, segments, loss], np.float64)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequence = 0
        self.name, self.start, self.size, self.prompt = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, name: np.ndarray, size: np.ndarray, prompt: np.ndarray) -> None:
        """Examples that wait from now on: size in tokens, of which the first `prompt` bear no loss."""
        self.name, self.size, self.prompt = np.append(self.name, name), np.append(self.size, size), np.append(self.prompt, np.minimum(prompt, size))
        self.start = np.append(self.start, np.zeros(len(name), np.int64))
        self._drop(self.size == 0)

    def _drop(self, gone: np.ndarray) -> None:
        if gone.any():
            keep = ~gone
            self.name, self.start, self.size, self.prompt = self.name[keep], self.start[keep], self.size[keep], self.prompt[keep]

    def fill(self, until: int) -> None:
        """Close sequences while more than `until` examples wait and they hold a sequence's tokens."""
        while len(self.size) > until and self.size.sum() >= self.limits[0]:
            self._one(int(self.limits[0]))

    def _one(self, tokens: int) -> None:
        room = np.array([tokens, self.limits[1], self.limits[2]], np.float64)
        size, loss = self.size.astype(np.float64), (self.size - self.prompt).astype(np.float64)
        open_ = np.ones(len(size), bool)
        chosen: list[tuple[int, int]] = []
        while room[0] >= 1 and room[1] >= 1:
            if room[2] < 1:
                open_ &= self.prompt > 0  # only tokens without loss have room
            if not open_.any():
                break
            product = (size * room[0] / self.limits[0] ** 2 + room[1] / self.limits[1] ** 2 + loss * room[2] / self.limits[2] ** 2) * open_
            fits = open_ & (size <= room[0]) & (loss <= room[2])
            i = int(np.argmax(np.where(fits, product, -1.0))) if fits.any() else int(np.argmax(product))
            if room[1] == 1 and size[i] < room[0]:  # the last segment must fill the room, if any can
                large = np.flatnonzero(open_ & (size >= room[0]) & (np.maximum(room[0] - self.prompt, 0) <= room[2]))
                i = int(large[np.argmax(product[large])]) if len(large) else i
            take = int(min(size[i], room[0], self.prompt[i] + room[2]))
            chosen.append((i, take))
            room -= (take, 1, max(0, take - int(self.prompt[i])))
            open_[i] = False  # two pieces of one example never share a sequence
        used = tokens - int(room[0])
        if used < tokens:
            used = 1 << (used.bit_length() - 1)
        at = 0
        for i, take in chosen:
            take = min(take, used - at)
            if take:
                self.rows.append((int(self.name[i]), int(self.start[i]), take, self.sequence, at))
                at += take
                self.start[i] += take
                self.size[i] -= take
                self.prompt[i] = max(0, int(self.prompt[i]) - take)
        self.sequence += 1
        self._drop(self.size == 0)

    def finish(self) -> None:
        """Place what still waits; the last sequences have sizes that are powers of two."""
        while len(self.size):
            left = int(self.size.sum())
            self._one(int(self.limits[0]) if left >= self.limits[0] else 1 << (left.bit_length() - 1))

    def taken(self) -> list[tuple[int, int, int, int, int]]:
        rows, self.rows = self.rows, []
        return rows


def pack_examples(examples: DataFrame, tokens: int = 2048, segments: int = 64, loss: int = 2048) -> DataFrame:
    """Place examples (example_id, n_tokens, n_loss) in sequences: example_id, start, length, sequence_id, offset.

    Null or negative counts are 0 and examples without tokens have no piece; an example's last n_loss tokens bear
    its loss. Sequence ids hold the task in their upper bits.
    """
    ship(examples.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(tokens, segments, loss), TaskContext.get().partitionId() << 40
        names: list[int | None] = []

        def out() -> pa.RecordBatch:
            c = list(zip(*packer.taken(), strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i in c[0]], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array([base + x for x in c[3]], pa.int64()), pa.array(c[4], pa.int64())], ["example_id", "start", "length", "sequence_id", "offset"])

        for batch in batches:
            for a in range(0, batch.num_rows, WAITING):
                part = batch.slice(a, WAITING)
                size, bears = part.column(1).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False)
                packer.add(np.arange(len(size)) + len(names), size, np.maximum(size - bears, 0))
                names += part.column(0).to_pylist()
                packer.fill(KEPT)
            yield out()
        packer.finish()
        yield out()

    count = lambda c: F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0)).alias(c)
    return examples.select(F.col("example_id").cast("long"), count("n_tokens"), count("n_loss")).mapInArrow(run, "example_id long, start long, length long, sequence_id long, offset long")


def prompts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes of each row's prompt: its first line with a word, if a later one has words too. The heading of a text
    asks, what follows answers; a single line is all response."""
    out = np.zeros(len(offsets) - 1, np.int64)
    ends = np.flatnonzero(data == 10)
    inside = np.flatnonzero((data != 32) & ((data < 9) | (data > 13)))
    word = np.append(inside, len(data))[np.searchsorted(inside, offsets[:-1])]
    line = np.append(ends, len(data))[np.searchsorted(ends, word)]
    later = np.append(inside, len(data))[np.searchsorted(inside, line)]
    some = later < offsets[1:]
    out[some] = line[some] + 1 - offsets[:-1][some]
    return out


def _ids_within(encode, data: np.ndarray, offsets: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The number of ids that each row's first `head` bytes have by themselves."""
    some = np.flatnonzero(head)
    out = np.zeros(len(head), np.int64)
    if len(some):
        size = head[some]
        first = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(offsets[some] - first[:-1], size) + np.arange(int(first[-1]))
        out[some] = np.diff(encode(data[take], first)[1])
    return out


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, tokens: int = 2048, segments: int = 64, loss: int = 1984, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text, append end_id and pack all ids: one row a piece, the columns of op6's contract, and
    loss, how many of the piece's ids bear it.

    A document's first ids bear no loss: as many as its prompt has by itself. with_ids adds the piece's ids.
    """
    ship(docs.sparkSession)
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, base = encoder(vocabulary), Packer(tokens, segments, loss), TaskContext.get().partitionId() << 40
        held: dict[int, tuple[int | None, bytes, int]] = {}
        n = 0

        def out() -> pa.RecordBatch:
            rows = packer.taken()
            cut = [held[i][1][4 * s : 4 * (s + k)] for i, s, k, _, _ in rows]
            cols = [[held[i][0] for i, *_ in rows], [r[1] for r in rows], [r[2] for r in rows], [zlib.crc32(x) for x in cut], [len(held[i][1]) // 4 for i, *_ in rows], [base + r[3] for r in rows], [r[4] for r in rows], [max(0, r[1] + r[2] - max(r[1], held[r[0]][2])) for r in rows]]
            for i in held.keys() - set(packer.name.tolist()):
                del held[i]
            arrays = [pa.array(c, pa.int64()) for c in cols]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in cut], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(arrays, [*fields, "ids"][: len(arrays)])

        for batch in steps(batches):
            data, rows = utf8(batch.column(1))
            flat, offsets = encode(data, rows)
            head = _ids_within(encode, data, rows, prompts(data, rows))
            size = np.diff(offsets)
            begun = np.minimum(size, head)
            blob = np.insert(flat, offsets[1:], end_id).astype("<u4").tobytes()
            at = 4 * (offsets + np.arange(batch.num_rows + 1))
            ids = [blob[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            held.update(zip(range(n, n + len(ids)), zip(batch.column(0).to_pylist(), ids, begun.tolist(), strict=True), strict=True))
            for a in range(0, len(ids), WAITING):
                packer.add(np.arange(n + a, n + min(len(ids), a + WAITING)), size[a : a + WAITING] + 1, begun[a : a + WAITING])
                packer.fill(KEPT)
            n += len(ids)
            yield out()
        packer.finish()
        yield out()

    schema = ", ".join(f"{x} long" for x in fields) + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
