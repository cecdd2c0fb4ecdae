"""Fitting models on a bounded sample of labelled rows, in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebody.llm.common import remainder, ship

#: Bounds of a training sample: rows, bytes of a text that may be in it, and bytes of all its texts.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_TOTAL = 6000, 1 << 16, 1 << 25


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    return remainder(doc_id, mod) == rest


def sample(docs: DataFrame, labels: DataFrame, column: str, mod: int, rest: int, rows: int = SAMPLE_ROWS, longest: int = SAMPLE_BYTES, text: str = "text", total: int = SAMPLE_TOTAL) -> DataFrame:
    """At most `rows` labelled rows (doc_id, text, label) that aren't held out: those whose ids hash lowest, as far as
    their texts have no more than `total` bytes together.

    Rows with a null id, label or text, and texts of more than `longest` bytes, aren't learned from. An id with
    several labels counts as its largest.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out(F.col("doc_id"), mod, rest))
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col(column).cast("int")).alias("label"))
    known = known.orderBy(F.xxhash64(F.lit(column), "id"), "id").limit(rows)
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.octet_length("text") <= longest)
    # Broadcast: `rows` pairs of an id and a label at most.
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("text")]
    found = body.join(F.broadcast(known), F.col("doc_id") == F.col("id")).select("doc_id", "text", "label").orderBy(*order).limit(rows)
    # One window over `rows` rows at most.
    sums = F.sum(F.octet_length("text")).over(Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("sum", sums).where(F.col("sum") <= total).select("doc_id", "text", "label")


def fit(rows: DataFrame, train: Callable[[list[bytes], np.ndarray], Any]) -> Any:
    """train(texts, labels) in a single task over a bounded sample; its result comes to the driver."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for batch in batches for x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
        got.sort(key=lambda x: (x[0], x[1]))
        model = train([(x[1] or "").encode() for x in got], np.array([x[2] for x in got], np.float64))
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    made = rows.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made["model"]) if made else train([], np.zeros(0))
