"""Toxicity by multiple-instance learning: sentences are scored, noisy-or makes a document's probability of them.

A sentence's logit is a bias plus the weights of the words that it has, each once, and of their beginnings of four to six bytes; the
document is toxic unless every sentence is not: 1 - prod(1 - p). Only documents have labels; the gradient of their
likelihood through the noisy-or decides which sentences bear a label. Sentences end at . ! ? and line ends; words
are runs of ASCII letters and bytes of non-ASCII characters, lower-cased where ASCII.

Edge cases: null and empty texts have no sentence and score 0; without labels of both classes every score is 0;
equal texts have equal scores, whatever their ids, and repeated rows stay rows; of equally bad sentences the first is the
worst; texts have no limit of length; an empty table gives no rows; nothing but the text is an input of a score, and
extra columns of any name are ignored (keep_clean() keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.llm.common import lower, ship, span_hash, steps, utf8
from orebody.llm.learn import SAMPLE_ROWS, fit, held_out, sample

#: Weights (a power of two), beginnings of words in bytes, and training documents that a feature needs.
WEIGHTS, BEGINNINGS, LEAST = 1 << 20, (4, 5, 6), 3
UPDATES, BATCH, RATE, PENALTY = 1200, 128, 0.7, 1e-6
#: The logit of a sentence without known words. A score counts what its words add to that: such sentences add nothing.
BIAS = -10.0

_WORD = np.zeros(256, bool)
_WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and each one's sentence; sentences' first byte and row. Sentences without words have no features."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = lower(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = _WORD[data]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    first = edge[:-1].copy()
    first[1:] |= _END[data[:-1]] & ~_END[data[1:]]
    sentence = np.flatnonzero(first)
    row = np.searchsorted(offsets, sentence, side="right") - 1
    found, where = [span_hash(data, start, end)], [np.arange(len(start))]
    for k in BEGINNINGS:
        long_ = np.flatnonzero(end - start > k)
        found.append(span_hash(data, start[long_], start[long_] + k) + np.uint64(k))
        where.append(long_)
    words = np.concatenate(where)
    return (np.concatenate(found) & np.uint64(WEIGHTS - 1)).astype(np.int64), np.searchsorted(sentence, start, side="right")[words] - 1, sentence, row


def _logs(logit: np.ndarray) -> np.ndarray:
    """log(1 - sigmoid(logit))."""
    return -np.logaddexp(0, logit)


def _once(f: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of a sentence once."""
    both = np.unique(s.astype(np.int64) << 21 | f)
    return (both & ((1 << 21) - 1)).astype(np.int32), (both >> 21).astype(np.int32)


def train(texts: list[bytes], labels: np.ndarray) -> dict:
    if len(set(labels.tolist())) < 2:
        return {"bias": -np.inf, "at": np.zeros(0, np.int64), "weight": np.zeros(0, np.float32)}
    docs = []
    for a in range(0, len(texts), 64):
        part = texts[a : a + 64]
        f, s, _, row = features(np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in part])]))
        by_doc = np.argsort(row[s], kind="stable") if len(s) else s
        f, s = f[by_doc].astype(np.int32), s[by_doc]
        cut, first = np.searchsorted(row[s], np.arange(len(part) + 1)), np.searchsorted(row, np.arange(len(part) + 1))
        for i in range(len(part)):
            docs.append((f[cut[i] : cut[i + 1]], (s[cut[i] : cut[i + 1]] - first[i]).astype(np.int32), int(first[i + 1] - first[i])))
    seen = np.zeros(WEIGHTS, np.int32)
    for f, _, _ in docs:
        seen[np.unique(f)] += 1
    used = np.flatnonzero(seen >= LEAST)
    number = np.full(WEIGHTS, len(used), np.int32)
    number[used] = np.arange(len(used))
    docs = [(*_once(number[f][keep], s[keep]), n) for f, s, n in docs for keep in (number[f] < len(used),)]
    weight, squares = np.zeros(len(used)), np.full(len(used), 1e-3)
    rng = np.random.default_rng(5)
    for epoch in range(max(12, -(-UPDATES * BATCH // len(docs)))):
        order = rng.permutation(len(docs))
        for a in range(0, len(docs), BATCH):
            part = [docs[i] for i in order[a : a + BATCH]]
            y = labels[order[a : a + BATCH]]
            counts = np.array([n for _, _, n in part])
            base = np.cumsum(counts) - counts
            f = np.concatenate([x for x, _, _ in part])
            s = np.concatenate([x + b for (_, x, _), b in zip(part, base, strict=True)])
            owner = np.repeat(np.arange(len(part)), counts)
            logit = BIAS + np.bincount(s, weight[f], minlength=int(counts.sum()))
            p = np.exp(-np.logaddexp(0, -logit))
            none = np.exp(np.bincount(owner, _logs(logit), minlength=len(part)))  # no sentence is toxic
            slope = np.where(y[owner] == 1, -p * none[owner] / np.maximum(1 - none[owner], 1e-9), p)
            g = np.bincount(f, slope[s], minlength=len(used)) / len(part) + PENALTY * weight
            squares += g * g
            weight -= RATE * g / np.sqrt(squares)
            weight = np.maximum(weight, 0)  # no word makes a sentence harmless
        if epoch >= 1:  # small weights carry noise
            weight = np.maximum(weight - 0.01, 0)
    kept = np.flatnonzero(weight)
    return {"bias": BIAS, "at": used[kept], "weight": weight[kept].astype(np.float32)}


class Scorer:
    def __init__(self, model: dict):
        self.bias, self.weight = model["bias"], np.zeros(WEIGHTS, np.float32)
        self.weight[model["at"]] = model["weight"]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each row's probability; each sentence's row, first byte and probability."""
        f, s, sentence, row = features(data, offsets)
        known = self.weight[f] != 0
        f, s = _once(f[known], s[known])
        logs = _logs(self.bias + np.bincount(s, self.weight[f], minlength=len(sentence))) - _logs(self.bias)
        score = 1 - np.exp(np.bincount(row, logs, minlength=len(offsets) - 1)) if len(row) else np.zeros(len(offsets) - 1)
        return np.clip(score, 0, 1), row, sentence, -np.expm1(logs)


def fit_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> dict:
    return fit(sample(docs, labels, "toxic", 4, 2, rows, text=text), train)


def score(docs: DataFrame, model: dict, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """op5's columns, then n_sentences, n_offending and the bytes of the worst sentence (null where there is none)."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # its size is bounded by WEIGHTS
    names = ["doc_id", "held_out", "score", "n_sentences", "n_offending", "worst_start", "worst_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Scorer(sent.value)
        for batch in steps(batches, limit=1 << 18):
            data, offsets = utf8(batch.column(2))
            p, row, first, each = of(data, offsets)
            n = len(p)
            ends = np.append(first[1:], len(data)) if len(first) else first
            order = np.lexsort((-each, row))
            lead = order[np.searchsorted(row, np.flatnonzero(np.bincount(row, minlength=n)))] if len(row) else order
            start, end, none = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
            start[row[lead]], end[row[lead]], none[row[lead]] = first[lead] - offsets[row[lead]], ends[lead] - offsets[row[lead]], False
            offending = np.bincount(row, each >= threshold, minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array(np.bincount(row, minlength=n).astype(np.int64)), pa.array(offending), pa.array(start, mask=none), pa.array(end, mask=none)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double, n_sentences long, n_offending long, worst_start long, worst_end long")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *names[3:])


def offending(docs: DataFrame, model: dict, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Every sentence whose own probability reaches the threshold: doc_id, start and end (bytes), sentence, score."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Scorer(sent.value)
        for batch in steps(batches, limit=1 << 18):
            data, offsets = utf8(batch.column(1))
            _, row, first, each = of(data, offsets)
            blob, ids = data.tobytes(), batch.column(0).to_pylist()
            ends = np.append(first[1:], len(data)) if len(first) else first
            hit = np.flatnonzero(each >= threshold)
            a, b, r = first[hit], ends[hit], row[hit]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in r], pa.int64()), pa.array(a - offsets[r]), pa.array(b - offsets[r]), pa.array([blob[x:y].decode() for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.string()), pa.array(each[hit])], ["doc_id", "start", "end", "sentence", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, end long, sentence string, score double")


def keep_clean(docs: DataFrame, model: dict, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold; null and empty texts stay."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    read = docs.schema[text].dataType.simpleString() == "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Scorer(sent.value)
        for batch in batches:
            keep = []
            column = batch.column(at) if read else pa.array([None if x is None else str(x) for x in batch.column(at).to_pylist()], pa.string())
            for part in steps(iter([pa.RecordBatch.from_arrays([column], ["text"])]), limit=1 << 18):
                keep.append(of(*utf8(part.column(0)))[0] < threshold)
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
