"""Quality classifier: a byte-level convolutional network in numpy.

Layer one: FILTERS learned filters of 8 bytes at every second byte, rectified and averaged over a chunk. Chunks have
96 bytes and overlap by half, so that they cover the whole document. Beside the filters stands one fixed channel,
the chunk's self-similarity: the largest share of its bytes that equal the byte LAGS back. Layer two: UNITS learned
units over the channels, rectified and max-pooled over the document's chunks; a logistic unit combines them into one
probability. Trained by Adam on a bounded sample; a maximum passes its gradient to its own chunk alone.

Edge cases: null and empty texts are one chunk without bytes (their channels are 0); a text shorter than a chunk is
one chunk; without labels of both classes the score is the labels' mean (0.5 without labels); equal texts have equal
scores, whatever their ids, and repeated rows stay rows; of chunks that tie for a maximum the first has its gradient;
texts have no limit of length; an empty table gives no rows; nothing but the text is an input of a score, and extra
columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.llm.common import ship, steps, utf8
from orebody.llm.learn import SAMPLE_ROWS, fit, held_out, sample

WIDTH, STRIDE, HALF, FILTERS, UNITS = 8, 2, 48, 8, 8
LAGS = range(3, 22)
BATCH, UPDATES, RATE, DECAY = 64, 900, 0.01, 1e-4


def layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of HALF bytes: each document begins a row, is filled up with zeros and followed by a row of zeros.

    Returns the bytes, how many are the document's own in each row, and each document's first row (one more at the end).
    """
    size = np.diff(offsets)
    rows = np.maximum(1, -(-size // HALF)) + 1
    first = np.concatenate([[0], np.cumsum(rows)])
    out = np.zeros(int(first[-1]) * HALF, np.uint8)
    out[np.arange(len(data)) + np.repeat(first[:-1] * HALF - offsets[:-1], size)] = data
    own = np.clip(np.repeat(size + first[:-1] * HALF, rows) - np.arange(int(first[-1])) * HALF, 0, HALF)
    return out, own, first


def similarity(rows: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each row, for each lag: its bytes that equal the byte so far back."""
    mask = np.arange(HALF)[None, :] < own[:, None]
    out = np.zeros((len(own), len(LAGS)), np.float32)
    for j, lag in enumerate(LAGS):
        same = np.zeros(len(rows), bool)
        same[lag:] = rows[lag:] == rows[:-lag]
        out[:, j] = (same.reshape(-1, HALF) & mask).sum(axis=1, dtype=np.uint8)
    return out


def _chunks(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each chunk (two rows), and each document's first chunk."""
    count = np.maximum(1, -(-size // HALF) - 1)
    at = np.concatenate([[0], np.cumsum(count)])
    return np.arange(int(at[-1])) + np.repeat(first[:-1] - at[:-1], count), at


class Net:
    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params
        e = params["filters"]
        #: Layer one by pairs of bytes: a row for each pair, FILTERS wide.
        self.pairs = [(e[2 * j][:, None, :] + e[2 * j + 1][None, :, :]).reshape(65536, FILTERS).astype(np.float32) for j in range(WIDTH // 2)]

    def channels(self, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Sums of each row's rectified filter responses."""
        pair = rows[0::2].astype(np.int32) << 8 | rows[1::2]
        z = self.pairs[0][pair] + self.p["filter_bias"].astype(np.float32)
        for j in range(1, WIDTH // 2):
            z[:-j] += self.pairs[j][pair[j:]]
        np.maximum(z, 0, out=z)
        z = z.reshape(len(own), HALF // 2, FILTERS)
        short = np.flatnonzero(own < HALF)
        z[short] *= (2 * np.arange(HALF // 2)[None, :] < own[short][:, None])[:, :, None]
        return z.sum(axis=1)

    def inputs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each chunk's channels, and each document's first chunk."""
        rows, own, first = layout(data, offsets)
        chunk, at = _chunks(first, np.diff(offsets))
        n = np.maximum(1, own[chunk] + own[chunk + 1]).astype(np.float32)[:, None]
        f, s = self.channels(rows, own), similarity(rows, own)
        same = ((s[chunk] + s[chunk + 1]) / n).max(axis=1, keepdims=True)
        return np.concatenate([(f[chunk] + f[chunk + 1]) * STRIDE / n, same], axis=1), at

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        h, at = self.inputs(data, offsets)
        u = np.maximum(h @ self.p["units"] + self.p["unit_bias"], 0)
        pooled = np.maximum.reduceat(u, at[:-1], axis=0)
        return 1 / (1 + np.exp(-np.clip(pooled @ self.p["out"] + self.p["out_bias"], -40, 40)))


def train(texts: list[bytes], labels: np.ndarray) -> dict:
    if len(set(labels.tolist())) < 2:
        return {"score": float(labels.mean()) if len(labels) else 0.5}
    rng = np.random.default_rng(11)
    p = {
        "filters": rng.normal(0, 0.25, (WIDTH, 256, FILTERS)),
        "filter_bias": np.zeros(FILTERS),
        "units": rng.normal(0, 0.7, (FILTERS + 1, UNITS)),
        "unit_bias": np.full(UNITS, 0.1),
        "out": rng.normal(0, 0.7, UNITS),
        "out_bias": np.array(1.0),
    }
    p["units"][FILTERS, ::2] = 3.0
    p["unit_bias"][::2] = -1.5
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    weight = np.where(labels == 1, 1.0, min(4.0, max(1.0, (labels == 1).sum() / (labels == 0).sum() / 2)))
    for _ in range(max(3, -(-UPDATES * BATCH // len(texts)))):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            part = [texts[i] for i in pick]
            data, offsets = np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in part])])
            net = Net(p)
            h, at = net.inputs(data, offsets)
            rows, own, row = layout(data, offsets)
            chunk, _ = _chunks(row, np.diff(offsets))
            pre = h @ p["units"] + p["unit_bias"]
            best = np.stack([at[i] + np.argmax(pre[at[i] : at[i + 1]], axis=0) for i in range(len(part))])  # documents x units
            top = np.stack([pre[best[:, k], k] for k in range(UNITS)], axis=1)
            pooled = np.maximum(top, 0)
            score = 1 / (1 + np.exp(-np.clip(pooled @ p["out"] + p["out_bias"], -40, 40)))
            d = (score - labels[pick]) * weight[pick] / len(pick)
            du = d[:, None] * p["out"][None, :] * (top > 0)
            g = {"out": pooled.T @ d, "out_bias": d.sum(), "unit_bias": du.sum(axis=0)}
            g["units"] = np.stack([h[best[:, k]].T @ du[:, k] for k in range(UNITS)], axis=1)
            # To the bytes of the chunks that were the maximum: FILTERS gradients a chunk.
            where = best.reshape(-1)
            dh = (du[:, :, None] * p["units"].T[None, :, :FILTERS]).reshape(-1, FILTERS)
            where, back = np.unique(where, return_inverse=True)
            total = np.zeros((len(where), FILTERS))
            np.add.at(total, back, dh)
            n = np.maximum(1, own[chunk[where]] + own[chunk[where] + 1])
            begin = chunk[where][:, None] * HALF + STRIDE * np.arange(HALF)[None, :]  # places of the filter
            live = np.repeat(np.stack([own[chunk[where]], own[chunk[where] + 1]], axis=1), HALF // 2, axis=1) > STRIDE * (np.arange(HALF) % (HALF // 2))[None, :]
            padded = np.append(rows, np.zeros(WIDTH, np.uint8))
            codes = [padded[begin + j] for j in range(WIDTH)]
            z = p["filter_bias"] + sum(p["filters"][j][codes[j]] for j in range(WIDTH))
            dz = (z > 0) * live[:, :, None] * (total * (STRIDE / n)[:, None])[:, None, :]
            g["filter_bias"] = dz.sum(axis=(0, 1))
            flat = dz.reshape(-1, FILTERS)
            g["filters"] = np.stack([np.stack([np.bincount(c.reshape(-1), flat[:, f], minlength=256) for f in range(FILTERS)], axis=1) for c in codes])
            g["filters"] += DECAY * p["filters"]
            step += 1
            for k, x in g.items():
                first[k] = 0.9 * first[k] + 0.1 * x
                second[k] = 0.99 * second[k] + 0.01 * x * x
                p[k] = p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return p


def scorer(model: dict):
    """The function from a text buffer to scores."""
    if "score" in model:
        return lambda data, offsets: np.full(len(offsets) - 1, model["score"])
    return Net(model)


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> dict:
    return fit(sample(docs, labels, "quality", 5, 0, rows, text=text), train)


def score(docs: DataFrame, model: dict, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The columns of op1's contract."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # WIDTH * 256 * FILTERS numbers and a few more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(sent.value)
        for batch in steps(batches, limit=1 << 18):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(of(*utf8(batch.column(2))).astype(np.float64))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
