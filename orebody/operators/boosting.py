"""Gradient-boosted regression trees with L1 and L2 terms on the leaves.

Squared error, trees grown level by level on histograms of binned features. Rows of equal bins have equal predictions, so a
model of all rows needs only what such rows add up to. Where each tree sees one feature, these are the counts of each two
features' bins and the sums of the labels: tables of a bounded size, made where the rows are. Otherwise they are the distinct
binned rows with their counts, which one task gets. A model is a few arrays, which every task gets to predict with.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orebody.plans.durable import durable

#: Bins of a feature; a tree whose features have no more cells than CELLS is grown on these and kept as their values.
BINS, CELLS = 64, 1 << 14
#: What a prediction begins with.
BASE = 0.5

Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # feature, last bin that goes left, first child, value


def edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """For each feature the values between its bins: a value goes to the number of edges below it."""
    found = []
    for column in x.T:
        value = np.unique(column)
        if len(value) > bins:
            value = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        else:
            value = value[:-1]
        found.append(value)
    return found


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, column, side="left").astype(np.int8) for column, c in zip(x.T, cuts, strict=True)], axis=1)


def _shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def grow(b: np.ndarray, g: np.ndarray, rows: np.ndarray, features: np.ndarray, depth: int, least: float, l1: float, l2: float, w: np.ndarray | None = None) -> Tree:
    """One tree for the gradients g of the binned rows: leaves of `least` rows or more, split while that gains.

    w: of how many rows each is the sum, one unless given.
    """
    w = np.ones(len(g)) if w is None else w
    feature, at, child, value = [-1], [0], [-1], [0.0]
    value[0] = float(-_shrunk(g[rows].sum(), l1) / (w[rows].sum() + l2))
    open_, node = np.array([0]), np.zeros(len(rows), np.int64)  # nodes of the level, and each row's place among them
    for _ in range(depth):
        n = len(open_)
        if not n or not len(rows):
            break
        total, size = np.bincount(node, g[rows], minlength=n), np.bincount(node, w[rows], minlength=n)
        best, which, where = np.zeros(n), np.full(n, -1), np.zeros(n, np.int64)
        whole = _shrunk(total, l1) ** 2 / (size + l2)
        for f in features.tolist():
            key = node * BINS + b[rows, f]
            left = np.cumsum(np.bincount(key, g[rows], minlength=n * BINS).reshape(n, BINS), axis=1)
            count = np.cumsum(np.bincount(key, w[rows], minlength=n * BINS).reshape(n, BINS), axis=1)
            right, rest = total[:, None] - left, size[:, None] - count
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = _shrunk(left, l1) ** 2 / (count + l2) + _shrunk(right, l1) ** 2 / (rest + l2) - whole[:, None]
            gain[(count < max(1, least)) | (rest < max(1, least))] = 0
            k = gain.argmax(axis=1)
            top = gain[np.arange(n), k]
            more = top > best + 1e-9
            best[more], which[more], where[more] = top[more], f, k[more]
        split = np.flatnonzero(which >= 0)
        if not len(split):
            break
        first = len(feature) + 2 * np.arange(len(split))
        for i, c in zip(split.tolist(), first.tolist(), strict=True):
            feature[open_[i]], at[open_[i]], child[open_[i]] = int(which[i]), int(where[i]), c
        place = np.full(n, -1)
        place[split] = 2 * np.arange(len(split))
        keep = place[node] >= 0
        rows, node = rows[keep], node[keep]
        node = place[node] + (b[rows, which[node]] > where[node])
        sums, size = np.bincount(node, g[rows], minlength=2 * len(split)), np.bincount(node, w[rows], minlength=2 * len(split))
        value += (-_shrunk(sums, l1) / (size + l2)).tolist()
        feature += [-1] * 2 * len(split)
        at += [0] * 2 * len(split)
        child += [-1] * 2 * len(split)
        open_ = first[:, None].repeat(2, 1).reshape(-1) + np.tile([0, 1], len(split))
        big = size[node] >= 2 * max(1, least)  # the others' nodes stay leaves
        used = np.flatnonzero(size >= 2 * max(1, least))
        number = np.full(len(size), -1)
        number[used] = np.arange(len(used))
        rows, node, open_ = rows[big], number[node[big]], open_[used]
    return np.array(feature, np.int16), np.array(at, np.int16), np.array(child, np.int32), np.array(value)


def leaves(b: np.ndarray, tree: Tree) -> np.ndarray:
    """The values of the leaves that binned rows reach."""
    feature, at, child, value = tree
    node = np.zeros(len(b), np.int64)
    while True:
        some = np.flatnonzero(feature[node] >= 0)
        if not len(some):
            return value[node]
        here = node[some]
        node[some] = child[here] + (b[some, feature[here]] > at[here])


def _seen(features: int, columns: float) -> int:
    """How many features a tree sees."""
    return max(1, int(columns * features))


def fit(x: np.ndarray, y: np.ndarray, **params) -> dict:
    """A model of y by the columns of x; parameters as in fit_cells. No rows give a model of BASE."""
    cuts = edges(x) if len(y) else []
    return fit_cells(binned(x, cuts) if cuts else np.zeros((0, 0), np.int8), y, np.ones(len(y), np.int64), cuts, **params)


def fit_cells(b: np.ndarray, y: np.ndarray, n: np.ndarray, cuts: list[np.ndarray], trees: int = 300, depth: int = 17, rate: float = 0.02, least: float = 1, l1: float = 0.0, l2: float = 1.0, columns: float = 1.0, share: float = 1.0, seed: int = 2020) -> dict:
    """A model of binned rows that stand for n rows each.

    Each tree sees `share` of the rows and `columns` of the features, one at least.
    """
    model: dict = {"cuts": cuts, "tables": {}, "trees": [], "rate": rate}
    if not len(y):
        return model
    rng, draws = np.random.default_rng(seed), np.random.default_rng([seed, 1])  # of features, of rows
    p, width = np.full(len(y), BASE), [len(c) + 1 for c in cuts]
    for _ in range(trees):
        w = draws.binomial(n, share) if share < 1 else n
        some = np.sort(rng.choice(len(cuts), _seen(len(cuts), columns), replace=False))
        shape = tuple(width[f] for f in some)
        cells, g = math.prod(shape), w * (p - y)
        if cells > CELLS:
            tree = grow(b, g, np.flatnonzero(w), some, depth, least, l1, l2, w)
            model["trees"].append(tree)
            p += rate * leaves(b, tree)
            continue
        key = np.ravel_multi_index(tuple(b[:, f] for f in some), shape)
        grid, size = np.zeros((cells, len(cuts)), np.int8), np.bincount(key, w, minlength=cells)
        grid[:, some] = np.stack(np.unravel_index(np.arange(cells), shape), axis=1)
        tree = grow(grid, np.bincount(key, g, minlength=cells), np.flatnonzero(size), some, depth, least, l1, l2, size)
        step = rate * leaves(grid, tree)
        model["tables"][tuple(some.tolist())] = model["tables"].get(tuple(some.tolist()), 0) + step.reshape(shape)
        p += step[key]
    return model


def fit_sums(n: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], trees: int = 300, depth: int = 17, rate: float = 0.02, least: float = 1, l1: float = 0.0, l2: float = 1.0, seed: int = 2020) -> dict:
    """The model of trees that see all rows and one feature each.

    n: for each two features the number of rows in each two of their bins; y: the sums of the labels by feature and bin.
    Predictions are sums of a value for each feature's bin, so their sums follow from n.
    """
    k = len(cuts)
    rng, out, size = np.random.default_rng(seed), np.zeros((k, BINS)), n[np.arange(k), np.arange(k)].diagonal(axis1=1, axis2=2)
    grid, p = np.arange(BINS, dtype=np.int8)[:, None].repeat(k, axis=1), BASE * size  # p: the sums of the predictions
    for _ in range(trees):
        some = rng.choice(k, 1, replace=False)
        f = int(some[0])
        tree = grow(grid, p[f] - y[f], np.flatnonzero(size[f]), some, depth, least, l1, l2, size[f])
        step = rate * leaves(grid, tree)
        out[f] += step
        p += n[:, f] @ step
    return {"cuts": cuts, "tables": {(f,): out[f, : len(c) + 1] for f, c in enumerate(cuts)}, "trees": [], "rate": rate}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), BASE)
    if model["cuts"]:
        b = binned(x, model["cuts"])
        for some, table in model["tables"].items():
            out += table[tuple(b[:, f] for f in some)]
        for tree in model["trees"]:
            out += model["rate"] * leaves(b, tree)
    return out


def _matrix(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    return np.stack([batch.column(batch.schema.get_field_index(f)).to_numpy(zero_copy_only=False).astype(np.float64) for f in features], axis=1)


def row_edges(numbers: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """The edges of all rows: values are counted and put in ranges, and those at the wanted ranks are found within these."""
    key, wanted = ["feature", "part"], []
    counts = numbers.unpivot([], features, "feature", "value").groupBy("feature", "value").agg(F.count("*").alias("n"))
    ranged = durable(counts.repartitionByRange("feature", "value").withColumn("part", F.spark_partition_id()), "values")
    parts = ranged.groupBy(*key).agg(F.sum("n").alias("n"), F.count("*").alias("values")).orderBy(*key).collect()
    few = {f: sum(r["values"] for r in parts if r["feature"] == f) <= bins for f in features}
    for f in features:
        own, before = [r for r in parts if r["feature"] == f], 0
        ranks = [(sum(r["n"] for r in own) - 1) * k // bins for k in range(1, bins)]
        for r in own:
            here = [rank - before for rank in ranks if before <= rank < before + r["n"]]
            if here or few[f]:
                wanted.append((f, r["part"], None if few[f] else here))
            before += r["n"]
    if not wanted:
        return []
    # Broadcast: `bins` rows a feature at most.
    near = ranged.join(F.broadcast(numbers.sparkSession.createDataFrame(wanted, "feature string, part int, ranks array<long>")), key)
    near = near.withColumn("upto", F.sum("n").over(Window.partitionBy(*key).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
    rows = near.where(F.col("ranks").isNull() | F.exists("ranks", lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))).select("feature", "value").collect()
    found = [np.unique(np.array([r["value"] for r in rows if r["feature"] == f], np.float64)) for f in features]
    return [x[:-1] if few[f] else x for f, x in zip(features, found, strict=True)]


def _sums(numbers: DataFrame, features: list[str], label: str, cuts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What fit_sums needs: each task adds its rows up, and the tasks' tables are added."""
    k = len(features)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, y = np.zeros((len(pairs), BINS * BINS), np.int64), np.zeros((len(pairs), BINS * BINS))
        for batch in batches:
            b, label_ = binned(_matrix(batch, features), cuts).astype(np.int64), _matrix(batch, [label])[:, 0]
            for t, (i, j) in enumerate(pairs):
                cell = b[:, i] * BINS + b[:, j]
                n[t] += np.bincount(cell, minlength=BINS * BINS)
                if i == j:
                    y[t] += np.bincount(cell, label_, minlength=BINS * BINS)
        t, cell = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(cell, pa.int32()), pa.array(n[t, cell]), pa.array(y[t, cell])], ["pair", "cell", "n", "y"])

    n, y = np.zeros((k, k, BINS, BINS)), np.zeros((k, BINS))
    made = numbers.mapInArrow(run, "pair int, cell int, n long, y double")
    for r in made.groupBy("pair", "cell").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).collect():  # 4096 rows a pair of features at most
        (i, j), (u, v) = pairs[r["pair"]], divmod(r["cell"], BINS)
        n[i, j, u, v] = n[j, i, v, u] = r["n"]
        if i == j:
            y[i, u] = r["y"]
    return n, y


def fit_rows(rows: DataFrame, features: list[str], label: str, **params) -> dict:
    """The model of label by features, of all rows; null features and labels count as 0.

    Models whose trees see one feature and all rows are made of sums, any others in one task that gets the distinct binned rows.
    """
    names = [*features, label]
    numbers = rows.select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names))
    cuts = row_edges(numbers, features)
    if not cuts:
        return fit(np.zeros((0, len(features))), np.zeros(0), **params)
    if _seen(len(features), params.get("columns", 1.0)) == 1 and params.get("share", 1.0) >= 1:
        return fit_sums(*_sums(numbers, features, label, cuts), cuts, **{k: v for k, v in params.items() if k not in ("columns", "share")})
    bins = [f"b{i}" for i in range(len(features))]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = binned(_matrix(batch, features), cuts)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x)) for x in b.T), pa.array(_matrix(batch, [label])[:, 0])], [*bins, "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.stack([batch.column(i).to_numpy() for i in range(len(bins))], axis=1), batch.column(len(bins)).to_numpy(), batch.column(len(bins) + 1).to_numpy()) for batch in batches if batch.num_rows]
        b, y, n = (np.concatenate(x) for x in zip(*held, strict=True))
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit_cells(b, y, n, cuts, **params))], pa.binary())})

    cells = numbers.mapInArrow(put, ", ".join(f"{c} tinyint" for c in bins) + ", label double").groupBy(*bins, "label").agg(F.count("*").alias("n"))
    return pickle.loads(cells.repartition(1).sortWithinPartitions(*bins, "label").mapInArrow(run, "model binary").first()["model"])


def predict_rows(model: dict, rows: DataFrame, features: list[str], keep: list[str], name: str = "prediction") -> DataFrame:
    """The columns in keep and the prediction, for each row where it stands."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # tables of CELLS values at most, and trees
    kept = [F.col(c) for c in keep]
    numbers = rows.select(*kept, *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"__{f}") for f in features))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + f", {name} double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = predict(sent.value, _matrix(batch, [f"__{f}" for f in features]))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(p)], [*keep, name])

    return numbers.mapInArrow(run, schema)
