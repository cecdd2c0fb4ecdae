"""N-gram Jaccard join by PartEnum signatures, and the components of its links.

Texts with equal shingle sets are one node. The sets are put in bands of similar size. For each band the domain of
shingle hashes is cut into first-level partitions, at least half as many as the elements in which linked sets of the
band may differ, and each of these into SECOND second-level ones: linked sets differ in one element at most in some
first-level partition, so leaving out one of its second-level partitions makes them agree. The signatures of a set are
the hashes of its elements in every such subset. Signatures meet in buckets; the nodes under one signature are a run.

A node of a link shares many signatures with its partner: all that the elements in which the two may differ can't
spoil. Nodes that share fewer with anything have no link and leave. Within the runs of the others,
sketches (a bit for each element's hash) rule out pairs that differ in more bits than linked sets can
differ in elements. What they leave connects nodes to clusters, of which each run reports a spanning forest only.
Every link lies in a cluster. In large clusters whole texts are first compared with a few pivots; what these don't
settle, and all of the small clusters, is compared exactly in blocks, as products of block matrices; the links, again
as forests, make the components. No list of a group's pairs is ever written, and none is dropped.

Edge cases: null texts, empty ones and those of white space alone have an empty set and are their own component; with
fewer words than a shingle, all words are one shingle; equal texts are one node whatever their ids; repeated rows stay
rows; a component's id is its least doc_id that isn't null (null if all are); sets whose size ties a band's edge take
part in both bands; texts have no limit of length; an empty table gives no rows; other columns are ignored, and
keep_one() returns them whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.llm.common import lower, materialize, mix64, ship, span_hash, steps, utf8, words

#: Words of a shingle, and the threshold as parts of WHOLE.
LENGTH, PART, WHOLE = 5, 75, 100
#: Size bands: band c has sets of BAND**c to BAND**(c + 1) - 1 shingles.
BAND = 2
#: Second-level partitions of a first-level one; each subset of all but one is a signature.
SECOND = 3
#: Entries that a task gathers before it sends them to their buckets; nodes of a run, nodes and shingles of a cluster in
#: a block; elements a matrix product takes at a time; rows that may be broadcast or, of a graph's edges, collected.
FLUSH, RUN_BLOCK, NODE_BLOCK, SHINGLE_BLOCK, COLUMNS, SMALL = 1 << 20, 1024, 512, 300_000, 8192, 200_000
#: Nodes of a large cluster that are compared with all others of it before blocks are.
PIVOTS = 3
#: Sets that a task gathers at most before it sends their signatures: a set's place is sent as uint16.
PLACES = 1 << 16


def shingles(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, ascending, and the rows' offsets among them."""
    data = lower(data)
    start, end, row = words(data, offsets)
    rows = len(offsets) - 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    each = span_hash(data, start, end)
    n = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(n)])
    # A shingle begins at each word that has length - 1 more of its row behind it; a shorter row is one shingle.
    place = np.arange(len(each)) - first[row]
    size = np.minimum(length, n)[row]
    begin = np.flatnonzero(place + size <= n[row])
    total = size[begin].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    padded = np.append(each, np.zeros(length, np.uint64))
    for j in range(length):
        part = mix64(padded[begin + j] + np.uint64((j + 1) * 0xA0761D6478BD642F % (1 << 64)))
        part[j >= size[begin]] = 0
        total += part
    hashes, of = mix64(total), row[begin]
    cut = np.searchsorted(of, np.arange(rows + 1))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        hashes[a:b].sort()
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[keep], np.concatenate([[0], np.cumsum(np.bincount(of[keep], minlength=rows))])


def bands(size: np.ndarray) -> list[np.ndarray]:
    """The bands that a set of each size takes part in: its own, and the next one if a partner may be there."""
    own = np.floor(np.log2(np.maximum(size, 1)) / np.log2(BAND) + 1e-9).astype(np.int64)
    above = BAND ** (own + 1)
    return [own, np.where(size * WHOLE >= PART * above, own + 1, -1)]


def partitions(band: np.ndarray) -> np.ndarray:
    """First-level partitions of a band: one more than half the differences that two linked sets of it can have.

    Then two differences in each would be more than there are, so one partition has one at most. More partitions only
    make signatures of fewer elements.
    """
    most = BAND ** (band + 1) - 1
    return 2 * (WHOLE - PART) * most // (WHOLE + PART) // 2 + 1


def _filled(hashes: np.ndarray, offsets: np.ndarray, band: np.ndarray) -> tuple:
    """The first-level partitions that the sets of a band fill.

    Returns which sets take part, their numbers of first-level partitions, and for each filled one its row, its number,
    the sums of the mixed elements of its second-level partitions and which of those are filled.
    """
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    take = (band >= 0) & (size > 0)
    n = np.where(take, partitions(np.maximum(band, 0)), 1)
    pick = np.flatnonzero(take[row])
    h, r = hashes[pick], row[pick]
    p = ((h >> np.uint64(32)) * n[r].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    if not len(h):
        return take, n, r, p, [h] * SECOND, [np.zeros(0, bool)] * SECOND
    begin = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] != p[:-1])]))
    part = (h & np.uint64(0xFFFFFFFF)) * np.uint64(SECOND) >> np.uint64(32)
    mixed = mix64(h ^ np.uint64(0x5851F42D4C957F2D))
    sums = [np.add.reduceat(np.where(part == j, mixed, np.uint64(0)), begin) for j in range(SECOND)]
    full = [np.logical_or.reduceat(part == j, begin) for j in range(SECOND)]
    return take, n, r[begin], p[begin], sums, full


def _need(size: np.ndarray, rows: np.ndarray, full: list[np.ndarray]) -> np.ndarray:
    """The signatures that each set shares with any linked one, at least; none or less if that isn't certain.

    At most size * (1/t - 1) elements differ: the partner's size and the threshold bound them. In a first-level
    partition the first of them spoils all but one signature, at most, the second one that, and a partition with one
    filled second-level partition has just the signatures that the first one spoils.
    """
    n = len(size)
    filled = sum(x.astype(np.int64) for x in full)
    several = filled > 1
    total = np.bincount(rows, np.where(several, SECOND, SECOND - 1), minlength=n).astype(np.int64)
    one, two = np.bincount(rows, minlength=n), np.bincount(rows[several], minlength=n)
    differ = size * (WHOLE - PART) // PART
    return total - (SECOND - 1) * np.minimum(differ, one) - np.minimum(np.maximum(differ - one, 0), two)


def _tagged(sig: np.ndarray, band: np.ndarray | int) -> np.ndarray:
    """The signature with the band's parity as its lowest bit: it tells a set's two bands apart."""
    return sig & ~np.uint64(1) | (np.asarray(band) & 1).astype(np.uint64)


def shared_at_least(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each set, by the parity of the band: the signatures that it shares with any linked set, at least; 1 where
    empty subsets have signatures too."""
    size = np.diff(offsets)
    out = np.ones((len(size), 2), np.int64)
    for band in bands(size):
        take, _, rows, _, _, full = _filled(hashes, offsets, band)
        need = _need(size, rows, full)
        some = np.flatnonzero(take)
        out[some, band[some] & 1] = np.maximum(1, need)[some]
    return out


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of all sets, and each one's row.

    A set's elements are dealt to its band's first-level partitions by the upper half of their hashes, to second-level
    ones by the lower half; a signature is the hash of the elements in all second-level partitions but one. A subset
    without elements has a signature only for sets of which such may be the only ones that are alike.
    """
    size = np.diff(offsets)
    out, rows = [], []
    for band in bands(size):
        take, n, r, p, sums, full = _filled(hashes, offsets, band)
        if not len(r):
            continue
        salt = lambda code, b: mix64(code.astype(np.uint64) + b.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        few = np.flatnonzero(take & (_need(size, r, full) < 1))
        codes = SECOND * n[few]
        base = np.cumsum(codes) - codes
        empty = np.ones(int(codes.sum()), bool)
        of = np.full(len(size), -1)
        of[few] = base
        for j in range(SECOND):
            others = [k for k in range(SECOND) if k != j]
            some = np.flatnonzero(np.logical_or.reduce([full[k] for k in others]))
            code = SECOND * p[some] + j
            total = sum(sums[k][some] for k in others)
            out.append(_tagged(mix64(total + salt(code, band[r[some]])), band[r[some]]))
            rows.append(r[some])
            known = of[r[some]] >= 0
            empty[of[r[some]][known] + code[known]] = False
        at = np.flatnonzero(empty)
        owner = few[np.searchsorted(base, at, side="right") - 1] if len(few) else at
        out.append(_tagged(mix64(salt(at - of[owner], band[owner])), band[owner]))
        rows.append(owner)
    return (np.concatenate(out), np.concatenate(rows)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _set_hash(hashes: np.ndarray, offsets: np.ndarray, salt: int) -> np.ndarray:
    """An odd 64-bit hash of each set; empty sets get 0."""
    size = np.diff(offsets)
    full = np.flatnonzero(size)
    out = np.zeros(len(size), np.uint64)
    if len(full):
        total = np.add.reduceat(mix64(mix64(hashes + np.uint64(salt)) ^ np.uint64(salt >> 7)), offsets[full])
        out[full] = mix64(total + size[full].astype(np.uint64)) | np.uint64(1)
    return out


def checks(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A second, independent hash of each set."""
    return _set_hash(hashes, offsets, 0x9D39247E33776D41).view(np.int64)


def node_ids(hashes: np.ndarray, offsets: np.ndarray, clashing: frozenset[int] = frozenset()) -> np.ndarray:
    """A signed 64-bit id for each set, equal for equal sets; empty sets get 0.

    clashing: ids that different sets have; these sets are named by both hashes instead.
    """
    out = _set_hash(hashes, offsets, 0x8CB92BA72F3D8DD7)
    if clashing:
        some = np.flatnonzero(np.isin(out.view(np.int64), list(clashing)))
        out[some] = mix64(out[some] ^ mix64(checks(hashes, offsets).view(np.uint64)[some])) | np.uint64(1)
    return out.view(np.int64)


def _bits(size: int) -> int:
    """Bits of a sketch: at least one for each element of any set that it is compared with in one run.

    A set that takes part in the next band has the bits of that band's sets.
    """
    return max(64, 1 << (int(size) * WHOLE // PART).bit_length())


def sketches(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    mixed = mix64(hashes ^ np.uint64(0x1B873593CC9E2D51))
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        n = _bits(b - a)
        flags = np.zeros(n, bool)
        flags[(mixed[a:b] >> np.uint64(64 - n.bit_length() + 1)).astype(np.int64)] = True
        out.append(np.packbits(flags).tobytes())
    return out


def _folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch as one of `size` bytes: neighbouring bits become one."""
    x = np.frombuffer(sketch, np.uint8)
    while len(x) > size:
        bits = np.unpackbits(x)
        x = np.packbits(bits[0::2] | bits[1::2])
    return x


def differ_at_most(a: np.ndarray | int, b: np.ndarray | int):
    """Elements in which linked sets of these sizes can differ."""
    return (WHOLE - PART) * (a + b) // (WHOLE + PART)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets reach the threshold."""
    if min(len(a), len(b)) * WHOLE < PART * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    both = int(np.count_nonzero(a[np.minimum(at, len(a) - 1)] == b))
    return WHOLE * both >= PART * (len(a) + len(b) - both)


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def _describe(rows: DataFrame, length: int, clashing: frozenset[int]) -> DataFrame:
    """doc_id, n_shingles, node (null without words), its check, sketch, and need: signatures to share in even and odd
    bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            h, o = shingles(*utf8(batch.column(1)), length)
            n, node = np.diff(o), node_ids(h, o, clashing)
            need = shared_at_least(h, o)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(node, mask=n == 0), pa.array(checks(h, o)), pa.array(sketches(h, o), pa.binary()), pa.array(need[:, 0]), pa.array(need[:, 1])], ["doc_id", "n_shingles", "node", "check", "sketch", "need_0", "need_1"])

    return rows.mapInArrow(run, "doc_id long, n_shingles long, node long, check long, sketch binary, need_0 long, need_1 long")


def _nodes(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """The described rows, their nodes (node, rep, n, sketch, need_0, need_1) and the ids that two sets had.

    Of n sets about n * n / 2**65 pairs have one id: a handful in the largest corpora, named anew by a second hash.
    """
    clashing: frozenset[int] = frozenset()
    while True:
        info = materialize(_describe(rows, length, clashing), "sets")
        grouped = info.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("check").alias("c0"), F.max("check").alias("c1"), *(F.first(x).alias(y) for x, y in (("n_shingles", "n"), ("sketch", "sketch"), ("need_0", "need_0"), ("need_1", "need_1"))))
        nodes = materialize(grouped, "nodes")
        more = frozenset(x["node"] for x in nodes.where("c0 <> c1").select("node").toLocalIterator())
        if not more or more <= clashing:
            return info, nodes.drop("c0", "c1"), clashing
        clashing |= more


def _partition_keys(rows: DataFrame, parts: int) -> list[int]:
    """A number for each partition that hash partitioning sends there, so that buckets fill partitions evenly."""
    ids = rows.sparkSession.range(32 * parts).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("part")).agg(F.min("id").alias("id"))
    return [x["id"] for x in ids.orderBy("part").collect()]  # `parts` rows


def _runs(rows: DataFrame, length: int, clashing: frozenset[int]) -> DataFrame:
    """The nodes under one signature, ascending, for all signatures of two nodes at least, the parity of the band, and
    for how many signatures: equal runs are one."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = _partition_keys(rows, parts)
    buckets = len(keys)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: dict[int, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            sig, row = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            bucket = ((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            low, row, bucket = sig[order].astype(np.uint32), row[order], bucket[order]
            ids = np.fromiter(seen, np.int64, len(seen))
            which = np.flatnonzero(np.diff(bucket, prepend=-1))
            out: list[list] = [[], [], [], []]
            for a, b in zip(which.tolist(), np.append(which[1:], len(bucket)).tolist(), strict=True):
                used, at = np.unique(row[a:b], return_inverse=True)
                for column, value in zip(out, (keys[int(bucket[a])], low[a:b].tobytes(), at.astype(np.uint16).tobytes(), ids[used].tobytes()), strict=True):
                    column.append(value)
            held.clear()
            seen.clear()
            for a in range(0, len(out[0]), 64):
                yield pa.RecordBatch.from_arrays([pa.array(out[0][a : a + 64], pa.int64()), *(pa.array(x[a : a + 64], pa.binary()) for x in out[1:])], ["bucket", "low", "at", "ids"])

        for batch in (step.slice(a, PLACES) for step in steps(batches) for a in range(0, step.num_rows, PLACES)):
            if held and len(seen) + batch.num_rows > PLACES:
                yield from flush()
            h, o = shingles(*utf8(batch.column(1)), length)
            node, size = node_ids(h, o, clashing), np.diff(o)
            new = [i for i, x in enumerate(node.tolist()) if size[i] and x not in seen and seen.setdefault(x, len(seen)) >= 0]
            keep = np.zeros(len(node), bool)
            keep[new] = True
            inside = np.repeat(keep, size)
            sig, row = signatures(h[inside], np.concatenate([[0], np.cumsum(size[keep])]))
            place = np.array([seen[x] for x in node[keep].tolist()], np.int64)
            if len(sig):
                held.append((sig, place[row].astype(np.uint16)))
            if sum(len(x) for x, _ in held) > FLUSH:
                yield from flush()
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for bucket, low, at, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                got.setdefault(bucket, []).append((np.frombuffer(low, np.uint32), np.frombuffer(ids, np.int64)[np.frombuffer(at, np.uint16)]))
        for bucket in list(got):
            found = got.pop(bucket)
            sig, node = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
            order = np.argsort(sig, kind="stable")
            sig, node = sig[order], node[order]
            same = np.zeros(len(sig), bool)
            same[1:] = sig[1:] == sig[:-1]
            same[:-1] |= same[1:].copy()
            sig, node = sig[same], node[same]
            if not len(sig):
                continue
            order = np.lexsort((node, sig))
            sig, node = sig[order], node[order]
            first = np.ones(len(sig), bool)
            first[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
            sig, node = sig[first], node[first]
            begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            out: dict[bytes, list] = {}  # equal runs are one, with the number of their signatures
            for a, b in zip(begin.tolist(), np.append(begin[1:], len(sig)).tolist(), strict=True):
                if b - a > 1:
                    run = node[a:b]
                    out.setdefault(run.tobytes() + bytes([int(sig[a]) & 1]), [run, int(sig[a]) & 1, 0])[2] += 1
            rows = list(out.values())
            for a in range(0, len(rows), 4096):
                cut = rows[a : a + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in cut], pa.list_(pa.int64())), pa.array([x[1] for x in cut], pa.int32()), pa.array([x[2] for x in cut], pa.int64())], ["nodes", "parity", "times"])

    sent = rows.mapInArrow(send, "bucket long, low binary, at binary, ids binary")
    return sent.repartition(parts, "bucket").mapInArrow(meet, "nodes array<long>, parity int, times long").groupBy("nodes", "parity").agg(F.sum("times").alias("times"))


def _labels(label: np.ndarray, near) -> np.ndarray:
    """The labels of places that have one already, joined where near(x, ys) says which of the later places ys x is
    connected to. Pairs that are connected already aren't asked for."""
    label = np.unique(label, return_inverse=True)[1]
    for x in range(len(label) - 1):
        ys = x + 1 + np.flatnonzero(label[x + 1 :] != label[x])
        if len(ys):
            hit = ys[near(x, ys)]
            if len(hit):
                old = np.unique(np.append(label[hit], label[x]))
                label[np.isin(label, old)] = old[0]
    return label


def _forest(node: np.ndarray, before: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the groups of the labels before to those of the labels now: one from each group but the first."""
    _, first = np.unique(before, return_index=True)
    node, label = node[first], label[first]
    order = np.lexsort((node, label))
    node, label = node[order], label[order]
    begin = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
    root = np.repeat(node[begin], np.diff(np.append(begin, len(node))))
    rest = np.flatnonzero(root != node)
    return list(zip(root[rest].tolist(), node[rest].tolist(), strict=True))


def _by_group(rows: DataFrame, key: list[str], work) -> DataFrame:
    """Deal rows by key and call work(rows of one key, as tuples) -> edges for each; rows begin with the key's columns."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, *key).sortWithinPartitions(*key, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            found = work(held)
            held.clear()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held and held[0][: len(key)] != row[: len(key)]:
                    yield from out()
                held.append(row)
        if held:
            yield from out()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _labelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (node, ...) with label: the node's component by the edges, or the node itself."""
    own = components(edges).withColumnRenamed("component", "own")
    return rows.join(own, "node", "left").withColumn("label", F.coalesce("own", "node")).drop("own")


def _open(rows: DataFrame, group: str, size: int) -> DataFrame:
    """The rows of groups that have several labels, with the number of blocks of `size` rows that a group makes."""
    ends = (F.min("label").alias("l0"), F.max("label").alias("l1"), F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    several = materialize(rows.groupBy(group).agg(*ends).where("l0 <> l1").select(group, "blocks"), "several")
    few = several.count() <= SMALL  # 20 bytes a row
    return rows.drop("blocks").join(F.broadcast(several) if few else several, group)


def _close(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, n_a, sketch_a, n_b, sketch_b) that sizes and sketches don't keep apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, x, n_b, y = (c.to_pylist() for c in batch.columns)
            keep = []
            for i in range(len(a)):
                if min(n_a[i], n_b[i]) * WHOLE < PART * max(n_a[i], n_b[i]):
                    continue
                u, v = (z if len(z) == m else _folded(z, m).tobytes() for m in (min(len(x[i]), len(y[i])),) for z in (x[i], y[i]))
                if (int.from_bytes(u) ^ int.from_bytes(v)).bit_count() <= differ_at_most(n_a[i], n_b[i]):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([z[i] for i in keep], pa.int64()) for z in (a, b)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _near(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the nodes of a run that counts, sizes and sketches don't keep apart.

    Each run's least node is compared with the others first, once for all runs that it leads. Runs whose nodes are
    connected then are done. The rest are cut into blocks of nodes; each pair of blocks is compared in one place, and
    there only nodes that aren't connected.
    """
    c = F.col
    rows = runs.select(F.xxhash64("nodes", "parity").alias("run"), "parity", "times", F.explode("nodes").alias("node"))
    counts = rows.groupBy("node", "parity").agg(F.sum("times").alias("times"))
    enough = counts.join(nodes, "node").where(c("times") >= F.when(c("parity") == 0, c("need_0")).otherwise(c("need_1")))
    enough = materialize(enough.select("node", "parity", "n", "sketch"), "enough")
    rows = materialize(rows.join(enough.select("node", "parity"), ["node", "parity"], "left_semi").select("run", "node"), "members")
    known = enough.select("node", "n", "sketch").dropDuplicates(["node"])
    leader = rows.groupBy("run").agg(F.min("node").alias("a"))
    pairs = rows.join(leader, "run").where("a <> node").select("a", c("node").alias("b")).distinct()
    for x in "ab":
        pairs = pairs.join(known.select(c("node").alias(x), c("n").alias(f"n_{x}"), c("sketch").alias(f"sketch_{x}")), x)
    star = materialize(_close(pairs.select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b")), "star")
    rest = materialize(_open(_labelled(rows, star), "run", RUN_BLOCK), "rest")
    rest = rest.withColumn("mine", F.pmod(F.hash("node"), c("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), c("blocks") - 1)))
    rest = rest.join(known, "node").select("run", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "mine", "n", "sketch", "label")

    def compare(group: list[tuple]) -> list[tuple[int, int]]:
        if len(group) < 2:
            return []
        group = sorted(group, key=lambda x: x[5])
        least = min(len(x[6]) for x in group)
        bits = np.stack([_folded(x[6], least) for x in group]).view(np.uint64)
        node, block, n, before = (np.array([x[k] for x in group]) for k in (3, 4, 5, 7))
        end = np.searchsorted(n, n * WHOLE // PART, side="right")
        cross = group[0][1] != group[0][2]

        def near(x: int, ys: np.ndarray) -> np.ndarray:
            at = ys < end[x]
            if cross:
                at &= block[ys] != block[x]
            some = ys[at]
            at[at] = np.bitwise_count(bits[some] ^ bits[x]).sum(axis=1, dtype=np.int64) <= differ_at_most(n[some], n[x])
            return at

        return _forest(node, before, _labels(before, near))

    return star.unionByName(_by_group(rest, ["run", "i", "j"], compare))


def _linked_pairs(sets: list[np.ndarray]) -> np.ndarray:
    """Which of the sets are linked, exactly: a symmetric matrix."""
    size = np.array([len(x) for x in sets])
    value, of = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = np.bincount(of, minlength=len(value)) > 1
    number = np.cumsum(shared) - 1
    row, of = row[shared[of]], number[of[shared[of]]]
    order = np.argsort(of, kind="stable")
    row, of = row[order], of[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(shared.sum()), COLUMNS):
        x, y = np.searchsorted(of, [a, a + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[x:y], of[x:y] - a] = 1
        both += part @ part.T  # counts below 2**24 are exact
    both = both.astype(np.int64)
    link = WHOLE * both >= PART * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(link, False)
    return link


def _compared(asked: DataFrame, docs: DataFrame, length: int, clashing: frozenset[int]) -> DataFrame:
    """Edges that join the linked nodes of each group (component, i, j) of asked, by their whole texts' shingles.

    Two nodes are compared if one of them is `left` and their labels differ.
    """
    asked = materialize(asked.select("component", "i", "j", "node", "left", "label", "rep"), "asked")
    small = asked.count() <= SMALL  # 56 bytes a row
    texts = docs.join(F.broadcast(asked) if small else asked, docs["doc_id"].eqNullSafe(asked["rep"]))
    texts = texts.select("component", "i", "j", "node", "left", "label", "text")

    def compare(group: list[tuple]) -> list[tuple[int, int]]:
        sets: dict[int, np.ndarray] = {}
        left: dict[int, bool] = {}
        label: dict[int, int] = {}
        for a in range(0, len(group), 256):
            some = group[a : a + 256]
            h, o = shingles(*utf8(pa.array([x[6] for x in some], pa.large_string())), length)
            for i, found in enumerate(node_ids(h, o, clashing).tolist()):
                if found == some[i][3]:  # else another text under the same id
                    sets[found], label[found] = h[o[i] : o[i + 1]], some[i][5]
                    left[found] = left.get(found, False) or some[i][4]
        if len(sets) < 2:
            return []
        node = np.array(sorted(sets))
        of = [sets[x] for x in node.tolist()]
        mine, before = np.array([left[x] for x in node.tolist()]), np.array([label[x] for x in node.tolist()])
        if len(node) >= 6 and mine.sum() > 1:
            link = _linked_pairs(of)
            near = lambda x, ys: link[x, ys] & (mine[x] | mine[ys])
        else:
            near = lambda x, ys: np.array([bool(mine[x] or mine[y]) and linked(of[x], of[y]) for y in ys.tolist()])
        return _forest(node, before, _labels(before, near))

    return materialize(_by_group(texts, ["component", "i", "j"], compare), "links")


def _links(clusters: DataFrame, nodes: DataFrame, docs: DataFrame, length: int, clashing: frozenset[int]) -> DataFrame:
    """Edges (a, b) that connect the linked nodes of each cluster (node, component), by their whole texts' shingles.

    The nodes of a small cluster meet in one place. A large one is dealt to as many blocks as its number of nodes and
    their size ask for. Its PIVOTS come first: one node goes to every block and is compared with all, so that a group
    of near copies is connected by texts that are sent once. If nodes are left that aren't connected with the
    cluster's largest part, these, in blocks of their own, are compared with all others.

    What is known of a large cluster is broadcast, so that its nodes aren't dealt by cluster: at most a row for each
    NODE_BLOCK nodes or SHINGLE_BLOCK shingles.
    """
    c = F.col
    blocks = lambda: F.greatest(F.ceil(F.count("*") / NODE_BLOCK), F.ceil(F.sum("n") / SHINGLE_BLOCK)).cast("int")
    place = lambda of: F.pmod(F.xxhash64("node"), of).cast("int")
    zero = F.lit(0)
    rows = clusters.join(nodes.select("node", "rep", "n"), "node").withColumn("label", c("node"))
    rows = materialize(rows.join(rows.groupBy("component").agg(blocks().alias("blocks")), "component"), "clusters")
    small = rows.where("blocks = 1").select("component", zero.alias("i"), zero.alias("j"), "node", F.lit(True).alias("left"), "label", "rep")
    edges = _compared(small, docs, length, clashing)
    large = rows.where("blocks > 1")
    for k in range(PIVOTS):
        if large.isEmpty():
            return edges
        ends = (F.min if k == 0 else F.max)(F.struct("label", "node", "rep"))
        pivot = large.groupBy("component").agg(ends.alias("p"), F.max("blocks").alias("blocks"))
        pivot = pivot.select("component", zero.alias("i"), F.explode(F.sequence(zero, c("blocks") - 1)).alias("j"), c("p.node").alias("node"), F.lit(True).alias("left"), c("p.label").alias("label"), c("p.rep").alias("rep"))
        others = large.join(F.broadcast(pivot.where("j = 0").select("component", c("label").alias("own"))), "component").where("label <> own")
        others = others.select("component", zero.alias("i"), place(c("blocks")).alias("j"), "node", F.lit(False).alias("left"), "label", "rep")
        edges = edges.unionByName(_compared(pivot.unionByName(others), docs, length, clashing))
        large = materialize(_open(_labelled(large.drop("label"), edges), "component", NODE_BLOCK), "large")
    parts = large.groupBy("component", "label").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    main = parts.groupBy("component").agg(F.max(F.struct("size", "label"))["label"].alias("main"))
    large = large.join(F.broadcast(main), "component").withColumn("left", c("label") != c("main"))
    rest = large.where("left").groupBy("component").agg(blocks().alias("rest"))
    large = large.join(F.broadcast(rest), "component")
    left = large.where("left").select("component", place(c("rest")).alias("i"), F.explode(F.sequence(zero, c("blocks") - 1)).alias("j"), "node", "left", "label", "rep")
    right = large.select("component", F.explode(F.sequence(zero, c("rest") - 1)).alias("i"), place(c("blocks")).alias("j"), "node", F.lit(False).alias("left"), "label", "rep")
    return edges.unionByName(_compared(left.unionByName(right), docs, length, clashing))


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), ascending, and each one's component: its least node.

    Labels that an edge joins are linked to the least of them, and chains of labels cut short; in two rounds every label
    that is left has taken in another, so the rounds are as many as the logarithm of the nodes asks for.
    """
    node, of = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = of[: len(a)], of[len(a) :]
    label = np.arange(len(node))
    while len(apart := np.flatnonzero(label[a] != label[b])):
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (label[label] != label).any():
            label = label[label]
    return node, node[label]


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of each node of an undirected graph's edges (a, b).

    At most SMALL edges are joined in the driver: rounds of shuffles cost more than the work. For more, large-star and
    small-star steps take turns: each node's larger neighbours, then its smaller ones, are linked to the least of them,
    until every edge points to its component's least node.
    """
    if links.count() <= SMALL:  # 16 bytes a row
        few = links.where("a <> b").select("a", "b").toArrow()
        found = pa.table(_joined(*(x.to_numpy() for x in few.columns)), ["node", "component"])
        return materialize(links.sparkSession.createDataFrame(found), "components")
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = None
    while True:
        # Written, so that a node of very many edges is a skewed join's key, which the engine deals to several tasks.
        least = materialize(edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), "least")
        edges = edges.join(least, F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u")
        edges = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialize(edges, "edges")
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if now == state:
            break
        state = now
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return materialize(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")


def join(docs: DataFrame, text: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame, DataFrame, frozenset[int]]:
    """Rows (doc_id, n_shingles, node), components (node, component), nodes (node, rep, n), and the ids named anew.

    Equal sets have one node; every node that has a link to another is in components.
    """
    ship(docs.sparkSession)
    rows = _texts(docs, text)
    info, nodes, clashing = _nodes(rows, length)
    runs = materialize(_runs(rows, length, clashing), "runs")
    clusters = components(materialize(_near(runs, nodes), "near"))
    labels = components(_links(clusters, nodes, rows, length, clashing))
    return info.select("doc_id", "n_shingles", "node"), labels, nodes, clashing


def jaccard_components(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """The columns of op4's contract: doc_id, n_shingles, component_id."""
    info, labels, nodes, _ = join(docs, text, length)
    labels = nodes.join(labels, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    least = labels.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = labels.join(least, "component").select("node", "component_id")
    return info.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """The rows of docs, with all their columns, without those that a linked row with a smaller doc_id stands for.

    Of each component the row with the least doc_id stays (a null id counts as least), once if it is repeated; rows
    without words stay. Rows that share a doc_id but not a text are told apart by their shingles.
    """
    info, labels, _, clashing = join(docs, text, length)
    info = info.where("node IS NOT NULL").select("doc_id", "node")
    named = info.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = named.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("best"))
    out = named.join(best, "component").where(~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("node") == F.col("best.node"))))
    own = lambda name: next(x for x in (name + "_" * i for i in range(len(docs.columns) + 1)) if x not in docs.columns)
    node_, id_, gone_ = own("node"), own("gone_id"), own("gone_node")
    out = materialize(out.select(F.col("doc_id").alias(id_), F.col("node").alias(gone_)).distinct(), "gone")
    unique = info.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty()
    small = out.count() <= SMALL  # 24 bytes a row
    gone = F.broadcast(out) if small else out
    if unique:
        return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)), "left_anti")
    at, schema = docs.columns.index(text), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            column = pa.array([None if x is None else str(x) for x in batch.column(at).to_pylist()], pa.string())
            node = node_ids(*shingles(*utf8(column), length), clashing)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node, mask=node == 0)], [*batch.schema.names, node_])

    rows = docs.mapInArrow(run, type(schema)([*schema.fields]).add(node_, "long"))
    rows = rows.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(node_) == F.col(gone_)), "left_anti")
    full = rows.where(F.col(node_).isNotNull()).dropDuplicates(["doc_id", node_])
    return full.unionByName(rows.where(F.col(node_).isNull())).drop(node_)


def sql(length: int = LENGTH) -> str:
    """jaccard_components() in DuckDB SQL, over all pairs that share a shingle."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{low}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {length} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {length - 2}), lambda i: array_to_string(w[i : i + {length - 1}], ' ')) END) AS s FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    e AS MATERIALIZED (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE {WHOLE} * c >= {PART} * (p.n + q.n - c)),
    b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e), r AS (SELECT x AS id, x AS root FROM b UNION SELECT b.y, r.root FROM r JOIN b ON b.x = r.id),
    c AS (SELECT id, min(root) AS root FROM r GROUP BY id)
    SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.id = w.doc_id"""
