"""Graphs as rows (src, dst) with src < dst once an edge: components, labels, betweenness, modularity."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.operators.similarity import co_occurrence
from orebody.plans.durable import durable

#: Betweenness sums are compared and kept at so many decimals, so that their order of summation doesn't matter.
DECIMALS = 9
#: Edges of a graph whose adjacency may be sent to every task; larger ones are refused, as exact betweenness visits
#: the whole graph from every root.
ADJACENCY = 2_000_000


def edges_of(pairs: DataFrame, user: str, item: str, threshold: int) -> DataFrame:
    """An edge for every two users that share at least `threshold` items."""
    return co_occurrence(pairs, user, item, threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"), "n")


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge in both directions."""
    rows = edges.select("src", "dst")
    return rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def vertices(edges: DataFrame) -> DataFrame:
    return symmetric(edges).select(F.col("src").alias("id")).distinct()


def degree(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id and component (its least id); nodes: further ids, which may have no edge.

    Large-star and small-star steps take turns until every edge points to its component's least id.
    """
    pairs = durable(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        pairs = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = pairs.groupBy("u").agg(F.min("v").alias("m"))
        kept = pairs.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = durable(kept.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == before:
            break
        before = now
    ids = vertices(edges) if nodes is None else vertices(edges).unionByName(nodes.select("id")).distinct()
    return ids.join(pairs.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """id and label after synchronous rounds: each vertex takes its neighbours' commonest label, the least of equals."""
    both = durable(symmetric(edges), "neighbours")
    labels = vertices(edges).withColumn("label", F.col("id"))
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("best"))
        labels = durable(best.select(F.col("src").alias("id"), F.col("best.label").alias("label")), "labels")
    return labels


def groups(labels: DataFrame, by: str = "label") -> DataFrame:
    """Sorted members and size of each group."""
    rows = labels.groupBy(by).agg(F.array_sort(F.collect_list("id")).alias("members"))
    return rows.select("members", F.size("members").alias("size"))


def bfs_depths(edges: DataFrame, root) -> DataFrame:
    """id and depth of every vertex reached from root, by frontiers."""
    both = durable(symmetric(edges), "neighbours")
    found = durable(vertices(edges).where(F.col("id") == root).withColumn("depth", F.lit(0)), "depth")
    frontier, depth = found, 0
    while True:
        depth += 1
        near = both.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = durable(near.join(found, "id", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def credits(neighbours: dict, root) -> dict[tuple, float]:
    """The credit that the shortest paths from root give to each edge."""
    order, paths, depth, parents = [root], {root: 1.0}, {root: 0}, defaultdict(list)
    for v in order:
        for w in neighbours[v]:
            if w not in depth:
                depth[w], paths[w] = depth[v] + 1, 0.0
                order.append(w)
            if depth[w] == depth[v] + 1:
                paths[w] += paths[v]
                parents[w].append(v)
    credit, out = dict.fromkeys(order, 1.0), {}
    for w in reversed(order):
        for v in parents[w]:
            share = credit[w] * paths[v] / paths[w]
            out[(min(v, w), max(v, w))] = share
            credit[v] += share
    return out


def edge_betweenness(edges: DataFrame) -> DataFrame:
    """a, b and the number of shortest paths over the edge: roots are dealt to tasks, which hold the adjacency."""
    spark = edges.sparkSession
    size = edges.count()
    if size > ADJACENCY:
        raise ValueError(f"{size} edges: exact betweenness is for graphs of up to {ADJACENCY} edges")
    around = defaultdict(list)
    for a, b in edges.select("src", "dst").toLocalIterator():
        around[a].append(b)
        around[b].append(a)
    sent = spark.sparkContext.broadcast({k: sorted(v) for k, v in around.items()})
    kind = edges.schema["src"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, float] = defaultdict(float)
        for frame in frames:
            for root in frame["id"].tolist():
                for edge, credit in credits(sent.value, root).items():
                    total[edge] += credit
        if total:
            yield pd.DataFrame([(a, b, c) for (a, b), c in total.items()], columns=["a", "b", "credit"])

    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), size))
    rows = vertices(edges).repartition(parts, "id").mapInPandas(run, f"a {kind}, b {kind}, credit double")
    return rows.groupBy("a", "b").agg(F.round(F.sum("credit") / 2, DECIMALS).alias("betweenness"))


def top_edges(scores: DataFrame) -> DataFrame:
    """All edges of the largest betweenness."""
    most = scores.agg(F.max("betweenness").alias("most"))
    return scores.join(F.broadcast(most), F.col("betweenness") == F.col("most")).drop("most")  # one row


def modularity(components: DataFrame, edges: DataFrame, remaining: DataFrame | None = None) -> DataFrame:
    """Modularity of the components (id, component) of a graph with these edges.

    remaining: the edges that count as present; then every one lies within a component. By default those of the
    graph whose ends share a component. Null without edges.
    """
    c = F.col
    m = edges.agg(F.count("*").alias("m"))
    if remaining is None:
        a = components.select(c("id").alias("src"), c("component").alias("x"))
        b = components.select(c("id").alias("dst"), c("component").alias("y"))
        remaining = edges.join(a, "src").join(b, "dst").where("x = y")
    inside = remaining.agg(F.count("*").alias("inside"))
    weight = components.join(degree(edges), "id", "left").groupBy("component").agg(F.sum(F.coalesce("degree", F.lit(0))).alias("d"))
    squares = weight.agg(F.sum(c("d") * c("d")).alias("squares"))
    one = m.withColumn("k", F.lit(1)).join(inside.withColumn("k", F.lit(1)), "k").join(squares.withColumn("k", F.lit(1)), "k")
    share = F.try_divide(c("inside"), c("m")) - F.try_divide(c("squares"), 4 * c("m") * c("m"))
    return one.select(F.round(share, 9).alias("modularity"))


def _split(nodes: list, around: dict) -> list[list]:
    """The connected parts of nodes."""
    left, out = set(nodes), []
    while left:
        part = [left.pop()]
        for v in part:
            for w in around[v]:
                if w in left:
                    left.discard(w)
                    part.append(w)
        out.append(part)
    return out


def _scored(part: list, around: dict) -> tuple[float, dict[tuple, float]]:
    """The largest edge betweenness in a connected part, and all of them."""
    total: dict[tuple, float] = defaultdict(float)
    for root in sorted(part):
        for edge, credit in credits(around, root).items():
            total[edge] += credit
    scores = {edge: round(x / 2, DECIMALS) for edge, x in total.items()}
    return max(scores.values(), default=0.0), scores


def dismantle(pairs: list[tuple]) -> Iterator[tuple[int, float | None, list[tuple], int, int]]:
    """Remove the edges of largest betweenness of one connected graph until none is left.

    For each step, 0 before the first: its number, the betweenness that was removed, the edges, how many of the graph's
    edges lie within its parts then, and the sum of the parts' squared degrees (degrees in the whole graph). Only the
    parts that lost an edge are looked at again.
    """
    around: dict = defaultdict(set)
    for a, b in pairs:
        around[a].add(b)
        around[b].add(a)
    degrees = {v: len(w) for v, w in around.items()}
    parts = [(*_scored(p, around), p) for p in _split(list(around), around)]
    squares = sum(sum(degrees[v] for v in p) ** 2 for _, _, p in parts)
    inside = len(pairs)
    name = {v: i for i, (_, _, p) in enumerate(parts) for v in p}
    yield 0, None, [], inside, squares
    step, fresh = 0, len(parts)
    while any(scores for _, scores, _ in parts):
        most = max(m for m, scores, _ in parts if scores)
        gone, kept = [], []
        for m, scores, part in parts:
            if not scores or m < most:
                kept.append((m, scores, part))
                continue
            cut = [e for e, x in scores.items() if x == most]
            gone += cut
            for a, b in cut:
                around[a].discard(b)
                around[b].discard(a)
            new = _split(part, around)
            squares += sum(sum(degrees[v] for v in p) ** 2 for p in new) - sum(degrees[v] for v in part) ** 2
            for p in new:
                kept.append((*_scored(p, around), p))
                name.update(dict.fromkeys(p, fresh))
                fresh += 1
        parts, step = kept, step + 1
        inside = sum(name[a] == name[b] for a, b in pairs)
        yield step, most, gone, inside, squares


def girvan_newman(edges: DataFrame, adjacency: str = "remaining") -> DataFrame:
    """id, component and modularity of the best partition met while edges of largest betweenness are removed, until
    none is left.

    The first of equally good partitions is kept. adjacency: whether edges count as present while they remain
    ('remaining') or throughout ('original'). Betweenness lies within components, so each component of the graph is
    dismantled by a task of its own; in the whole graph the component whose next removal is largest goes on, equal
    ones together, and modularity is a sum over them. Larger graphs than ADJACENCY are refused.
    """
    spark = edges.sparkSession
    start = durable(edges.select("src", "dst"), "graph")
    m = start.count()
    if m > ADJACENCY:
        raise ValueError(f"{m} edges: all removals are computed for graphs of up to {ADJACENCY} edges")
    ids = durable(vertices(start), "vertices")
    if not m:
        return connected_components(start, ids).withColumn("modularity", F.lit(None).cast("double"))
    parts = connected_components(start, ids)
    kind, kind_of = (x.dataType.simpleString() for x in (start.schema["src"], parts.schema["component"]))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(frame["src"].tolist(), frame["dst"].tolist(), strict=True))
        rows, left = [], len(pairs)
        for step, value, gone, inside, squares in dismantle([(min(p), max(p)) for p in pairs]):
            left -= len(gone)
            rows.append((frame["component"].iloc[0], step, value, None, None, left, inside, squares))
            rows += [(frame["component"].iloc[0], step, value, a, b, None, None, None) for a, b in gone]
        out = pd.DataFrame(rows, columns=["component", "step", "value", "src", "dst", "left", "inside", "squares"], dtype=object)
        return out

    named = start.join(parts.select(F.col("id").alias("src"), "component"), "src")
    schema = f"component {kind_of}, step int, value double, src {kind}, dst {kind}, left bigint, inside bigint, squares bigint"
    steps = durable(named.groupBy("component").applyInPandas(run, schema), "steps")
    # One row a step of a component: no more than there are edges.
    queues: dict = defaultdict(list)
    present = "left" if adjacency == "remaining" else "inside"
    for row in steps.where("src IS NULL").select("component", "step", "value", present, "squares").orderBy("component", "step").toLocalIterator():
        queues[row["component"]].append((row["value"], row[present], row["squares"]))
    at = dict.fromkeys(queues, 0)
    heap = [(-q[1][0], c) for c, q in queues.items() if len(q) > 1]
    heapq.heapify(heap)
    held, squares = sum(q[0][1] for q in queues.values()), sum(q[0][2] for q in queues.values())
    best, log, done = round(held / m - squares / (4 * m * m), DECIMALS), [], 0
    while heap:
        most, more = heap[0][0], []
        while heap and heap[0][0] == most:
            _, c = heapq.heappop(heap)
            q, at[c] = queues[c], at[c] + 1
            held, squares = held + q[at[c]][1] - q[at[c] - 1][1], squares + q[at[c]][2] - q[at[c] - 1][2]
            log.append(c)
            if at[c] + 1 < len(q):
                more.append((-q[at[c] + 1][0], c))
        for x in more:
            heapq.heappush(heap, x)
        now = round(held / m - squares / (4 * m * m), DECIMALS)
        if now > best and heap:
            best, done = now, len(log)
    taken = Counter(log[:done])
    upto = spark.createDataFrame([(c, taken.get(c, 0)) for c in queues], f"component {kind_of}, upto int")
    rest = steps.where("src IS NOT NULL").join(upto, "component").where("step > upto").select("src", "dst")
    return connected_components(rest, ids).withColumn("modularity", F.lit(best))
