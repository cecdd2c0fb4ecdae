"""Baskets and frequent itemsets: levelwise, SON and FP-growth; supports are absolute."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebody.plans.durable import durable

#: Items of which every task may hold a list, and candidates that every task may count.
ITEMS, CANDIDATES = 100_000, 1_000_000


def baskets(pairs: DataFrame, key: str, item: str) -> DataFrame:
    """key and its sorted set of items."""
    return pairs.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_set(item)).alias("items"))


def larger_than(rows: DataFrame, threshold: int) -> DataFrame:
    """Baskets with more items than the threshold."""
    return rows.where(F.size("items") > threshold)


def listed(items: str | Column = "items") -> Column:
    return F.concat_ws(",", F.transform(F.col(items) if isinstance(items, str) else items, lambda x: x.cast("string")))


def frequent(pairs: DataFrame, key: str, item: str, support: Column | int, level: int) -> DataFrame:
    """itemset (sorted array) and support, for sets of `level` items in at least `support` baskets.

    Level by level: a basket's rows are its frequent sets of the level below, each extended by larger items of the
    basket that are frequent themselves and end a frequent set; sets are grown inside baskets and counted once.
    """
    rows = pairs.select(F.col(key).alias("key"), F.col(item).alias("item")).distinct()
    one = rows.groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") >= support)
    rows = rows.join(one.select("item"), "item")
    found = one.select(F.array("item").alias("itemset"), "support")
    held = rows.select("key", F.array("item").alias("itemset"))
    for _ in range(1, level):
        grown = held.join(rows, "key").where(F.col("item") > F.element_at("itemset", -1))
        grown = grown.select("key", "itemset", "item", F.concat("itemset", F.array("item")).alias("larger"))
        # The set without its last but one item must be frequent too: the other parent.
        size = F.size("larger")
        other = F.concat(F.slice("larger", F.lit(1), size - 2), F.array("item"))
        grown = grown.join(found.select(F.col("itemset").alias("other")), other == F.col("other"), "left_semi")
        found = grown.groupBy("larger").agg(F.count("*").alias("support")).where(F.col("support") >= support).select(F.col("larger").alias("itemset"), "support")
        held = grown.join(found.select(F.col("itemset").alias("larger")), "larger", "left_semi").select("key", F.col("larger").alias("itemset"))
    return found


def support_of(candidates: DataFrame, pairs: DataFrame, key: str, item: str) -> DataFrame:
    """candidates (itemset array) with the number of baskets that hold all of its items; 0 if none does."""
    names = candidates.select("itemset").distinct().withColumn("need", F.size("itemset"))
    rows = pairs.select(F.col(key).alias("key"), F.col(item).alias("item")).distinct()
    hits = names.withColumn("item", F.explode("itemset")).join(rows, "item").groupBy("itemset", "need", "key").agg(F.count("*").alias("have"))
    counts = hits.where("have = need").groupBy("itemset").agg(F.count("*").alias("support"))
    return names.select("itemset").join(counts, "itemset", "left").select("itemset", F.coalesce("support", F.lit(0)).alias("support"))


def candidates(found: DataFrame, mode: str = "pruned") -> DataFrame:
    """Candidate sets one item larger than the frequent sets in found.

    pruned: two sets that share all but their last items, if every subset is frequent; extend: a set and any larger
    item of the level; combos: all combinations of the level's items.
    """
    size = found.select(F.max(F.size("itemset")).alias("k"))
    if mode == "pruned":
        a, b = found.select(F.col("itemset").alias("a")), found.select(F.col("itemset").alias("b"))
        head = lambda c: F.slice(c, F.lit(1), F.size(c) - 1)
        both = a.join(b, (head(F.col("a")) == head(F.col("b"))) & (F.element_at("a", -1) < F.element_at("b", -1)))
        both = both.select(F.concat("a", F.slice("b", -1, 1)).alias("itemset"))
        parts = both.withColumn("out", F.explode("itemset")).withColumn("part", F.array_remove("itemset", F.col("out")))
        known = parts.join(found.select(F.col("itemset").alias("part")), "part", "left_semi")
        return known.groupBy("itemset").agg(F.count("*").alias("n")).where(F.col("n") == F.size("itemset")).select("itemset")
    names = found.select(F.explode("itemset").alias("item")).distinct()
    n = names.count()
    if n > ITEMS:
        raise ValueError(f"{n} items: candidates of this kind are made for {ITEMS} at most")
    every = F.broadcast(names.agg(F.array_sort(F.collect_list("item")).alias("every")))  # one row
    if mode == "extend":
        grown = found.crossJoin(every).select("itemset", F.explode(F.array_except("every", "itemset")).alias("item"))
        return grown.select(F.array_sort(F.concat("itemset", F.array("item"))).alias("itemset")).distinct()
    if mode != "combos":
        raise ValueError(f"unknown mode {mode}")
    out, k = names.select(F.array("item").alias("itemset")), size.first()["k"] or 0
    for _ in range(k):
        later = F.filter("every", lambda x: x > F.element_at("itemset", -1))
        out = out.crossJoin(every).select("itemset", F.explode(later).alias("item")).select(F.concat("itemset", F.array("item")).alias("itemset"))
    return out


def all_frequent(pairs: DataFrame, key: str, item: str, support: int) -> list[DataFrame]:
    """The frequent itemsets of each size, until one has none."""
    found: list[DataFrame] = []
    while True:
        level = durable(frequent(pairs, key, item, support, len(found) + 1), "level")
        if level.isEmpty():
            return found
        found.append(level)


def fp_growth(rows: DataFrame, support: int, total: int) -> DataFrame:
    """itemset and support by FP-growth; total: the number of baskets."""
    from pyspark.ml.fpm import FPGrowth

    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (support - 0.5) / max(1, total))).fit(rows)
    return model.freqItemsets.select(F.array_sort("items").alias("itemset"), F.col("freq").alias("support"))


def mine_local(found: list[list], support: int, longest: int | None = None) -> set[tuple]:
    """All itemsets in at least `support` of the baskets, by levels, in memory."""
    one = Counter(x for b in found for x in b)
    good = {x for x, n in one.items() if n >= support}
    out = {(x,) for x in good}
    held = [sorted(x for x in b if x in good) for b in found]
    own = [[(x,) for x in b] for b in held]  # each basket's frequent sets of the level
    k = 1
    while any(own) and (longest is None or k < longest):
        larger = [[(*s, x) for s in sets for x in b if x > s[-1]] for b, sets in zip(held, own, strict=True)]
        count = Counter(s for sets in larger for s in sets)
        level = {s for s, n in count.items() if n >= support}
        own = [[s for s in sets if s in level] for sets in larger]
        out |= level
        k += 1
    return out


def son(rows: DataFrame, support: int, total: int, kind: str = "bigint", longest: int | None = None) -> DataFrame:
    """itemset and support in two passes: each chunk of a partition is mined at its share of the support, and the
    union of what is frequent somewhere is counted over all baskets. longest: the largest sets that are mined;
    by default levels go on until one is empty."""
    chunk = 20_000

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of = None
        held: list[list] = []

        def out() -> pa.RecordBatch:
            found = sorted(mine_local(held, max(1, math.ceil(support * len(held) / max(1, total))), longest))
            return pa.RecordBatch.from_arrays([pa.array([list(x) for x in found], kind_of)], ["itemset"])

        for batch in batches:
            kind_of = batch.schema.field(0).type
            held += batch.column(0).to_pylist()
            while len(held) >= chunk:
                rest, held = held[chunk:], held[:chunk]
                yield out()
                held = rest
        if held:
            yield out()

    local = durable(rows.select("items").mapInArrow(mine, f"itemset array<{kind}>").distinct(), "candidates")
    if local.count() > CANDIDATES:
        counted = support_of(local, rows.select("key", F.explode("items").alias("item")), "key", "item")
    else:
        counted = counted_in(local, rows, kind)
    return counted.where(F.col("support") >= support)


def counted_in(candidates: DataFrame, rows: DataFrame, kind: str = "bigint") -> DataFrame:
    """candidates (itemset; CANDIDATES at most) and their support in one pass over the baskets: every task holds the
    candidates as a tree of items and sums what its baskets hold; only sums are shuffled."""
    tree: dict = {}
    for row in candidates.toLocalIterator():
        node = tree
        for x in sorted(row["itemset"]):
            node = node.setdefault(x, {})
        node[None] = True
    sent = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        kind_of = None

        def walk(node: dict, items: list, at: int, found: tuple) -> None:
            if None in node:
                count[found] += 1
            for i in range(at, len(items)):
                below = node.get(items[i])
                if below:
                    walk(below, items, i + 1, (*found, items[i]))

        for batch in batches:
            kind_of = batch.schema.field(0).type
            for basket in batch.column(0).to_pylist():
                walk(sent.value, sorted(basket), 0, ())
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([list(s) for s in count], kind_of), pa.array(list(count.values()), pa.int64())], ["itemset", "n"])

    return rows.select("items").mapInArrow(run, f"itemset array<{kind}>, n bigint").groupBy("itemset").agg(F.sum("n").alias("support"))


def report_lines(sets: DataFrame) -> DataFrame:
    """k and one line of its itemsets, each written ('a', 'b'), in the order of that text."""
    name = F.concat(F.lit("("), F.concat_ws(", ", F.transform("itemset", lambda x: F.concat(F.lit("'"), x.cast("string"), F.lit("'")))), F.lit(")"))
    rows = sets.select(F.size("itemset").alias("k"), name.alias("name"))
    return rows.groupBy("k").agg(F.concat_ws(",", F.array_sort(F.collect_list("name"))).alias("line"))


def report(pairs: DataFrame, key: str, item: str, support: int, mode: str = "pruned") -> DataFrame:
    """section ('Candidates' or 'Frequent Itemsets'), k and line: all levels. The candidates of level 1 are all items; a
    level without candidates, and one without frequent sets, has no line."""
    found = all_frequent(pairs, key, item, support)
    asked = pairs.select(F.array(F.col(item)).alias("itemset")).distinct()
    for level in found:
        asked = asked.unionByName(candidates(level, mode))
    sets = found[0].select("itemset") if found else asked.limit(0)
    for level in found[1:]:
        sets = sets.unionByName(level.select("itemset"))
    both = [report_lines(rows).withColumn("section", F.lit(name)) for name, rows in (("Candidates", asked), ("Frequent Itemsets", sets))]
    return both[0].unionByName(both[1]).select("section", "k", "line")
