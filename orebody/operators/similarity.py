"""Set similarity: MinHash signatures, banding, exact Jaccard joins. Sets are rows (id, elem)."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebody.plans.durable import durable

#: Fixed value: the prime modulus of the MinHash functions.
PRIME = 2_147_483_647
#: Buckets that elements are counted in; words of 64 bits in the marks of sets, and in those of large ones.
BUCKETS, WORDS, WIDE = 1 << 20, 16, 128
#: Marks, and elements of sets, that are sent to all tasks, at most.
MARKED, HELD = 750_000, 16_000_000


def coefficients(n: int, seed: int) -> list[tuple[int, int]]:
    rng = random.Random(seed)
    return [(rng.randrange(1, PRIME), rng.randrange(PRIME)) for _ in range(n)]


def element_sets(sets: DataFrame) -> DataFrame:
    """id, its sorted distinct elements and their number."""
    rows = sets.groupBy("id").agg(F.sort_array(F.collect_set("elem")).alias("elems"))
    return rows.withColumn("n", F.size("elems"))


def signatures(sets: DataFrame, functions: int = 100, seed: int = 13) -> DataFrame:
    """id and sig: the least (a * elem + b) mod PRIME over its integer elements, for each function.

    One aggregation with map-side minima: rows aren't multiplied by the functions.
    """
    x = F.pmod(F.col("elem").cast("bigint"), F.lit(PRIME))
    least = [F.min((x * a + b) % PRIME).alias(f"h{i}") for i, (a, b) in enumerate(coefficients(functions, seed))]
    return sets.groupBy("id").agg(*least).select("id", F.array(*(f"h{i}" for i in range(functions))).alias("sig"))


def bands(sigs: DataFrame, rows: int = 5) -> DataFrame:
    """id, band and key of each band of `rows` signature values."""
    number = F.sequence(F.lit(0), (F.floor(F.size("sig") / rows) - 1).cast("int"))
    cut = F.transform(number, lambda i: F.struct(i.alias("band"), F.slice("sig", i * rows + 1, F.lit(rows)).alias("values")))
    return sigs.select("id", F.inline(cut)).select("id", "band", F.concat_ws(",", F.transform("values", lambda v: v.cast("string"))).alias("key"))


def candidate_pairs(sigs: DataFrame, rows: int = 5) -> DataFrame:
    """Pairs a < b with an equal band, once each."""
    keys = bands(sigs, rows)
    a, b = keys.withColumnRenamed("id", "a"), keys.withColumnRenamed("id", "b")
    return a.join(b, ["band", "key"]).where("a < b").select("a", "b").distinct()


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose exact Jaccard similarity reaches the threshold; elements are compared by their 64-bit hashes."""
    known = element_sets(sets.select("id", F.xxhash64("elem").alias("elem")))
    a, b = (known.select(F.col("id").alias(x), F.col("elems").alias(f"e_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").withColumn("both", F.size(F.array_intersect("e_a", "e_b")))
    both = both.withColumn("similarity", F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both")))
    return both.where(F.col("similarity") >= threshold).select("a", "b", F.round("similarity", 6).alias("similarity"))


def jaccard_join(sets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """All pairs a < b with Jaccard similarity of at least the threshold, exactly; elements are compared by their 64-bit hashes."""
    return jaccard_hashed(durable(sets.groupBy("id").agg(F.collect_set(F.xxhash64("elem")).alias("elems")), "sets"), threshold)


def jaccard_hashed(sets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The same for rows (id, elems): each id once, with the distinct 64-bit hashes of its elements. sets is read several times.

    Elements are ordered from rare to common. Sets that similar share one among their first n - ceil(t n) + 1, so only
    these are joined on; sizes must allow the similarity, and so must what lies behind the first common element in
    both sets: at most that many elements more can be shared. If the elements before are equal too, the pair is found
    there; 32 bits of a key are enough, as the same bits are joined on. Where a pair is found its sets' marks are compared:
    they differ in no more bits than the sets in elements. Only pairs that this leaves are dealt and compared exactly.
    """
    rows = durable(_from_rare(sets.where("id IS NOT NULL").withColumn("n", F.size("elems")).where("n > 0")), "keys")
    place = F.posexplode(F.slice("keys", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int")))
    prefix = rows.select("id", "n", "keys", place.alias("place", "elem")).withColumn("before", F.hash(F.get("keys", F.col("place") - 1)))
    prefix = prefix.select("id", F.hash("elem").alias("elem"), "n", F.shiftleft(F.col("before").cast("bigint"), 32).bitwiseOR(F.col("place").cast("bigint")).alias("at"))
    a, b = (prefix.select(F.col("id").alias(x), "elem", F.col("n").alias(f"n_{x}"), F.col("at").alias(f"at_{x}")) for x in "ab")
    p_a, p_b = (F.col(f"at_{x}").bitwiseAND(F.lit(0xFFFFFFFF)) for x in "ab")
    first = (p_a == 0) | (p_b == 0) | (F.shiftright("at_a", 32) != F.shiftright("at_b", 32))
    both = F.col("n_a") + F.col("n_b")
    need = F.ceil(both * (threshold / (1 + threshold)) - 1e-9)
    fits = (F.col("n_a") >= F.col("n_b") * threshold) & (F.col("n_b") >= F.col("n_a") * threshold)
    behind = F.least(F.col("n_a") - p_a, F.col("n_b") - p_b) >= need
    found = a.join(b, "elem").where((F.col("a") < F.col("b")) & first & fits & behind)
    if rows.count() <= MARKED:
        found = _alike(found, rows, F.floor(both * ((1 - threshold) / (1 + threshold)) + 1e-9))
    pairs = durable(found.select("a", "b").distinct(), "pairs")
    named = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    named = durable(named, "named")
    near = durable(rows.join(F.broadcast(named) if named.count() <= MARKED else named, "id", "left_semi"), "near")
    known = F.broadcast(near) if (near.agg(F.sum("n")).first()[0] or 0) <= HELD else near
    x, y = (known.select(F.col("id").alias(k), F.col("keys").alias(f"e_{k}"), F.col("n").alias(f"n_{k}")) for k in "ab")
    shared = F.size(F.array_intersect("e_a", "e_b"))
    done = pairs.join(x, "a").join(y, "b").select("a", "b", (shared / (F.col("n_a") + F.col("n_b") - shared)).alias("similarity"))
    return done.where(F.col("similarity") >= threshold).select("a", "b", F.round("similarity", 6).alias("similarity"))


def _from_rare(rows: DataFrame) -> DataFrame:
    """id, n and keys: the elements, in an order that is the same in all sets, mostly from rare to common.

    An element's key begins with a level for the number of elements in its bucket; any such order is right, a finer one finds fewer pairs.
    """
    bucket = lambda x: F.pmod(x, F.lit(BUCKETS))
    counts = rows.select(F.explode("elems").alias("x")).groupBy(bucket(F.col("x")).alias("bucket")).agg(F.count("*").alias("k"))
    level = F.coalesce(F.floor(32 * F.log2(F.col("k") + 1)), F.lit(0)).cast("smallint").alias("level")
    whole = rows.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").select("bucket", level)
    levels = durable(whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "level"))), lambda s: s["level"]).alias("levels")), "levels")
    key = lambda x: F.shiftleft(F.get(F.col("levels"), bucket(x).cast("int")).cast("bigint"), 53).bitwiseOR(x.bitwiseAND(F.lit((1 << 53) - 1)))
    return rows.withColumn("levels", levels.scalar()).select("id", "n", F.sort_array(F.transform("elems", key)).alias("keys"))


def _alike(found: DataFrame, rows: DataFrame, most: Column) -> DataFrame:
    """The found pairs a, b whose marks differ in `most` bits or fewer, where they are found; large sets' wide marks after the others."""
    known = marks(rows)
    wide = durable(known.where(F.size("bits") > WORDS).withColumn("slot", F.row_number().over(Window.orderBy("id")) - 1), "wide")
    table = wide.select("slot", "bits").toArrow().sort_by("slot")["bits"].combine_chunks()
    sent = found.sparkSession.sparkContext.broadcast(table.flatten().to_numpy().view(np.uint64).reshape(-1, WIDE))
    known = known.join(F.broadcast(wide.select("id", "slot")), "id", "left")
    folded = [reduce(Column.bitwiseXOR, (F.coalesce(F.get("bits", F.lit(i)), F.lit(0).cast("bigint")) for i in range(k, WIDE, WORDS))) for k in range(WORDS)]
    for x in "ab":
        found = found.join(F.broadcast(known.select(F.col("id").alias(x), F.col("slot").alias(f"slot_{x}"), *(w.alias(f"{x}{k}") for k, w in enumerate(folded)))), x)
    apart = reduce(Column.__add__, (F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(WORDS)))
    left = found.withColumn("most", most).where(apart <= F.col("most")).select("a", "b", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("slot_a", "slot_b")), "most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, bound = (batch.column(k).to_numpy() for k in (2, 3, 4))
            keep = np.ones(batch.num_rows, bool)
            at = np.flatnonzero((x >= 0) & (y >= 0))
            keep[at] = np.bitwise_count(sent.value[x[at]] ^ sent.value[y[at]]).sum(axis=1, dtype=np.int64) <= bound[at]
            yield batch.select([0, 1]).filter(pa.array(keep))

    return left.mapInArrow(run, left.select("a", "b").schema)


def marks(rows: DataFrame) -> DataFrame:
    """id and bits: each element flips one of 64 * WORDS bits, or 64 * WIDE where these are fewer than two for each element."""
    words = F.when(F.col("n") > 32 * WORDS, F.lit(WIDE)).otherwise(F.lit(WORDS))
    x = F.col("x")
    flips = rows.select("id", words.alias("words"), F.explode("keys").alias("x"))
    flips = flips.groupBy("id", "words", F.pmod(F.shiftright(x, 6), F.col("words")).cast("int").alias("word"))
    flips = flips.agg(F.bit_xor(F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(F.lit(63)).cast("int"))).alias("bit"))
    held = flips.groupBy("id", "words").agg(F.map_from_entries(F.collect_list(F.struct("word", "bit"))).alias("bits"))
    filled = F.transform(F.sequence(F.lit(0), F.col("words") - 1), lambda i: F.coalesce(F.try_element_at("bits", i), F.lit(0).cast("bigint")))
    return durable(held.select("id", filled.alias("bits")), "marks")


def co_occurrence(pairs: DataFrame, node: str, shared: str, threshold: int = 1) -> DataFrame:
    """Pairs a < b of nodes that share at least `threshold` (1 or more) values, and how many: an equi-join."""
    rows = pairs.select(F.col(node).alias("node"), F.col(shared).alias("value")).distinct()
    a, b = rows.withColumnRenamed("node", "a"), rows.withColumnRenamed("node", "b")
    return a.join(b, "value").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= max(1, threshold))
