"""Streams in batches of a fixed number of records: repeat rates, Bloom filters, Flajolet-Martin, reservoirs.

A stream is rows (seq, user_id), seq from 1 on. What a sequential program keeps as state is here the first batch in
which something happened, an aggregate that any number of tasks can make.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.functions.scalars import STREAM_PRIME, draw, text_mod, trailing_zeros

#: Bits and functions of the Bloom filter and its seed; the modulus of the Flajolet-Martin hashes; the
#: reservoir's size and the slots that are reported.
BITS, FUNCTIONS, SEED = 69_997, 10, 553
FM_MODULUS = 997
RESERVOIR, SLOTS = 100, (0, 20, 40, 60, 80)


def coefficients(n: int = FUNCTIONS, bits: int = BITS, seed: int = SEED) -> list[tuple[int, int]]:
    """n different multipliers and n different offsets below bits."""
    rng = random.Random(seed)
    return list(zip(rng.sample(range(1, bits), n), rng.sample(range(1, bits), n), strict=True))


def batches(stream: DataFrame, size: int) -> DataFrame:
    return stream.withColumn("batch_id", F.expr(f"(seq - 1) div {size}"))


def batch_sizes(stream: DataFrame, size: int) -> DataFrame:
    return batches(stream, size).groupBy("batch_id").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_distinct"))


def repeat_rate(stream: DataFrame, size: int) -> DataFrame:
    """For each batch: its distinct users that an earlier batch had, as a share of the batch size."""
    seen = batches(stream, size).select("batch_id", "user_id").distinct()
    first = seen.groupBy("user_id").agg(F.min("batch_id").alias("first"))
    return seen.join(first, "user_id").groupBy("batch_id").agg(F.round(F.count_if(F.col("first") < F.col("batch_id")) / size, 6).alias("rate"))


def positions(number, bits: int = BITS):
    """The bits of a user, given as a number below STREAM_PRIME."""
    return F.array(*((number * a + b) % STREAM_PRIME % bits for a, b in coefficients(bits=bits)))


def bloom_rate(stream: DataFrame, size: int, bits: int = BITS) -> DataFrame:
    """For each batch: the share of its new users that the filter, as the batch begins, takes for seen.

    A bit is set from the first batch on that has a user with it; a user looks seen in a batch if all its bits were
    set in earlier ones. The rate is 0 for batches without new users.
    """
    users = batches(stream, size).groupBy("user_id").agg(F.min("batch_id").alias("first"))
    places = users.withColumn("bit", F.explode(F.array_distinct(positions(text_mod(F.col("user_id"), STREAM_PRIME), bits))))
    since = places.groupBy("bit").agg(F.min("first").alias("since"))  # at most `bits` rows
    latest = places.join(F.broadcast(since), "bit").groupBy("user_id", "first").agg(F.max("since").alias("all_set"))
    new = latest.groupBy(F.col("first").alias("batch_id")).agg(F.count("*").alias("n"), F.count_if(F.col("all_set") < F.col("first")).alias("wrong"))
    every = batches(stream, size).select("batch_id").distinct()
    out = every.join(new, "batch_id", "left")
    return out.select("batch_id", F.round(F.coalesce(F.col("wrong") / F.col("n"), F.lit(0.0)), 6).alias("fpr"))


def fm_estimates(stream: DataFrame, size: int, modulus: int = FM_MODULUS, functions: int = FUNCTIONS) -> DataFrame:
    """For each batch: distinct users and the Flajolet-Martin estimate 2 ** (mean of the largest trailing zeros)."""
    number = text_mod(F.col("user_id"), STREAM_PRIME)
    rows = batches(stream, size).withColumn("number", number)
    most = [F.max(trailing_zeros(((F.col("number") * a + b) % modulus).cast("bigint"))).alias(f"z{i}") for i, (a, b) in enumerate(coefficients(functions))]
    out = rows.groupBy("batch_id").agg(F.count_distinct("user_id").alias("n_distinct"), *most)
    mean = sum((F.col(f"z{i}") for i in range(functions)), F.lit(0)) / functions
    return out.select("batch_id", "n_distinct", F.round(F.pow(F.lit(2.0), mean), 6).alias("estimate"))


def bottom_sample(stream: DataFrame, k: int = RESERVOIR, seed: int = SEED) -> DataFrame:
    """A uniform sample of k records: those whose numbers draw the least values; any tasks can make it."""
    return stream.withColumn("drawn", draw(F.col("seq"), seed)).orderBy("drawn", "seq").limit(k).select("seq", "user_id")


def reservoir(stream: DataFrame, k: int = RESERVOIR, every: int = 100, seed: int = SEED, batch: int = 1) -> DataFrame:
    """The sequential reservoir: after every `every` records, seqnum and the users in SLOTS.

    batch: records come in batches of so many, and it is only looked at when one is whole.

    The order of its random draws is the stream's order, so one task makes it, holding k users; the stream must be
    one that one task can read. bottom_sample scales.
    """
    names = [f"slot_{i}" for i in SLOTS]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng, kept, n, rows = random.Random(seed), [], 0, []
        for frame in frames:
            for user in frame["user_id"].tolist():
                n += 1
                if len(kept) < k:
                    kept.append(user)
                elif rng.random() < k / n:
                    kept[rng.randint(0, k - 1)] = user
                if n % every == 0 and n % batch == 0:
                    rows.append((n, *(kept[i] if i < len(kept) else None for i in SLOTS)))
            if rows:
                yield pd.DataFrame(rows, columns=["seqnum", *names])
                rows = []

    ordered = stream.select("seq", "user_id").repartition(1).sortWithinPartitions("seq")
    return ordered.mapInPandas(run, "seqnum bigint, " + ", ".join(f"{n} string" for n in names))
