"""Structured Streaming twins of the batch sketches: micro-batches in place of batches of a fixed number.

State is kept by the engine (watermarks, aggregations, a keyed state processor), so queries restart from their
checkpoint.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from orebody.operators.sketches import RESERVOIR, SEED


def read_events(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, time: str = "ts", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Records and (approximately) distinct users of each window; later records than `late` are dropped."""
    rows = events.withWatermark(time, late).groupBy(F.window(time, size))
    return rows.agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("n_users")).select(F.col("window.start").alias("start"), "n", "n_users")


def first_seen(events: DataFrame, time: str = "ts") -> DataFrame:
    """Each user's first time: the state behind the repeat rate, as a running aggregation."""
    return events.groupBy("user_id").agg(F.min(time).alias("first"))


def by_batch(events: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Apply a batch operator to each micro-batch."""
    return events.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)


def reservoirs(events: DataFrame, k: int = RESERVOIR, seed: int = SEED) -> DataFrame:
    """A reservoir for each key (column key): after each micro-batch its number of records and its sample, as text."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, kept = state.get if state.exists else (0, [])
        kept = list(kept)
        for frame in frames:
            for user in frame["user_id"].tolist():
                n += 1
                rng = random.Random(seed * 1_000_003 + n)  # a record's draw depends on its number alone
                if len(kept) < k:
                    kept.append(user)
                elif rng.random() < k / n:
                    kept[rng.randrange(k)] = user
        state.update((n, kept))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "sample": [",".join(kept)]})

    rows = events.select("key", F.col("user_id").cast("string").alias("user_id")).groupBy("key")
    return rows.applyInPandasWithState(update, "key string, n bigint, sample string", "n bigint, kept array<string>", "update", GroupStateTimeout.NoTimeout)
