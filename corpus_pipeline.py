"""A training corpus from documents: toxic and poor documents and near copies go, sources are mixed, texts packed.

Each stage works on all that its predecessor kept and is written as Parquet before the next one reads it. So a stage's
intermediates are spent when the next one begins on written rows, and are removed then, unless those rows are read from them.

Edge cases, in every stage: null and empty texts aren't toxic, fail the quality rules (no words), would be nobody's
copies, give the mix nothing and pack to the end id; null and repeated doc_ids, ties and repeated rows are rows of their
own but for near copies, of which the least doc_id stays once; texts of any length are worked on whole; an empty table
stays empty through all stages; extra columns, whatever their names, pass through all stages but the last, which has
columns of its own.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orebody.llm import mixing, ngrams, packing, rules, toxicity
from orebody.llm.common import materialize, table
from orebody.llm.queries import vocabulary
from orebody.plans import durable

#: The intermediates of the stage that each application ran last.
_SPENT: dict[str, list[str]] = {}


def _stage(function: Callable) -> Callable:
    """A stage that removes its predecessor's intermediates first."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        spent = _SPENT.pop(app, [])
        folders = {x.rsplit("/", 1)[0] for x in docs.inputFiles()} if spent else set()
        if folders:  # docs that aren't read from files may still be made from what is spent
            durable.remove(spark, [p for p in spent if not any(p.rsplit("/", 1)[1] in x for x in folders)])
        before = set(durable.written(spark))
        out = function(spark, docs, sf_dir)
        _SPENT[app] = [p for p in durable.written(spark) if p not in before]
        return out

    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below 0.3; the model learns from the labelled ones of docs."""
    return toxicity.keep_clean(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


@_stage
def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules keep."""
    return rules.keep_good(docs)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each group of linked documents."""
    return ngrams.keep_one(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each document piece of each slot, in the columns of documents, in the order of the shards."""
    return mixing.mix(docs, block=256, weights=(5, 2, 1), share=1.5, most=2)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of at most 2048."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=1, tokens=2048, segments=64, loss=1984)


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_poor), ("near_duplicates", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]

#: The stages' models and token ids are beyond SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, earlier = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        durable.remove(spark, earlier)
        earlier = durable.written(spark)[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
