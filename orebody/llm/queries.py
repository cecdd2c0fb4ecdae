"""Registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orebody.llm import convnet, flac, mixing, ngrams, packing, pages, rules, tokens, toxicity, transducer
from orebody.llm.common import table


def op1_byte_convnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return convnet.score(docs, convnet.fit_quality(docs, table(spark, sf_dir, "labels")))


def op2_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_digests(table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op4_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.jaccard_components(table(spark, sf_dir, "documents"))


def op5_sentence_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=1, tokens=2048, segments=64, loss=1984)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"), block=256, weights=(5, 2, 1), share=1.5, most=2)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.dataset_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op10_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), limit=4096)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_convnet": op1_byte_convnet,
    "op2_flac_media": op2_flac_media,
    "op3_crf_main_text": op3_crf_main_text,
    "op4_partenum_jaccard": op4_partenum_jaccard,
    "op5_sentence_toxicity": op5_sentence_toxicity,
    "op6_vector_packing": op6_vector_packing,
    "op7_source_mixing": op7_source_mixing,
    "op8_token_files": op8_token_files,
    "op9_quality_rules": op9_quality_rules,
    "op10_transducer_counts": op10_transducer_counts,
}

#: DuckDB SQL of the queries that SQL can express; the others are compared with brute force in the tests.
SQL: dict[str, str] = {
    "op4_partenum_jaccard": ngrams.sql(),
    "op7_source_mixing": mixing.sql(block=256, weights=(5, 2, 1), share=1.5, most=2),
    "op9_quality_rules": rules.sql(),
}
