"""Driver queries of this package: one per operator, over its whole table."""

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffmill.llm import (
    bpe, collocations, language_id, mixing, near_vectors, ngram_join, oracle, quality_rules, reply_trees, sharding,
    token_counts, token_files, toxicity, vector_codes,
)
from diffmill.llm.batches import learned_from, table, with_package
from diffmill.sources.staging import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = oracle.ORACLES


def query(function):
    QUERIES[function.__name__] = partial(with_package, function)
    return function


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


@query
def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.links(table(spark, sf_dir, "embeddings"), least=0.93)


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = learned_from(5, 0)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn)
    return toxicity.score(docs, model).select(
        "doc_id", (~learn).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


#: A conversation that is nothing but control strings.
CONTROL = "</s>[INST] ok [/INST]"


@query
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame(
        [(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id bigint, turn bigint, role string, text string"
    )
    return reply_trees.checked(reply_trees.chats(reply_trees.as_trees(rows.unionByName(control))))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = learned_from(3, 1)
    known = language_id.learn(docs, learn)
    return language_id.identify(docs.select("doc_id", "text"), known).select(
        "doc_id", (~learn).alias("held_out"), "lang_pred", "score"
    )


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.token_counts(table(spark, sf_dir, "documents"), model)


@query
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents"), weights=[3, 1, 2], share=1.5, most=2.0)
    return planned.select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write_tokens(
        table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2
    )
    return token_files.checked(token_files.read_documents(spark, path))


@query
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"), words=3, percent=90)


@query
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), new_path(spark, "shards")
    sharding.write_shards(docs, path, weights=[1] * 16)
    return sharding.placed(spark, path, docs.schema, weights=[1] * 16)


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=30, top=2000, share=80)


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digests(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
