"""A corpus from documents to token ids: five stages, each written and read again.

Toxic documents go, documents of no known language go, one document of each group of near
copies stays, sources are mixed to target weights, and what is left is encoded and decoded.
"""

from functools import partial

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diffmill.llm import bpe, language_id, mixing, ngram_join, toxicity
from diffmill.llm.batches import free_name, table, with_small_workers
from diffmill.sources.staging import staged

#: Documents without an n-gram of any language, or with fewer than this share of known
#: ones in their best language, are rejected.
LEAST_LANGUAGE = 0.3
#: Weights of the sources in turn, and how many words to take, as a share of those that are left.
WEIGHTS, SHARE, MOST = [3, 1, 2], 1.5, 2.0


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    score = free_name(docs, "toxicity")
    return toxicity.score(docs, model, score, keep_text=True).filter(F.col(score) < 0.5).select(_columns(docs))


def of_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known = language_id.learn(docs, F.lit(True))
    lang, share = free_name(docs, "known_lang"), free_name(docs, "known_share")
    found = language_id.identify(docs, known, lang, share, keep_text=True)
    return found.filter((F.col(lang) != language_id.UNKNOWN) & (F.col(share) >= LEAST_LANGUAGE)).select(_columns(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by a number of their own, so that of rows with one id, or with none,
    one stays of each group, too."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct(_columns(docs)).alias("row"))
    numbered = staged(numbered, "numbered")
    groups = ngram_join.components(numbered.select(F.col("row_id").alias("doc_id"), "row.text"), words=5, percent=80)
    first = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("row_id"))
    return numbered.join(first, "row_id", "left_semi").select("row.*")


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, WEIGHTS, SHARE, MOST)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = docs.select("doc_id", "source", "text")
    coded = bpe.encode(rows, vocabulary, public_tokenizers.PATTERN, decoded="decoded")
    return coded.select(
        "doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    (name, partial(with_small_workers, stage))
    for name, stage in [
        ("toxicity", without_toxic),
        ("language ID", of_known_language),
        ("n-gram Jaccard join", without_near_copies),
        ("mixing sources to target weights", to_weights),
        ("byte-level BPE encoding and decoding", as_tokens),
    ]
]

#: Learned models and hashed n-grams have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
