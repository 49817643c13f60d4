"""Language of a file by its extension (P1) and languages per pull request (A1)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffmill.constants import EXTENSION_LANGUAGES, UNKNOWN_LANGUAGE
from diffmill.functions.text import lookup


def language_of(file: Column) -> Column:
    extension = F.lower(F.substring_index(file, ".", -1))
    known = lookup(EXTENSION_LANGUAGES, extension, UNKNOWN_LANGUAGE)
    return F.when(F.contains(file, F.lit(".")), known).otherwise(UNKNOWN_LANGUAGE)


def language_counts(chunks: DataFrame) -> DataFrame:
    """Chunks per language and the place of the first one."""
    return (
        chunks.select("pr_id", "chunk_index", language_of(F.col("file")).alias("language"))
        .groupBy("pr_id", "language")
        .agg(F.count("*").alias("n"), F.min("chunk_index").alias("first_chunk"))
    )


def language_info(chunks: DataFrame) -> DataFrame:
    """One row per pull request: language map and primary language.

    The languages are known, so each has its own count and first place: one aggregation by
    pull request with numbers alone.
    """
    known = sorted({*EXTENSION_LANGUAGES.values(), UNKNOWN_LANGUAGE})
    language = language_of(F.col("file"))
    marked = chunks.select("pr_id", "chunk_index", language.alias("language"))
    sums = [
        column
        for k, name in enumerate(known)
        for column in (
            F.count_if(F.col("language") == name).alias(f"n{k}"),
            F.min(F.when(F.col("language") == name, F.col("chunk_index"))).alias(f"first{k}"),
        )
    ]
    found = F.filter(
        F.array(*[F.struct(F.col(f"first{k}").alias("first"), F.lit(name).alias("language"), F.col(f"n{k}").alias("n")) for k, name in enumerate(known)]),
        lambda e: e["n"] > 0,
    )
    most = F.array_max(F.transform("found", lambda e: F.struct(e["n"], -e["first"], e["language"].alias("language"))))
    return (
        marked.groupBy("pr_id")
        .agg(*sums)
        .select("pr_id", F.array_sort(found).alias("found"))
        .select(
            "pr_id",
            most["language"].alias("language"),
            F.map_from_entries(F.transform("found", lambda e: F.struct(e["language"], e["n"]))).alias("languages"),
        )
    )
