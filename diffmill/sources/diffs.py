"""Diff sources (S1) and the table of added code."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffmill.functions.text import is_blank, strip
from diffmill.schemas import CORPUS, DIFFS


def read_diffs(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Diffs from Parquet, ORC or JSON with the columns pr_id and diff."""
    return spark.read.schema(DIFFS).format(file_format).load(path)


def read_diff_files(spark: SparkSession, path: str) -> DataFrame:
    """One diff per text file; the number in the file's name is the pull request."""
    number = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\D*\z", 1)
    return spark.read.text(path, wholetext=True).select(
        number.try_cast("bigint").alias("pr_id"), F.col("value").alias("diff")
    )


def submitted_diffs(diffs: DataFrame) -> DataFrame:
    """Diffs handed in directly: stripped, and blank ones left out."""
    return diffs.select("pr_id", strip(F.col("diff")).alias("diff")).filter(F.col("diff") != "")


def rejected_diffs(diffs: DataFrame) -> DataFrame:
    """Number of diffs that were accepted and rejected."""
    rejected = F.coalesce(is_blank(F.col("diff")), F.lit(True))
    return diffs.agg(
        F.count_if(~rejected).alias("accepted"), F.count_if(rejected).alias("rejected")
    )


def read_corpus(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    return corpus_code(spark.read.schema(CORPUS).format(file_format).load(path))


def corpus_code(corpus: DataFrame) -> DataFrame:
    """The function's code, or the whole function where that is missing or empty."""
    code = F.coalesce(
        F.nullif("func_code_string", F.lit("")), F.col("whole_func_string"), F.lit("")
    )
    return corpus.withColumn("code", code).drop("func_code_string", "whole_func_string")
