"""Labelled-sample sinks and sources."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffmill.operators.selection import stratified_split
from diffmill.schemas import SAMPLES

_CSV = {"header": True, "quoteAll": True, "escape": '"', "multiLine": True}


def write_samples(split_samples: DataFrame, path: str, file_format: str = "parquet") -> None:
    """S3: samples with their split as one partitioned table. All rows of the table are
    the balanced set, a partition is one part of it."""
    ordered = split_samples.select(SAMPLES.names)  # a CSV reader goes by position
    writer = ordered.write.mode("overwrite").partitionBy("split")
    if file_format == "csv":
        writer = writer.options(**_CSV)
    writer.format(file_format).save(path)


def read_samples(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    reader = spark.read.schema(SAMPLES)
    if file_format == "csv":
        reader = reader.options(**_CSV)
    return reader.format(file_format).load(path)


def training_parts(samples: DataFrame, key: str = "sample_key") -> DataFrame:
    """Samples with a split. A table that is not split yet gets an exact stratified
    80/20 split into train and val; code is cast to string and label to int."""
    typed = samples.withColumns(
        {"code": F.col("code").cast("string"), "label": F.col("label").cast("int")}
    )
    if "split" in samples.columns:
        return typed
    return stratified_split(typed, key, shares=(("train", 80),), rest="val")
