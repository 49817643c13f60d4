"""Small helpers for Arrow batches and columns that the operators of this package share."""

import os
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the contracts call a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Where the package lies, for the Python workers of a session started elsewhere.
ROOT = str(Path(__file__).resolve().parents[2])


#: Makes Python workers, which live on from stage to stage, give freed memory back.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "4194304"}


def with_package(function: Callable[..., DataFrame], spark: SparkSession, *args) -> DataFrame:
    """``function(spark, *args)``, with workers that find the package by the path it has
    on the driver; a cluster that has it elsewhere ships it with ``--py-files``."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, ROOT]))
    return function(spark, *args)


#: Rows of an Arrow batch in such jobs; both sides of the pipe hold one.
BATCH_ROWS = "1000"


def with_small_workers(function: Callable[..., DataFrame], spark: SparkSession, *args) -> DataFrame:
    """As ``with_package``, for jobs of several stages whose workers should stay small."""
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return with_package(function, spark, *args)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def texts(column: pa.Array) -> list[str]:
    """Texts of a batch, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of the texts of a batch, null as the empty text."""
    if column.type not in (pa.binary(), pa.large_binary()):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in column.to_pylist()]


def list_array(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def learned_from(modulus: int, held: int):
    """True for documents outside the fold that is held out: crc32 of the id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != held
