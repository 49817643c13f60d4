"""Tables laid out by a hash bucket of their key, and a growing index of places.

A micro-batch meets few keys. It reads the buckets of those, named in the filter, so the
scan leaves out all other folders, whatever the table holds.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffmill.sources.staging import found, remove

BUCKETS = 64


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_bucketed(df: DataFrame, path: str, key: str = "pr_id", buckets: int = BUCKETS, mode: str = "errorifexists") -> None:
    """A folder per bucket; a large bucket is written by several tasks."""
    rows = df.withColumn("bucket", bucket_of(F.col(key), buckets)).hint("rebalance", "bucket")
    rows.write.mode(mode).partitionBy("bucket").parquet(path)


def buckets_present(keys: DataFrame, key: str = "pr_id", buckets: int = BUCKETS) -> list[int]:
    """At most ``buckets`` numbers reach the driver."""
    return sorted(r.bucket for r in keys.select(bucket_of(F.col(key), buckets).alias("bucket")).distinct().collect())


def read_bucketed(
    spark: SparkSession, path: str, schema: T.StructType, keys: DataFrame, key: str = "pr_id", buckets: int = BUCKETS
) -> DataFrame:
    """The rows of a bucketed table whose key is one of ``keys``."""
    present = buckets_present(keys, key, buckets)
    whole = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    rows = spark.read.schema(whole).parquet(path).filter(F.col("bucket").isin(present))
    return rows.drop("bucket").join(keys.select(key).distinct(), key, "left_semi")


class PlaceIndex:
    """Places (pr_id, file, line) that carry a comment, in bucketed runs.

    Every micro-batch adds a run of its own number; writing it again replaces it. ``fan``
    runs of a level are merged into one of the next, so a batch reads a number of runs that
    grows with the logarithm of the batches, and a place is copied as many times. A run
    counts once its completion mark is there. If a merge ends half way, places are there twice,
    which does no harm.
    """

    schema = T.StructType(
        [T.StructField("pr_id", T.LongType()), T.StructField("file", T.StringType()), T.StructField("line", T.LongType())]
    )

    def __init__(self, spark: SparkSession, path: str, fan: int = 16, buckets: int = BUCKETS):
        self.spark, self.path, self.fan, self.buckets = spark, path, fan, buckets

    def runs(self) -> list[tuple[int, int, str]]:
        """Level, last batch and folder of every complete run."""
        out = []
        for mark in found(self.spark, f"{self.path}/level=*/run=*/_SUCCESS"):
            folder = mark.rsplit("/", 1)[0]
            level, run = (int(part.split("=")[1]) for part in folder.rsplit("/", 2)[1:])
            out.append((level, run, folder))
        return out

    def _write(self, places: DataFrame, level: int, run: int) -> None:
        write_bucketed(places, f"{self.path}/level={level}/run={run}", "pr_id", self.buckets, "overwrite")

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema).withColumn("bucket", F.lit(0))
        own = [("level", T.IntegerType()), ("run", T.LongType()), ("bucket", T.IntegerType())]
        whole = T.StructType([*self.schema.fields, *[T.StructField(n, k) for n, k in own]])
        return self.spark.read.schema(whole).option("basePath", self.path).parquet(*folders)

    def add(self, places: DataFrame, batch: int) -> None:
        self._write(places.select("pr_id", "file", "line").distinct(), 0, batch)

    def merge(self, before: int) -> None:
        """Merge full levels, of runs that no batch from ``before`` on can write again."""
        level = 0
        while full := [r for r in self.runs() if r[0] == level and r[1] < before]:
            if len(full) >= self.fan:
                places = self._read([folder for _, _, folder in full]).select("pr_id", "file", "line").distinct()
                self._write(places, level + 1, max(run for _, run, _ in full))
                for _, _, folder in full:
                    remove(self.spark, folder)
            level += 1

    def of(self, prs: DataFrame, before: int) -> DataFrame:
        """Places of some pull requests from the batches before ``before``."""
        folders = [folder for _, run, folder in self.runs() if run < before]
        present = buckets_present(prs, "pr_id", self.buckets)
        rows = self._read(folders).filter(F.col("bucket").isin(present)).select("pr_id", "file", "line")
        return rows.join(prs.select("pr_id").distinct(), "pr_id", "left_semi")
