"""Sharding by rendezvous hashing (operator 11).

Every pair of a record's key and a shard has a draw of its own, a digest of both, and the
record goes to the shard that wins: with a weight w, the draw u in (0, 1) counts as
-ln(u) / w and the smallest value wins, so a shard gets its share of the weights. A draw
does not depend on the other shards. So a new shard takes records only into itself, a
shard that goes gives its records to the others, and no other record moves.

Shards are written as Parquet folders ``shard=K``. Rows are dealt to tasks by ranges of
shard and of an order by digest, so a shard is written by many tasks, whatever its size,
and rows lie in a random but fixed order. Rows that agree in key and text are told apart
by their place in the input, so that a key which holds a third of all rows is cut like any
other. A row's slot is its place in its shard: tasks store places within their part, and
the parts' sizes, one row for each task and shard, add up to the rest.

The input has to be a table or another source that gives the same rows in the same order
when it is read again, as a lost task's part is.

Defined results: null keys count as the empty text and null texts have order as the empty
text; equal keys share a shard, repeated rows keep a slot each; an empty table gives empty
shards; weights of 0 or less take nothing; all columns are kept, whatever their names.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a digest that make up a draw; a double holds them.
_BITS = 52


def _digits(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard, from 0, that holds a key."""
    shares = [(i, float(w)) for i, w in enumerate(weights) if w > 0]
    if not shares:
        raise ValueError("at least one shard needs a weight above 0")
    each = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(w).alias("weight")) for i, w in shares])

    def drawn(shard: Column) -> Column:
        digest = F.md5(F.concat(_digits(key), F.lit(":"), shard["shard"].cast("string")).cast("binary"))
        u = (F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("double") + 0.5) / float(1 << _BITS)
        return F.struct((-F.log(u) / shard["weight"]).alias("value"), shard["shard"].alias("shard"))

    return F.array_min(F.transform(each, drawn))["shard"]


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], key: str = "doc_id") -> None:
    """Write whole documents to the folders of their shards."""
    order = F.md5(F.concat(_digits(F.col(key)), F.lit(":"), F.crc32(F.coalesce("text", F.lit(""))).cast("string")).cast("binary"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        shard_of(F.col(f"`{key}`"), weights).alias("shard"),
        order.alias("place"),
        F.monotonically_increasing_id().alias("origin"),
    )
    by = ["shard", "place", "origin"]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    numbered = dealt.select("row", "shard", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    numbered.write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``row`` with the columns of ``schema``, ``shard`` and ``slot`` of all documents.

    ``starts`` has a row for each task that wrote and each shard it met: as ranges follow
    the shards, no more than tasks and shards together, whatever the rows.
    """
    own = [("part", T.IntegerType()), ("at", T.LongType()), ("shard", T.IntegerType())]
    kept = T.StructType([T.StructField(name, kind) for name, kind in [("row", schema), *own]])
    stored = spark.read.schema(kept).parquet(path)
    sizes = stored.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("start"))
    return stored.join(F.broadcast(starts), ["shard", "part"]).select(
        "row", "shard", (F.col("at") + F.col("start")).alias("slot")
    )


def placed(spark: SparkSession, path: str, schema: T.StructType, weights: Sequence[float], key: str = "doc_id") -> DataFrame:
    """Digest of the written shards, and where each document would be with one more shard
    of the last one's weight."""
    rows = read_shards(spark, path, schema)
    text = F.coalesce("row.text", F.lit(""))
    grown = shard_of(F.col(f"row.`{key}`"), [*weights, weights[-1]])
    return rows.select(
        F.col(f"row.`{key}`").alias(key),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        grown.alias("grown_shard"),
    )
