"""Mixing sources to target weights (operator 8). DataFrame functions only.

Every document gets a hash-random key. Within a source, documents stand in the order of
their keys, and a document's place is the number of words before it: the prefix sum over
the source. The order is cut into ranges by the first digits of the key. Sizes are summed
by source and range first, so that the running sum over a source goes over few rows, and
inside a range it goes over few documents, however large the source is.

A source's target is met to the word: the whole source as often as it fits, then the
documents in order up to the budget, the last one in part.

Defined results: a null text has size 0; null sources form one source, the last one;
documents of size 0, and all documents where nothing is to be taken, take 0; equal ids are
told apart by size; an empty table gives no rows; other columns are left out of the plan
and kept by ``mixed``.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffmill.llm.batches import WORD
from diffmill.sources.staging import staged

_FIRST = Window.unboundedPreceding


def targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """Target of each row of ``source, source_size``: one row per source.

    The sources in order, null last, take the weights in turn and share ``share`` of all
    sizes. No target is above ``most`` times its source; what is cut off goes to the
    others by weight. That is a level: the sources with the least room per weight are
    full, the others get the level times their weight.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    number = (F.row_number().over(in_order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (number + 1).cast("int"))
    limit = F.lit(float(most)) * F.col("source_size")
    full = F.coalesce(F.sum("limit").over(by_room.rowsBetween(_FIRST, -1)), F.lit(0.0))
    # the level if all sources before this one are full; it holds from the first source
    # whose room is not below it
    level = (F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()) - full) / F.sum(
        "weight"
    ).over(by_room.rowsBetween(0, Window.unboundedFollowing))
    fits = F.when(F.col("level") <= F.col("room"), F.col("level"))
    held = F.first(fits, ignorenulls=True).over(by_room.rowsBetween(_FIRST, Window.unboundedFollowing))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("limit", limit)
        .withColumn("room", F.col("limit") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("held", held)
        .withColumn("target", F.least("limit", F.coalesce(F.col("held") * F.col("weight"), F.col("limit"))))
        .select("source", "source_size", "target")
    )


def _key(seed: int) -> Column:
    """Of the id and the text, so that rows of one id, or of none, are spread as well."""
    name = F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(f"{seed}"), F.xxhash64("text").cast("string"))
    return F.md5(name.cast("binary"))


def plan(
    docs: DataFrame, weights: list[int], share: float = 1.0, most: float = 2.0, seed: int = 8, digits: int = 3
) -> DataFrame:
    """``doc_id, source, size, source_size, target, place, taken`` of each document.

    ``place`` is the number of words before the document in its source, ``taken`` how many
    of its words the mix takes, repeats counted. ``digits`` hexadecimal digits of the key
    name a range: 4,096 ranges per source hold some thousand documents each up to
    10 million documents in a source; take one more digit for 16 times as many.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    keyed = docs.select("doc_id", "source", size.alias("size"), _key(seed).alias("key"))
    # the texts are read once; ids and sizes are small
    keyed = staged(keyed.withColumn("range", F.substring("key", 1, digits)), "mix-sizes")
    ranges = staged(keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "mix-ranges")
    sizes = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    by_range = Window.partitionBy("source").orderBy("range").rowsBetween(_FIRST, -1)
    begun = ranges.select(
        "source", "range", F.coalesce(F.sum("range_size").over(by_range), F.lit(0)).alias("begun")
    )
    goals = targets(sizes, weights, share, most).alias("g")
    begun = (
        begun.alias("b")
        .join(goals, F.expr("b.source <=> g.source"))
        .select("b.source", "b.range", "b.begun", "g.source_size", "g.target")
    )
    within = Window.partitionBy("source", "range").orderBy("key", "size").rowsBetween(_FIRST, -1)
    placed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).alias("k")
    joined = placed.join(begun.alias("b"), F.expr("k.source <=> b.source AND k.range = b.range"))
    size, target = F.col("size"), F.floor("target")
    rest = target - F.col("epochs") * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(size, rest - F.col("place")))
    return (
        joined.select(
            "doc_id", "k.source", "size", "source_size", "target", (F.col("begun") + F.col("inside")).alias("place")
        )
        .withColumn("epochs", F.coalesce(F.floor(target / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)))
        .withColumn("taken", (F.col("epochs") * size + cut).cast("bigint"))
        .drop("epochs")
    )


def mixed(docs: DataFrame, weights: list[int], share: float = 1.0, most: float = 2.0, seed: int = 8) -> DataFrame:
    """The mix itself: every document as often as the plan takes at least half of it, with
    all its columns; a document that is taken twice is there twice.

    Documents with equal ids and texts are one document here; its rows share the copies.
    """
    chosen = plan(docs, weights, share, most, seed)
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    counted = chosen.groupBy("doc_id", "size").agg(F.sum(copies).alias("copies"), F.count("*").alias("rows"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    # the row apart, whatever its columns are called
    rows = docs.select("doc_id", size.alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).alias("d")
    joined = rows.join(
        counted.filter("copies > 0").alias("c"), F.expr("d.doc_id <=> c.doc_id AND d.size = c.size")
    )
    # rows with equal ids and sizes share their copies evenly, rounded up
    times = F.ceil(F.col("c.copies") / F.col("c.rows")).cast("int")
    return joined.select("row", F.explode(F.sequence(F.lit(1), times))).select("row.*")
