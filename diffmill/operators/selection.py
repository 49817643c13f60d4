"""Exact random selection and splitting without moving the rows.

"Take the first k rows of a class in random order" is usually written as a ranking over
the class, which sends a whole class through one task. Here the order is a hash of the
row's key, so it is enough to know the hash of the k-th row:

1. count rows per class and hash prefix (combined on the map side);
2. find the prefix in which the k-th row falls;
3. rank only the rows of that prefix, one in 65,536 of a class.

The result, one hash per class and cut, is joined back as a broadcast. Rows whose class is
null or not a known one are one more class, so it has at most six rows per cut.
Row keys must be unique, otherwise rows with equal keys stay on the same side of a cut.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffmill import constants as C
from diffmill.functions.hashing import hash_order

_PREFIX_DIGITS = 4


#: The class that all rows without a known class form together.
FOREIGN = -1


def _known_classes() -> Column:
    return F.col("label").isin(list(C.CLASS_NAMES))


def class_key() -> Column:
    """The class of a row: a known id, or ``FOREIGN`` for nulls and all other ids."""
    return F.when(_known_classes(), F.col("label")).otherwise(FOREIGN)


def class_counts(samples: DataFrame) -> DataFrame:
    """Rows per known class; at most one row per class."""
    return samples.filter(_known_classes()).groupBy("label").agg(F.count("*").alias("n"))


def hash_cuts(keys: DataFrame, limits: DataFrame | Column) -> DataFrame:
    """(label, cut, cut_hash): hash of the k-th row of a class.

    ``keys(label, h)`` are the rows. The wanted positions are ``limits(label, cut, k)``, or
    a column, an array of structs (cut, k) that may use ``label`` and the size of the
    class, ``class_rows``. A position beyond the end of its class, or below 1, gives no row.
    """
    prefixed = keys.select("label", "h", F.substring("h", 1, _PREFIX_DIGITS).alias("prefix"))
    upto = Window.partitionBy("label").orderBy("prefix").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    histogram = (
        prefixed.filter(F.col("label").isin([*C.CLASS_NAMES, FOREIGN]))
        .groupBy("label", "prefix")
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(upto))
        .withColumn("class_rows", F.sum("n").over(Window.partitionBy("label")))
    )
    if isinstance(limits, Column):
        wanted = histogram.select("*", F.inline(limits))
    else:
        wanted = histogram.join(F.broadcast(limits), "label")
    hit = (
        wanted.filter((F.col("k") <= F.col("upto")) & (F.col("k") > F.col("upto") - F.col("n")))
        .select("label", "cut", "prefix", (F.col("k") - F.col("upto") + F.col("n")).alias("nth"))
    )
    in_prefix = Window.partitionBy("label", "cut").orderBy("h")
    return (
        prefixed.join(F.broadcast(hit), ["label", "prefix"])
        .withColumn("rn", F.row_number().over(in_prefix))
        .filter(F.col("rn") == F.col("nth"))
        .select("label", "cut", F.col("h").alias("cut_hash"))
    )


def _with_hash(samples: DataFrame, key: str, seed: int) -> DataFrame:
    return samples.withColumn("h", hash_order(F.col(key), seed))


def _pivot_cuts(cuts: DataFrame, names: list[str]) -> DataFrame:
    return cuts.groupBy("label").agg(
        *[F.max(F.when(F.col("cut") == name, F.col("cut_hash"))).alias(name) for name in names]
    )


def subsample(rows: DataFrame, key: str, n: int = C.SAMPLE_ROWS, seed: int = C.SEED) -> DataFrame:
    """N rows in random order if there are more, else all. The last join is a nested
    loop over one row, the hash of the n-th row."""
    one_class = _with_hash(rows, key, seed).withColumn("label_", F.lit(0))
    keys = one_class.select(F.col("label_").alias("label"), "h")
    limits = F.array(F.struct(F.lit("sample").alias("cut"), F.lit(n).alias("k")))
    cut = hash_cuts(keys, limits).select(F.col("label").alias("label_"), "cut_hash")
    return (
        one_class.join(F.broadcast(cut), "label_", "left")
        .filter(F.col("cut_hash").isNull() | (F.col("h") <= F.col("cut_hash")))
        .drop("label_", "h", "cut_hash")
    )


def target_table(samples: DataFrame, targets: dict[int, int]) -> DataFrame:
    """(label, k) from a small literal map."""
    entries = F.create_map(*[F.lit(x) for item in targets.items() for x in item])
    return samples.sparkSession.range(1).select(F.explode(entries).alias("label", "k"))


def downsample(
    samples: DataFrame, key: str, targets: dict[int, int] = C.TARGET_COUNTS, seed: int = C.SEED
) -> DataFrame:
    """At most the target number of rows per class; smaller classes stay whole."""
    hashed = _with_hash(samples, key, seed)
    entries = F.create_map(*[F.lit(x) for item in targets.items() for x in item])
    target = F.element_at(entries, F.col("label"))
    limits = F.array(F.struct(F.lit("target").alias("cut"), target.alias("k")))
    cuts = hash_cuts(hashed.select("label", "h"), limits).select("label", "cut_hash")
    return (
        hashed.join(F.broadcast(cuts), "label", "left")
        .filter(F.col("cut_hash").isNull() | (F.col("h") <= F.col("cut_hash")))
        .select(samples.columns)
    )


def stratified_split(
    samples: DataFrame,
    key: str,
    shares: tuple[tuple[str, int], ...] = (("train", 70), ("val", 85)),
    rest: str = "test",
    seed: int = C.SEED,
) -> DataFrame:
    """O-SPLIT: adds ``split``. Exact per class: the first 70 % of the class in random
    order are train, up to 85 % val, the rest test. ``shares`` are upper bounds in percent.
    Rows without a known class are split by the same shares, together.
    """
    hashed = _with_hash(samples, key, seed).withColumn("class_", class_key())
    cut_names = [f"cut_{name}" for name, _ in shares]
    bounds = F.array(
        *[
            F.struct(
                F.lit(cut).alias("cut"), F.floor(F.col("class_rows") * upper / 100).alias("k")
            )
            for cut, (_, upper) in zip(cut_names, shares, strict=True)
        ]
    )
    keys = hashed.select(F.col("class_").alias("label"), "h")
    cuts = _pivot_cuts(hash_cuts(keys, bounds), cut_names).withColumnRenamed("label", "class_")
    split = F.lit(rest)
    for cut, (name, _) in reversed(list(zip(cut_names, shares, strict=True))):
        split = F.when(F.col("h") <= F.col(cut), name).otherwise(split)
    return (
        hashed.join(F.broadcast(cuts), "class_", "left")
        .withColumn("split", split)
        .select(*samples.columns, "split")
    )


def approximate_split(samples: DataFrame, key: str, seed: int = C.SEED) -> DataFrame:
    """Split by the hash alone, in one pass. Sizes hold only approximately."""
    part = F.conv(F.substring(hash_order(F.col(key), seed), 1, 8), 16, 10).cast("bigint")
    share = part / F.lit(2**32)
    return samples.withColumn(
        "split", F.when(share < 0.70, "train").when(share < 0.85, "val").otherwise("test")
    )
