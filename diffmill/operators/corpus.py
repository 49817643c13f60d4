"""Labelled corpus: filter, label, seeds, distinct, augmentation and balance
(ids P4, T9, U0 to U5, W4, W5, A2 to A4)."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffmill import constants as C
from diffmill.functions.hashing import content_key, hash_number, hash_order
from diffmill.functions.rules import rule_label
from diffmill.functions.text import lookup, pattern, split_lines
from diffmill.operators.selection import class_counts, downsample, hash_cuts, target_table

_VARIANTS = 4


def usable_code(corpus: DataFrame) -> DataFrame:
    """Code that is neither missing, empty nor too long. Lengths are characters."""
    return corpus.filter(F.length("code").between(1, C.MAX_CORPUS_CHARS))


def label_code(corpus: DataFrame) -> DataFrame:
    """samples(code, label)."""
    return usable_code(corpus).select("code", rule_label(F.col("code")).alias("label"))


# Seed samples are built from a few forms per class and a list of names.
_SEED_NAMES = ["ledger", "parcel", "ticket", "invoice", "sensor"]
_SEED_FORMS = {
    3: [
        'def drop_{0}(db, ref):\n    db.execute("DELETE FROM {0} WHERE ref = " + ref)',
        "def run_{0}(tool):\n    subprocess.run(tool, shell=True)",
        "def rate_{0}(formula):\n    return eval(formula)",
        'def scan_{0}(folder):\n    os.system("scan_{0} " + folder)',
    ],
    2: [
        'def show_{0}(count):\n    return "{0}: " + count',
        "def same_{0}(kind):\n    if kind = 7:\n        return kind",
        'def name_{0}(code, size):\n    return code + "_{0}_" + size',
        "def sum_{0}(text):\n    return 0 + text",
    ],
    1: [
        "def owner_of_{0}(cur):\n    return cur.fetchone().owner",
        'def code_of_{0}(store):\n    return store.get("{0}").code',
        "def last_{0}(rows):\n    found = None\n    for row in rows:\n        found = row\n    return found.key",
        'def tag_{0}(store):\n    tag = store.get("{0}_tag")\n    return tag.lower()',
        "def next_{0}(queue):\n    head = queue.peek()\n    return head.created",
        "def first_{0}(db):\n    row = db.one_or_none()\n    return row[0]",
        "def mail_{0}(team):\n    lead = team.lead\n    return lead.address.strip()",
    ],
    4: [
        "def walk_{0}(xs):\n    for i in range(len(xs) + 1):\n        keep(xs[i])",
        "def tail_{0}(xs):\n    return xs[len(xs)]",
        'def open_{0}(state):\n    if state == "new" or "held":\n        return True',
        "def mean_{0}(xs):\n    return sum(xs) / len(xs)",
        "def wait_{0}():\n    while True:\n        poll_{0}()",
    ],
}


def seed_rows() -> list[tuple[str, int]]:
    return [
        (form.format(name), label)
        for label, forms in _SEED_FORMS.items()
        for form in forms
        for name in _SEED_NAMES
    ]


def seed_samples(spark: SparkSession) -> DataFrame:
    """20 security, 20 type, 35 null-reference and 25 logic samples."""
    rows = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(n).alias("label")) for c, n in seed_rows()])
    return spark.range(1).select(F.inline(rows))


def with_seeds(samples: DataFrame) -> DataFrame:
    """Samples and seeds; ``source_rank`` puts the corpus before the seeds."""
    corpus = samples.select("code", "label", F.lit(0).alias("source_rank"))
    seeds = seed_samples(samples.sparkSession).withColumn("source_rank", F.lit(1))
    return corpus.unionByName(seeds)


def without_nulls(samples: DataFrame) -> DataFrame:
    """U3. Asked column by column: a label that can't be null is then not asked for, while
    ``na.drop`` has the rules run once to look and once more for the label."""
    kept = [F.col(f"`{f.name}`").isNotNull() for f in samples.schema]
    kept += [~F.isnan(f"`{f.name}`") for f in samples.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return samples.filter(reduce(lambda a, b: a & b, kept))


def distinct_code(samples: DataFrame, order: list[str]) -> DataFrame:
    """One row per code, the first one by ``order``.

    The shuffle key is a fixed-width hash, and copies are combined before the shuffle,
    so a code that makes up a third of the rows sends one row per task.
    """
    kept = [c for c in samples.columns if c not in order]
    return (
        samples.groupBy(content_key(F.col("code")).alias("sample_key"))
        .agg(F.min_by(F.struct(*samples.columns), F.struct(*order, *[c for c in kept if c != "code"])).alias("s"))
        .select("sample_key", "s.*")
    )


# --- augmentation ------------------------------------------------------------------------


def _whole_word(name: str) -> str:
    return pattern(rf"\b{name}\b")


def _chosen_names(code: Column, draw: Column) -> Column:
    """Two or three of the known names in the code, chosen by ``draw``."""
    present = F.array_compact(
        F.array(
            *[
                F.when(
                    F.contains(code, F.lit(name)) & code.rlike(_whole_word(name)), F.lit(name)
                )
                for name in C.RENAMES
            ]
        )
    )
    drawn = F.array_sort(
        F.transform(
            present,
            lambda n: F.struct(hash_order(F.concat(draw, F.lit("/"), n)).alias("o"), n.alias("n")),
        )
    )
    wanted = (F.lit(2) + hash_number(draw) % 2).cast("int")
    return F.transform(F.slice(drawn, F.lit(1), wanted), lambda e: e["n"])


def _renamed(code: Column, draw: Column) -> Column:
    """Each chosen name replaced by one of its alternatives. No alternative is itself a
    known name, so the order does not matter."""
    options = F.create_map(
        *[
            x
            for name, names in C.RENAMES.items()
            for x in (F.lit(name), F.array(*[F.lit(n) for n in names]))
        ]
    )

    def replace(text: Column, name: Column) -> Column:
        alternatives = F.element_at(options, name)
        number = hash_number(F.concat(draw, F.lit(":"), name)) % F.size(alternatives)
        whole_word = F.concat(F.lit(r"(?dU)\b"), name, F.lit(r"\b"))
        return F.regexp_replace(text, whole_word, F.get(alternatives, number.cast("int")))

    return F.aggregate(_chosen_names(code, draw), code, replace)


def augmented(samples: DataFrame, rounds: Column) -> DataFrame:
    """``rounds`` times four variants of each sample.

    Needs code, label and sample_key; variants get their own key, made of the sample's
    key, the round and the number of the variant.
    """
    numbered = samples.select(
        "code",
        "label",
        "sample_key",
        F.explode(F.sequence(F.lit(0), (rounds * _VARIANTS - 1).cast("int"))).alias("at"),
    ).select(
        "code",
        "label",
        (F.col("at") % _VARIANTS).alias("variant"),
        F.concat_ws("#", "sample_key", F.col("at").cast("string")).alias("sample_key"),
    )
    return numbered


def write_variants(numbered: DataFrame) -> DataFrame:
    """The text of each variant. Even variants get an empty line after the first
    line that is followed by text, odd ones a comment on top; the last two are wrapped
    in a function."""
    draw = F.col("sample_key")
    comment = F.element_at(
        F.array(*[F.lit(c) for c in C.INJECTED_COMMENTS]),
        (hash_number(F.concat(draw, F.lit(":comment"))) % len(C.INJECTED_COMMENTS) + 1).cast("int"),
    )
    body = F.col("renamed")
    spaced = F.regexp_replace(
        body, r"(?sU)^(.*?)\n([\s\x1c-\x1f]*[^\s\x1c-\x1f])", "$1\n\n$2"
    )
    commented = F.concat(comment, F.lit("\n"), body)
    text = F.when(F.col("variant") % 2 == 0, spaced).otherwise(commented)
    indented = F.array_join(
        F.transform(split_lines(F.col("text")), lambda ln: F.concat(F.lit("    "), ln)), "\n"
    )
    wrapped = F.concat(F.lit("def wrapper():\n"), indented)
    return (
        numbered.withColumn("renamed", _renamed(F.col("code"), draw))
        .withColumn("text", text)
        .select(
            F.when(F.col("variant") >= 2, wrapped).otherwise(F.col("text")).alias("code"),
            "label",
            "variant",
            "sample_key",
        )
    )


def upsample(
    samples: DataFrame, targets: dict[int, int] = C.TARGET_COUNTS, seed: int = C.SEED
) -> DataFrame:
    """Variants that fill each short class up to its target. A class without rows
    gets none. Only the keys of the wanted variants are ranked; their text is written
    afterwards."""
    short = (
        class_counts(samples)
        .join(F.broadcast(target_table(samples, targets)), "label")
        .filter(F.col("n") < F.col("k"))
        .select(
            "label",
            (F.col("k") - F.col("n")).alias("needed"),
            F.ceil((F.col("k") - F.col("n")) / (F.col("n") * _VARIANTS)).alias("rounds"),
        )
    )
    pool = samples.join(F.broadcast(short), "label")
    numbered = augmented(pool, F.col("rounds")).withColumn(
        "h", hash_order(F.col("sample_key"), seed)
    )
    limits = short.select("label", F.lit("needed").alias("cut"), F.col("needed").alias("k"))
    cuts = hash_cuts(numbered.select("label", "h"), limits).select("label", "cut_hash")
    wanted = numbered.join(F.broadcast(cuts), "label").filter(F.col("h") <= F.col("cut_hash"))
    return write_variants(wanted.drop("h", "cut_hash"))


def balance(
    samples: DataFrame, targets: dict[int, int] = C.TARGET_COUNTS, seed: int = C.SEED
) -> DataFrame:
    """Large classes cut to the target, short ones filled up to it."""
    columns = ["code", "label", "sample_key"]
    known = samples.filter(F.col("label").isin(list(targets)))
    kept = downsample(known, "sample_key", targets, seed).select(columns)
    return kept.unionByName(upsample(known, targets, seed).select(columns))


def shuffled(samples: DataFrame, seed: int = C.SEED) -> DataFrame:
    """Random order, as a range-partitioned sort; only useful right before a write."""
    return samples.orderBy(hash_order(F.col("sample_key"), seed))


# --- class distribution --------------------------------------------------------------------


def _class_dimension(spark: SparkSession) -> DataFrame:
    entries = F.create_map(*[F.lit(x) for item in C.CLASS_NAMES.items() for x in item])
    return spark.range(1).select(F.explode(entries).alias("label", "class_name"))


def class_distribution(samples: DataFrame) -> DataFrame:
    """A2: count and percent of every class, those without rows included."""
    counts = class_counts(samples)
    total = F.sum(F.coalesce("n", F.lit(0))).over(
        Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return (
        _class_dimension(samples.sparkSession)
        .join(counts, "label", "left")
        .withColumn("total", total)
        .select(
            "label",
            "class_name",
            F.coalesce("n", F.lit(0)).alias("n"),
            F.round(
                F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)) * 100, F.col("total")), F.lit(0.0)),
                4,
            ).alias("percent"),
        )
    )


def unknown_classes(samples: DataFrame) -> DataFrame:
    """A2: rows of every class id that is not a known one, nulls included. These rows take
    no part in the distribution, in balancing and in training."""
    known = F.coalesce(F.col("label").isin(list(C.CLASS_NAMES)), F.lit(False))
    return samples.filter(~known).groupBy("label").agg(F.count("*").alias("n"))


def short_classes(samples: DataFrame, floors: dict[int, int] = C.CLASS_FLOORS) -> DataFrame:
    """A3: classes below their floor, as warning rows."""
    floor = lookup(floors, F.col("label"), 0)
    return (
        class_distribution(samples)
        .select("label", "class_name", "n", floor.alias("floor"))
        .filter(F.col("n") < F.col("floor"))
    )


def class_weights(samples: DataFrame) -> DataFrame:
    """A4: total / (classes * count); a class without rows counts as one row."""
    counts = class_distribution(samples)
    total = F.sum("n").over(
        Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return counts.withColumn("total", total).select(
        "label",
        (F.col("total") / (F.lit(C.NUM_CLASSES) * F.greatest("n", F.lit(1)))).alias("weight"),
    )
