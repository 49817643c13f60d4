"""Classifier metrics and detection reports (ids A5 to A7, A14, A15).

Everything starts from counts per (true, predicted) pair, which are combined on the map
side; whatever follows works on at most a few dozen rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffmill import constants as C


def confusion_counts(predicted: DataFrame, *by: str) -> DataFrame:
    """A5, long form: rows per true class ``label`` and predicted class ``pred``."""
    return predicted.groupBy(*by, "label", "pred").agg(F.count("*").alias("n"))


def confusion_matrix(predicted: DataFrame) -> DataFrame:
    """A5: one row per class that occurs on either side, one column per known class and
    one, ``pred_other``, for all other predictions, failed and missing ones included. So
    the sum of a row is the support of its class."""
    counts = confusion_counts(predicted)
    # a class that was only predicted gets a row of zeros
    only_predicted = F.struct(
        F.col("pred").alias("label"), F.lit(None).cast("int").alias("pred"), F.lit(0).cast("bigint").alias("n")
    )
    sides = F.array(F.struct("label", "pred", "n"), only_predicted)
    known = [F.col("pred") == c for c in C.CLASS_NAMES]
    other = ~F.coalesce(F.col("pred").isin(list(C.CLASS_NAMES)), F.lit(False))
    return (
        counts.select(F.inline(sides))
        .groupBy("label")
        .agg(
            *[_count_if(hit).alias(f"pred_{c}") for c, hit in zip(C.CLASS_NAMES, known, strict=True)],
            _count_if(other).alias("pred_other"),
        )
    )


def _count_if(hit: Column) -> Column:
    return F.sum(F.when(hit, F.col("n")).otherwise(0))


def _ratio(top, bottom):
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def class_metrics(predicted: DataFrame, *by: str) -> DataFrame:
    """Precision, recall, F1 and support of each class that occurs on either side."""
    sides = F.array(
        F.struct(
            F.col("label").alias("class_id"),
            F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"),
            F.col("n").alias("support"),
            F.lit(0).cast("bigint").alias("predicted"),
        ),
        F.struct(
            F.col("pred").alias("class_id"),
            F.lit(0).cast("bigint").alias("hit"),
            F.lit(0).cast("bigint").alias("support"),
            F.col("n").alias("predicted"),
        ),
    )
    sums = (
        confusion_counts(predicted, *by)
        .select(*by, F.inline(sides))
        .groupBy(*by, "class_id")
        .agg(*[F.sum(c).alias(c) for c in ("hit", "support", "predicted")])
    )
    precision = _ratio(F.col("hit"), F.col("predicted"))
    recall = _ratio(F.col("hit"), F.col("support"))
    # 2pr/(p+r) in counts
    f1 = _ratio(F.col("hit") * 2, F.col("support") + F.col("predicted"))
    return sums.select(
        *by,
        "class_id",
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
        "support",
        "hit",
    )


def summary_metrics(predicted: DataFrame, *by: str) -> DataFrame:
    """Accuracy, macro and weighted averages."""

    def weighted(name: str):
        return _ratio(F.sum(F.col(name) * F.col("support")), F.sum("support")).alias(
            f"weighted_{name}"
        )

    names = ("precision", "recall", "f1")
    return (
        class_metrics(predicted, *by)
        .groupBy(*by)
        .agg(
            _ratio(F.sum("hit"), F.sum("support")).alias("accuracy"),
            *[F.avg(n).alias(f"macro_{n}") for n in names],
            *[weighted(n) for n in names],
            F.sum("support").alias("support"),
        )
    )


def best_candidate(predicted: DataFrame) -> DataFrame:
    """Candidate with the highest weighted F1; the earliest wins a tie, and one
    with an F1 of zero never wins. ``predicted(candidate, label, pred)``."""
    scores = summary_metrics(predicted, "candidate").filter(F.col("weighted_f1") > 0)
    best = F.max_by(
        F.struct("candidate", "accuracy", "weighted_f1"),
        F.struct("weighted_f1", -F.col("candidate")),
    )
    return scores.agg(best.alias("best")).filter(F.col("best").isNotNull()).select("best.*")


def detection_report(issues: DataFrame) -> DataFrame:
    """Issues and mean confidence per file and label, per file, and in total."""
    return issues.rollup("file", "label").agg(
        F.count("*").alias("issues"), F.avg("confidence").alias("mean_confidence")
    )


def snippet_accuracy(predicted: DataFrame, floor: float = 0.5) -> DataFrame:
    """Share of right predictions and whether it reaches the floor."""
    return predicted.agg(
        F.count("*").alias("snippets"),
        F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"),
    ).withColumn("reaches_floor", F.col("accuracy") >= floor)
