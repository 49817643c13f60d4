"""Issue filter, ranking and top-k (ids P12, W1, W2).

The groups are the issues of one pull request, and all of them stem from one diff row,
so no group outgrows a single input row.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffmill import constants as C
from diffmill.functions.text import lookup


def severity_rank(label_id: Column) -> Column:
    return lookup(C.SEVERITY_RANKS, label_id, 0)


def issues_only(classifications: DataFrame) -> DataFrame:
    """Everything but clean; a missing class id counts as clean."""
    return classifications.filter(F.coalesce("label_id", F.lit(0)) != 0)


def _rank() -> Column:
    order = Window.partitionBy("pr_id").orderBy(
        severity_rank(F.col("label_id")).desc(),
        F.coalesce("confidence", F.lit(0.0)).desc(),
        "chunk_index",
        "label_ord",
    )
    return F.row_number().over(order)


def prioritize(classifications: DataFrame) -> DataFrame:
    """Issues numbered from 1 per pull request, most severe first."""
    return issues_only(classifications).withColumn("issue_idx", _rank())


def top_issues(classifications: DataFrame, limit: int = C.MAX_INLINE_COMMENTS) -> DataFrame:
    """The first issues of each pull request. The filter right above the ranking lets
    Spark cut each partition to ``limit`` rows per key before the shuffle."""
    return prioritize(classifications).filter(F.col("issue_idx") <= limit)
