"""The corpus job (M4): code corpus to balanced, split training samples."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from diffmill import constants as C
from diffmill.operators.corpus import (
    balance,
    class_distribution,
    distinct_code,
    label_code,
    short_classes,
    with_seeds,
    without_nulls,
)
from diffmill.operators.selection import stratified_split, subsample
from diffmill.sources.diffs import corpus_code
from diffmill.sources.staging import staged


@dataclass
class TrainingSet:
    labelled: DataFrame
    balanced: DataFrame
    distribution: DataFrame
    warnings: DataFrame
    split: DataFrame


def labelled_corpus(corpus: DataFrame, sample_rows: int | None = None, key: str | None = None) -> DataFrame:
    """Source, filter, label, distinct: samples without seeds. Subsampling is off unless
    a number of rows and the key column of the corpus are given."""
    code = corpus_code(corpus)
    if sample_rows is not None:
        code = subsample(code, key, sample_rows)
    return distinct_code(without_nulls(label_code(code)), ["label"])


def training_set(
    corpus: DataFrame, targets: dict[int, int] = C.TARGET_COUNTS, stage: bool = True
) -> TrainingSet:
    """The whole job. Corpus and seeds are made distinct in one step: of two equal codes
    the one of the corpus is kept.

    The labelled set is staged, because balancing reads it several times; so is the
    balanced set, which is checked, counted and split.
    """
    samples = with_seeds(without_nulls(label_code(corpus_code(corpus))))
    labelled = distinct_code(samples, ["source_rank", "label"]).drop("source_rank")
    if stage:
        labelled = staged(labelled, "labelled")
    balanced = balance(labelled, targets)
    if stage:
        balanced = staged(balanced, "balanced")
    return TrainingSet(
        labelled,
        balanced,
        class_distribution(balanced),
        short_classes(balanced),
        stratified_split(balanced, "sample_key"),
    )
