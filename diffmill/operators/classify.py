"""Chunk classification around a scorer (ids P2 to P11, U5).

A scored chunk carries a ``prediction`` struct (see ``schemas.PREDICTION``). Where it
comes from does not matter here: a Spark ML model, a user's own model or a table.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffmill import constants as C
from diffmill.functions.rules import blank_code, borderline_type, high_signal_type, is_trivial, refined_by
from diffmill.functions.text import lookup
from diffmill.operators.diffs import within_size_limit
from diffmill.schemas import PREDICTION


def reviewable(chunks: DataFrame) -> DataFrame:
    """Chunks worth a score. Runs before the scorer on purpose; the optimizer
    does not move filters below Python or model stages."""
    return within_size_limit(chunks).filter(~is_trivial(F.col("code")))


def _prediction(label: str, confidence: float, label_id: int) -> Column:
    return F.struct(
        F.lit(label).alias("label"),
        F.lit(confidence).alias("confidence"),
        F.lit(label_id).alias("label_id"),
        F.lit(None).cast("map<int,double>").alias("all_probs"),
    ).cast(PREDICTION)


CLEAN_PREDICTION = ("Clean", 0.0, 0)
ERROR_PREDICTION = ("Error", 0.0, -1)
NO_MODEL_PREDICTION = ("CODE_SMELL", 0.0, 0)


def guarded_prediction(code: Column, prediction: Column) -> Column:
    """Blank code is clean without a score, a missing score is an error."""
    return F.when(blank_code(code), _prediction(*CLEAN_PREDICTION)).otherwise(
        F.coalesce(prediction, _prediction(*ERROR_PREDICTION))
    )


def score_from_table(chunks: DataFrame, scores: DataFrame) -> DataFrame:
    """Predictions made elsewhere, joined by chunk; chunks without one become errors."""
    joined = chunks.join(
        scores.select("pr_id", "chunk_index", "prediction"), ["pr_id", "chunk_index"], "left"
    )
    return joined.withColumn(
        "prediction", guarded_prediction(F.col("code"), F.col("prediction"))
    )


def score_without_model(chunks: DataFrame) -> DataFrame:
    """With no scorer every chunk is a code smell of confidence zero."""
    return chunks.withColumn("prediction", _prediction(*NO_MODEL_PREDICTION))


def _labels(
    prediction: Column, threshold: float, multi_label_threshold: float
) -> Column:
    """Every likely class other than clean, in id order; else the top class."""
    likely = F.filter(
        F.array_sort(F.map_entries(prediction["all_probs"])),
        lambda e: (e["key"] != 0) & (e["value"] >= multi_label_threshold),
    )
    several = F.transform(
        likely,
        lambda e: F.struct(
            lookup_class(e["key"]).alias("label"),
            F.round(e["value"], 4).alias("confidence"),
            e["key"].alias("label_id"),
        ),
    )
    top = F.array(
        F.struct(
            F.coalesce(prediction["label"], F.lit("Clean")).alias("label"),
            F.coalesce(prediction["confidence"], F.lit(0.0)).alias("confidence"),
            F.coalesce(prediction["label_id"], F.lit(0)).alias("label_id"),
        )
    )
    return F.when(
        (F.coalesce(prediction["confidence"], F.lit(0.0)) >= threshold)
        & (F.size(likely) > 0),
        several,
    ).otherwise(top)


def lookup_class(class_id: Column) -> Column:
    pairs = [F.lit(x) for item in C.CLASS_NAMES.items() for x in item]
    return F.coalesce(
        F.element_at(F.create_map(*pairs), class_id),
        F.concat(F.lit("Unknown("), class_id.cast("string"), F.lit(")")),
    )


def issue_type_of(raw_label: Column) -> Column:
    """P8."""
    return lookup(C.ISSUE_TYPES, raw_label, C.DEFAULT_ISSUE_TYPE)


def gated_issue_type(
    issue_type: Column, confidence: Column, threshold: float = C.CONFIDENCE_THRESHOLD
) -> Column:
    """An unsure issue becomes a matter of code quality."""
    return F.when(
        (confidence < threshold) & ~issue_type.isin("Clean", "Code Quality"), "Code Quality"
    ).otherwise(issue_type)


def repaired_label_id(label_id: Column, before: Column, after: Column) -> Column:
    """A clean class id follows a type that refinement changed; others stay."""
    return F.when(
        (after != before) & (label_id == 0),
        lookup(C.ISSUE_TYPE_IDS, after, C.DEFAULT_ISSUE_TYPE_ID),
    ).otherwise(label_id)


def labels_of(
    scored: DataFrame,
    threshold: float = C.CONFIDENCE_THRESHOLD,
    multi_label_threshold: float = C.MULTI_LABEL_THRESHOLD,
) -> DataFrame:
    """U5 alone: one row per chunk and raw label, with the place among the chunk's labels.
    Several arise where classes are scored independently (``model.score_independently``)."""
    labels = _labels(F.col("prediction"), threshold, multi_label_threshold)
    return scored.select("pr_id", "chunk_index", F.posexplode(labels).alias("label_ord", "l")).select(
        "pr_id", "chunk_index", "label_ord", "l.*"
    )


def classify(
    scored: DataFrame,
    threshold: float = C.CONFIDENCE_THRESHOLD,
    multi_label_threshold: float = C.MULTI_LABEL_THRESHOLD,
) -> DataFrame:
    """One row per chunk and label. No shuffle.

    The rules read the code below the generator. Above it the optimizer would copy them into
    every filter on the label, and they would run two or three times for each label.
    """
    chunk = ["pr_id", "chunk_index", "code", "file", "start_line"]
    asked = scored.select(
        *chunk,
        _labels(F.col("prediction"), threshold, multi_label_threshold).alias("labels"),
        high_signal_type(F.col("code")).alias("high_signal"),
        borderline_type(F.col("code")).alias("borderline"),
    )
    exploded = asked.select(
        *chunk, "high_signal", "borderline", F.posexplode("labels").alias("label_ord", "l")
    )
    gated = exploded.withColumn(
        "gated",
        gated_issue_type(issue_type_of(F.col("l.label")), F.col("l.confidence"), threshold),
    )
    refined = gated.withColumn(
        "refined",
        refined_by(F.col("gated"), F.col("l.confidence"), F.col("high_signal"), F.col("borderline")),
    )
    return refined.select(
        "pr_id",
        "chunk_index",
        "label_ord",
        F.col("refined").alias("label"),
        F.col("l.confidence").alias("confidence"),
        repaired_label_id(F.col("l.label_id"), F.col("gated"), F.col("refined")).alias(
            "label_id"
        ),
        (F.col("l.label_id") == -1).alias("is_error"),
        "code",
        "file",
        "start_line",
    )
