"""Classifier: training, candidate choice and scoring (ids M1 to M3)."""

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, OneVsRest
from pyspark.ml.feature import IDF, HashingTF, IDFModel, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffmill.functions.rules import blank_code
from diffmill.operators.classify import guarded_prediction, lookup_class
from diffmill.operators.corpus import class_weights
from diffmill.operators.metrics import best_candidate
from diffmill.schemas import PREDICTION
from diffmill.sources.staging import staged

DEFAULT_CANDIDATES = (0.001, 0.01, 0.1)
_TOKEN = r"\w+|[^\w\s]"
#: Codes read at once, and tokens whose place among the features a task remembers.
_CODES_READ, _TOKENS_KEPT = 1000, 1 << 18


def token_features(features: int = 1 << 16) -> Pipeline:
    """Weighted bag of code tokens."""
    return Pipeline(
        stages=[
            RegexTokenizer(
                inputCol="code",
                outputCol="tokens",
                pattern=_TOKEN,
                gaps=False,
                toLowercase=False,
            ),
            HashingTF(inputCol="tokens", outputCol="counts", numFeatures=features),
            IDF(inputCol="counts", outputCol="features"),
        ]
    )


def classifier(regularization: float) -> LogisticRegression:
    """Multinomial regression over the five classes."""
    return LogisticRegression(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        family="multinomial",
        regParam=regularization,
        maxIter=50,
    )


def weighted_samples(samples: DataFrame) -> DataFrame:
    """A4 joined to the samples; the weight table has one row per class."""
    return samples.join(F.broadcast(class_weights(samples)), "label")


def train(
    train_part: DataFrame,
    val_part: DataFrame,
    candidates: Sequence[float] = DEFAULT_CANDIDATES,
    features: int = 1 << 16,
) -> tuple[PipelineModel, DataFrame]:
    """M3: fit one model per regularization, keep the one with the best weighted F1 on
    the validation part. Returns the model and the row that describes it.

    The features are fitted once and shared by all candidates. Only the choice of one row
    reaches the driver.
    """
    weighted = weighted_samples(train_part)
    tokens = token_features(features).fit(weighted)
    prepared = tokens.transform(weighted).select("features", "label", "weight")
    validation = tokens.transform(val_part).select("features", "label")
    fitted = [classifier(reg).fit(prepared) for reg in candidates]
    models = [PipelineModel(stages=[*tokens.stages, model]) for model in fitted]
    predicted = None
    for number, model in enumerate(fitted):
        part = model.transform(validation).select(
            F.lit(number).alias("candidate"), "label", F.col("prediction").cast("int").alias("pred")
        )
        predicted = part if predicted is None else predicted.unionByName(part)
    best = best_candidate(predicted)
    chosen = best.first()
    return models[chosen["candidate"] if chosen else 0], best


def prediction_struct(probabilities: Column) -> Column:
    """Probabilities by class id to the prediction of the schema."""
    rounded = F.transform(probabilities, lambda p: F.round(p, 4))
    top = F.array_position(probabilities, F.array_max(probabilities)) - 1
    label_id = top.cast("int")
    ids = F.transform(rounded, lambda p, i: i)
    return F.struct(
        lookup_class(label_id).alias("label"),
        F.element_at(rounded, label_id + 1).alias("confidence"),
        label_id.alias("label_id"),
        F.map_from_arrays(ids, rounded).alias("all_probs"),
    ).cast(PREDICTION)


def softmax(logits: Column) -> Column:
    """Class probabilities from raw scores."""
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(shifted, lambda x: x / total)


def _token_weights(model: PipelineModel) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights (class, feature) and intercepts of a model that ``train`` made, whose classes weigh
    hashed tokens of the column ``code``. None for any other model."""
    stages = model.stages
    if [type(s) for s in stages] != [RegexTokenizer, HashingTF, IDFModel, LogisticRegressionModel]:
        return None
    words, hashed, idf, last = stages
    columns = [(words.getInputCol(), "code")] + [
        (b.getFeaturesCol() if b is last else b.getInputCol(), a.getOutputCol()) for a, b in zip(stages, stages[1:])
    ]
    plain = words.getPattern() == _TOKEN and words.getMinTokenLength() <= 1 and not (words.getGaps() or words.getToLowercase())
    weights = last.coefficientMatrix.toArray()
    if any(a != b for a, b in columns) or not plain or hashed.getBinary() or len(weights) < 2:
        return None
    return weights * idf.idf.toArray(), last.interceptVector.toArray()


def _token_scorer(size: int) -> Callable[[np.ndarray, np.ndarray], Callable[[list[str]], np.ndarray]]:
    """From weights and intercepts to a function that gives the class probabilities of codes, one
    row for each. Made of local names alone, so that it goes to the workers by value."""
    tokens_of, most = re.compile(_TOKEN, re.ASCII).findall, _TOKENS_KEPT

    def place(token: str) -> int:
        """Where ``HashingTF`` counts a token: MurmurHash3 of its bytes, as a signed number."""
        data = token.encode()
        whole, h, low = len(data) & ~3, 42, 0xFFFFFFFF

        def mixed(k: int) -> int:
            k = k * 0xCC9E2D51 & low
            return (k << 15 | k >> 17) * 0x1B873593 & low

        for i in range(0, whole, 4):
            h ^= mixed(int.from_bytes(data[i : i + 4], "little"))
            h = (h << 13 | h >> 19) * 5 + 0xE6546B64 & low
        if whole < len(data):
            h ^= mixed(int.from_bytes(data[whole:], "little"))
        h ^= len(data)
        h = (h ^ h >> 16) * 0x85EBCA6B & low
        h = (h ^ h >> 13) * 0xC2B2AE35 & low
        h ^= h >> 16
        return (h - (1 << 32) if h >> 31 else h) % size

    def load(weights: np.ndarray, intercepts: np.ndarray) -> Callable[[list[str]], np.ndarray]:
        class Places(dict):
            def __missing__(self, token: str) -> int:
                if len(self) >= most:
                    self.clear()
                found = self[token] = place(token)
                return found

        places = Places()

        def scores(codes: list[str]) -> np.ndarray:
            tokens, counts = [], []
            for code in codes:
                found = tokens_of(code)
                counts.append(len(found))
                tokens += found
            at = np.fromiter(map(places.__getitem__, tokens), np.int64, len(tokens))
            rows = np.repeat(np.arange(len(codes)), counts)
            sums = [np.bincount(rows, own[at], len(codes)) + base for own, base in zip(weights, intercepts)]
            margins = np.stack(sums, axis=1)
            highest = margins.max(axis=1, keepdims=True)
            certain = np.isposinf(highest)  # all samples had this class
            shares = np.exp(np.where(certain, 0.0, margins - np.where(certain, 0.0, highest)))
            shares /= shares.sum(axis=1, keepdims=True)
            return np.where(certain, np.arange(len(intercepts)) == margins.argmax(axis=1)[:, None], shares)

        return scores

    return load


def _rounder() -> Callable[[np.ndarray], np.ndarray]:
    """Four decimals as Spark's ``round`` gives them: half up, by the decimal digits of a number."""

    def rounded(shares: np.ndarray) -> np.ndarray:
        scaled = shares * 1e4
        out = np.floor(scaled + 0.5) / 1e4
        for at in zip(*np.nonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6)):
            out[at] = float(Decimal(repr(float(shares[at]))).quantize(Decimal("0.0001"), ROUND_HALF_UP))
        return out

    return rounded


def _score_tokens(chunks: DataFrame, weights: np.ndarray, intercepts: np.ndarray) -> DataFrame:
    """``score_with_model`` for models of ``train``: tokens are read, hashed and weighed in Arrow
    batches, where the model's own stages pass a vector on from one to the next for each row."""
    names = [f"_share_{k}" for k in range(len(intercepts))]
    extra = [T.StructField("_top", T.IntegerType()), T.StructField("_confidence", T.DoubleType())]
    extra += [T.StructField(name, T.DoubleType()) for name in names]
    at, read = chunks.columns.index("code"), _CODES_READ
    shared = chunks.sparkSession.sparkContext.broadcast((weights, intercepts))
    load, rounded, added = _token_scorer(weights.shape[1]), _rounder(), [f.name for f in extra]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = load(*shared.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, read):
                part = batch.slice(begin, read)
                # as bytes: a text that is no sound UTF-8 must not end the job
                codes = [(c or b"").decode("utf-8", "replace") for c in part.column(at).cast(pa.large_binary()).to_pylist()]
                found = scores(codes)
                top, found = found.argmax(axis=1), rounded(found)
                own = [pa.array(top.astype(np.int32)), pa.array(found[np.arange(len(top)), top])]
                own += [pa.array(np.ascontiguousarray(found[:, k])) for k in range(found.shape[1])]
                yield pa.RecordBatch.from_arrays([*part.columns, *own], names=[*part.schema.names, *added])

    scored = chunks.mapInArrow(score, T.StructType([*chunks.schema, *extra]))
    predicted = F.struct(
        lookup_class(F.col("_top")).alias("label"),
        F.col("_confidence").alias("confidence"),
        F.col("_top").alias("label_id"),
        F.create_map(*[x for k, name in enumerate(names) for x in (F.lit(k), F.col(name))]).alias("all_probs"),
    ).cast(PREDICTION)
    return scored.select(*chunks.columns, guarded_prediction(F.col("code"), predicted).alias("prediction"))


def score_with_model(chunks: DataFrame, model: PipelineModel) -> DataFrame:
    """M1 and M2: chunks or samples with a ``prediction``. The whole code is read."""
    columns = chunks.columns
    parts = _token_weights(model)
    # Arrow has no types of users, such as vectors
    if parts is not None and not any(isinstance(f.dataType, T.UserDefinedType) for f in chunks.schema):
        return _score_tokens(chunks, *parts)
    scored = model.transform(chunks)
    probabilities = vector_to_array(F.col("probability"))
    return scored.select(
        *columns,
        guarded_prediction(F.col("code"), prediction_struct(probabilities)).alias("prediction"),
    )


def score_with_function(
    chunks: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], error: str | None = None
) -> DataFrame:
    """M1 with a user's own model. ``load()`` runs once per task and returns a function
    from a list of codes to an array with one row of class probabilities per code.

    Blank code is not sent to it. A batch that fails is halved until
    only the codes that fail by themselves are marked as errors (P6); what the function
    said of such a code goes to the column ``error``, if that is named.
    """
    columns = chunks.columns
    raw = chunks.withColumn("needs_score", ~blank_code(F.col("code")))
    schema = T.StructType(
        [*raw.schema, T.StructField("probabilities", T.ArrayType(T.DoubleType())), T.StructField("_failure", T.StringType())]
    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for batch in batches:
            # plain lists: a failing code is found by many small calls
            codes = batch["code"].tolist()
            scores, failures = [None] * len(batch), [None] * len(batch)
            waiting = [np.flatnonzero(batch["needs_score"]).tolist()]
            while waiting:
                wanted = waiting.pop()
                try:
                    found = list(predict([codes[at] for at in wanted])) if wanted else []
                    rows = [[float(p) for p in row] for row in found]
                    if len(rows) != len(wanted):
                        raise ValueError("not one row of probabilities per code")
                except Exception as failure:  # a failing scorer must not end the job
                    if len(wanted) > 1:  # find the code that fails
                        middle = len(wanted) // 2
                        waiting += [wanted[:middle], wanted[middle:]]
                    else:
                        failures[wanted[0]] = f"{type(failure).__name__}: {failure}"[:1000]
                    continue
                for at, row in zip(wanted, rows):
                    scores[at] = row
            yield batch.assign(
                probabilities=pd.Series(scores, index=batch.index, dtype=object),
                _failure=pd.Series(failures, index=batch.index, dtype=object),
            )

    scored = raw.mapInPandas(score, schema)
    predicted = F.when(
        F.col("probabilities").isNotNull(), prediction_struct(F.col("probabilities"))
    )
    said = [F.col("_failure").alias(error)] if error else []
    return scored.select(
        *columns, guarded_prediction(F.col("code"), predicted).alias("prediction"), *said
    )


@dataclass
class IndependentModels:
    """A model per class over shared features, and the curve that makes its margin a
    probability."""

    models: PipelineModel
    slopes: list[float]
    offsets: list[float]


def train_independent(
    train_part: DataFrame, val_part: DataFrame, regularization: float = 0.01, features: int = 1 << 16
) -> IndependentModels:
    """Is a sample of class k or not, for each class on its own, so that a chunk may have
    several. Features are formed once for all classes; margins are calibrated on the
    validation part. A class that it lacks keeps the plain curve."""
    tokens = token_features(features).fit(train_part)
    prepared = staged(tokens.transform(weighted_samples(train_part)).select("features", "label", "weight"), "independent-features")
    one = LogisticRegression(featuresCol="features", weightCol="weight", regParam=regularization, maxIter=50)
    rest = OneVsRest(classifier=one, featuresCol="features", labelCol="label", weightCol="weight", parallelism=5)
    fitted = rest.fit(prepared.withColumn("label", F.col("label").cast("double")))
    validation = tokens.transform(val_part).select("features", "label")
    margins = staged(fitted.transform(validation).select("label", vector_to_array("rawPrediction").alias("m")), "independent-margins")
    slopes, offsets = [], []
    for k in range(len(fitted.models)):
        own = margins.select((F.col("label") == k).cast("double").alias("label"), array_to_vector(F.array(F.col("m")[k])).alias("features"))
        if own.agg(F.count_distinct("label")).first()[0] < 2:
            slopes.append(1.0)
            offsets.append(0.0)
            continue
        curve = LogisticRegression(regParam=1e-4, standardization=False).fit(own)
        slopes.append(float(curve.coefficients[0]))
        offsets.append(float(curve.intercept))
    return IndependentModels(PipelineModel(stages=[*tokens.stages, fitted]), slopes, offsets)


def score_independently(chunks: DataFrame, model: IndependentModels) -> DataFrame:
    """Chunks or samples with a ``prediction`` whose probabilities are each its class's own."""
    margins = vector_to_array(F.col("rawPrediction"))
    curves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in zip(model.slopes, model.offsets)])
    probabilities = F.zip_with(margins, curves, lambda m, c: 1 / (1 + F.exp(-(c["a"] * m + c["b"]))))
    scored = model.models.transform(chunks)
    return scored.select(
        *chunks.columns, guarded_prediction(F.col("code"), prediction_struct(probabilities)).alias("prediction")
    )


def predicted_classes(scored: DataFrame) -> DataFrame:
    """(label, pred) of a scored labelled set, for the metrics."""
    return scored.select("label", F.col("prediction.label_id").alias("pred"))


