"""Inputs of the driver queries, derived from the test tables.

All derivations work within a row: they add no shuffle of their own, so what a query
costs is the cost of its operators.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diffmill import constants as C
from diffmill.functions.text import lookup
from diffmill.operators.classify import guarded_prediction
from diffmill.schemas import PREDICTION
from workload import snippets as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Narrow rows dealt to as many tasks as a shuffle has, whatever files they come from.
    The texts derived from them are far larger than they are."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = (
        "array_join(transform(sequence(0L, o_orderkey % 6), i -> "
        + S.block("spark")
        + "), chr(10))"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return spread(orders).selectExpr(
        "o_orderkey AS pr_id", S.whole_diff(blocks) + " AS diff"
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber")
    row = "struct(" + ", ".join(S.corpus_columns("spark")) + ")"
    # a generator, so that filters on the text stay behind the exchange of spread()
    return spread(items).selectExpr(f"inline(array({row}))")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "ts", S.payload() + " AS payload")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = (
        "array_join(transform(sequence(0L, pr_id % 9), i -> " + S.response_element() + "), ',')"
    )
    prs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pr_id"))
    return spread(prs).selectExpr("pr_id", S.whole_response(elements) + " AS response")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five stories: success, rate limit then fallback, time-outs, failure, late success."""
    story = """
      CASE o_orderkey % 5
        WHEN 0 THEN array(struct(0 AS m, 1 AS a, CAST(NULL AS STRING) AS e, 'first' AS c))
        WHEN 1 THEN array(struct(0 AS m, 1 AS a, 'HTTP 429: Quota' AS e, CAST(NULL AS STRING) AS c),
                          struct(0 AS m, 2 AS a, CAST(NULL AS STRING) AS e, 'ignored' AS c),
                          struct(1 AS m, 1 AS a, CAST(NULL AS STRING) AS e, 'fallback' AS c))
        WHEN 2 THEN array(struct(0 AS m, 1 AS a, 'timeout' AS e, CAST(NULL AS STRING) AS c),
                          struct(0 AS m, 2 AS a, 'timeout' AS e, CAST(NULL AS STRING) AS c),
                          struct(0 AS m, 3 AS a, CAST(NULL AS STRING) AS e, 'third' AS c))
        WHEN 3 THEN array(struct(0 AS m, 1 AS a, 'Tokens per DAY used up' AS e, CAST(NULL AS STRING) AS c),
                          struct(1 AS m, 1 AS a, 'rate_limit' AS e, CAST(NULL AS STRING) AS c))
        ELSE array(struct(0 AS m, 4 AS a, CAST(NULL AS STRING) AS e, 'too late' AS c)) END"""
    return (
        table(spark, sf_dir, "orders")
        .select(F.col("o_orderkey").alias("pr_id"), F.inline(F.expr(story)))
        .toDF("pr_id", "model_rank", "attempt", "error", "content")
    )


def _number() -> Column:
    return F.col("pr_id") % 1_000_003 * 31 + F.col("chunk_index") * 17 + F.length("code") * 7


def prediction() -> Column:
    """Prediction by a formula over the chunk; one class in six is a failed score."""
    h = _number()
    names = lookup(C.CLASS_NAMES, (h % 6).cast("int"), "Error")
    probs = F.map_from_arrays(
        F.array(*[F.lit(i) for i in range(5)]),
        F.array(*[((h + 37 * i) % 101) / F.lit(100.0) for i in range(5)]),
    )
    found = F.struct(
        names.alias("label"),
        ((h % 101) / F.lit(100.0)).alias("confidence"),
        (h % 6).cast("int").alias("label_id"),
        F.when(h % 3 == 0, probs).alias("all_probs"),
    ).cast(PREDICTION)
    return F.when(h % 6 != 5, found)


def formula_scorer(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("prediction", guarded_prediction(F.col("code"), prediction()))


def existing_comments(comments: DataFrame) -> DataFrame:
    """Earlier comments: a quarter of the planned ones, some by others or moved."""
    h = F.col("pr_id") + F.col("issue_idx")
    return comments.filter(h % 4 == 0).select(
        "pr_id",
        F.col("file").alias("path"),
        F.when(h % 8 == 0, F.col("line")).otherwise(
            F.when(h % 3 == 0, F.lit(0).cast("bigint"))
        ).alias("line"),
        F.col("line").alias("original_line"),
        F.when(h % 12 == 0, F.lit("by someone else"))
        .otherwise(F.concat(F.lit("by "), F.lit(C.PRODUCT)))
        .alias("body"),
    )
