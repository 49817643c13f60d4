"""Webhook events (S6, P13) and existing comments."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffmill import constants as C
from diffmill.schemas import WEBHOOK_PAYLOAD


def webhook_events(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Flat events from JSON payloads, with a default per field. Works on a batch
    and on a stream; the other columns are kept."""
    others = [c for c in payloads.columns if c != column]
    event = payloads.select(*others, F.from_json(column, WEBHOOK_PAYLOAD).alias("e"))
    return event.select(
        *others,
        F.coalesce("e.action", F.lit("")).alias("action"),
        F.coalesce("e.repository.full_name", F.lit("unknown")).alias("repo"),
        F.coalesce(F.col("e.pull_request.number").cast("string"), F.lit("?")).alias("pr_number"),
        F.coalesce("e.pull_request.head.sha", F.lit("")).alias("head_sha"),
        F.col("e.installation.id").alias("installation_id"),
    )


def payload_fault(payload: Column) -> Column:
    """Why a payload gives no event; null if it does."""
    parsed = F.try_parse_json(payload)
    return (
        F.when(payload.isNull(), "no payload")
        .when(parsed.isNull(), "no JSON")
        .when(~F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), "no object")
    )


def sound_payloads(payloads: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Payloads that are JSON objects, and all others with the ``reason``. Works on a
    batch and on a stream; a stream gives two, to be written each on its own."""
    marked = payloads.withColumn("reason", payload_fault(F.col(column)))
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def reviewed_events(events: DataFrame) -> DataFrame:
    """Events that start a review; an installation id of zero counts as missing."""
    return events.filter(
        F.col("action").isin(C.REVIEWED_ACTIONS)
        & (F.coalesce("installation_id", F.lit(0)) != 0)
    )


def pr_key(repo: Column, number: Column) -> Column:
    """The id of a pull request of an event: 60 bits of the hash of its repository and
    number, because numbers repeat between repositories."""
    name = F.concat(repo, F.lit("#"), number.cast("string"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("bigint")


def commented_places(existing: DataFrame) -> DataFrame:
    """File and line of earlier comments of this product. A line of zero counts as
    missing."""
    return existing.filter(F.contains("body", F.lit(C.PRODUCT))).select(
        "pr_id",
        F.coalesce("path", F.lit("")).alias("file"),
        F.coalesce(
            F.nullif("line", F.lit(0)), F.nullif("original_line", F.lit(0)), F.lit(0)
        ).alias("line"),
    )
