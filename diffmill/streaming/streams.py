"""Streams (ids X1 to X3)."""

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from diffmill.operators.review import status_body
from diffmill.plans.review_job import Review
from diffmill.sources.buckets import BUCKETS, PlaceIndex
from diffmill.sources.events import pr_key, reviewed_events, webhook_events
from diffmill.sources.products import write_part
from diffmill.sources.staging import run, staged

_STORE = "spark.sql.streaming.stateStore."
#: State in files, of which an executor keeps so many MB in memory. Rows are not counted, which takes a look-up each.
LARGE_STATE = {
    _STORE + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    _STORE + "rocksdb.changelogCheckpointing.enabled": "true",
    _STORE + "rocksdb.trackTotalNumberOfRows": "false",
    _STORE + "rocksdb.boundedMemoryUsage": "true",
    _STORE + "rocksdb.maxMemoryUsageMB": "256",
}


@contextmanager
def large_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in files. Spark's default keeps all of it on the heap
    of the executors, with the version before. A checkpoint keeps the store that it began with."""
    before = {key: spark.conf.get(key, None) for key in LARGE_STATE}
    try:
        for key, value in LARGE_STATE.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def request_counts(
    requests: DataFrame,
    limit: int,
    window: str = "1 minute",
    key: str = "client",
    watermark: str = "10 minutes",
) -> DataFrame:
    """Requests per client and time window, and whether they exceed the limit.

    Same code for a batch and a stream (columns ts and ``key``). On a stream the
    watermark bounds the state to the open windows.
    """
    if requests.isStreaming:
        requests = requests.withWatermark("ts", watermark)
    counts = requests.groupBy(F.window("ts", window), key).agg(F.count("*").alias("requests"))
    return counts.select(
        key,
        F.col("window.start").alias("window_start"),
        "requests",
        (F.col("requests") > limit).alias("over_limit"),
    )


def first_comments(comments: DataFrame, horizon: timedelta = timedelta(days=90), ts: str | None = None) -> DataFrame:
    """The first comment per pull request, file and line.

    On a stream a place is kept for ``horizon`` after it was seen, by the clock, or by the
    comments' own times if ``ts`` names that column; then the next batch removes its state, and after that a
    comment on it counts as a first one again. ``review_events`` asks the index of places instead, which
    forgets nothing. A place takes about 200 bytes of state: start streams of many places in ``large_state``.
    """
    place = ["pr_id", "file", "line"]
    if not comments.isStreaming:
        return comments.dropDuplicates(place)
    # a state row lives for the delay beyond its own time, and the watermark is as far behind
    delay = f"{int(horizon.total_seconds() * 1000) // 2} milliseconds"
    if ts is not None:
        return comments.withWatermark(ts, delay).dropDuplicatesWithinWatermark(place)
    seen = comments.withColumn("_seen_at", F.current_timestamp()).withWatermark("_seen_at", delay)
    return seen.dropDuplicatesWithinWatermark(place).drop("_seen_at")


def events_to_prs(payloads: DataFrame) -> DataFrame:
    """Events that start a review, with ``number`` and the key ``pr_id`` of
    repository and number."""
    events = reviewed_events(webhook_events(payloads))
    numbered = events.withColumn("number", F.col("pr_number").try_cast("bigint"))
    return numbered.filter(F.col("number").isNotNull()).withColumn(
        "pr_id", pr_key(F.col("repo"), F.col("number"))
    )


def review_events(
    payloads: DataFrame,
    review: Callable[[DataFrame, DataFrame], Review],
    sink_path: str,
    checkpoint_path: str,
    trigger: dict | None = None,
    fan: int = 16,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Review the pull requests of each micro-batch and write the products.

    ``review(prs, places)`` gets the pull requests (pr_id, repo, number, has_commit) and the
    places that earlier batches commented in them; diffs and answers must carry that pr_id
    (``sources.events.pr_key``). An event is acknowledged by the source's offset log
    and processed afterwards. A pull request with several events in a batch is reviewed
    once; one that comes back in a later batch is reviewed again, but gets no second
    comment on the same line. Every batch writes its own part of the sink, all products in
    one write, so a reader (``sources.products.read_product``) sees all of them or none, and a
    retried batch replaces what it wrote. Places are kept in an index by bucket
    (``sources.buckets.PlaceIndex``); a batch reads those of its own buckets from the batches
    before it. What ``review`` stages goes with the batch.
    """
    spark = payloads.sparkSession
    index = PlaceIndex(spark, f"{sink_path}-places", fan, buckets)

    def process(batch: DataFrame, batch_id: int) -> None:
        events = (
            events_to_prs(batch)
            .groupBy("pr_id", "repo", "number")
            .agg((F.max(F.length("head_sha")) > 0).alias("has_commit"))
        )
        with run(spark, f"batch-{batch_id}"):
            prs = staged(events, "prs")
            index.merge(batch_id)
            products = review(prs, index.of(prs, batch_id)).products()
            for name in ("reviews", "posted"):  # the status texts are made of both
                products[name] = staged(products[name], name)
            products["status"] = status_body(products["reviews"], products["posted"]).select(products["status"].columns)
            write_part(products, sink_path, batch_id)
            index.add(products["posted"], batch_id)

    writer = payloads.writeStream.foreachBatch(process).option(
        "checkpointLocation", checkpoint_path
    )
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
