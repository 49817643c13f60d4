"""Events, comments and streams; stream and batch give the same rows."""

import json
import random
import re
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from diffmill import schemas
from diffmill.constants import PRODUCT
from diffmill.plans.review_job import find_issues, write_reviews
from diffmill.sources.diffs import read_diff_files, rejected_diffs, submitted_diffs
from diffmill.sources import staging
from diffmill.sources.buckets import PlaceIndex, read_bucketed, write_bucketed
from diffmill.sources.events import commented_places, pr_key, reviewed_events, sound_payloads, webhook_events
from diffmill.sources.products import read_product, write_part
from diffmill.streaming.admission import _decided, _outcomes, admitted
from diffmill.streaming.streams import LARGE_STATE, first_comments, large_state, request_counts, review_events
from diffmill.operators.classify import score_without_model


def event(number=1, action="opened", installation=5, sha="abc", repo="o/r"):
    return json.dumps(
        {
            "action": action,
            "repository": {"full_name": repo},
            "pull_request": {"number": number, "head": {"sha": sha}},
            "installation": {"id": installation},
        }
    )


def test_event_defaults_and_filter(spark):
    payloads = [event(), event(action="closed"), event(installation=0), "{}", "not json", event(2, "reopened")]
    events = webhook_events(spark.createDataFrame([(p,) for p in payloads], "payload string"))
    rows = events.collect()
    assert (rows[3].action, rows[3].repo, rows[3].pr_number, rows[3].head_sha) == ("", "unknown", "?", "")
    assert rows[4].action == "" and rows[4].installation_id is None
    assert [r.pr_number for r in reviewed_events(events).collect()] == ["1", "2"]


def test_commented_places(spark):
    rows = [
        (1, "a.py", 3, 9, f"by {PRODUCT}"),
        (1, "a.py", 0, 9, PRODUCT),
        (1, None, None, None, PRODUCT),
        (1, "a.py", 5, 9, "someone"),
        (1, "a.py", 5, 9, None),
    ]
    places = commented_places(spark.createDataFrame(rows, schemas.EXISTING_COMMENTS))
    assert [(r.file, r.line) for r in places.collect()] == [("a.py", 3), ("a.py", 9), ("", 0)]


def test_diff_sources(spark, tmp_path):
    (tmp_path / "pr_12.diff").write_text("+a\n+b\n")
    (tmp_path / "7.diff").write_text(" \n")
    diffs = read_diff_files(spark, str(tmp_path))
    assert {(r.pr_id, r.diff) for r in diffs.collect()} == {(12, "+a\n+b\n"), (7, " \n")}
    assert [r.diff for r in submitted_diffs(diffs).collect()] == ["+a\n+b"]
    assert tuple(rejected_diffs(diffs).first()) == (1, 1)


def run_stream(df, path):
    query = (
        df.writeStream.format("parquet")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{path}/out")
    )
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out")


def test_request_counts_stream_equals_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("hot" if i % 3 else f"c{i % 5}", start + timedelta(seconds=7 * i)) for i in range(200)]
    rows.append(("late", start + timedelta(hours=2)))
    requests = spark.createDataFrame(rows, "client string, ts timestamp")
    requests.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(requests.schema).parquet(str(tmp_path / "in"))
    # the last window stays open on the stream
    batch = request_counts(requests, 5).filter("client <> 'late'")
    streamed = run_stream(request_counts(stream, 5), tmp_path)
    assert sorted(streamed.collect()) == sorted(batch.collect())
    assert batch.filter("over_limit").count() > 0


def test_first_comments_stream_equals_batch(spark, tmp_path):
    rows = [(i % 3, f"f{i % 4}", i % 5) for i in range(100)]
    comments = spark.createDataFrame(rows, "pr_id long, file string, line long")
    comments.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(comments.schema).parquet(str(tmp_path / "in"))
    streamed = run_stream(first_comments(stream), tmp_path)
    assert sorted(streamed.collect()) == sorted(comments.distinct().collect())


def test_large_state_is_kept_in_files(spark, tmp_path):
    """The store goes with the checkpoint, so a stream that goes on outside knows the places, too."""
    schema, source = "pr_id long, file string, line long", str(tmp_path / "in")
    before = {key: spark.conf.get(key, None) for key in LARGE_STATE}

    def more(number):
        rows = [(i % 3, f"f{i % 4}", i % 5 + number) for i in range(100)] + [(None, None, number)]
        spark.createDataFrame(rows, schema).write.parquet(f"{source}/b{number}")
        found = first_comments(spark.readStream.schema(schema).parquet(f"{source}/b*"))
        writer = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint"))
        return writer.trigger(availableNow=True).start(str(tmp_path / "out"))

    with large_state(spark):
        query = more(0)
    assert {key: spark.conf.get(key, None) for key in LARGE_STATE} == before
    query.awaitTermination()
    later = more(1)
    later.awaitTermination()
    for done in (query, later):
        assert "rocksdbGetCount" in {m for p in done.recentProgress for m in p["stateOperators"][0]["customMetrics"]}
    known = spark.read.schema(schema).parquet(f"{source}/b*").distinct()
    found = spark.read.schema(schema).parquet(str(tmp_path / "out"))
    assert found.count() == known.count() and found.exceptAll(known).count() == 0


def test_first_comments_query_keeps_its_state_in_files(spark, sf_dir):
    from workload.queries import QUERIES

    pattern = f"{staging.shared_dir(spark)}/diffmill/first-comments-*-checkpoint/offsets/0"
    earlier = staging.found(spark, pattern)
    QUERIES["x3_first_comments"](spark, sf_dir)
    (began,) = set(staging.found(spark, pattern)) - set(earlier)
    assert "RocksDBStateStoreProvider" in "".join(r.value for r in spark.read.text(began).collect())


def test_review_stream_posts_no_second_comment(spark, tmp_path):
    diff = "+++ b/a.py\n@@ -0,0 +1,2 @@\n+def f(x):\n+    return x / len(x)"
    names = [("o/r", 1), ("o/r", 2), ("o/r", 3), ("other/r", 2)]
    known = spark.createDataFrame([(*name, diff) for name in names], "repo string, number long, diff string")
    diffs = known.select(pr_key(F.col("repo"), F.col("number")).alias("pr_id"), "diff")
    name_of = dict(zip([r.pr_id for r in diffs.collect()], names))
    assert len(name_of) == 4
    responses = spark.createDataFrame([], schemas.RESPONSES)

    def review(prs, earlier):
        wanted = diffs.join(prs.select("pr_id"), "pr_id", "left_semi")
        found = find_issues(wanted, score_without_model, stage=True)
        return write_reviews(found, responses, earlier, prs.filter("has_commit"), stage=True)

    source = tmp_path / "in"
    batches = [
        [event(1), event(1, "synchronize"), event(2, sha=""), event(2, repo="other/r")],
        [event(1, "synchronize"), event(3), event(9, "closed")],
    ]
    sink = str(tmp_path / "sink")
    source.mkdir()
    for number, batch in enumerate(batches):
        # file names in order; each run takes what is new
        spark.createDataFrame([(p,) for p in batch], "payload string").coalesce(1).write.parquet(str(source / f"b{number}"))
        stream = spark.readStream.schema("payload string").parquet(str(source / "b*"))
        query = review_events(stream, review, sink, str(tmp_path / "checkpoint"), {"availableNow": True})
        query.awaitTermination()

    def table(name):
        schema = {"posted": schemas.COMMENTS, "status": schemas.STATUS, "reviews": schemas.REVIEWS}[name]
        return read_product(spark, sink, name, schema)

    posted = sorted((r.part, *name_of[r.pr_id], r.line) for r in table("posted").collect())
    # the head commit of one repository does not count for the other
    assert posted == [(0, "o/r", 1, 1), (0, "other/r", 2, 1), (1, "o/r", 3, 1)]
    status = {(r.part, *name_of[r.pr_id]): r.status_body for r in table("status").collect()}
    assert set(status) == {(0, "o/r", 1), (0, "o/r", 2), (0, "other/r", 2), (1, "o/r", 1), (1, "o/r", 3)}
    assert "1 issue detected" in status[(0, "o/r", 1)] and "Issues found" in status[(1, "o/r", 1)]
    assert table("reviews").count() == 5
    assert staging.found(spark, f"{staging.shared_dir(spark)}/diffmill/runs/*") == []


def test_first_comments_forget_places_after_the_horizon(spark, tmp_path):
    """State rows fall once the clock has passed the horizon; then a place is new again."""
    source, kept = str(tmp_path / "in"), []
    for number in range(4):
        rows = [(1, "a", 1), (number, f"f{number}", 7)]
        spark.createDataFrame(rows, "pr_id long, file string, line long").coalesce(1).write.parquet(f"{source}/b{number}")
        stream = spark.readStream.schema("pr_id long, file string, line long").parquet(f"{source}/b*")
        found = first_comments(stream, horizon=timedelta(seconds=30))
        assert found.columns == ["pr_id", "file", "line"]
        query = (
            found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint"))
            .trigger(availableNow=True).start(str(tmp_path / "out"))
        )
        query.awaitTermination()
        kept.append([p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress][-1])
        if number == 1:
            time.sleep(31)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    # seen within the horizon: once; beyond it: again
    assert sorted(r.file for r in rows if r.file != "a") == ["f0", "f1", "f2", "f3"]
    assert sum(r.file == "a" for r in rows) == 2
    assert kept[:2] == [2, 3] and kept[3] <= 3


def test_broken_payloads_are_kept_with_a_reason(spark):
    rows = [event(), "not json", "", "[]", "12", None, '{"action": "opened"', "{}", '"text"']
    sound, broken = sound_payloads(spark.createDataFrame(list(enumerate(rows)), "id int, payload string"))
    assert {r.id for r in sound.collect()} == {0, 7}
    assert {r.id: r.reason for r in broken.collect()} == {
        1: "no JSON", 2: "no JSON", 3: "no object", 4: "no object", 5: "no payload", 6: "no JSON", 8: "no object"
    }
    assert {r.payload for r in broken.collect()} == {rows[i] for i in (1, 2, 3, 4, 5, 6, 8)}


def one_by_one(rows, limit, window):
    """The limiter as it is asked: request after request."""
    opened, out = {}, {}
    for ts, request, client in sorted(rows):
        start, count = opened.get(client, (None, 0))
        if start is None or ts >= start + window:
            start, count = ts, 0
        opened[client] = start, count + 1
        out[request] = count + 1 <= limit
    return out


def random_requests(seed, count, hot=0.4):
    rng, start = random.Random(seed), datetime(2024, 1, 1)
    rows = []
    for i in range(count):
        client = "hot" if rng.random() < hot else f"c{rng.randint(0, 6)}"
        rows.append((start + timedelta(seconds=rng.choice([rng.randint(0, 3000), rng.randint(0, 200), 60 * rng.randint(0, 50)])), i, client))
    return rows


@pytest.mark.parametrize(("limit", "window", "segment"), [(5, 60, None), (1, 60, 60), (3, 7, 100), (10, 300, 301)])
def test_admission_equals_one_request_after_another(spark, limit, window, segment):
    rows = random_requests(limit, 900)
    frame = spark.createDataFrame([(c, i, t) for t, i, c in rows], "client string, request_id long, ts timestamp").repartition(5)
    found = admitted(frame, limit, timedelta(seconds=window), segment=segment and timedelta(seconds=segment)).collect()
    assert {r.request_id: r.admitted for r in found} == one_by_one(rows, limit, timedelta(seconds=window))
    assert any(r.admitted for r in found) and not all(r.admitted for r in found)


def test_admission_of_odd_requests(spark):
    frame = spark.createDataFrame(
        [(None, 1, datetime(2024, 1, 1)), ("a", 2, None), ("a", 3, datetime(1960, 1, 1))], "client string, request_id long, ts timestamp"
    )
    assert {r.request_id: r.admitted for r in admitted(frame, 1).collect()} == {1: False, 2: False, 3: True}
    assert admitted(frame.limit(0), 1).count() == 0
    with pytest.raises(ValueError):
        admitted(frame, 1, segment=timedelta(seconds=1))


def test_segments_hand_on_few_outcomes():
    """Windows fall into step: what a segment hands on does not grow with its requests."""
    import numpy as np

    at = np.sort(np.random.default_rng(0).integers(0, 600_000_000, 50_000))
    until, starts, counts = _outcomes(at, 0, 60_000_000)
    assert len(until) < (at < 60_000_000).sum() / 4
    for start in (-50_000_000, -1, -59_999_999):
        _, s, c = _decided(at, start, 3, 5, 60_000_000)
        k = int(np.searchsorted(until, start + 60_000_000, "left"))
        assert (starts[k], counts[k]) == (s, c)


def test_admission_makes_no_pandas_frames(spark):
    """Groups are many and small; a frame of each costs more than its work."""
    frame = spark.createDataFrame([(1, "a", None)], "request_id long, client string, ts timestamp")
    plan = admitted(frame, 1)._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" in plan and "InPandas" not in plan


def test_admission_on_a_stream(spark, tmp_path):
    """Requests in any order, over several batches, and a state that the watermark bounds."""
    rows = random_requests(9, 600)
    rng = random.Random(1)
    late = datetime(2024, 1, 2)
    schema = "client string, request_id long, ts timestamp"
    batches = [[r for r in rows if r[0] < datetime(2024, 1, 1, 0, 25)], [r for r in rows if r[0] >= datetime(2024, 1, 1, 0, 25)]]
    batches += [[(late, 10_000, "last")], [(late + timedelta(hours=1), 10_001, "last")]]
    left = None
    for number, batch in enumerate(batches):
        rng.shuffle(batch)
        frame = spark.createDataFrame([(c, i, t) for t, i, c in batch], schema)
        frame.repartition(2).write.parquet(str(tmp_path / f"in/b{number}"))
        stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in/b*"))
        query = (
            admitted(stream, 4, watermark="5 minutes").writeStream.format("parquet")
            .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start(str(tmp_path / "out"))
        )
        query.awaitTermination()
        left = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress][-1]
    found = {r.request_id: r.admitted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {k: v for k, v in found.items() if k < 10_000} == one_by_one(rows, 4, timedelta(minutes=1))
    assert left == 1


def test_batch_is_seen_whole_or_not_at_all(spark, tmp_path):
    sink = str(tmp_path / "sink")
    frames = {
        "reviews": spark.createDataFrame([(1, "a"), (2, "b")], "pr_id long, text string"),
        "posted": spark.createDataFrame([(1, 5)], "pr_id long, line long"),
    }
    schema = {name: frame.schema for name, frame in frames.items()}
    assert read_product(spark, sink, "posted", schema["posted"]).count() == 0
    write_part(frames, sink, 0)
    broken = {**frames, "posted": frames["posted"].withColumn("line", F.raise_error(F.lit("killed")).cast("long"))}
    with pytest.raises(Exception, match="killed"):
        write_part(broken, sink, 1)
    for name in frames:
        rows = read_product(spark, sink, name, schema[name])
        assert {r.part for r in rows.collect()} == {0} and rows.drop("part").count() == frames[name].count()
    write_part(frames, sink, 1)
    write_part(frames, sink, 1)  # a batch that runs again
    assert read_product(spark, sink, "reviews", schema["reviews"]).count() == 4
    assert read_product(spark, sink, "reviews", schema["reviews"], parts=[1]).count() == 2
    plan = read_product(spark, sink, "posted", schema["posted"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(product" in plan and "reviews" not in plan.split("ReadSchema")[1]


def test_place_index_reads_buckets_and_few_runs(spark, tmp_path):
    index = PlaceIndex(spark, str(tmp_path / "places"), fan=3, buckets=16)
    wanted = set()
    for batch in range(12):
        index.merge(batch)
        prs = spark.createDataFrame([(batch,), (batch // 2,)], "pr_id long")
        assert {tuple(r) for r in index.of(prs, batch).collect()} == {w for w in wanted if w[0] in (batch, batch // 2)}
        own = [(batch, "a", batch), (batch // 2, "b", batch)]
        index.add(spark.createDataFrame(own, "pr_id long, file string, line long"), batch)
        wanted |= set(own)
        assert len(index.runs()) <= 7
    assert max(level for level, _, _ in index.runs()) == 2
    # a batch that runs again does not see its own places
    again = spark.createDataFrame([(11,)], "pr_id long")
    assert index.of(again, 11).count() == 0 and index.of(again, 12).count() == 1
    plan = index.of(again, 12)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_bucketed_tables_read_the_buckets_of_the_keys(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").alias("pr_id"), F.concat(F.lit("d"), "id").alias("diff"))
    write_bucketed(rows, str(tmp_path / "diffs"), buckets=32)
    keys = spark.createDataFrame([(3,), (499,), (3,), (1000,)], "pr_id long")
    found = read_bucketed(spark, str(tmp_path / "diffs"), rows.schema, keys, buckets=32)
    assert sorted(map(tuple, found.collect())) == [(3, "d3"), (499, "d499")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_runs_leave_nothing_behind(spark):
    base = f"{staging.shared_dir(spark)}/diffmill/runs"
    frame = spark.range(3)
    with staging.run(spark, "good"):
        assert staging.staged(frame, "x").count() == 3
        assert len(staging.found(spark, f"{base}/good-*/x-*")) == 1
    with pytest.raises(RuntimeError), staging.run(spark, "bad"):
        staging.staged(frame, "x")
        raise RuntimeError
    assert staging.found(spark, f"{base}/*") == []
    # a run that was killed: its folder stays until it has shown no life for a while
    dead, alive = staging.run(spark, "dead"), staging.run(spark, "alive")
    dead_folder, _ = dead.__enter__(), alive.__enter__()
    where, system = staging._files(spark, f"{dead_folder}/{staging.ALIVE}")
    system.setTimes(where, int((time.time() - 3 * 3600) * 1000), -1)
    assert [p.rsplit("/", 1)[1].split("-")[0] for p in staging.sweep(spark, patience=2)] == ["dead"]
    assert [p.rsplit("/", 1)[1].split("-")[0] for p in staging.found(spark, f"{base}/*")] == ["alive"]
    alive.__exit__(None, None, None)
    staging._run.set(None)


def test_steps_replace_each_other(spark):
    step, frame = staging.Step("loop"), spark.range(4)
    with staging.run(spark, "steps") as folder:
        for _ in range(3):
            frame = step.replace(frame.selectExpr("id + 1 AS id"))
            assert len(staging.found(spark, f"{folder}/loop-*")) == 1
        assert sorted(r.id for r in frame.collect()) == [3, 4, 5, 6]
        step.drop(spark)
        assert staging.found(spark, f"{folder}/loop-*") == []
