"""Sharding, collocations and vector codes against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from diffmill.llm import collocations, queries, sharding, vector_codes


def draw(key, shard):
    return (int(hashlib.md5(f"{key}:{shard}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def winner(key, weights):
    return min((-math.log(draw(key, s)) / w, s) for s, w in enumerate(weights) if w > 0)[1]


def test_shards_of_keys(spark):
    keys = spark.range(3000).select(F.col("id"), F.col("id").cast("string").alias("key"))
    weights = [1, 2.5, 0, 4]
    rows = keys.select("id", sharding.shard_of(F.col("key"), weights).alias("s"), sharding.shard_of(F.col("id"), [*weights, 2]).alias("t")).collect()
    assert all(r.s == winner(r.id, weights) for r in rows)
    # one more shard takes rows only into itself, about as many as its weight says
    assert all(r.t in (r.s, 4) for r in rows)
    shares = Counter(r.s for r in rows)
    assert shares[2] == 0 and all(abs(shares[s] / 3000 - w / 7.5) < 0.03 for s, w in enumerate(weights))
    assert abs(sum(r.t == 4 for r in rows) / 3000 - 2 / 9.5) < 0.03
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("id"), [0, -1])


def check_shards(spark, frame, path, weights):
    sharding.write_shards(frame, path, weights)
    rows = sharding.read_shards(spark, path, frame.schema)
    assert dict(rows.dtypes)["slot"] == "bigint"
    found, wanted = rows.collect(), frame.collect()
    assert sorted(map(repr, (r.row for r in found))) == sorted(map(repr, wanted))
    for shard in range(len(weights)):
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))
    key = lambda r: "" if r.doc_id is None else str(r.doc_id)
    assert all(r.shard == winner(key(r.row), weights) for r in found)
    digest = sharding.placed(spark, path, frame.schema, weights).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in digest) == Counter(
        (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in wanted
    )
    assert all(r.law == "key" and r.grown_shard in (r.shard, len(weights)) for r in digest)


def test_shards_of_odd_rows(spark, odd, none, tmp_path):
    clashing = odd.withColumns({"shard": F.lit("x"), "part": F.lit(1), "row": F.lit(2), "slot": F.lit(3), "at": F.lit("y")})
    clashing = clashing.unionByName(clashing.withColumn("doc_id", F.lit(None).cast("bigint")))
    check_shards(spark, clashing, str(tmp_path / "odd"), [1] * 16)
    check_shards(spark, none, str(tmp_path / "none"), [1] * 3)


def test_one_key_fills_many_tasks(spark, tmp_path):
    frame = spark.range(4000).select(F.lit(7).alias("doc_id"), F.lit("same").alias("text")).repartition(4)
    path = str(tmp_path / "hot")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    try:
        sharding.write_shards(frame, path, [1] * 4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = sharding.read_shards(spark, path, frame.schema)
    assert sorted(r.slot for r in rows.collect()) == list(range(4000))
    parts = spark.read.parquet(path).groupBy("part").count().collect()
    assert len(parts) > 2 and max(r["count"] for r in parts) < 2000


def test_slots_do_not_depend_on_the_number_of_tasks(spark, docs, tmp_path):
    found = []
    for n in (1, 7):
        sharding.write_shards(docs.repartition(n), str(tmp_path / f"n{n}"), [1] * 5)
        rows = sharding.read_shards(spark, str(tmp_path / f"n{n}"), docs.schema)
        found.append(sorted(tuple(r) for r in rows.select("row.doc_id", "shard", "slot").collect()))
    assert found[0] == found[1]


def phrase_counts(rows):
    f, n = Counter(), Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in rows:
        lang = r.lang if r.lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r.text or "").translate(low)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                f.update((lang, " ".join(words[i : i + m])) for i in range(len(words) - m + 1))
    return f, n


def brute_collocations(rows, least, top, share):
    f, n = phrase_counts(rows)
    frequent = {k: a for k, a in f.items() if a >= least}
    held = Counter()
    for (lang, phrase), a in frequent.items():
        words = phrase.split(" ")
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                key = lang, " ".join(words[i : i + m])
                held[key] = max(held[key], a)
    out = {}
    for (lang, phrase), a in frequent.items():
        words = phrase.split(" ")
        if len(words) < 2 or 100 * held[lang, phrase] >= share * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, " ".join(words[:k])], f[lang, " ".join(words[k:])]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, phrase.encode(), left, right))
    return {
        (lang, rank + 1, phrase.decode(), -a, left, right, n[lang], -score)
        for lang, best in out.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top])
    }


def check_collocations(frame, least=30, top=2000, share=80, **hashing):
    found = collocations.collocations(frame, least, top, share, **hashing).collect()
    rows = [(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute_collocations(frame.select("lang", "text").collect(), least, top, share)
    return rows


def test_collocations_of_odd_rows(odd, none):
    assert check_collocations(odd, least=2)
    assert collocations.collocations(none).count() == 0


def test_collocations_of_documents(docs):
    assert check_collocations(docs, least=5, top=40)


def phrase_texts(spark, n=300, seed=3):
    rng = random.Random(seed)
    marks = [" ", " ", " ", "\t", ". ", ",", "\n", "  ", "\x0b", "!"]
    words = ["New", "york", "city", "ÄÖ", "x" * 70, "a-b", "\x1c", "é́", "the", "of", "\x85"]
    texts = ["".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    rows = [(i, rng.choice(["en", "de", None, "und"]), t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, lang string, text string").repartition(4)


def test_collocations_in_slices(spark, monkeypatch):
    """Slices of a few bytes cut texts between pieces and lose nothing."""
    frame = phrase_texts(spark)
    wanted = sorted(check_collocations(frame, least=4, top=100))
    batch = frame.coalesce(1).select("lang", "text", F.xxhash64("lang").alias("seed")).toArrow().combine_chunks().to_batches()[0]
    monkeypatch.setattr(collocations, "SLICE", 40)
    pieces = list(collocations._slices(batch))
    assert len(pieces) > 100
    whole = {}
    for texts, _, rows, begins in pieces:
        for text, row, at in zip(texts, rows, begins):
            assert at == len(whole.get(row, b""))
            whole[row] = whole.get(row, b"") + text
    assert all(whole.get(i, b"") == (t or "").encode() for i, t in enumerate(batch.column("text").to_pylist()))
    assert wanted


@pytest.mark.parametrize(("hash_bits", "field_bits"), [(6, 10), (12, 6), (64, 6)])
def test_collisions_change_nothing(spark, hash_bits, field_bits):
    frame = phrase_texts(spark, 120, seed=hash_bits)
    assert check_collocations(frame, least=4, top=50, hash_bits=hash_bits, field_bits=field_bits)


def test_texts_are_compared(monkeypatch):
    """Words of one hash, or phrases of one fingerprint and check, are not taken for equal."""
    words = collocations.Words([b"a b a c", b"a b"], [1, 1])
    assert words.numbered().tolist() == [0, 1, 0, 2, 0, 1] or len(set(words.numbered().tolist())) == 3
    places = words.places(2)
    same = np.zeros(len(places), np.uint64)
    with pytest.raises(ValueError, match="two phrases"):
        collocations._verified(words, places, same, same, 2, words.numbered())
    collocations._verified(words, places[[0, 3]], same[:2], same[:2], 2, words.numbered())
    words.hashes[0] = np.zeros(6, np.uint64)
    assert words.numbered() is None
    collocations._verified(words, places[[0, 3]], same[:2], same[:2], 2, None)


def test_pointers_lead_to_the_phrase(spark):
    frame = phrase_texts(spark, 100)
    kept, _ = collocations.phrases(frame, least=5)
    texts = {str(r.doc_id): (r.text or "").encode() for r in frame.collect()}
    rows = kept.collect()
    assert rows
    for r in rows:
        begin = texts[r.doc_id][r.at : r.at + len(r.phrase.encode()) + 40].decode(errors="ignore")
        low = re.sub(r"[\x20\x09]+", " ", begin.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        assert low.startswith(r.phrase)


def brute_codes(rows, parts, entries, rounds):
    kept = [r for r in rows if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    whole = [[math.floor(256 * x) for x in r.embedding] for r in kept]
    by_id = sorted(range(len(kept)), key=lambda i: (kept[i].vec_id is None, kept[i].vec_id or 0, whole[i]))
    length = len(whole[by_id[0]])
    cut = [(k * length // parts, (k + 1) * length // parts) for k in range(parts)]
    fit = [i for i in by_id if len(whole[i]) == length]
    books = [[whole[i][a:b] for i in fit[:entries]] for a, b in cut]

    def nearest(x, book):
        return min((sum((p - q) ** 2 for p, q in zip(x, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for (a, b), book in zip(cut, books):
            members = {}
            for i in fit:
                members.setdefault(nearest(whole[i][a:b], book)[1], []).append(whole[i][a:b])
            for e, own in members.items():
                book[e] = [sum(c) // len(own) for c in zip(*own)]
    out = []
    for i, r in enumerate(kept):
        if len(whole[i]) != length:
            out.append((r.vec_id, None, None, r.label))
            continue
        best = [nearest(whole[i][a:b], book) for (a, b), book in zip(cut, books)]
        out.append((r.vec_id, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), r.label))
    errors = Counter()
    for _, _, error, label in out:
        errors[label] += error or 0
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return Counter((i, code, error, errors[label], digest) for i, code, error, label in out)


def check_codes(frame, **sizes):
    found = vector_codes.digests(frame, **sizes).collect()
    rows = Counter((r.vec_id, r.code, r.error, r.label_error or 0, r.codebooks_sha256) for r in found)
    assert rows == brute_codes(frame.collect(), **{"parts": 16, "entries": 64, "rounds": 2} | sizes)


VECTORS = "vec_id bigint, embedding array<double>, label int, row_id string, code string, x int"


def vectors(spark, count, length, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    rows = [(int(i), (rng.normal(size=length) * spread).tolist(), int(i % 3) if i % 4 else None, "r", "c", 0) for i in rng.permutation(count)]
    return rows


@pytest.mark.parametrize(("length", "sizes"), [(16, {}), (32, {"entries": 5, "rounds": 3}), (10, {"parts": 4, "entries": 7}), (6, {"parts": 4, "rounds": 0})])
def test_codes(spark, length, sizes):
    check_codes(spark.createDataFrame(vectors(spark, 150, length, length), VECTORS).repartition(3), **sizes)


def test_codes_of_odd_vectors(spark):
    rows = vectors(spark, 40, 16, 1)
    own = rows[0][1]
    rows += [
        (100, None, 1, "", "", 1), (101, [], 1, "", "", 1), (102, [None] + own[1:], 1, "", "", 1), (103, [math.nan] + own[1:], 1, "", "", 1),
        (104, [-math.inf] + own[1:], 2, "", "", 1), (None, own, 7, "", "", 1), (105, [1.0] * 5, None, "", "", 1), rows[3], rows[3],
        (106, [0.0] * 16, 1, "", "", 1), (106, [-0.001] * 16, 1, "", "", 1), (-5, [2.0**19] * 16, 9, "", "", 1),
    ]
    check_codes(spark.createDataFrame(rows, VECTORS).repartition(4))
    assert vector_codes.digests(spark.createDataFrame([], VECTORS)).count() == 0
    assert vector_codes.digests(spark.createDataFrame([(1, [2.0**20] * 16, 1, "", "", 1)], VECTORS)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.compressed(spark.createDataFrame([], VECTORS), entries=300)


def test_codes_of_one_vector_in_most_rows(spark):
    rows = vectors(spark, 60, 16, 5)
    rows += [(1000 + i, rows[0][1], 1, "", "", 1) for i in range(900)]
    check_codes(spark.createDataFrame(rows, VECTORS).repartition(4))


def test_only_movers_are_shuffled(spark):
    """After a round most members stay, and the union keeps its partitions."""
    frame = spark.createDataFrame(vectors(spark, 200, 16, 8), VECTORS)
    rows = vector_codes.staged(vector_codes.integers(frame), "x")
    books = vector_codes.first_codebooks(rows, 16, 64)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(vector_codes.shared_dir(spark))
    members = vector_codes.Members(vector_codes._first_blocks(rows, books, 4), books, 4, 5)
    members.migrate(members.next_codebooks(books))
    assert members.blocks.getNumPartitions() == 5
    assert "PartitionerAwareUnionRDD" in members.blocks.toDebugString().decode()
    assert members.blocks.map(lambda b: len(b[1][0])).sum() == 200 * 16


@pytest.mark.parametrize("name", ["op11_sharding", "op12_collocations", "op13_vector_codes"])
def test_queries_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    found = queries.QUERIES[name](spark, sf_dir)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, found.select(columns).collect()))) == sorted(map(repr, cursor.fetchall()))
