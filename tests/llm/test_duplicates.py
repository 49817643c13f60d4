"""Similarity joins and the pipeline against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from diffmill.llm import components, near_vectors, ngram_join, queries


class Union(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def shingles(text, n):
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    words = [w.lower() for w in words]
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(n))))


def brute(rows, n, percent):
    sets = {r.doc_id: shingles(r.text, n) for r in rows}
    union, ids = Union(), sorted(sets, key=lambda i: len(sets[i]))
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if not x or 100 * len(x) < percent * len(y):
                break
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                union.join(a, b)
    return {i: (len(sets[i]), union.root(i)) for i in sets}


def check_join(frame, n, percent):
    found = ngram_join.components(frame, n, percent).collect()
    assert len(found) == frame.count()
    wanted = brute(frame.select("doc_id", "text").collect(), n, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == wanted


def near_copies(spark, count, words, edits, seed):
    draw = random.Random(seed)
    base = [f"w{draw.randint(0, 300)}" for _ in range(words)]
    rows = []
    for i in range(count):
        text = base[:]
        for _ in range(draw.randint(0, edits)):
            text[draw.randrange(words)] = f"e{draw.randint(0, 10**6)}"
        rows.append((i, " ".join(text)))
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)


def test_join_of_odd_rows(odd, none):
    check_join(odd.filter("text IS NULL OR length(text) < 1000"), 3, 90)
    assert ngram_join.components(none, 3, 90).count() == 0


def test_join_of_documents(docs):
    check_join(docs, 3, 90)


@pytest.mark.parametrize("percent", [30, 50, 0, 101])
def test_join_below_its_range_is_an_error(none, percent):
    with pytest.raises(ValueError, match="out of range"):
        ngram_join.components(none, 3, percent)


@pytest.mark.parametrize("percent", [51, 60])
def test_join_of_small_sets(spark, percent):
    draw = random.Random(percent)
    rows = [(i, " ".join(draw.choices("abc", k=draw.randint(0, 7)))) for i in range(250)]
    check_join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), 3, percent)


@pytest.mark.parametrize(("words", "edits", "n", "percent"), [(120, 4, 3, 90), (40, 3, 3, 80), (200, 8, 5, 80), (12, 1, 3, 80)])
def test_join_of_near_copies(spark, words, edits, n, percent):
    check_join(near_copies(spark, 150, words, edits, words), n, percent)


def test_join_of_null_ids(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (3, "a b c d"), (4, "a b c d"), (4, "other words of the same id")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = [(r.doc_id, r.component_id) for r in ngram_join.components(frame, 3, 90).collect()]
    assert sorted(found, key=str) == [(3, 3), (4, 3), (4, 3), (None, None), (None, None)]


def test_components_of_a_path_and_a_star(spark):
    links = [(i + 1, i) for i in range(40)] + [(1000, i) for i in range(900, 950)] + [(7, 7)]
    found = components.connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in found} == {**{i: 0 for i in range(41)}, **{i: 900 for i in [*range(900, 950), 1000]}}
    assert components.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def vectors(spark):
    draw = random.Random(5)
    rows, centres = [], [[draw.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    for i in range(500):
        c = centres[i % 12] if i % 3 else [draw.gauss(0, 1) for _ in range(16)]
        rows.append((i, [x + draw.gauss(0, 0.15) for x in c], i % 2))
    rows += [(600 + i, rows[1][1], 1) for i in range(60)]
    odd = [None, [], [0.0] * 16, [1.0, None] * 8, [float("nan")] * 16, [float("inf")] * 16, [1.0] * 3, [2.0] * 3]
    rows += [(700 + i, v, 1) for i, v in enumerate(odd)] + [(800, rows[1][1], None), (801, rows[1][1], 0)]
    return rows


def test_vectors(spark):
    rows = vectors(spark)
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)
    unit = {}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            size = math.sqrt(sum(x * x for x in v))
            unit[i] = ([x / size for x in v], label)
    union, links = Union(), {i: 0 for i, _, _ in rows}
    for a, (x, label) in unit.items():
        for b, (y, other) in unit.items():
            if a < b and label == other and len(x) == len(y) and sum(p * q for p, q in zip(x, y)) >= 0.93:
                union.join(a, b)
                links[a] += 1
                links[b] += 1
    for sizes in ({}, {"shard": 60, "block": 50}):
        found = near_vectors.links(frame, 0.93, **sizes).collect()
        assert {r.vec_id for r in found} == set(links)
        hit = sum(r.n_links for r in found)
        assert 0.98 * sum(links.values()) <= hit <= sum(links.values())
        assert all(r.n_links <= links[r.vec_id] and r.kept == (r.vec_id == r.component_id) for r in found)
        assert sum(r.component_id == union.root(r.vec_id) for r in found) >= 0.98 * len(found)
    assert near_vectors.links(frame.limit(0), 0.93).count() == 0


@pytest.mark.parametrize(("first", "step"), [(1, 2), (0, 32)])
@pytest.mark.parametrize(("dense", "lost"), [(250, 300), (0, 3)])
def test_audit_finds_lost_links(first, step, dense, lost):
    # a dense cluster, vectors that link with nothing, and pairs that no beam reaches
    draw = np.random.default_rng(3)
    pairs = np.repeat(draw.normal(size=(lost, 24)), 2, axis=0)
    rows = np.concatenate([np.ones((dense, 24)), draw.normal(size=(800, 24)), pairs])
    rows, reached = rows + draw.normal(size=rows.shape) * 0.01, dense + 800
    one = near_vectors.Shard(first + step * np.arange(len(rows)), rows, np.ones(len(rows), np.int64))
    for node, levels in enumerate(one.graph.links):
        for level in levels:
            level[:] = [] if node >= reached else [x for x in level if x < reached]
    one.graph.entry, one.graph.top = 0, 0
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    wanted = [np.flatnonzero(x).tolist() for x in unit @ unit.T >= 0.93]
    assert [x.tolist() for x in one.search(one.raw, one.ids, 0.93)] == wanted
    block = rows[reached - 50 :].copy()
    assert [x.tolist() for x in one.search(block, 10**6 + 2 * np.arange(len(block)) + first, 0.93)] == wanted[reached - 50 :]


def test_pipeline_stages(spark, sf_dir, docs):
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    kept = stages["n-gram Jaccard join"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    wanted = brute(docs.collect(), 5, 80)
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, root) in wanted.items() if i == root}
    assert stages["toxicity"](spark, docs, sf_dir).columns == docs.columns
    assert stages["language ID"](spark, docs, sf_dir).count() >= 0.98 * docs.count()


CLASHING = ["_id", "_size", "_toxicity", "_lang", "_share", "_copy", "row_id", "row", "toxicity", "known_lang", "known_share", "size", "ratio", "Known_Lang_"]


@pytest.mark.parametrize("index", range(5))
def test_pipeline_stages_on_odd_rows(spark, sf_dir, odd, none, index):
    """All columns of the input come back as they were, whatever their names."""
    added = {c: F.concat(F.lit(f"own {c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASHING}
    frame = odd.withColumns(added)
    stage = corpus_pipeline.STAGES[index][1]
    found = stage(spark, frame, sf_dir)
    rows = found.collect()
    if index < 4:
        assert found.columns == frame.columns
        before = {tuple(map(str, r)) for r in frame.collect()}
        assert {tuple(map(str, r)) for r in rows} <= before
    assert stage(spark, none.withColumns(added), sf_dir).count() == 0


def test_one_row_of_equal_texts_stays(spark, sf_dir):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(1, text), (1, text), (1, text), (2, text), (None, text), (None, text), (3, text + " more"), (1, "another text of its own")]
    rows += [(None, None), (None, ""), (9, ""), (None, "x " * 20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = [r.text for r in corpus_pipeline.without_near_copies(spark, docs, sf_dir).collect()]
    # texts without words link with nothing
    assert sum((t or "").startswith("word0") for t in kept) == 1
    assert sorted(t or "" for t in kept if not (t or "").startswith("word0")) == ["", "", "", "another text of its own", "x " * 20]


def test_pipeline_decodes(spark, sf_dir, odd):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    found = corpus_pipeline.STAGES[4][1](spark, odd.select(columns), sf_dir).collect()
    wanted = [(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect()]
    assert sorted((r.doc_id, r.decoded_sha256) for r in found) == sorted(wanted)


def test_pipeline_runs(spark, sf_dir, docs):
    found = corpus_pipeline.run(spark, sf_dir)
    assert 0 < found.count() <= 2 * docs.count()


def test_every_operator_is_registered():
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES} == set(range(1, 14))
