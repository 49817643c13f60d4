"""Corpus, selection, metrics and model."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from diffmill.constants import INJECTED_COMMENTS
from diffmill.operators import corpus as co
from diffmill.operators import metrics as me
from diffmill.operators import model as mo
from diffmill.operators import selection as se
from diffmill import schemas
from diffmill.operators.classify import classify, labels_of
from diffmill.plans.corpus_job import labelled_corpus, training_set
from diffmill.sources import products, samples
from diffmill.sources.diffs import corpus_code

PAIRS = "label int, pred int"


def order_of(key):
    return hashlib.md5(f"{key}#42".encode()).hexdigest()


def make_samples(spark, sizes):
    rows = [(f"code_{c}_{i}", c, f"{c}:{i}") for c, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "code string, label int, sample_key string")


def test_corpus_source_and_filter(spark):
    rows = [("a", "b"), ("", "b"), (None, "c"), ("", None), ("x" * 2048, ""), ("x" * 2049, "y")]
    df = corpus_code(spark.createDataFrame(rows, "func_code_string string, whole_func_string string"))
    assert sorted(len(r.code) for r in df.collect()) == [0, 1, 1, 1, 2048, 2049]
    assert sorted(len(r.code) for r in co.usable_code(df).collect()) == [1, 1, 1, 2048]


def test_seeds():
    rows = co.seed_rows()
    assert Counter(label for _, label in rows) == {3: 20, 2: 20, 1: 35, 4: 25}
    assert len({code for code, _ in rows}) == 100


def test_distinct_keeps_the_first_and_combines_copies_before_the_shuffle(spark):
    rows = [("same", 2, 1), ("same", 1, 0), ("other", 3, 1)] + [("hot", 0, 0)] * 1000
    df = co.distinct_code(spark.createDataFrame(rows, "code string, label int, source_rank int"), ["source_rank"])
    assert {r.code: r.label for r in df.collect()} == {"same": 1, "other": 3, "hot": 0}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_min_by") > plan.index("Exchange")


def test_hash_cuts_equal_a_full_ranking(spark):
    df = make_samples(spark, {0: 5000, 1: 700, 2: 1})
    keys = df.select("label", F.md5(F.concat("sample_key", F.lit("#42")).cast("binary")).alias("h"))
    limits = spark.createDataFrame(
        [(0, "a", 1), (0, "b", 4999), (0, "c", 5001), (1, "a", 350), (2, "a", 0), (2, "b", 1)], "label int, cut string, k int"
    )
    found = {(r.label, r.cut): r.cut_hash for r in se.hash_cuts(keys, limits).collect()}
    ranked = {c: sorted(order_of(f"{c}:{i}") for i in range(n)) for c, n in {0: 5000, 1: 700, 2: 1}.items()}
    assert found == {(0, "a"): ranked[0][0], (0, "b"): ranked[0][4998], (1, "a"): ranked[1][349], (2, "b"): ranked[2][0]}


def test_split_is_exact_per_class(spark):
    df = make_samples(spark, {0: 1000, 1: 101, 3: 1})
    split = se.stratified_split(df, "sample_key")
    counts = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert counts == {
        (0, "train"): 700, (0, "val"): 150, (0, "test"): 150,
        (1, "train"): 70, (1, "val"): 15, (1, "test"): 16, (3, "test"): 1,
    }
    again = se.stratified_split(df.repartition(7), "sample_key")
    assert split.exceptAll(again).count() == 0


def test_subsample(spark):
    df = spark.range(500)
    expected = set(sorted(range(500), key=order_of)[:40])
    assert {r.id for r in se.subsample(df, "id", 40).collect()} == expected
    assert se.subsample(df, "id", 500).count() == se.subsample(df, "id", 9000).count() == 500


def test_balance(spark):
    targets = {0: 50, 1: 40, 2: 10, 3: 5}
    df = make_samples(spark, {0: 300, 1: 3, 2: 10, 4: 8})
    balanced = co.balance(df, targets).cache()
    rows = balanced.collect()
    assert Counter(r.label for r in rows) == {0: 50, 1: 40, 2: 10}
    assert len({r.sample_key for r in rows}) == len(rows)
    kept = {r.code for r in rows if r.label == 0}
    assert kept == {f"code_0_{i}" for i in sorted(range(300), key=lambda i: order_of(f"0:{i}"))[:50]}
    assert {"code_1_0", "code_1_1", "code_1_2"} < {r.code for r in rows if r.label == 1}
    balanced.unpersist()


def test_variants(spark):
    code = "def f(user, data):\n    result = user + data\n    return result"
    df = spark.createDataFrame([(code, 1, "k"), ("one line", 1, "m")], "code string, label int, sample_key string")
    rows = co.write_variants(co.augmented(df, F.lit(3))).collect()
    assert len(rows) == 24 and len({r.sample_key for r in rows}) == 24
    for r in rows:
        lines = r.code.split("\n")
        if r.variant >= 2:
            assert lines[0] == "def wrapper():" and all(ln.startswith("    ") for ln in lines[1:])
            lines = [ln[4:] for ln in lines[1:]]
        if r.variant % 2:
            assert lines[0] in INJECTED_COMMENTS
            lines = lines[1:]
        elif r.sample_key.startswith("k"):
            assert lines[1] == ""
            del lines[1]
        if r.sample_key.startswith("m"):
            assert lines == ["one line"]
            continue
        words = set("\n".join(lines).replace("(", " ").replace(")", " ").replace(",", " ").split())
        renamed = {"user", "data", "result"} - words
        assert 2 <= len(renamed) <= 3 and len(lines) == 3


def test_distribution_and_weights(spark):
    df = make_samples(spark, {0: 6, 3: 2})
    dist = {r.label: (r.class_name, r.n, r.percent) for r in co.class_distribution(df).collect()}
    assert dist[0] == ("Clean", 6, 75.0) and dist[4] == ("Logic Flaw", 0, 0.0) and len(dist) == 5
    assert {r.label for r in co.short_classes(df, {0: 6, 1: 0, 2: 1, 3: 3, 4: 0}).collect()} == {2, 3}
    weights = {r.label: r.weight for r in co.class_weights(df).collect()}
    assert weights == {0: 8 / 30, 1: 1.6, 2: 1.6, 3: 0.8, 4: 1.6}
    assert {r.percent for r in co.class_distribution(df.limit(0)).collect()} == {0.0}


def test_metrics(spark, tmp_path):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(2, 1)] + [(1, 4)]
    df = spark.createDataFrame(pairs, PAIRS)
    per_class = {r.class_id: (r.precision, r.recall, r.f1, r.support) for r in me.class_metrics(df).collect()}
    assert per_class[0] == (1.0, 5 / 7, pytest.approx(10 / 12), 7)
    assert per_class[1] == (0.5, 0.75, pytest.approx(0.6), 4)
    assert per_class[2] == (0.0, 0.0, 0.0, 1)
    assert per_class[4] == (0.0, 0.0, 0.0, 0)
    [total] = me.summary_metrics(df).collect()
    assert total.accuracy == pytest.approx(8 / 12)
    assert total.macro_f1 == pytest.approx((10 / 12 + 0.6) / 4)
    assert total.weighted_f1 == pytest.approx((7 * 10 / 12 + 4 * 0.6) / 12)
    matrix = {r.label: r for r in me.confusion_matrix(df).collect()}
    assert set(matrix) == {0, 1, 2, 4} and matrix[0].pred_1 == 2 and matrix[4].pred_4 == 0
    foreign = df.unionByName(spark.createDataFrame([(0, -1), (7, 0), (None, 1), (0, None)], PAIRS))
    matrix = {r.label: r for r in me.confusion_matrix(foreign).collect()}
    assert set(matrix) == {0, 1, 2, 4, -1, 7, None} and matrix[0].pred_other == 2 and matrix[None].pred_1 == 1
    support = Counter(r.label for r in foreign.collect())
    assert {k: sum(r[1:]) for k, r in matrix.items()} == {k: support[k] for k in matrix}
    report = products.evaluation_report(me.class_metrics(df), me.summary_metrics(df), me.confusion_matrix(df))
    assert report.orderBy("line_no").collect()[1].line == "Samples evaluated: 12"
    products.write_report(report, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).first().value == "DiffMill evaluation report"


def test_best_candidate(spark):
    rows = [(0, 1, 0), (1, 1, 1), (2, 1, 1), (3, 1, 0)]
    df = spark.createDataFrame(rows, "candidate int, label int, pred int")
    assert [r.candidate for r in me.best_candidate(df).collect()] == [1]
    assert me.best_candidate(df.filter("candidate in (0, 3)")).collect() == []


def test_detection_report(spark):
    df = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.7), ("b", "x", 0.9)], "file string, label string, confidence double")
    rows = {(r.file, r.label): r.issues for r in me.detection_report(df).collect()}
    assert rows[(None, None)] == 3 and rows[("a", None)] == 2 and rows[("b", "x")] == 1


def test_rows_without_a_known_class_are_split_by_the_same_shares(spark):
    rows = [(f"c{i}", (None, 7, 9)[i % 3], f"k{i}") for i in range(60)] + [(f"d{i}", 1, f"d{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "code string, label int, sample_key string")
    found = Counter((r.label == 1, r.split) for r in se.stratified_split(df, "sample_key").collect())
    assert found == {
        (True, "train"): 14, (True, "val"): 3, (True, "test"): 3, (False, "train"): 42, (False, "val"): 9, (False, "test"): 9,
    }
    assert {r.label: r.n for r in co.unknown_classes(df).collect()} == {None: 20, 7: 20, 9: 20}
    assert se.downsample(df, "sample_key", {1: 5}).count() == 65


def corpus(spark):
    rows = [(f"def f{i}(a):\n    return a + {i}", None) for i in range(120)]
    rows += [(f"def g{i}(a):\n    return eval(a{i})", None) for i in range(30)] * 3
    return spark.createDataFrame(rows, "func_code_string string, whole_func_string string")


def test_corpus_job(spark, tmp_path):
    assert labelled_corpus(corpus(spark)).count() == 150
    job = training_set(corpus(spark), {0: 60, 1: 40, 2: 30, 3: 40, 4: 30})
    assert {r.label: r.n for r in job.distribution.collect()} == {0: 60, 1: 40, 2: 30, 3: 40, 4: 30}
    assert job.warnings.count() == 5
    sizes = Counter(r.split for r in job.split.collect())
    assert sizes == {"train": 42 + 28 + 21 + 28 + 21, "val": 9 + 6 + 4 + 6 + 4, "test": 9 + 6 + 5 + 6 + 5}
    for kind in ("parquet", "csv"):
        path = str(tmp_path / kind)
        samples.write_samples(job.split, path, kind)
        back = samples.training_parts(samples.read_samples(spark, path, kind))
        assert back.select(job.split.columns).exceptAll(job.split).count() == 0
        assert back.count() == 200


def test_unsplit_samples_get_an_80_20_split(spark):
    parts = samples.training_parts(make_samples(spark, {0: 100, 1: 10}))
    assert Counter((r.label, r.split) for r in parts.collect()) == {
        (0, "train"): 80, (0, "val"): 20, (1, "train"): 8, (1, "val"): 2,
    }


def test_model_reaches_the_floor(spark):
    split = training_set(corpus(spark), {0: 60, 1: 40, 2: 40, 3: 40, 4: 40}).split.cache()
    model, best = mo.train(split.filter("split = 'train'"), split.filter("split = 'val'"), (0.01, 0.1), 1 << 10)
    assert best.count() == 1
    tested = mo.score_with_model(split.filter("split = 'test'"), model).cache()
    assert me.snippet_accuracy(mo.predicted_classes(tested)).first().reaches_floor
    row = tested.first()
    probs = row.prediction.all_probs
    assert set(probs) == set(range(5)) and abs(sum(probs.values()) - 1) < 0.001
    assert row.prediction.confidence == max(probs.values())


def test_models_score_in_batches_as_their_stages_do(spark):
    codes = ["def f(x):\n    return x / 0", "", " \n", "é = ünï['日本'] \U0001f600\x0b\x1c_x", "eval(word)", "a" * 50 + " 1 12 123"]
    # weight, two classes and class 4 have no samples
    train = spark.createDataFrame([(c, k % 3, 1.0 + k) for k, c in enumerate(codes)], "code string, label int, weight double")
    tokens = mo.token_features(32).fit(train)
    model = mo.PipelineModel(stages=[*tokens.stages, mo.classifier(0.01).fit(tokens.transform(train))])
    asked = spark.createDataFrame([(k, c) for k, c in enumerate([*codes, None])], "id int, code string")
    scored = mo.score_with_model(asked, model)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "UDF" not in plan
    found = {r.id: r.prediction.asDict(recursive=True) for r in scored.collect()}
    by_stages = model.transform(asked.na.drop())
    expected = by_stages.select(
        "id", mo.guarded_prediction(F.col("code"), mo.prediction_struct(mo.vector_to_array(F.col("probability")))).alias("p")
    )
    assert scored.schema["prediction"].dataType == expected.schema["p"].dataType
    assert found.pop(len(codes))["label"] == "Clean"
    assert found == {r.id: r.p.asDict(recursive=True) for r in expected.collect()}


def test_other_models_score_by_their_stages(spark):
    train = spark.createDataFrame([("a b", 0, 1.0), ("c", 1, 1.0), ("c d", 2, 1.0)], "code string, label int, weight double")
    tokens = mo.token_features(32)
    lowered = mo.Pipeline(stages=[tokens.getStages()[0].copy().setToLowercase(True), *tokens.getStages()[1:]]).fit(train)
    model = mo.PipelineModel(stages=[*lowered.stages, mo.classifier(0.01).fit(lowered.transform(train))])
    scored = mo.score_with_model(spark.createDataFrame([("A B",), ("C D",)], "code string"), model)
    assert [r.prediction.label_id for r in scored.collect()] == [0, 2]


def test_a_model_of_one_class_is_certain(spark):
    scores = mo._token_scorer(8)(mo.np.zeros((3, 8)), mo.np.array([0.0, 0.0, float("inf")]))
    assert scores(["x = 1", ""]).tolist() == [[0.0, 0.0, 1.0]] * 2


def test_shares_are_rounded_as_spark_does(spark):
    shares = [0.00005, 0.12345, 0.99995, 0.00015, 1 / 3, 0.49995, 1.0, 0.0, 0.00025, 0.10005]
    row = spark.createDataFrame([(shares,)], "p array<double>").select(F.transform("p", lambda x: F.round(x, 4)).alias("p")).first()
    assert mo._rounder()(mo.np.array([shares]))[0].tolist() == row.p


def test_rules_run_once_to_label_and_drop_nulls(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    codes = spark.createDataFrame([("x = 1",), ("os.system('a' + b)",), (None,)], "code string")
    labelled = co.label_code(codes)
    kept = co.without_nulls(labelled)
    assert plan(kept).count("RLIKE") == plan(labelled).count("RLIKE")
    assert sorted((r.code, r.label) for r in kept.collect()) == [("os.system('a' + b)", 3), ("x = 1", 0)]
    numbers = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "c"), (2.0, None)], "`n.m` double, t string")
    assert [tuple(r) for r in co.without_nulls(numbers).collect()] == [(1.0, "a")]


def test_user_scorer(spark):
    def load():
        def predict(codes):
            if any("boom" in c for c in codes):
                raise ValueError("boom")
            return [[0.0, 0.1, 0.0, 0.9, 0.0] for _ in codes]

        return predict

    columns = "pr_id long, chunk_index int, file string, start_line long, code string"
    good = spark.createDataFrame([(1, 0, "a", 1, "x = 1"), (1, 1, "a", 1, " ")], columns)
    rows = {r.chunk_index: r.prediction for r in mo.score_with_function(good, load).collect()}
    assert (rows[0].label, rows[0].confidence, rows[0].label_id) == ("Security Vulnerability", 0.9, 3)
    assert (rows[1].label, rows[1].confidence, rows[1].label_id) == ("Clean", 0.0, 0)
    bad = spark.createDataFrame([(1, 0, "a", 1, "boom")], columns)
    [found] = classify(mo.score_with_function(bad, load)).collect()
    assert (found.label, found.label_id, found.is_error) == ("Code Quality", -1, True)


def test_softmax(spark):
    df = spark.createDataFrame([([1.0, 1000.0, 2.0],), ([0.0, 0.0],)], "x array<double>")
    rows = df.select(mo.softmax(F.col("x")).alias("p")).collect()
    assert rows[0].p == [0.0, 1.0, 0.0] and rows[1].p == [0.5, 0.5]


def test_what_a_scorer_said_is_kept(spark):
    def load():
        def predict(codes):
            if "boom" in codes:
                raise RuntimeError("out of tokens")
            if "short" in codes:
                return [[0.1] * 5] * (len(codes) - 1)
            return [[0.6, 0.1, 0.1, 0.1, 0.1]] * len(codes)

        return predict

    rows = [(1, i, "a.py", 1, code) for i, code in enumerate(["x = 1", "boom", "y = 2", "short", " "])]
    chunks = spark.createDataFrame(rows, schemas.CHUNKS).coalesce(1)
    found = {r.chunk_index: r for r in mo.score_with_function(chunks, load, error="why").collect()}
    assert {i: r.why for i, r in found.items()} == {
        0: None, 1: "RuntimeError: out of tokens", 2: None, 3: "ValueError: not one row of probabilities per code", 4: None
    }
    assert [found[i].prediction.label_id for i in range(5)] == [0, -1, 0, -1, 0]
    assert "why" not in mo.score_with_function(chunks, load).columns


def test_independent_models_give_several_labels(spark):
    """A sample that shows the marks of two classes is likely to be of both."""
    marks = {1: "eval ( user )", 2: "open ( path )", 3: "for for for", 4: "foo bar baz"}
    rows = [(f"x = {i}\n" + (f"{marks[k]}\n" if k else "pass\n"), k) for i in range(60) for k in range(5)]
    samples = spark.createDataFrame(rows, "code string, label int")
    model = mo.train_independent(samples, samples, features=1 << 10)
    assert len(model.slopes) == 5 and all(a > 0 for a in model.slopes)
    both = spark.createDataFrame(
        [(1, 0, "a.py", 1, f"x = 3\n{marks[1]}\n{marks[3]}\n"), (1, 1, "a.py", 1, f"x = 3\n{marks[2]}\n")], schemas.CHUNKS
    )
    scored = mo.score_independently(both, model)
    assert scored.columns == [*both.columns, "prediction"]
    labels = labels_of(scored, multi_label_threshold=0.3).collect()
    assert {r.label_id for r in labels if r.chunk_index == 0} >= {1, 3}
    assert {r.label_id for r in labels if r.chunk_index == 1} == {2}
    total = sum(scored.filter("chunk_index = 0").head().prediction.all_probs.values())
    assert total > 1.2
