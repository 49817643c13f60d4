"""Classification, ranking, explanations and review texts."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from diffmill import schemas
from diffmill.constants import CLEAN_REVIEW, LANGUAGE_WARNING, NO_ANSWER, PRODUCT, SUMMARY_FOOTER
from diffmill.operators.classify import (
    classify,
    reviewable,
    score_from_table,
    score_without_model,
)
from diffmill.operators.explain import answer_entries, explain, first_answers, json_array_text, prompts
from diffmill.operators.rank import prioritize, top_issues
from diffmill.operators.review import (
    comment_places,
    comments_to_post,
    inline_comments,
    planned_comments,
    reviews,
    status_body,
)
from diffmill.plans.review_job import find_issues, write_reviews

BUG = "y = total / len(parts)"


def chunk(index=0, code="z = 1", pr=1, file="a.py", start=1):
    return (pr, index, file, start, code)


def scored(spark, *items):
    """items: (code, label, confidence, label_id, all_probs)"""
    rows = [
        (1, i, "a.py", 1, code, Row(label=label, confidence=conf, label_id=lid, all_probs=probs))
        for i, (code, label, conf, lid, probs) in enumerate(items)
    ]
    schema = schemas.T.StructType(
        [*schemas.CHUNKS, schemas.T.StructField("prediction", schemas.PREDICTION)]
    )
    return spark.createDataFrame(rows, schema)


def labels(df):
    rows = df.orderBy("chunk_index", "label_ord").collect()
    return [(r.chunk_index, r.label, r.confidence, r.label_id) for r in rows]


def test_gate_boundary(spark):
    df = scored(
        spark,
        ("z", "Type Mismatch", 0.59, 2, None),
        ("z", "Type Mismatch", 0.60, 2, None),
        ("z", "Clean", 0.10, 0, None),
        ("z", "other", 0.9, 9, None),
    )
    assert labels(classify(df)) == [
        (0, "Code Quality", 0.59, 2),
        (1, "Type Bug", 0.60, 2),
        (2, "Clean", 0.10, 0),
        (3, "Code Issue", 0.9, 9),
    ]


def test_multi_label_boundaries(spark):
    probs = {0: 0.9, 1: 0.40, 2: 0.39999, 3: 0.41237, 4: 0.0}
    df = scored(
        spark,
        ("z", "Clean", 0.60, 0, probs),
        ("z", "Clean", 0.59, 0, probs),
        ("z", "Clean", 0.9, 0, {0: 0.9, 1: 0.1}),
        ("z", "Clean", 0.9, 0, {}),
        ("z", "Clean", 0.9, 0, {7: 0.5}),
    )
    assert labels(classify(df)) == [
        (0, "Code Quality", 0.4, 1),
        (0, "Code Quality", 0.4124, 3),
        (1, "Clean", 0.59, 0),
        (2, "Clean", 0.9, 0),
        (3, "Clean", 0.9, 0),
        (4, "Code Quality", 0.5, 7),
    ]


def test_repair_sets_only_a_clean_id(spark):
    df = scored(spark, (BUG, "Clean", 0.8, 0, None), (BUG, "Type Mismatch", 0.8, 2, None), (BUG, "Clean", 0.95, 0, None))
    assert labels(classify(df)) == [
        (0, "Runtime Bug", 0.8, 1),
        (1, "Runtime Bug", 0.8, 2),
        (2, "Clean", 0.95, 0),
    ]


def test_missing_scores_are_errors_and_stay(spark):
    chunks = spark.createDataFrame([chunk(0), chunk(1), chunk(2, " \n")], schemas.CHUNKS)
    good = Row(label="Clean", confidence=0.9, label_id=0, all_probs=None)
    table = spark.createDataFrame([(1, 0, good), (1, 2, good)], schemas.SCORES)
    found = classify(score_from_table(chunks, table))
    assert labels(found) == [(0, "Clean", 0.9, 0), (1, "Code Quality", 0.0, -1), (2, "Clean", 0.0, 0)]
    assert [r.chunk_index for r in prioritize(found).collect()] == [1]


def test_without_a_model(spark):
    chunks = spark.createDataFrame([chunk(0), chunk(1, BUG)], schemas.CHUNKS)
    assert labels(classify(score_without_model(chunks))) == [
        (0, "Code Quality", 0.0, 0),
        (1, "Runtime Bug", 0.0, 1),
    ]


def test_trivial_and_oversize_chunks_are_left_out(spark):
    long, limit = "\n".join(["x = 1"] * 102), "\n".join(["x = 1"] * 101)
    chunks = spark.createDataFrame([chunk(0, "import os"), chunk(1, long), chunk(2, limit), chunk(3)], schemas.CHUNKS)
    assert sorted(r.chunk_index for r in reviewable(chunks).collect()) == [2, 3]


def classification(index, label_id, confidence, label="Type Bug", pr=1, code="z", label_ord=0, start=1, file="a.py"):
    return (pr, index, label_ord, label, confidence, label_id, label_id == -1, code, file, start)


def test_ranking(spark):
    rows = [
        classification(0, 4, 0.9),
        classification(1, 3, 0.7),
        classification(2, 3, 0.8),
        classification(3, 1, 0.9),
        classification(4, 0, 1.0),
        classification(5, 3, 0.8),
        classification(6, -1, 0.0),
        classification(7, 2, 0.9),
        classification(8, None, 0.9),
    ]
    ranked = prioritize(spark.createDataFrame(rows, schemas.CLASSIFICATIONS)).orderBy("issue_idx").collect()
    assert [r.chunk_index for r in ranked] == [2, 5, 1, 3, 7, 0, 6]
    assert [r.issue_idx for r in ranked] == list(range(1, 8))


def test_top_issues_are_cut_before_the_shuffle(spark):
    rows = [classification(i, 3, 0.5) for i in range(30)]
    top = top_issues(spark.createDataFrame(rows, schemas.CLASSIFICATIONS))
    assert sorted(r.chunk_index for r in top.collect()) == list(range(10))
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


ANSWER = '[{"issue_number": 1, "explanation": " one ", "severity": "High", "recommended_fix": "f", "fixed_code": "c"}]'


@pytest.mark.parametrize(
    ("response", "expected"),
    [
        (ANSWER, {1: ("one", "High", "f", "c")}),
        (f"```json\n{ANSWER}\n```", {1: ("one", "High", "f", "c")}),
        (f" \n```\n{ANSWER}```  \n", {1: ("one", "High", "f", "c")}),
        (f"Sure: {ANSWER} Done.", {1: ("one", "High", "f", "c")}),
        ("no array here", {}),
        ('{"issue_number": 1}', {}),
        ("[1] and [2]", {}),
        ("[{]", {}),
        ("", {}),
        ('[5, null, "x", {"explanation": "pos four"}]', {4: ("pos four", "", "", "")}),
        ('[{"issue_number": "2", "severity": 3}]', {2: ("", "3", "", "")}),
        ('[{"issue_number": 1.7, "severity": "Low"}]', {1: ("", "Low", "", "")}),
        ('[{"issue_number": "x"}, {"issue_number": null}]', {}),
        ('[{"issue_number": 1, "severity": "a"}, {"issue_number": 1, "severity": "b"}]', {1: ("", "b", "", "")}),
        (
            '[{"explanation": 0, "severity": false, "recommended_fix": [], "fixed_code": true}]',
            {1: ("", "", "", "True")},
        ),
        ("[{}]", {1: ("", "", "", "")}),
        ('[{"explanation": "a [b] c"}]', {1: ("a [b] c", "", "", "")}),
    ],
)
def test_answer_entries(spark, response, expected):
    rows = answer_entries(spark.createDataFrame([(1, response)], schemas.RESPONSES)).collect()
    assert {
        r.issue_idx: (r.explanation, r.severity, r.recommended_fix, r.fixed_code) for r in rows
    } == expected


def test_json_array_text(values):
    texts = ["```json\n[1]\n```", "a [b\n] c] d", "none"]
    assert values(lambda t: json_array_text(t), texts) == ["[1]", "[b\n] c]", ""]


def explained(spark, rows, response="", pr=1):
    issues = prioritize(spark.createDataFrame(rows, schemas.CLASSIFICATIONS))
    return explain(issues, spark.createDataFrame([(pr, response)], schemas.RESPONSES))


def test_defaults_of_unanswered_issues(spark):
    rows = explained(spark, [classification(0, 3, 0.9), classification(1, 4, 0.9)], ANSWER).orderBy("issue_idx").collect()
    assert (rows[0].explanation, rows[0].fixed_code, rows[0].fix_suggestion) == ("one", "c", "one")
    assert rows[1].explanation == "Potential issue detected by static analysis."
    assert (rows[1].severity, rows[1].recommended_fix, rows[1].fixed_code) == (
        "Medium", "Review this code for correctness.", "",
    )


def test_prompt(spark):
    issues = prioritize(
        spark.createDataFrame([classification(0, 4, 0.945, "Logic Bug", code="a"), classification(1, 3, 0.5, code="b")], schemas.CLASSIFICATIONS)
    )
    [row] = prompts(issues).collect()
    assert row.prompt.endswith(
        "---\n\n### Issue 1\n**Bug type detected:** Type Bug\n**Confidence:** 50%\n\n```python\nb\n```\n\n"
        "### Issue 2\n**Bug type detected:** Logic Bug\n**Confidence:** 94%\n\n```python\na\n```\n\n"
    )


def test_first_answers(spark):
    log = [
        (1, 0, 1, None, "ok"),
        (2, 0, 1, "Error 429", None), (2, 0, 2, None, "skipped"), (2, 1, 1, None, "fallback"),
        (3, 0, 1, "timeout", None), (3, 0, 2, None, "second"), (3, 1, 1, None, "unused"),
        (4, 0, 1, "quota", None), (4, 1, 1, "quota", None),
        (5, 0, 4, None, "beyond the limit"),
        (6, 0, 1, None, "before"), (6, 0, 2, "429", None),
    ]
    attempts = spark.createDataFrame(log, schemas.ATTEMPTS)
    prs = spark.createDataFrame([(i,) for i in range(1, 8)], "pr_id long")
    found = {r.pr_id: r.response for r in first_answers(attempts, prs).collect()}
    assert found == {1: "ok", 2: "fallback", 3: "second", 4: NO_ANSWER, 5: NO_ANSWER, 6: "before", 7: NO_ANSWER}


def test_inline_comment(spark):
    code = "def f(cur):\n    return eval(cur)"
    df = explained(spark, [classification(0, 3, 0.9, "Security Vulnerability", code=code, start=0)], ANSWER)
    [c] = inline_comments(df).collect()
    assert (c.file, c.line) == ("a.py", 2)
    assert c.body == (
        f"**\U0001f6e1️ {PRODUCT} — Security Vulnerability (Confidence: 90%)**\n\n**Issue**\n\none\n\n"
        "**Severity:** High\n\n**Recommended fix**\n\nf\n\n**Fixed code**\n\n```python\nc\n```\n"
    )


def test_blank_fields_leave_no_section(spark):
    df = explained(spark, [classification(0, 3, 0.9)]).withColumns(
        {
            "explanation": F.lit(" "),
            "fix_suggestion": F.lit(None).cast("string"),
            "severity": F.lit(""),
            "recommended_fix": F.lit("\n"),
            "fixed_code": F.lit(None).cast("string"),
        }
    )
    [c] = inline_comments(df).collect()
    assert c.body.endswith("**Issue**\n\nNo details available.\n")
    languages = spark.createDataFrame([(1, "Python")], "pr_id long, language string")
    [r] = reviews(df, languages).collect()
    assert "**Explanation:**\n\nN/A\n\n---\n" in r.final_review
    assert "Severity" not in r.final_review and "fix:" not in r.final_review


def test_reviews(spark):
    rows = [
        classification(0, 3, 0.9, "Security Vulnerability"),
        classification(1, 3, 0.8, "Security Vulnerability"),
        classification(2, 1, 0.8, "Runtime Bug", code="'## Issue'"),
    ]
    languages = spark.createDataFrame([(1, "Go"), (2, "Python")], "pr_id long, language string")
    found = {r.pr_id: r for r in reviews(explained(spark, rows), languages).collect()}
    title = f"# \U0001f6e1️ {PRODUCT} Review\n"
    assert found[2].final_review == found[2].review_summary == (
        title + "\n**Language detected:** Python\n\n" + CLEAN_REVIEW
    )
    assert found[1].review_summary == (
        title + "\n**Language detected:** Go\n" + LANGUAGE_WARNING + "\n\n**3 issues detected.**\n\n"
        "- **Security Vulnerabilities:** 2\n- **Runtime Bug:** 1\n" + SUMMARY_FOOTER
    )
    assert found[1].final_review.startswith(
        title + "\n**Language detected:** Go\n" + LANGUAGE_WARNING + "\n\n**Issues found:** 3\n\n---\n\n## Issue 1: Security Vulnerability\n"
    )
    assert (found[1].issue_count, found[1].issues_found) == (3, 4)
    assert (found[2].issue_count, found[2].issues_found) == (0, 0)


def test_cap_comes_before_duplicates(spark):
    rows = [classification(i, 3, 0.9, start=i + 1) for i in range(12)]
    comments = inline_comments(explained(spark, rows))
    existing = spark.createDataFrame([(1, "a.py", 2), (1, "a.py", 2), (1, "b.py", 3)], "pr_id long, file string, line long")
    posted = comments_to_post(comments, existing)
    assert sorted(r.line for r in posted.collect()) == [1, 3, 4, 5, 6, 7, 8, 9, 10]
    review = spark.createDataFrame([(1, "full", "short"), (2, "full", "short")], "pr_id long, final_review string, review_summary string")
    assert {r.pr_id: r.status_body for r in status_body(review, posted).collect()} == {1: "short", 2: "full"}


def test_missing_fields_are_shown_by_defaults(spark):
    from diffmill.operators import explain, review

    schema = "pr_id long, issue_idx int, label string, confidence double, code string, file string, start_line int"
    extra = "explanation string, severity string, recommended_fix string, fixed_code string, fix_suggestion string"
    rows = [
        (1, 1, "Logic Bug", None, "x = 1", "a.py", 1), (1, 2, None, 0.5, None, "a.py", 2), (1, 3, "Logic Bug", 0.5, "y", None, 3),
    ]
    issues = spark.createDataFrame(rows, schema)
    assert explain.prompts(issues).head().prompt.count("### Issue ") == 3
    explained = spark.createDataFrame([(*r, *[None] * 5) for r in rows], f"{schema}, {extra}")
    languages = spark.createDataFrame([(1, "Python")], "pr_id long, language string")
    found = review.reviews(explained, languages).head()
    assert found.final_review.count("**File:** `") == 3 and "`unknown`" in found.final_review
    assert found.issue_count == found.issues_found == 3 and "Unknown" in found.review_summary
    assert all(r.body.count("Confidence") == 1 for r in review.inline_comments(explained).collect())


def test_a_failing_code_fails_alone(spark):
    import numpy as np

    from diffmill.operators.model import score_with_function

    def load():
        def predict(codes):
            if any("boom" in c for c in codes):
                raise ValueError("boom")
            return np.full((len(codes), 5), 0.2)

        return predict

    rows = [(i, f"def f{i}():\n    return {'boom' if i == 7 else i} + total") for i in range(50)]
    chunks = spark.createDataFrame(rows, "pr_id long, code string")
    failed = score_with_function(chunks, load).filter("prediction IS NULL OR prediction.label_id < 0").collect()
    assert [r.pr_id for r in failed] == [7]


def test_staging_needs_a_shared_folder():
    from types import SimpleNamespace as N

    from diffmill.sources import staging

    session = N(
        conf=N(get=lambda *_: None), sparkContext=N(master="spark://host:7077", getConf=lambda: N(get=lambda _: None))
    )
    with pytest.raises(ValueError, match="must name a folder"):
        staging.shared_dir(session)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_shuffles_of_the_review_job(spark):
    """Answers are read within their row, texts move once, and one aggregation per pull
    request makes the sections, the counts and the bullets."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        diffs = spark.createDataFrame([(1, "+++ b/a.py\n@@ -0,0 +1,2 @@\n+def f(x):\n+    return x / len(x)")], schemas.DIFFS)
        responses = spark.createDataFrame([(1, '[{"explanation": "e"}]')], schemas.RESPONSES)
        assert exchanges(answer_entries(responses)) == 0
        found = find_issues(diffs, score_without_model, stage=True)
        assert exchanges(explain(found.issues, responses)) == 2  # issues and answers, by pull request
        places = spark.createDataFrame([], "pr_id long, file string, line long")
        done = write_reviews(found, responses, places, stage=True)
        assert exchanges(done.reviews) <= 3
        assert done.reviews.first().issue_count == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bodies_of_posted_comments_alone(spark):
    """The cap and the places come first; both ways give the same comments."""
    rows = [(1, i, "Bug", 0.9, "x = 1\n", f"f{i % 4}.py", 3 * i) for i in range(1, 15)]
    issues = spark.createDataFrame(rows, "pr_id long, issue_idx int, label string, confidence double, code string, file string, start_line long")
    explained = explain(issues, spark.createDataFrame([], schemas.RESPONSES))
    places = spark.createDataFrame([(1, "f1.py", 3), (1, "f2.py", 99)], "pr_id long, file string, line long")
    one = planned_comments(explained, places).collect()
    other = comments_to_post(inline_comments(explained), places).select("pr_id", "issue_idx", "file", "line", "label", "confidence", "body")
    assert sorted(one) == sorted(other.collect()) and len(one) == 9
    assert sorted(comment_places(issues).collect()) == sorted(inline_comments(explained).select("pr_id", "issue_idx", "file", "line").collect())


def test_no_texts_of_a_review_are_broadcast(spark, tmp_path):
    """Compressed files hide the size of texts: the planner would send all through the driver."""
    from diffmill.plans.review_job import find_issues, write_reviews
    from diffmill.operators.classify import score_without_model

    def table(rows, schema, name):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, schema).write.parquet(path)
        return spark.read.parquet(path)

    diffs = table([(1, "+x = 1\n+y = x / 0"), (2, "")], "pr_id long, diff string", "diffs")
    answers = table([(1, "[]")], "pr_id long, response string", "answers")
    places = table([(1, "unknown", 0)], "pr_id long, file string, line long", "places")
    done = write_reviews(find_issues(diffs, score_without_model), answers, places)
    for product in (done.status, done.reviews, done.to_post, done.explained):
        assert "Broadcast" not in product._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.pr_id for r in done.status.collect()) == [1, 2]
