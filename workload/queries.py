"""Driver queries: one per operator, each over its whole input, with its SQL counterpart."""

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffmill import constants as C
from diffmill import schemas
from diffmill.functions import languages, rules, text
from diffmill.operators import classify as cl
from diffmill.operators import corpus as co
from diffmill.operators import diffs as d
from diffmill.operators import explain as ex
from diffmill.operators import metrics as me
from diffmill.operators import model as mo
from diffmill.operators import rank as rk
from diffmill.operators import review as rv
from diffmill.operators import selection as se
from diffmill.operators import split_diffs as sd
from diffmill.plans import corpus_job, review_job
from diffmill.functions.hashing import hash_number
from diffmill.sources import diffs as diff_source
from diffmill.sources import events as ev
from diffmill.sources import buckets, products, samples, staging
from diffmill.streaming import admission, streams
from workload import inputs as I
from workload import oracle as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql if sql.startswith("WITH ") else O.query(sql)
        return query

    return add


# --- steps several queries share ---------------------------------------------------------------


def chunks(spark, sf):
    return d.parse_diffs(I.diffs(spark, sf))


def scored(spark, sf):
    return I.formula_scorer(cl.reviewable(chunks(spark, sf)))


def classified(spark, sf):
    return cl.classify(scored(spark, sf))


def issues(spark, sf):
    return rk.prioritize(classified(spark, sf))


def explained(spark, sf):
    return ex.explain(issues(spark, sf), I.responses(spark, sf))


def comments(spark, sf):
    return rv.inline_comments(explained(spark, sf))


def corpus_codes(spark, sf):
    return diff_source.corpus_code(I.corpus(spark, sf))


def labelled(spark, sf):
    return co.label_code(corpus_codes(spark, sf))


def predicted(spark, sf):
    return labelled(spark, sf).select(
        "code", "label", (hash_number(F.col("code")) % 7 % 5).cast("int").alias("pred")
    )


def labelled_documents(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", F.col("text").alias("code"))
    marks = I.table(spark, sf, "labels").select(
        "doc_id", (F.col("quality") + 2 * F.col("toxic")).cast("int").alias("label")
    )
    return docs.join(marks, "doc_id")


def corpus_samples(spark, sf):
    seeded = co.with_seeds(labelled(spark, sf))
    return co.distinct_code(seeded, ["source_rank", "label"]).drop("source_rank")


# --- sources and sinks -----------------------------------------------------------------------


@register("s1_submitted_diffs", f"SELECT pr_id, {O.strip('diff')} AS diff FROM diffs WHERE {O.strip('diff')} <> ''")
def s1(spark, sf):
    return diff_source.submitted_diffs(I.diffs(spark, sf))


@register(
    "s1_rejected_diffs",
    f"""SELECT count(*) FILTER ({O.strip('diff')} <> '') AS accepted,
        count(*) FILTER ({O.strip('diff')} = '') AS rejected FROM diffs""",
)
def s1_rejected(spark, sf):
    return diff_source.rejected_diffs(I.diffs(spark, sf))


@register("s2_corpus_code", "SELECT code FROM codes")
def s2(spark, sf):
    return corpus_codes(spark, sf)


_SPLIT_SQL = """SELECT doc_id, label, CASE WHEN rn * 100 <= {} * n THEN 'train' {} ELSE '{}' END AS split
  FROM (SELECT doc_id, label, count(*) OVER (PARTITION BY label) AS n,
          row_number() OVER (PARTITION BY label ORDER BY """ + O.hash_order("doc_id") + """) AS rn
        FROM documents_distinct)"""
_SPLIT_3 = _SPLIT_SQL.format(70, "WHEN rn * 100 <= 85 * n THEN 'val'", "test")
_SPLIT_2 = _SPLIT_SQL.format(80, "", "val")


def distinct_documents(spark, sf):
    return co.distinct_code(labelled_documents(spark, sf), ["doc_id"])


@register("s3_sample_sink", _SPLIT_3)
def s3(spark, sf):
    split = se.stratified_split(distinct_documents(spark, sf), "doc_id")
    path = staging.new_path(spark, "samples")
    samples.write_samples(split.withColumn("sample_key", F.col("doc_id").cast("string")), path)
    back = samples.read_samples(spark, path)
    return back.select(F.col("sample_key").cast("bigint").alias("doc_id"), "label", "split")


@register("s4_split_fallback", _SPLIT_2)
def s4(spark, sf):
    return samples.training_parts(distinct_documents(spark, sf), "doc_id").select(
        "doc_id", "label", "split"
    )


@register("s5_review_products", "SELECT pr_id, final_review, review_summary, language FROM reviews")
def s5(spark, sf):
    parsed = chunks(spark, sf)
    review = rv.reviews(
        explained(spark, sf), review_job.pr_languages(I.diffs(spark, sf), parsed)
    )
    path = staging.new_path(spark, "products")
    products.write_products({"reviews": review}, path)
    back = spark.read.schema(review.schema).parquet(f"{path}/reviews")
    return back.select("pr_id", "final_review", "review_summary", "language")


@register("s6_webhook_events", "SELECT event_id, action, repo, pr_number, head_sha, installation_id FROM webhook_events")
def s6(spark, sf):
    return ev.webhook_events(I.payloads(spark, sf)).drop("ts")


_DAMAGED = """CASE event_id % 9 WHEN 1 THEN substr(payload, 1, length(payload) - 3) WHEN 3 THEN 'not json'
  WHEN 4 THEN concat('[', payload, ']') WHEN 5 THEN CAST(NULL AS VARCHAR(1)) WHEN 7 THEN '12' WHEN 8 THEN '' ELSE payload END"""


@register(
    "s6_broken_payloads",
    f"""SELECT event_id, CASE WHEN damaged IS NULL THEN 'no payload' WHEN NOT json_valid(damaged) THEN 'no JSON'
          WHEN json_type(CASE WHEN json_valid(damaged) THEN damaged ELSE '{{}}' END) <> 'OBJECT' THEN 'no object' END AS reason
        FROM (SELECT event_id, {_DAMAGED} AS damaged FROM payloads)""",
)
def s6_broken(spark, sf):
    """Every payload, damaged ones with the reason, sound ones with none."""
    sound, broken = ev.sound_payloads(I.payloads(spark, sf).withColumn("payload", F.expr(_DAMAGED)))
    return sound.select("event_id", F.lit(None).cast("string").alias("reason")).unionByName(broken.select("event_id", "reason"))


@register("s7_commented_places", "SELECT pr_id, file, line FROM places")
def s7(spark, sf):
    return ev.commented_places(I.existing_comments(comments(spark, sf)))


def _class_metrics_sql(source: str, by: str = "") -> str:
    return f"""SELECT {by} class_id, hit, support, coalesce(hit / nullif(found, 0)::DOUBLE, 0) AS precision_,
        coalesce(hit / nullif(support, 0)::DOUBLE, 0) AS recall_
      FROM (SELECT {by} class_id, sum(h) AS hit, sum(s) AS support, sum(f) AS found FROM (
          SELECT {by} label AS class_id, CASE WHEN label = pred THEN 1 ELSE 0 END AS h, 1 AS s, 0 AS f FROM {source}
          UNION ALL SELECT {by} pred, 0, 0, 1 FROM {source}) GROUP BY ALL)"""


_F1 = "coalesce(2 * precision_ * recall_ / nullif(precision_ + recall_, 0), 0)"


_CELLS = [*(f"pred_{c}" for c in C.CLASS_NAMES), "pred_other"]


def _matrix_sql(source: str) -> str:
    known = ", ".join(f"count(*) FILTER (real AND pred = {c}) AS pred_{c}" for c in C.CLASS_NAMES)
    return f"""SELECT label, {known}, count(*) FILTER (real AND (pred IS NULL OR pred NOT IN (0, 1, 2, 3, 4))) AS pred_other
      FROM (SELECT label, pred, true AS real FROM {source} UNION ALL SELECT pred, NULL, false FROM {source}) GROUP BY label"""


def _number(x: str) -> str:
    return f"lpad(printf('%.4f', CAST({x} AS DOUBLE)), 10, ' ')"


def _report_sql() -> str:
    def mean(x: str, weight: str) -> str:
        return f"sum({x} * {weight}) / sum({weight})"

    names = ("precision_", "recall_", "f1")
    averages = [
        ("'accuracy'", ["sum(hit) / CAST(sum(support) AS DOUBLE)"]),
        ("'macro avg'", [f"avg({n})" for n in names]),
        ("'weighted avg'", [mean(n, "support") for n in names]),
    ]
    per_class = f"(SELECT *, {_F1} AS f1 FROM ({_class_metrics_sql('predicted')}))"
    head = f"""SELECT 0 AS line_no, '{C.PRODUCT} evaluation report' AS line
      UNION ALL SELECT 1, concat('Samples evaluated: ', count(*)) FROM predicted
      UNION ALL SELECT 2, 'class  precision  recall  f1  support'
      UNION ALL SELECT 100 + class_id, concat_ws(' ', {O.case_map('class_id', C.CLASS_NAMES, "'Unknown'")},
        {', '.join(_number(n) for n in names)}, CAST(support AS BIGINT)) FROM {per_class}"""
    for at, (name, values) in enumerate(averages):
        head += f" UNION ALL SELECT {200 + at}, concat({name}, {', '.join(_number(v) for v in values)}) FROM {per_class}"
    return head + f" UNION ALL SELECT 300 + label, concat_ws(' ', label, {', '.join(_CELLS)}) FROM ({_matrix_sql('predicted')})"


@register("s8_evaluation_report", _report_sql())
def s8(spark, sf):
    rows = predicted(spark, sf)
    return products.evaluation_report(
        me.class_metrics(rows), me.summary_metrics(rows), me.confusion_matrix(rows)
    )


# --- diff parsing --------------------------------------------------------------------------------


@register("d1_diff_lines", "SELECT pr_id, pos, raw FROM lines")
def d1(spark, sf):
    return d.diff_lines(I.diffs(spark, sf))


@register("d2_line_kinds", "SELECT pr_id, kind, count(*) AS n, CAST(sum(pos) AS BIGINT) AS positions FROM kinds GROUP BY ALL")
def d2(spark, sf):
    kinds = d.diff_lines(I.diffs(spark, sf)).withColumn("kind", d.line_kind(F.col("raw")))
    return kinds.groupBy("pr_id", "kind").agg(F.count("*").alias("n"), F.sum("pos").alias("positions"))


@register("d3_added_lines", "SELECT pr_id, file, line_no, code, boundary FROM added")
def d3(spark, sf):
    return d.added_lines(I.diffs(spark, sf)).select("pr_id", "file", "line_no", "code", "boundary")


@register("d7_chunks", "SELECT pr_id, chunk_index, file, start_line, code FROM chunks")
def d7(spark, sf):
    return chunks(spark, sf)


_DOC_DIFF = "concat('+++ b/d', CAST(doc_id AS VARCHAR(20)), '.py', chr(10), '@@ -0,0 +1,1 @@', chr(10), '+', replace(text, chr(10), concat(chr(10), '+')))"


@register("d7_split_diffs", "SELECT pr_id, chunk_index, file, start_line, code FROM chunks")
def d7_split(spark, sf):
    """Every diff in segments of 60 lines, as if it were too large for a task."""
    return sd.parse_segments(sd.segments_of(I.diffs(spark, sf), lines=60), stage=True)


@register(
    "d7_document_chunks",
    O.query("SELECT pr_id, chunk_index, file, start_line, code FROM chunks", "chunks").replace(
        O.STEPS["diffs"], f"SELECT doc_id AS pr_id, {_DOC_DIFF} AS diff FROM documents"
    ),
)
def d7_documents(spark, sf):
    docs = I.table(spark, sf, "documents")
    return d.parse_diffs(docs.selectExpr("doc_id AS pr_id", _DOC_DIFF + " AS diff"))


# --- projections and filters ---------------------------------------------------------------------


@register("p1_file_languages", f"SELECT pr_id, chunk_index, {O.language('file')} AS language FROM chunks")
def p1(spark, sf):
    return chunks(spark, sf).select(
        "pr_id", "chunk_index", languages.language_of(F.col("file")).alias("language")
    )


@register("p2_trivial_chunks", f"SELECT pr_id, chunk_index, {O.is_trivial('code')} AS is_trivial FROM chunks")
def p2(spark, sf):
    return chunks(spark, sf).select(
        "pr_id", "chunk_index", rules.is_trivial(F.col("code")).alias("is_trivial")
    )


@register(
    "p3_size_limit",
    "SELECT doc_id FROM documents WHERE length(text) - length(replace(text, chr(10), '')) <= 100",
)
def p3(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", F.col("text").alias("code"))
    return d.within_size_limit(docs).select("doc_id")


@register("p4_usable_code", "SELECT doc_id, text AS code FROM documents WHERE length(text) BETWEEN 1 AND 2048")
def p4(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", F.col("text").alias("code"))
    return co.usable_code(docs)


_BLANKED = "CASE WHEN pr_id % 7 = 0 THEN concat(' ', chr(10)) ELSE code END"


@register(
    "p5_guarded_predictions",
    f"""SELECT pr_id, chunk_index, CASE WHEN pr_id % 7 = 0 THEN 'Clean' ELSE p_label END AS label,
        CASE WHEN pr_id % 7 = 0 THEN 0.0 ELSE p_conf END AS confidence,
        CASE WHEN pr_id % 7 = 0 THEN 0 ELSE p_id END AS label_id FROM scored""",
)
def p5(spark, sf):
    raw = cl.reviewable(chunks(spark, sf)).withColumn("prediction", I.prediction())
    guarded = cl.guarded_prediction(F.expr(_BLANKED), F.col("prediction"))
    return raw.select("pr_id", "chunk_index", guarded.alias("p")).select(
        "pr_id", "chunk_index", "p.label", "p.confidence", "p.label_id"
    )


@register("p6_error_issues", "SELECT pr_id, chunk_index, label, label_id FROM issues WHERE is_error")
def p6(spark, sf):
    return issues(spark, sf).filter("is_error").select("pr_id", "chunk_index", "label", "label_id")


@register(
    "p7_without_model",
    f"""SELECT pr_id, chunk_index, label, CASE WHEN label = 'Code Quality' THEN 0 ELSE {O.case_map('label', C.ISSUE_TYPE_IDS, '4')} END AS label_id
        FROM (SELECT *, {O.refined("'Code Quality'", '0.0', 'code')} AS label FROM reviewable)""",
)
def p7(spark, sf):
    found = cl.classify(cl.score_without_model(cl.reviewable(chunks(spark, sf))))
    return found.select("pr_id", "chunk_index", "label", "label_id")


@register("p8_issue_types", f"SELECT pr_id, chunk_index, {O.issue_type('p_label')} AS issue_type FROM scored")
def p8(spark, sf):
    return scored(spark, sf).select(
        "pr_id", "chunk_index", cl.issue_type_of(F.col("prediction.label")).alias("issue_type")
    )


@register(
    "p9_confidence_gate",
    f"""SELECT pr_id, chunk_index, CASE WHEN p_conf < 0.6 AND t NOT IN ('Clean', 'Code Quality') THEN 'Code Quality' ELSE t END AS gated
        FROM (SELECT *, {O.issue_type('p_label')} AS t FROM scored)""",
)
def p9(spark, sf):
    kind = cl.issue_type_of(F.col("prediction.label"))
    return scored(spark, sf).select(
        "pr_id",
        "chunk_index",
        cl.gated_issue_type(kind, F.col("prediction.confidence")).alias("gated"),
    )


@register(
    "p10_refinement",
    f"SELECT pr_id, chunk_index, {O.refined(chr(39) + 'Clean' + chr(39), 'p_conf', 'code')} AS refined FROM scored",
)
def p10(spark, sf):
    refined = rules.refined_issue_type(F.lit("Clean"), F.col("prediction.confidence"), F.col("code"))
    return scored(spark, sf).select("pr_id", "chunk_index", refined.alias("refined"))


@register(
    "p11_classified",
    "SELECT pr_id, chunk_index, label_ord, label, confidence, label_id, is_error, code, file, start_line FROM classified",
)
def p11(spark, sf):
    return classified(spark, sf)


@register("p12_issues_only", "SELECT pr_id, chunk_index, label_ord, label_id FROM classified WHERE label_id <> 0")
def p12(spark, sf):
    return rk.issues_only(classified(spark, sf)).select("pr_id", "chunk_index", "label_ord", "label_id")


@register(
    "p13_reviewed_events",
    """SELECT event_id, action, pr_number FROM webhook_events
       WHERE action IN ('opened', 'synchronize', 'reopened') AND coalesce(installation_id, 0) <> 0""",
)
def p13(spark, sf):
    events = ev.reviewed_events(ev.webhook_events(I.payloads(spark, sf)))
    return events.select("event_id", "action", "pr_number")


_ATTEMPTS_SQL = """(SELECT o_orderkey AS pr_id, unnest(CASE o_orderkey % 5
    WHEN 0 THEN [{'m': 0, 'a': 1, 'e': NULL, 'c': 'first'}]
    WHEN 1 THEN [{'m': 0, 'a': 1, 'e': 'HTTP 429: Quota', 'c': NULL}, {'m': 0, 'a': 2, 'e': NULL, 'c': 'ignored'},
                 {'m': 1, 'a': 1, 'e': NULL, 'c': 'fallback'}]
    WHEN 2 THEN [{'m': 0, 'a': 1, 'e': 'timeout', 'c': NULL}, {'m': 0, 'a': 2, 'e': 'timeout', 'c': NULL},
                 {'m': 0, 'a': 3, 'e': NULL, 'c': 'third'}]
    WHEN 3 THEN [{'m': 0, 'a': 1, 'e': 'Tokens per DAY used up', 'c': NULL}, {'m': 1, 'a': 1, 'e': 'rate_limit', 'c': NULL}]
    ELSE [{'m': 0, 'a': 4, 'e': NULL, 'c': 'too late'}] END) AS t FROM orders)"""
_LIMITED = "regexp_matches(lower(t.e), 'rate_limit|429|tokens per day|tokens per minute|quota')"


@register(
    "p14_rate_limited",
    f"SELECT pr_id, t.m AS model_rank, t.a AS attempt, {_LIMITED} AS limited FROM {_ATTEMPTS_SQL} WHERE t.e IS NOT NULL",
)
def p14(spark, sf):
    failed = I.attempts(spark, sf).filter(F.col("error").isNotNull())
    return failed.select(
        "pr_id", "model_rank", "attempt", rules.is_rate_limited(F.col("error")).alias("limited")
    )


@register("p15_suspicious_lines", f"SELECT pr_id, chunk_index, {O.suspicious_offset('code')} AS line_offset FROM chunks")
def p15(spark, sf):
    return chunks(spark, sf).select(
        "pr_id", "chunk_index", rules.suspicious_line_offset(F.col("code")).alias("line_offset")
    )


@register("p16_comment_lines", "SELECT pr_id, issue_idx, file, line FROM comments")
def p16(spark, sf):
    return comments(spark, sf).select("pr_id", "issue_idx", "file", "line")


@register("p17_language_headers", "SELECT pr_id, header FROM headers")
def p17(spark, sf):
    found = review_job.pr_languages(I.diffs(spark, sf), chunks(spark, sf))
    return found.select("pr_id", rv.language_header(F.col("language")).alias("header"))


_STATUS = """SELECT r.pr_id, CASE WHEN review_summary <> '' AND p.n > 0 THEN review_summary ELSE final_review END AS status_body
  FROM reviews r LEFT JOIN (SELECT pr_id, count(*) AS n FROM to_post GROUP BY pr_id) p USING (pr_id)"""


def whole_review(spark, sf, stage=False):
    found = review_job.find_issues(I.diffs(spark, sf), I.formula_scorer, stage)
    # the earlier comments of the test are made from the planned ones
    existing = I.existing_comments(rv.comment_places(found.issues))
    return review_job.write_reviews(
        found, I.responses(spark, sf), ev.commented_places(existing), stage=stage
    )


@register("p18_status_bodies", _STATUS)
def p18(spark, sf):
    return whole_review(spark, sf, stage=True).status


# --- joins -----------------------------------------------------------------------------------------


@register(
    "j1_lookups",
    f"""SELECT pr_id, chunk_index, {O.case_map('p_id', C.CLASS_NAMES, "'none'")} AS class_name,
        {O.case_map('p_id', C.SEVERITY_RANKS, '0')} AS severity_rank FROM scored""",
)
def j1(spark, sf):
    label_id = F.col("prediction.label_id")
    return scored(spark, sf).select(
        "pr_id",
        "chunk_index",
        text.lookup(C.CLASS_NAMES, label_id, "none").alias("class_name"),
        rk.severity_rank(label_id).alias("severity_rank"),
    )


@register(
    "j2_explained_issues",
    "SELECT pr_id, issue_idx, label, explanation, severity, recommended_fix, fixed_code FROM explained",
)
def j2(spark, sf):
    return explained(spark, sf).select(
        "pr_id", "issue_idx", "label", "explanation", "severity", "recommended_fix", "fixed_code"
    )


@register("j3_comments_to_post", "SELECT pr_id, issue_idx, file, line, label, confidence, body FROM to_post")
def j3(spark, sf):
    found = staging.staged(issues(spark, sf), "issues")
    existing = ev.commented_places(I.existing_comments(rv.comment_places(found)))
    # the cap comes before the answers, the bodies after the places
    top = found.filter(F.col("issue_idx") <= C.MAX_INLINE_COMMENTS)
    return rv.planned_comments(ex.explain(top, I.responses(spark, sf)), existing)


@register("j4_fix_suggestions", "SELECT pr_id, issue_idx, chunk_index, code, file, explanation AS fix_suggestion FROM explained")
def j4(spark, sf):
    return explained(spark, sf).select("pr_id", "issue_idx", "chunk_index", "code", "file", "fix_suggestion")


@register(
    "j_scores_from_table",
    "SELECT pr_id, chunk_index, CASE WHEN pr_id % 3 = 0 THEN 'Error' ELSE p_label END AS label FROM scored",
)
def j_scores(spark, sf):
    made = I.formula_scorer(chunks(spark, sf)).filter("pr_id % 3 <> 0")
    table = made.select("pr_id", "chunk_index", "prediction")
    joined = cl.score_from_table(cl.reviewable(chunks(spark, sf)), table)
    return joined.select("pr_id", "chunk_index", "prediction.label")


# --- aggregations ----------------------------------------------------------------------------------


@register("a1_language_counts", "SELECT pr_id, language, n, first_chunk FROM language_counts")
def a1(spark, sf):
    return languages.language_counts(chunks(spark, sf))


@register("a1_primary_language", "SELECT pr_id, language FROM pr_languages")
def a1_primary(spark, sf):
    found = review_job.pr_languages(I.diffs(spark, sf), chunks(spark, sf))
    return found.select("pr_id", "language")


_NAMES = "(VALUES " + ", ".join(f"({k}, '{v}')" for k, v in C.CLASS_NAMES.items()) + ") AS c(label, class_name)"
_CLASS_SQL = f"""SELECT c.label, class_name, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER () AS total
  FROM {_NAMES} LEFT JOIN (SELECT label, count(*) AS n FROM {{}} GROUP BY label) s ON s.label = c.label"""


@register(
    "a2_class_distribution",
    f"SELECT label, class_name, n, round(n * 100 / CAST(total AS DOUBLE), 4) AS percent FROM ({_CLASS_SQL.format('labelled')})",
)
def a2(spark, sf):
    return co.class_distribution(labelled(spark, sf))


@register(
    "a3_short_classes",
    f"""SELECT label, class_name, n, floor FROM (SELECT *, {O.case_map('label', C.CLASS_FLOORS, '0')} AS floor
        FROM ({_CLASS_SQL.format('documents_labelled')})) WHERE n < floor""",
)
def a3(spark, sf):
    return co.short_classes(labelled_documents(spark, sf))


@register(
    "a4_class_weights",
    f"""SELECT label, round(total / CAST(5 * greatest(n, 1) AS DOUBLE), 6) AS weight
        FROM ({_CLASS_SQL.format('documents_labelled')})""",
)
def a4(spark, sf):
    weights = co.class_weights(labelled_documents(spark, sf))
    return weights.select("label", F.round("weight", 6).alias("weight"))


@register("a5_confusion_counts", "SELECT label, pred, count(*) AS n FROM predicted GROUP BY ALL")
def a5(spark, sf):
    return me.confusion_counts(predicted(spark, sf))


_FOREIGN_SQL = f"""(SELECT CASE {O.hash_number('code')} % 11 WHEN 0 THEN 7 WHEN 1 THEN NULL ELSE label END AS label,
    CASE {O.hash_number('code')} % 13 WHEN 0 THEN -1 WHEN 1 THEN NULL ELSE {O.hash_number('code')} % 7 % 5 END AS pred FROM labelled)"""


@register("a5_confusion_matrix", _matrix_sql(_FOREIGN_SQL))
def a5_matrix(spark, sf):
    """With classes and predictions that are missing, foreign or failed."""
    draw = hash_number(F.col("code"))
    label = F.when(draw % 11 == 0, 7).when(draw % 11 != 1, F.col("label"))
    pred = F.when(draw % 13 == 0, -1).when(draw % 13 != 1, (draw % 7 % 5).cast("int"))
    return me.confusion_matrix(labelled(spark, sf).select(label.alias("label"), pred.alias("pred")))


@register(
    "a2_unknown_classes",
    f"SELECT label, count(*) AS n FROM {_FOREIGN_SQL} WHERE label IS NULL OR label NOT IN (0, 1, 2, 3, 4) GROUP BY label",
)
def a2_unknown(spark, sf):
    draw = hash_number(F.col("code"))
    label = F.when(draw % 11 == 0, 7).when(draw % 11 != 1, F.col("label"))
    return co.unknown_classes(labelled(spark, sf).select(label.alias("label")))


@register(
    "a6_class_metrics",
    f"""SELECT class_id, round(precision_, 6) AS "precision", round(recall_, 6) AS recall, round({_F1}, 6) AS f1, CAST(support AS BIGINT) AS support
        FROM ({_class_metrics_sql('predicted')})""",
)
def a6(spark, sf):
    found = me.class_metrics(predicted(spark, sf))
    return found.select(
        "class_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


@register(
    "a6_summary_metrics",
    f"""SELECT round(sum(hit) / sum(support)::DOUBLE, 6) AS accuracy, round(avg(f1), 6) AS macro_f1,
          round(sum(f1 * support) / sum(support), 6) AS weighted_f1, CAST(sum(support) AS BIGINT) AS support
        FROM (SELECT *, {_F1} AS f1 FROM ({_class_metrics_sql('predicted')}))""",
)
def a6_summary(spark, sf):
    found = me.summary_metrics(predicted(spark, sf))
    return found.select(
        *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")], "support"
    )


_CANDIDATES = f"""(SELECT code, label, unnest([0, 1, 2]) AS candidate,
    CASE WHEN {O.hash_number("code")} % 5 < unnest([1, 3, 3]) THEN label ELSE 0 END AS pred FROM labelled)"""


@register(
    "a7_best_candidate",
    f"""SELECT candidate, round(weighted_f1, 6) AS weighted_f1 FROM (
          SELECT candidate, sum(f1 * support) / sum(support) AS weighted_f1
          FROM (SELECT *, {_F1} AS f1 FROM ({_class_metrics_sql(_CANDIDATES, 'candidate,')})) GROUP BY candidate)
        WHERE weighted_f1 > 0 ORDER BY weighted_f1 DESC, candidate LIMIT 1""",
)
def a7(spark, sf):
    rights = F.array(*[F.struct(F.lit(i).alias("candidate"), F.lit(n).alias("right")) for i, n in enumerate((1, 3, 3))])
    rows = labelled(spark, sf).select("code", "label", F.inline(rights))
    pred = F.when(hash_number(F.col("code")) % 5 < F.col("right"), F.col("label")).otherwise(0)
    best = me.best_candidate(rows.withColumn("pred", pred))
    return best.select("candidate", F.round("weighted_f1", 6).alias("weighted_f1"))


@register("a8_issue_type_counts", "SELECT pr_id, label, n, first_idx FROM type_counts")
def a8(spark, sf):
    return rv.issue_type_counts(issues(spark, sf))


@register("a9_summaries", "SELECT pr_id, bullets, total FROM bullets")
def a9(spark, sf):
    return rv.summary_bullets(issues(spark, sf))


@register("a10_full_reviews", "SELECT pr_id, final_review FROM reviews")
def a10(spark, sf):
    found = review_job.find_issues(I.diffs(spark, sf), I.formula_scorer, stage=True)
    review = rv.reviews(ex.explain(found.issues, I.responses(spark, sf)), found.languages)
    return review.select("pr_id", "final_review")


@register("a11_comment_bodies", "SELECT pr_id, issue_idx, body FROM comments")
def a11(spark, sf):
    return comments(spark, sf).select("pr_id", "issue_idx", "body")


@register(
    "a12_prompts",
    f"""SELECT pr_id, {O.lit(C.PROMPT_HEADER)} || string_agg('### Issue ' || issue_idx || chr(10) || '**Bug type detected:** ' || label
          || chr(10) || '**Confidence:** ' || {O.percent('confidence')} || chr(10) || chr(10) || '```python' || chr(10) || code || chr(10)
          || '```' || chr(10) || chr(10), '' ORDER BY issue_idx) AS prompt FROM issues GROUP BY pr_id""",
)
def a12(spark, sf):
    return ex.prompts(issues(spark, sf))


@register(
    "a13_issues_found",
    "SELECT pr_id, CAST(len(string_split(final_review, '## Issue')) - 1 AS INT) AS issues_found, issue_count FROM reviews",
)
def a13(spark, sf):
    found = review_job.find_issues(I.diffs(spark, sf), I.formula_scorer, stage=True)
    review = rv.reviews(ex.explain(found.issues, I.responses(spark, sf)), found.languages)
    return review.select("pr_id", "issues_found", "issue_count")


@register(
    "a14_detection_report",
    "SELECT file, label, count(*) AS issues, round(avg(confidence), 6) AS mean_confidence FROM issues GROUP BY ROLLUP (file, label)",
)
def a14(spark, sf):
    report = me.detection_report(classified(spark, sf).filter("label_id <> 0"))
    return report.withColumn("mean_confidence", F.round("mean_confidence", 6))


@register(
    "a15_snippet_accuracy",
    """SELECT count(*) AS snippets, round(avg(CAST(label = pred AS INT)), 6) AS accuracy,
       avg(CAST(label = pred AS INT)) >= 0.5 AS reaches_floor FROM predicted""",
)
def a15(spark, sf):
    found = me.snippet_accuracy(predicted(spark, sf))
    return found.withColumn("accuracy", F.round("accuracy", 6))


# --- ranking, sampling, splitting -----------------------------------------------------------------


@register("w1_ranked_issues", "SELECT pr_id, issue_idx, chunk_index, label_ord, label, label_id, confidence FROM issues")
def w1(spark, sf):
    return issues(spark, sf).select(
        "pr_id", "issue_idx", "chunk_index", "label_ord", "label", "label_id", "confidence"
    )


@register("w2_top_issues", "SELECT pr_id, issue_idx, chunk_index, label FROM issues WHERE issue_idx <= 10")
def w2(spark, sf):
    return rk.top_issues(classified(spark, sf)).select("pr_id", "issue_idx", "chunk_index", "label")


@register("w3_subsample", f"SELECT doc_id, text FROM documents ORDER BY {O.hash_order('doc_id')} LIMIT 300")
def w3(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", "text")
    return se.subsample(docs, "doc_id", 300)


@register("w4_downsample", "SELECT code, label, sample_key FROM downsampled")
def w4(spark, sf):
    return se.downsample(corpus_samples(spark, sf), "sample_key").select("code", "label", "sample_key")


@register("w5_upsample", "SELECT code, label, variant, sample_key FROM variants")
def w5(spark, sf):
    return co.upsample(corpus_samples(spark, sf))


@register("w6_shuffled", "SELECT sample_key, code, label FROM samples")
def w6(spark, sf):
    return co.shuffled(corpus_samples(spark, sf)).select("sample_key", "code", "label")


_FOREIGN_SPLIT = _SPLIT_3.replace("PARTITION BY label", "PARTITION BY CASE WHEN label IN (0, 1, 2, 3, 4) THEN label END").replace(
    "documents_distinct)", "(SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 7 WHEN 1 THEN 8 WHEN 2 THEN NULL ELSE label END AS label FROM documents_distinct))"
)


@register("o_split_unknown_classes", _FOREIGN_SPLIT)
def o_split_unknown(spark, sf):
    """Rows of two foreign classes, and of none, are split together."""
    rest = F.when(F.col("doc_id") % 10 != 2, F.col("label"))
    label = F.when(F.col("doc_id") % 10 == 0, 7).when(F.col("doc_id") % 10 == 1, 8).otherwise(rest)
    rows = distinct_documents(spark, sf).withColumn("label", label)
    return se.stratified_split(rows, "doc_id").select("doc_id", "label", "split")


@register("o_split_stratified", _SPLIT_3)
def o_split(spark, sf):
    return se.stratified_split(distinct_documents(spark, sf), "doc_id").select("doc_id", "label", "split")


@register(
    "o_split_approximate",
    f"""SELECT doc_id, CASE WHEN {O.hash_number('doc_id')} / 4294967296.0::DOUBLE < 0.70 THEN 'train'
          WHEN {O.hash_number('doc_id')} / 4294967296.0::DOUBLE < 0.85 THEN 'val' ELSE 'test' END AS split FROM documents""",
)
def o_split_approximate(spark, sf):
    return se.approximate_split(I.table(spark, sf, "documents").select("doc_id"), "doc_id")


# --- sets and distinct -------------------------------------------------------------------------------


@register("u0_seeded", "SELECT code, label, source_rank FROM seeded")
def u0(spark, sf):
    return co.with_seeds(labelled(spark, sf))


@register("u2_distinct_code", "SELECT sample_key, code, label FROM samples")
def u2(spark, sf):
    return corpus_samples(spark, sf)


@register("u2_distinct_documents", "SELECT sample_key, doc_id, code, label FROM documents_distinct")
def u2_documents(spark, sf):
    return distinct_documents(spark, sf)


@register("u3_without_nulls", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def u3(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id")
    joined = docs.join(I.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return co.without_nulls(joined)


@register("u4_balanced", "SELECT code, label, sample_key FROM balanced")
def u4(spark, sf):
    return co.balance(staging.staged(corpus_samples(spark, sf), "samples"))


# --- nested data and JSON ------------------------------------------------------------------------------


@register(
    "u1_variants",
    f"""SELECT sample_key, variant, CASE WHEN variant >= 2 THEN 'def wrapper():' || chr(10) || array_to_string(
            list_transform({O.lines_of('t')}, lambda l: '    ' || l), chr(10)) ELSE t END AS code
        FROM (SELECT *, CASE WHEN variant % 2 = 0 THEN regexp_replace(r, '\\n(\\s*\\S)', chr(10) || chr(10) || '\\1')
                ELSE {O.comment_choice('sample_key')} || chr(10) || r END AS t
          FROM (SELECT *, {O.renamed('code', 'chosen', 'sample_key')} AS r
            FROM (SELECT *, {O.chosen_names('code', 'sample_key')} AS chosen
              FROM (SELECT code, v AS variant, concat(sample_key, '#', v) AS sample_key
                FROM (SELECT *, unnest([0, 1, 2, 3]) AS v FROM samples)))))""",
)
def u1(spark, sf):
    numbered = co.augmented(corpus_samples(spark, sf), F.lit(1))
    return co.write_variants(numbered).select("sample_key", "variant", "code")


@register("u5_labels", "SELECT pr_id, chunk_index, label_ord, confidence, label FROM classified")
def u5(spark, sf):
    return classified(spark, sf).select("pr_id", "chunk_index", "label_ord", "confidence", "label")


@register("u6_json_arrays", "SELECT pr_id, body FROM array_texts")
def u6(spark, sf):
    return I.responses(spark, sf).select("pr_id", ex.json_array_text(F.col("response")).alias("body"))


@register("u7_answer_entries", "SELECT pr_id, issue_idx FROM entries")
def u7(spark, sf):
    return ex.answer_entries(I.responses(spark, sf)).select("pr_id", "issue_idx")


@register("u8_entry_fields", "SELECT pr_id, issue_idx, explanation, severity, recommended_fix, fixed_code FROM entries")
def u8(spark, sf):
    return ex.answer_entries(I.responses(spark, sf))


@register(
    "u9_first_answers",
    f"""SELECT o_orderkey AS pr_id, coalesce(c, {O.lit(C.NO_ANSWER)}) AS response FROM orders LEFT JOIN (
          SELECT pr_id, t.c AS c FROM (
            SELECT *, min(CASE WHEN {_LIMITED} THEN t.a END) OVER (PARTITION BY pr_id, t.m) AS limited_at
            FROM {_ATTEMPTS_SQL} WHERE t.a <= 3)
          WHERE t.e IS NULL AND (limited_at IS NULL OR t.a < limited_at)
          QUALIFY row_number() OVER (PARTITION BY pr_id ORDER BY t.m, t.a) = 1) a ON a.pr_id = o_orderkey""",
)
def u9(spark, sf):
    prs = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("pr_id"))
    return ex.first_answers(I.attempts(spark, sf), prs)


# --- scalar functions and rules ------------------------------------------------------------------------


@register("t1_split_lines", f"SELECT doc_id, len({O.lines_of('text')}) AS n_lines, ({O.lines_of('text')})[-1] AS last_line FROM documents")
def t1(spark, sf):
    lines = text.split_lines(F.col("text"))
    docs = I.table(spark, sf, "documents").select("doc_id", lines.alias("lines"))
    return docs.select("doc_id", F.size("lines").alias("n_lines"), F.element_at("lines", -1).alias("last_line"))


@register("t2_percent_texts", f"SELECT l_orderkey, l_discount, {O.percent('(l_discount * 9.45)')} AS percent FROM lineitem")
def t2(spark, sf):
    items = I.table(spark, sf, "lineitem")
    return items.select(
        "l_orderkey", "l_discount", text.percent(F.col("l_discount") * 9.45).alias("percent")
    )


@register(
    "t3_softmax",
    f"""SELECT vec_id, round(list_max(p), 4) AS confidence, list_position(p, list_max(p)) - 1 AS label_id
        FROM (SELECT vec_id, list_transform(x, lambda v: exp(v - list_max(x)) / list_sum(list_transform(x, lambda w: exp(w - list_max(x))))) AS p
          FROM (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings))""",
)
def t3(spark, sf):
    logits = F.transform("embedding", lambda v: v.cast("double"))
    vectors = I.table(spark, sf, "embeddings").select("vec_id", logits.alias("x"))
    probs = vectors.select("vec_id", mo.softmax(F.col("x")).alias("p"))
    return probs.select("vec_id", mo.prediction_struct(F.col("p")).alias("s")).select(
        "vec_id", "s.confidence", "s.label_id"
    )


def _rule_query(name: str, condition: str, rule: Callable) -> None:
    @register(name, f"SELECT code, {condition} AS hit FROM codes")
    def rule_hits(spark, sf):
        codes = corpus_codes(spark, sf)
        return codes.select("code", rule(F.col("code")).alias("hit"))


_rule_query("t4_sql_injection", O.any_hit("code", O.SQL_INJECTION, "i"), rules.has_sql_injection_risk)
_rule_query("t5_security", O.any_hit("code", O.SQL_INJECTION + O.SECURITY, "i"), rules.has_security_risk)
_rule_query("t6_null_reference", O.any_hit("code", O.NULL_REFERENCE), rules.has_null_reference_risk)
_rule_query("t7_type_mismatch", O.any_hit("code", O.TYPE_MISMATCH), rules.has_type_mismatch)
_rule_query(
    "t8_logic_flaw", f"({O.any_hit('code', O.LOGIC_FLAW)} OR {O.endless_loop('code')})", rules.has_logic_flaw
)


@register("t9_rule_labels", "SELECT code, label FROM labelled")
def t9(spark, sf):
    return labelled(spark, sf)


@register(
    "t9_chunk_classes",
    f"SELECT label, count(*) AS chunks, count(DISTINCT pr_id) AS prs FROM (SELECT pr_id, {O.rule_label('code')} AS label FROM chunks) GROUP BY label",
)
def t9_chunks(spark, sf):
    marked = chunks(spark, sf).select("pr_id", rules.rule_label(F.col("code")).alias("label"))
    # one row per pull request and class first: no row of a hot class is moved twice
    per_pr = marked.groupBy("label", "pr_id").agg(F.count("*").alias("n"))
    return per_pr.groupBy("label").agg(F.sum("n").alias("chunks"), F.count("*").alias("prs"))


# --- streams --------------------------------------------------------------------------------------------


def _event_stream(spark, sf):
    schema = I.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return stream.selectExpr("event_id", "ts", "user_id", I.S.payload() + " AS payload")


_ACCEPTED = """SELECT DISTINCT CAST(pr_number AS BIGINT) AS number,
    CAST(concat('0x', substr(md5(concat(repo, '#', pr_number)), 1, 15)) AS BIGINT) AS pr_id FROM webhook_events
  WHERE action IN ('opened', 'synchronize', 'reopened') AND coalesce(installation_id, 0) <> 0 AND pr_number <> '?'"""


def _of_events(name: str, column: str) -> str:
    return f"SELECT a.pr_id, t.{column} FROM accepted a JOIN ({O.STEPS[name]}) t ON t.pr_id = a.number"


def _stream_sql() -> str:
    """The reviews of the pull requests of events, each keyed by repository and number."""
    sql = O.query("SELECT pr_id, final_review, review_summary, issue_count FROM reviews", "reviews")
    for name, column in (("diffs", "diff"), ("responses", "response")):
        sql = sql.replace(O.STEPS[name], _of_events(name, column))
    steps = {**{n: O.STEPS[n] for n in ("payloads", "webhook_events")}, "accepted": _ACCEPTED}
    return "WITH " + ", ".join(f"{n} AS ({s})" for n, s in steps.items()) + ", " + sql.removeprefix("WITH ")


@register("x1_review_stream", _stream_sql())
def x1(spark, sf):
    sink = staging.new_path(spark, "stream-sink")
    tables = {}
    for name, rows in (("diffs", I.diffs(spark, sf)), ("responses", I.responses(spark, sf))):
        # the tables have numbers alone: each repository of the test has the same diffs
        rows = rows.withColumnRenamed("pr_id", "number")
        tables[name] = staging.new_path(spark, name), rows.schema
        buckets.write_bucketed(rows, tables[name][0], key="number")

    def review(prs, earlier):
        def of_events(name):
            rows = buckets.read_bucketed(spark, *tables[name], prs, key="number")
            return prs.select("pr_id", "number").join(rows, "number").drop("number")

        found = review_job.find_issues(of_events("diffs"), I.formula_scorer, stage=True)
        return review_job.write_reviews(found, of_events("responses"), earlier, prs.filter("has_commit"), stage=True)

    query = streams.review_events(
        _event_stream(spark, sf), review, sink, sink + "-checkpoint", {"availableNow": True}
    )
    query.awaitTermination()
    return products.read_product(spark, sink, "reviews", schemas.REVIEWS).select(
        "pr_id", "final_review", "review_summary", "issue_count"
    )


@register(
    "x2_request_counts",
    """SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests, count(*) > 5 AS over_limit
       FROM events GROUP BY ALL""",
)
def x2(spark, sf):
    events = I.table(spark, sf, "events").select("ts", "user_id")
    counts = streams.request_counts(events, limit=5, window="1 day", key="user_id")
    return counts.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@register(
    "x2_admitted",
    """WITH RECURSIVE opened AS (
      SELECT user_id, min(ts) AS s FROM events GROUP BY user_id
      UNION ALL
      SELECT o.user_id, min(e.ts) FROM opened o JOIN events e ON e.user_id = o.user_id AND e.ts >= o.s + INTERVAL 12 HOURS GROUP BY o.user_id
    )
    SELECT event_id, e.user_id, row_number() OVER (PARTITION BY e.user_id, o.s ORDER BY ts, event_id) <= 2 AS admitted
    FROM events e ASOF JOIN opened o ON o.user_id = e.user_id AND e.ts >= o.s""",
)
def x2_admitted(spark, sf):
    events = I.table(spark, sf, "events").select("event_id", "user_id", "ts")
    found = admission.admitted(events, limit=2, window=timedelta(hours=12), key="user_id", request="event_id")
    return found.select("event_id", "user_id", "admitted")


@register("x3_first_comments", "SELECT DISTINCT pr_id, file, line FROM comments")
def x3(spark, sf):
    source = staging.new_path(spark, "planned")
    planned = staging.staged(comments(spark, sf).select("pr_id", "file", "line"), "planned", source)
    stream = spark.readStream.schema(planned.schema).parquet(source)
    sink = staging.new_path(spark, "first-comments")
    writer = streams.first_comments(stream).writeStream.format("parquet").option(
        "checkpointLocation", sink + "-checkpoint"
    )
    with streams.large_state(spark):
        query = writer.trigger(availableNow=True).start(sink)
    query.awaitTermination()
    return spark.read.schema(planned.schema).parquet(sink)


# --- models and jobs --------------------------------------------------------------------------------------


def _small_training_set(spark, sf):
    job = corpus_job.training_set(I.corpus(spark, sf))
    return staging.staged(job.split, "split")


def _trained(spark, sf):
    split = _small_training_set(spark, sf)
    model, best = mo.train(split.filter("split = 'train'"), split.filter("split = 'val'"))
    return split, model, best


_SPLIT_BALANCED = f"""SELECT code, label, sample_key, CASE WHEN rn * 100 <= 70 * n THEN 'train' WHEN rn * 100 <= 85 * n THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n,
            row_number() OVER (PARTITION BY label ORDER BY {O.hash_order('sample_key')}) AS rn FROM balanced)"""


@register(
    "m1_scored_chunks",
    "SELECT pr_id, chunk_index, true AS sums_to_one, true AS most_likely, true AS named FROM reviewable",
)
def m1(spark, sf):
    _, model, _ = _trained(spark, sf)
    found = mo.score_with_model(cl.reviewable(chunks(spark, sf)), model)
    p = found.select("pr_id", "chunk_index", "prediction.*")
    probs = F.map_values("all_probs")
    total = F.aggregate(probs, F.lit(0.0), lambda acc, x: acc + x)
    highest = F.col("confidence") == F.array_max(probs)
    return p.select(
        "pr_id",
        "chunk_index",
        (F.abs(total - 1) < 0.001).alias("sums_to_one"),
        (highest & (F.element_at("all_probs", F.col("label_id")) == F.col("confidence"))).alias("most_likely"),
        (F.col("label") == text.lookup(C.CLASS_NAMES, F.col("label_id"), "")).alias("named"),
    )


def _failing_model():
    """Fails for a batch that holds a code of a length divisible by 7."""

    def predict(codes):
        if any(len(c) % 7 == 0 for c in codes):
            raise ValueError("a code this model cannot read")
        return [[0.8 if k == len(c) % 5 else 0.05 for k in range(5)] for c in codes]

    return predict


@register(
    "m1_user_scorer",
    f"""SELECT pr_id, chunk_index, CASE WHEN length(code) % 7 = 0 THEN -1 ELSE CAST(length(code) % 5 AS INT) END AS label_id,
        CASE WHEN length(code) % 7 = 0 THEN 'Error' ELSE {O.case_map('length(code) % 5', C.CLASS_NAMES, "''")} END AS label,
        CASE WHEN length(code) % 7 = 0 THEN 0.0::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM reviewable""",
)
def m1_user(spark, sf):
    found = mo.score_with_function(cl.reviewable(chunks(spark, sf)), _failing_model)
    return found.select("pr_id", "chunk_index", "prediction.label_id", "prediction.label", "prediction.confidence")


@register(
    "m1_scorer_errors",
    """SELECT pr_id, chunk_index, 'ValueError: a code this model cannot read' AS score_error FROM reviewable WHERE length(code) % 7 = 0""",
)
def m1_errors(spark, sf):
    """What the scorer said of each code that it failed on."""
    found = mo.score_with_function(cl.reviewable(chunks(spark, sf)), _failing_model, error="score_error")
    return found.filter("score_error IS NOT NULL").select("pr_id", "chunk_index", "score_error")


_INDEPENDENT = "((h + 37 * i * i) % 101) / 100.0"


@register(
    "u5_independent_labels",
    f"""SELECT pr_id, chunk_index, label_ord, label_id, confidence FROM (
      SELECT pr_id, chunk_index, ps, unnest(CASE WHEN list_max(ps) >= {C.CONFIDENCE_THRESHOLD} AND len(likely) > 0 THEN likely
          ELSE [list_position(ps, list_max(ps)) - 1] END) AS label_id,
        unnest(range(CASE WHEN list_max(ps) >= {C.CONFIDENCE_THRESHOLD} AND len(likely) > 0 THEN len(likely) ELSE 1 END))::INT AS label_ord,
        round(ps[label_id + 1], 4) AS confidence
      FROM (SELECT *, list_filter([1, 2, 3, 4], lambda k: ps[k + 1] >= {C.MULTI_LABEL_THRESHOLD}) AS likely FROM (
        SELECT pr_id, chunk_index, list_transform(range(5), lambda i: CAST({_INDEPENDENT} AS DOUBLE)) AS ps
        FROM (SELECT pr_id, chunk_index, pr_id % 1000003 * 31 + chunk_index * 17 + length(code) * 7 AS h FROM reviewable))))""",
)
def u5_independent(spark, sf):
    """Labels of chunks whose classes have scores that do not add up to one."""
    found = cl.reviewable(chunks(spark, sf))
    number = F.col("pr_id") % 1_000_003 * 31 + F.col("chunk_index") * 17 + F.length("code") * 7
    rows = found.withColumn("h", number)
    scores = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: ((F.col("h") + 37 * i * i) % 101 / F.lit(100.0)))
    table = rows.select("pr_id", "chunk_index", mo.prediction_struct(scores).alias("prediction"))
    labels = cl.labels_of(cl.score_from_table(found, table))
    return labels.select("pr_id", "chunk_index", "label_ord", "label_id", "confidence")


@register(
    "u5_one_vs_rest",
    "SELECT label AS class_id, count(*) AS support, true AS reaches_floor, true AS probabilities FROM (" + _SPLIT_BALANCED + ") WHERE split = 'test' GROUP BY label",
)
def u5_one_vs_rest(spark, sf):
    """Five independent models: each finds its class, by a probability of its own."""
    split = _small_training_set(spark, sf)
    model = mo.train_independent(split.filter("split = 'train'"), split.filter("split = 'val'"))
    scored_rows = mo.score_independently(split.filter("split = 'test'"), model)
    own = F.element_at(F.col("prediction.all_probs"), F.col("label"))
    most = F.element_at(F.col("prediction.all_probs"), F.col("prediction.label_id"))
    return scored_rows.groupBy(F.col("label").alias("class_id")).agg(
        F.count("*").alias("support"),
        (F.avg((own >= 0.5).cast("double")) >= 0.5).alias("reaches_floor"),
        F.bool_and((own >= 0) & (most <= 1) & (most >= own)).alias("probabilities"),
    )


@register(
    "m2_scored_samples",
    f"SELECT label AS class_id, count(*) AS support, true AS reaches_floor FROM ({_SPLIT_BALANCED}) WHERE split = 'test' GROUP BY label",
)
def m2(spark, sf):
    split, model, _ = _trained(spark, sf)
    tested = mo.predicted_classes(mo.score_with_model(split.filter("split = 'test'"), model))
    per_class = me.class_metrics(tested)
    return per_class.select("class_id", "support", (F.col("f1") >= 0.5).alias("reaches_floor"))


@register("m3_best_model", "SELECT true AS known_candidate, true AS reaches_floor")
def m3(spark, sf):
    best = _trained(spark, sf)[2]
    return best.select(
        F.col("candidate").between(0, len(mo.DEFAULT_CANDIDATES) - 1).alias("known_candidate"),
        (F.col("weighted_f1") >= 0.5).alias("reaches_floor"),
    )


@register("m4_training_set", _SPLIT_BALANCED)
def m4(spark, sf):
    return corpus_job.training_set(I.corpus(spark, sf)).split.select("code", "label", "sample_key", "split")


@register(
    "m5_reviews",
    "SELECT pr_id, language, final_review, review_summary, issue_count, CAST(len(string_split(final_review, '## Issue')) - 1 AS INT) AS issues_found FROM reviews",
)
def m5(spark, sf):
    return whole_review(spark, sf, stage=True).reviews
