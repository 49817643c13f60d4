"""Prompts, answers and explained issues (ids A12, U6 to U9, J2, J4, P14)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffmill import constants as C
from diffmill.functions.rules import is_rate_limited
from diffmill.functions.text import let, percent, strip

_FIELDS = ("explanation", "severity", "recommended_fix", "fixed_code")


def _in_rank_order(text: Column, separator: str) -> Column:
    """Join the texts of a group by issue number. A group is one pull request."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("issue_idx"), text.alias("t"))))
    return F.array_join(F.transform(ordered, lambda e: e["t"]), separator)


def with_defaults(issues: DataFrame) -> DataFrame:
    """Issues with a text for every field that a prompt, comment or review shows."""
    defaults = {
        "label": F.lit("Unknown"),
        "confidence": F.lit(0.0),
        "code": F.lit(""),
        "file": F.lit("unknown"),
    }
    return issues.withColumns(
        {c: F.coalesce(F.col(c), d) for c, d in defaults.items() if c in issues.columns}
    )


def prompts(issues: DataFrame) -> DataFrame:
    """One prompt per pull request with a block per issue, in rank order."""
    issues = with_defaults(issues)
    block = F.concat(
        F.lit("### Issue "),
        F.col("issue_idx").cast("string"),
        F.lit("\n**Bug type detected:** "),
        F.col("label"),
        F.lit("\n**Confidence:** "),
        percent(F.col("confidence")),
        F.lit("\n\n```python\n"),
        F.col("code"),
        F.lit("\n```\n\n"),
    )
    return issues.groupBy("pr_id").agg(
        F.concat(F.lit(C.PROMPT_HEADER), _in_rank_order(block, "")).alias("prompt")
    )


def json_array_text(response: Column) -> Column:
    """The JSON array inside a response, without code fences; '' if there is none."""
    text = strip(response)
    unfenced = F.regexp_replace(
        F.regexp_replace(text, r"(?U)^```(?:json)?[\s\x1c-\x1f]*\n?", ""),
        r"(?U)\n?```[\s\x1c-\x1f]*\z",
        "",
    )
    body = F.when(F.startswith(text, F.lit("```")), unfenced).otherwise(text)
    return F.regexp_extract(body, r"(?s)\[.*\]", 0)


def _entries(response: Column) -> Column:
    # The wrapper object makes trailing text after the array an error, as it should be.
    wrapped = F.concat(F.lit('{"entries":'), json_array_text(response), F.lit("}"))
    return F.try_variant_get(F.try_parse_json(wrapped), "$.entries", "array<variant>")


def _field_text(kind: Column, text: Column) -> Column:
    """A field as stripped text; missing, null, zero, false and empty values give ''."""
    number = kind.isin("BIGINT", "DOUBLE") | F.startswith(kind, F.lit("DECIMAL"))
    value = (
        F.when(kind == "STRING", text)
        .when(kind == "BOOLEAN", F.when(text == "true", "True"))
        .when(number, F.when(text.try_cast("double") != 0, text))
        .when(~text.isin("[]", "{}"), text)
    )
    return F.coalesce(strip(value), F.lit(""))


def _answers(response: Column) -> Column:
    """U6 to U8 within the row: (issue_idx, four text fields) of each issue number, in order."""

    def read(e: Column, pos: Column) -> Column:
        number = F.when(
            F.try_variant_get(e, "$.issue_number", "variant").isNull(), pos + 1
        ).otherwise(F.try_variant_get(e, "$.issue_number", "int"))
        fields = [
            _field_text(
                F.schema_of_variant(F.try_variant_get(e, f"$.{f}", "variant")), F.try_variant_get(e, f"$.{f}", "string")
            ).alias(f)
            for f in _FIELDS
        ]
        return F.struct(number.alias("issue_idx"), pos.alias("pos"), *fields)

    numbered = F.transform(_entries(response), lambda e, pos: F.struct(e.alias("e"), pos.alias("pos")))
    objects = F.filter(numbered, lambda x: F.startswith(F.schema_of_variant(x["e"]), F.lit("OBJECT")))
    known = F.filter(F.transform(objects, lambda x: read(x["e"], x["pos"])), lambda x: x["issue_idx"].isNotNull())

    def last_of_each(ordered: Column) -> Column:
        return F.filter(
            ordered,
            lambda x, i: F.coalesce(F.get(ordered, i + 1)["issue_idx"] != x["issue_idx"], F.lit(True)),
        )

    return let(F.array_sort(known), last_of_each)


def answer_entries(responses: DataFrame) -> DataFrame:
    """(pr_id, issue_idx, four text fields), one row per issue number.

    Elements that are no objects, or whose number is none, are left out. A number that
    appears twice keeps its last element. Broken responses give no rows. ``responses`` has one
    row per pull request; it is read within the row, without a shuffle.
    """
    return responses.select("pr_id", F.inline(_answers(F.col("response")))).drop("pos")


def explain(issues: DataFrame, responses: DataFrame) -> DataFrame:
    """Issues widened by explanation, severity and fix, with defaults.

    An answer stays whole in its row until it meets the issues of its pull request.
    """
    by_number = F.map_from_entries(
        F.transform(
            _answers(F.col("response")),
            lambda a: F.struct(a["issue_idx"].alias("key"), F.struct(*[a[f].alias(f) for f in _FIELDS]).alias("value")),
        )
    )
    answers = responses.select("pr_id", by_number.alias("answers"))
    # one row per pull request: never to be sent to every task, however small the files seem
    joined = issues.join(answers.hint("merge"), "pr_id", "left").withColumn("answers", F.try_element_at("answers", F.col("issue_idx")))

    def field(name: str, default: str) -> Column:
        return F.coalesce(F.nullif(F.col(f"answers.{name}"), F.lit("")), F.lit(default))

    return joined.withColumns(
        {
            "explanation": field("explanation", C.DEFAULT_EXPLANATION),
            "severity": field("severity", C.DEFAULT_SEVERITY),
            "recommended_fix": field("recommended_fix", C.DEFAULT_FIX),
            "fixed_code": field("fixed_code", ""),
        }
    ).withColumn("fix_suggestion", F.col("explanation")).drop("answers")


def first_answers(attempts: DataFrame, prs: DataFrame | None = None) -> DataFrame:
    """The answer a retry-and-fall-back caller would have used.

    Per model the attempts after a rate-limit error do not count, nor do those beyond
    the limit. The first success in order of model and attempt wins. Both aggregations
    combine on the map side; a pull request with no success gets the placeholder.
    """
    failed = F.col("error").isNotNull()
    tried = attempts.filter(F.col("attempt") <= C.MAX_ATTEMPTS)
    per_model = tried.groupBy("pr_id", "model_rank").agg(
        F.min(F.when(failed & is_rate_limited(F.col("error")), F.col("attempt"))).alias("limited_at"),
        F.min(F.when(~failed, F.struct("attempt", "content"))).alias("success"),
    )
    usable = F.when(
        F.col("limited_at").isNull() | (F.col("success.attempt") < F.col("limited_at")),
        F.col("success"),
    )
    answers = per_model.groupBy("pr_id").agg(
        F.min(
            F.when(
                usable.isNotNull(),
                F.struct("model_rank", F.col("success.content").alias("content")),
            )
        ).alias("answer")
    )
    if prs is not None:
        answers = prs.select("pr_id").join(answers, "pr_id", "left")
    return answers.select(
        "pr_id", F.coalesce("answer.content", F.lit(C.NO_ANSWER)).alias("response")
    )
