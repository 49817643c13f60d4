"""Reviews, summaries and inline comments (ids P15 to P18, A8 to A11, A13, W2, J3, S5).

Text is assembled per pull request: all issues of one stem from one diff row.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffmill import constants as C
from diffmill.functions.rules import suspicious_line_offset
from diffmill.functions.text import let, percent, strip, strip_to_null
from diffmill.operators.explain import with_defaults

_REVIEW_MARK = "## Issue"


def language_header(language: Column) -> Column:
    """P17."""
    foreign = ~language.isin(C.OPTIMIZED_LANGUAGE, C.UNKNOWN_LANGUAGE)
    return F.concat(
        F.lit("**Language detected:** "),
        language,
        F.lit("\n"),
        F.when(foreign, C.LANGUAGE_WARNING).otherwise(""),
    )


def comment_line(start_line: Column, offset: Column) -> Column:
    """A missing or zero start line counts as line 1."""
    return F.greatest(F.coalesce(F.nullif(start_line, F.lit(0)), F.lit(1)) + offset, F.lit(1))


def _fenced(code: Column) -> Column:
    return F.concat(F.lit("```python\n"), code, F.lit("\n```\n"))


def _line(*parts) -> Column:
    """One text item that ends in a newline; null if any part is null."""
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.concat(*columns, F.lit("\n"))


def _if_present(value: Column, item: Column) -> Column:
    return F.when(value.isNotNull(), item)


def _explanation(default: str) -> Column:
    return F.coalesce(
        strip_to_null(F.col("explanation")),
        strip(F.coalesce(F.col("fix_suggestion"), F.lit(default))),
    )


def _optional_fields() -> tuple[Column, Column, Column]:
    return (
        strip_to_null(F.col("severity")),
        strip_to_null(F.col("recommended_fix")),
        strip_to_null(F.col("fixed_code")),
    )


def comment_body() -> Column:
    """Inline comment of an explained issue; blank fields leave no section."""
    severity, fix, fixed_code = _optional_fields()
    return F.concat_ws(
        "\n",
        _line(
            C.COMMENT_TITLE,
            F.col("label"),
            " (Confidence: ",
            percent(F.col("confidence")),
            ")**",
        ),
        _line("**Issue**"),
        _line(_explanation(C.NO_DETAILS)),
        _line("**Severity:** ", severity),
        _if_present(fix, _line("**Recommended fix**")),
        _line(fix),
        _if_present(fixed_code, _line("**Fixed code**")),
        _fenced(fixed_code),
    )


def inline_comments(explained: DataFrame) -> DataFrame:
    """One comment per issue, on its most suspicious line."""
    explained = with_defaults(explained)
    return explained.select(
        "pr_id",
        "issue_idx",
        "file",
        comment_line(F.col("start_line"), suspicious_line_offset(F.col("code"))).alias("line"),
        "label",
        "confidence",
        comment_body().alias("body"),
    )


def comment_places(issues: DataFrame) -> DataFrame:
    """P15 and P16 alone: the place of each issue's comment, whatever its text."""
    line = comment_line(F.col("start_line"), suspicious_line_offset(F.coalesce("code", F.lit(""))))
    return issues.select("pr_id", "issue_idx", F.coalesce("file", F.lit("unknown")).alias("file"), line.alias("line"))


def planned_comments(
    explained: DataFrame, existing: DataFrame, limit: int = C.MAX_INLINE_COMMENTS
) -> DataFrame:
    """A11, W2 and J3 from explained issues: as ``comments_to_post`` of their comments, but
    a body is formed for the comments that are posted alone."""
    top = with_defaults(explained.filter(F.col("issue_idx") <= limit))
    placed = top.withColumn("line", comment_line(F.col("start_line"), suspicious_line_offset(F.col("code"))))
    places = existing.select("pr_id", "file", "line").distinct()
    return placed.join(places.hint("merge"), ["pr_id", "file", "line"], "left_anti").select(
        "pr_id", "issue_idx", "file", "line", "label", "confidence", comment_body().alias("body")
    )


def comments_to_post(
    comments: DataFrame, existing: DataFrame, limit: int = C.MAX_INLINE_COMMENTS
) -> DataFrame:
    """The first comments of each pull request, then without those whose
    file and line already carry one. The cap comes first: a duplicate is not replaced.

    ``existing`` has the columns pr_id, file, line (see ``sources.comments``); each
    place is needed once, so repeats are combined before the join.
    """
    planned = comments.filter(F.col("issue_idx") <= limit)
    places = existing.select("pr_id", "file", "line").distinct()
    return planned.join(places.hint("merge"), ["pr_id", "file", "line"], "left_anti")


def _issue_section() -> Column:
    severity, fix, fixed_code = _optional_fields()
    return F.concat_ws(
        "\n",
        _line(_REVIEW_MARK + " ", F.col("issue_idx").cast("string"), ": ", F.col("label")),
        _line("**Confidence:** ", percent(F.col("confidence"))),
        _line("**File:** `", F.col("file"), "`"),
        _line("**Severity:** ", severity),
        _line("**Problematic code:**"),
        _fenced(F.col("code")),
        _line("**Explanation:**"),
        _line(_explanation(C.NOT_AVAILABLE)),
        _if_present(fix, _line("**Recommended fix:**")),
        _line(fix),
        _if_present(fixed_code, _line("**Fixed code:**")),
        _fenced(fixed_code),
        _line("---"),
    )


def issue_type_counts(explained: DataFrame) -> DataFrame:
    """Issues per type and pull request with the place of the first one."""
    explained = with_defaults(explained)
    return explained.groupBy("pr_id", "label").agg(
        F.count("*").alias("n"), F.min("issue_idx").alias("first_idx")
    )


def plural_of(issue_type: Column, n: Column) -> Column:
    """A9: 'Vulnerability' gives 'Vulnerabilities', 'Bug' gives 'Bugs'."""
    several = n > 1
    ends_in_y = F.endswith(issue_type, F.lit("y"))
    return (
        F.when(several & ends_in_y, F.concat(F.regexp_replace(issue_type, r"y+\z", ""), F.lit("ies")))
        .when(several, F.concat(issue_type, F.lit("s")))
        .otherwise(issue_type)
    )


def _in_order(explained: DataFrame, **texts: Column) -> DataFrame:
    """Per pull request its issues in rank order, with their type and some texts. All of
    them stem from one diff row."""
    item = F.struct("issue_idx", "label", *[text.alias(name) for name, text in texts.items()])
    return explained.groupBy("pr_id").agg(F.array_sort(F.collect_list(item)).alias("items"))


def _bullets(items: Column) -> Column:
    """A line per issue type, the most frequent first, else by first appearance."""

    def counted(kinds: Column) -> Column:
        def one(kind: Column, at: Column) -> Column:
            n = F.size(F.filter(items, lambda x: x["label"] == kind))
            text = F.concat(F.lit("- **"), plural_of(kind, n), F.lit(":** "), n.cast("string"))
            return F.struct((-n).alias("n"), at.alias("at"), text.alias("t"))

        return F.array_join(F.transform(F.array_sort(F.transform(kinds, one)), lambda e: e["t"]), "\n")

    return let(F.array_distinct(F.transform(items, lambda x: x["label"])), counted)


def summary_bullets(explained: DataFrame) -> DataFrame:
    """Total and bullet list per pull request, at most one bullet per issue type."""
    items = _in_order(with_defaults(explained).select("pr_id", "issue_idx", "label"))
    return items.select("pr_id", F.size("items").cast("bigint").alias("total"), _bullets(F.col("items")).alias("bullets"))


def reviews(explained: DataFrame, languages: DataFrame) -> DataFrame:
    """Per pull request the full review, the summary, the number of
    issue marks in the text and the true number of issues. One aggregation gives the
    sections, the counts and the bullets.

    ``languages(pr_id, language)`` has every pull request, clean ones included.
    """
    items = _in_order(with_defaults(explained), section=_issue_section())
    texts = items.select(
        "pr_id",
        F.array_join(F.transform("items", lambda x: x["section"]), "\n").alias("sections"),
        F.size("items").cast("bigint").alias("total"),
        _bullets(F.col("items")).alias("bullets"),
    )
    joined = languages.select("pr_id", "language").join(texts.hint("merge"), "pr_id", "left")
    header = language_header(F.col("language"))
    title = F.lit(C.REVIEW_TITLE)
    clean = F.concat(title, F.lit("\n"), header, F.lit("\n" + C.CLEAN_REVIEW))
    full = F.concat_ws(
        "\n",
        title,
        _line(header),
        _line("**Issues found:** ", F.col("total").cast("string")),
        _line("---"),
        F.col("sections"),
    )
    summary = F.concat_ws(
        "\n",
        title,
        _line(header),
        F.concat(
            F.lit("**"),
            F.col("total").cast("string"),
            F.when(F.col("total") == 1, " issue detected.**\n").otherwise(" issues detected.**\n"),
        ),
        F.col("bullets"),
        F.lit(C.SUMMARY_FOOTER),
    )
    is_clean = F.col("sections").isNull()
    return joined.select(
        "pr_id",
        "language",
        F.when(is_clean, clean).otherwise(full).alias("final_review"),
        F.when(is_clean, clean).otherwise(summary).alias("review_summary"),
        F.coalesce("total", F.lit(0)).alias("issue_count"),
    ).withColumn("issues_found", issues_found(F.col("final_review")))


def issues_found(review: Column) -> Column:
    """Occurrences of the issue mark, hits inside quoted code included."""
    return F.size(F.split(review, _REVIEW_MARK)) - 1


def status_body(review: DataFrame, posted: DataFrame) -> DataFrame:
    """The summary where at least one comment is planned, else the full review."""
    with_comments = posted.groupBy("pr_id").agg(F.count("*").alias("posted"))
    has_summary = (F.coalesce("review_summary", F.lit("")) != "") & (
        F.coalesce("posted", F.lit(0)) > 0
    )
    return review.join(with_comments.hint("merge"), "pr_id", "left").select(
        "pr_id",
        F.when(has_summary, F.col("review_summary"))
        .otherwise(F.col("final_review"))
        .alias("status_body"),
    )
