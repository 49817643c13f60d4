"""The review job (M5): diffs to chunks, issues, explanations, comments and reviews."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffmill.functions.languages import language_info
from diffmill.operators.classify import classify, reviewable
from diffmill.operators.diffs import parse_diffs
from diffmill.operators.explain import explain, prompts
from diffmill.operators.rank import prioritize
from diffmill.operators.review import inline_comments, planned_comments, reviews, status_body
from diffmill.sources.staging import staged

Scorer = Callable[[DataFrame], DataFrame]


@dataclass
class Findings:
    """Everything known before the explanations are asked for."""

    chunks: DataFrame
    languages: DataFrame
    issues: DataFrame
    prompts: DataFrame


@dataclass
class Review:
    """The products of a review."""

    explained: DataFrame
    reviews: DataFrame
    comments: DataFrame
    to_post: DataFrame
    status: DataFrame

    def products(self) -> dict[str, DataFrame]:
        return {
            "reviews": self.reviews,
            "comments": self.comments,
            "posted": self.to_post,
            "status": self.status,
        }


def pr_languages(diffs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Primary language of every pull request, those without chunks included."""
    return (
        diffs.select("pr_id")
        .join(language_info(chunks).hint("merge"), "pr_id", "left")
        .select("pr_id", F.coalesce("language", F.lit("Unknown")).alias("language"), "languages")
    )


def find_issues(diffs: DataFrame, scorer: Scorer, stage: bool = False) -> Findings:
    """Parse, score, classify and rank.

    ``scorer`` adds a ``prediction`` to chunks. With ``stage`` the chunks and the issues
    are written to tables in the shared folder: both are read several times, and neither
    parsing nor scoring should then run more than once.
    """
    chunks = parse_diffs(diffs)
    if stage:
        chunks = staged(chunks, "chunks")
    issues = prioritize(classify(scorer(reviewable(chunks))))
    if stage:
        issues = staged(issues, "issues")
    return Findings(chunks, pr_languages(diffs, chunks), issues, prompts(issues))


def write_reviews(
    findings: Findings,
    responses: DataFrame,
    places: DataFrame,
    with_commit: DataFrame | None = None,
    stage: bool = False,
) -> Review:
    """Join the explanations and assemble comments, reviews and status texts.

    ``responses`` is the answer per pull request and ``places`` the lines that already
    carry a comment (see ``sources.events.commented_places``). Comments go to the pull
    requests in ``with_commit`` only, if that is given.
    """
    explained = explain(findings.issues, responses)
    if stage:
        explained = staged(explained, "explained")
    comments = inline_comments(explained)
    to_post = planned_comments(explained, places)
    if with_commit is not None:
        to_post = to_post.join(with_commit.select("pr_id"), "pr_id", "left_semi")
    review = reviews(explained, findings.languages)
    return Review(explained, review, comments, to_post, status_body(review, to_post))
