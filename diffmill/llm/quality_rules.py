"""Quality rules as weak supervision (operator 3). DataFrame functions only.

Each rule reads the counts of one text and votes good (1), bad (-1) or abstains (0). No
rule decides alone: expectation-maximisation over all documents estimates how often each
rule is right when it votes on a good or on a bad text, and the posterior probability of good
replaces the demand that all rules pass. Documents matter to the estimate only by their
pattern of votes, so it works on the histogram of patterns: at most 3 to the number of
rules rows, however many documents there are.

Defined results: a null or empty text has no words, fails the base rule and is not kept;
an empty table gives no rows; repeated rows count and are judged each; other columns are
left out. Windows of words are compared by 64-bit hashes within one text.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffmill.sources.staging import staged

_BLANK = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ends", "n_letters"]


def _covered(starts: Column) -> Column:
    """Places covered by windows that begin at the ascending ``starts``."""
    gaps = F.transform(
        starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW)))
    )
    return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, gap: total + gap)


def text_counts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of each whole text, without a shuffle.

    Lines with a word count in ``n_lines``, those that end a sentence in ``n_ends``.
    """
    text = F.col("text")
    # each step is used more than once by the next, so that the optimizer keeps them apart
    parts = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text")).select(
        "doc_id",
        "text",
        F.array_remove(F.split(text, _BLANK), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(_BLANKS)) != "").alias("lines"),
    )
    hashed = parts.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size(F.filter("lines", lambda x: F.right(F.rtrim(x, F.lit(_BLANKS)), F.lit(1)).isin(*".!?"))).cast("bigint").alias("n_ends"),
        F.length(F.regexp_replace(text, r"\P{L}+", "")).cast("bigint").alias("n_letters"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    hashes = F.col("hashes")
    windows = F.transform(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))),
        lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)]),
    )
    windowed = hashed.withColumn("windows", windows).drop("hashes")
    found = F.size(F.array_distinct("windows")) < F.size("windows")
    in_order = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ordered = windowed.withColumn("ordered", F.when(found, in_order)).drop("windows")
    pairs = F.col("ordered")

    def same(x: Column, other: Column) -> Column:
        return F.coalesce(F.get(pairs, other)["h"] == x["h"], F.lit(False))

    twice = F.filter(pairs, lambda x, j: same(x, j - 1) | same(x, j + 1))
    placed = ordered.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("ordered")
    counted = placed.withColumn("n_repeat_words", F.coalesce(_covered(F.col("starts")), F.lit(0).cast("bigint")))
    return counted.select("doc_id", *COUNTS)


@dataclass(frozen=True)
class Rule:
    """Votes good where ``good`` holds, else bad where ``bad`` holds, else abstains."""

    name: str
    good: Column
    bad: Column

    def vote(self) -> Column:
        return F.when(self.good, 1).when(self.bad, -1).otherwise(0).alias(self.name)


def rules() -> list[Rule]:
    """Rules over the counts; each looks at one property of a text."""

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.col(part) / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0))

    words, lines = F.col("n_words"), F.col("n_lines")
    mean = share("word_chars", "n_words")
    symbols, repeats = share("n_symbols", "n_words"), share("n_repeat_words", "n_words")
    letters, ends, copies = share("n_letters", "word_chars"), share("n_ends", "n_lines"), share("n_dup_lines", "n_lines")
    return [
        Rule("size", words >= 50, words < 12),
        Rule("word_length", mean.between(3.0, 9.0), ~mean.between(2.5, 12.0)),
        Rule("symbols", symbols <= 0.02, symbols > 0.10),
        Rule("letters", letters >= 0.90, letters < 0.75),
        Rule("line_copies", copies <= 0.10, copies > 0.35),
        Rule("repetition", repeats <= 0.10, repeats > 0.17),
        Rule("sentences", ends >= 0.50, ends < 0.10),
    ]


@dataclass(frozen=True)
class VoteModel:
    """``prior``: share of good documents; ``good`` and ``bad``: by rule, the chance of
    the votes -1 and 1 on documents of that kind where the rule votes. To abstain says
    nothing."""

    prior: float
    good: list[dict[int, float]]
    bad: list[dict[int, float]]

    def logit(self, votes: tuple[int, ...]) -> float:
        known = zip(votes, self.good, self.bad)
        return math.log(self.prior / (1 - self.prior)) + sum(math.log(g[v] / b[v]) for v, g, b in known if v)


def posterior(logit: float) -> float:
    return 1 / (1 + math.exp(-max(min(logit, 700.0), -700.0)))


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 100, tolerance: float = 1e-7) -> VoteModel:
    """Expectation-maximisation over the histogram of vote patterns.

    Begins with the majority of the votes, which also says which class is the good one.
    Every chance is smoothed by one document, so none is 0.
    """
    n_rules = len(next(iter(patterns), ()))
    total = sum(patterns.values())

    def fit(weights: dict[tuple[int, ...], float]) -> VoteModel:
        mass = sum(n * weights[p] for p, n in patterns.items())
        good, bad = [], []
        for k in range(n_rules):
            g, b = {-1: 1.0, 1: 1.0}, {-1: 1.0, 1: 1.0}
            for p, n in patterns.items():
                if p[k]:
                    g[p[k]] += n * weights[p]
                    b[p[k]] += n * (1 - weights[p])
            good.append({v: x / sum(g.values()) for v, x in g.items()})
            bad.append({v: x / sum(b.values()) for v, x in b.items()})
        return VoteModel((mass + 1) / (total + 2), good, bad)

    weights = {p: 0.5 + 0.45 * sum(p) / max(sum(map(abs, p)), 1) for p in patterns}
    model = fit(weights)
    for _ in range(rounds):
        before, weights = weights, {p: posterior(model.logit(p)) for p in patterns}
        model = fit(weights)
        if sum(n * abs(weights[p] - before[p]) for p, n in patterns.items()) <= tolerance * max(total, 1):
            break
    return model


def vote_model(counts: DataFrame, chosen: list[Rule]) -> VoteModel:
    """The estimate from all documents. What reaches the driver is the histogram of vote
    patterns: 2,187 rows at most for seven rules."""
    found = counts.select([r.vote() for r in chosen]).groupBy([r.name for r in chosen]).count().collect()
    return estimate({tuple(row[:-1]): row[-1] for row in sorted(found)} or {(0,) * len(chosen): 0})


def quality(model: VoteModel, chosen: list[Rule]) -> Column:
    """Posterior probability that a document is good, as a column over the counts."""
    logit = F.lit(math.log(model.prior / (1 - model.prior)))
    for rule, g, b in zip(chosen, model.good, model.bad):
        vote = rule.vote()
        weight = {v: math.log(g[v] / b[v]) for v in g}
        logit = logit + F.when(vote == 1, weight[1]).when(vote == -1, weight[-1]).otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


def judged(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Counts, ``base_failed``, ``quality`` and ``kept`` of every document.

    Texts are read once: the counts are staged, and both the estimate and the verdict
    read them from there.
    """
    counts, chosen = staged(text_counts(docs), "text-counts"), rules()
    model = vote_model(counts, chosen)
    words = F.col("n_words")
    failed = (words < 10) | (100 * F.col("n_repeat_words") > 20 * words)
    return (
        counts.withColumn("base_failed", failed)
        .withColumn("quality", quality(model, chosen))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
    )
