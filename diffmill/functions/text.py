"""Text expressions with the line and white-space rules of the review model.

All of them are native columns, so they stay inside the JVM. Patterns take the prefix
``(?dU)``: ``.`` excludes the newline only and ``\\w \\s \\b`` follow Unicode.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from diffmill.constants import LINE_BREAK, OTHER_LINE_BREAK, WHITE_SPACE


def pattern(*alternatives: str, ignore_case: bool = False) -> str:
    """One pattern that hits when any alternative hits, so a row is decoded once."""
    flags = "(?idU)" if ignore_case else "(?dU)"
    if len(alternatives) == 1:
        return flags + alternatives[0]
    return flags + "|".join(f"(?:{p})" for p in alternatives)


def strip(text: Column) -> Column:
    """Remove white space (any kind, not only blanks) on both sides."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def strip_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def normalize_breaks(text: Column) -> Column:
    """Turn every kind of line break into a newline. Most texts have no other kind, and
    looking for one is much cheaper than rewriting every line end."""
    return F.when(
        text.rlike(OTHER_LINE_BREAK), F.regexp_replace(text, LINE_BREAK, "\n")
    ).otherwise(text)


def raw_lines(text: Column) -> Column:
    """Lines, with an empty last element if the text ends in a line break. A text without other
    kinds is cut at newlines alone, which takes no pattern."""
    return F.when(text.rlike(OTHER_LINE_BREAK), F.split(text, LINE_BREAK)).otherwise(F.split(text, "\n"))


def split_lines(text: Column) -> Column:
    """Lines without an empty last element; no lines for an empty text."""
    lines = raw_lines(text)
    return F.when(
        F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)
    ).otherwise(lines)


def line_breaks(text: Column) -> Column:
    """Number of newline characters."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def percent(share: Column) -> Column:
    """A share as a whole percent, half to even: 0.945 gives 94%."""
    return F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))


def lookup(mapping: dict, key: Column, default) -> Column:
    """Value of a small literal map, with a default for other keys."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; for use inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)
