"""Rule predicates over code and the rule label (ids T4 to T9, P2, P10, P15)."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from diffmill import constants as C
from diffmill.functions.text import is_blank, pattern, raw_lines, strip


# Texts that must all occur for a pattern to match, one entry per pattern of the list with
# the same name. A plain search works on bytes and is far cheaper than a pattern; on most
# code it settles the matter. Lower case stands for "in any case".
_SQL_INJECTION_HINTS = [("select",), ("insert",), ("update",), ("delete",), ("select",), (".format(", "select")]
_SECURITY_HINTS = [
    ("cursor.execute", "+"),
    ("cursor.execute", ".format("),
    ("cursor.execute",),
    ("eval",),
    ("os.system", "+"),
    ("os.system",),
    ("subprocess.", "shell"),
    ("open",),
]
_NULL_REFERENCE_HINTS = [("None", "."), (".fetchone().",), ("return", "]."), (".get",), ("None", "(")]
_TYPE_MISMATCH_HINTS = [("if", "="), ("int", "+", "str"), ("str", "+", "int"), ('"', "+"), ("str", "==")]
_LOGIC_FLAW_HINTS = [("range(len(",), ("/", "0"), ("while", "True"), ("True", ":"), ("[", "len(")]
_HIGH_SIGNAL_HINTS = [("if", "or"), ("if", "==", "or", ":"), ("/", "len("), (".fetchone()", "["), (".fetchone().",)]
_BORDERLINE_HINTS = [("subprocess.", "shell"), ("os.system",)]
_SUSPICIOUS_LINE_HINTS = [
    ("select", "+"),
    ("eval", "("),
    ("os.system", "("),
    ("exec", "("),
    ("subprocess.", "shell"),
    (".fetchone().",),
    ("None", "="),
    ("/", "0"),
    ("if", "="),
    ("range(len(",),
]


def _all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _matches(code: Column, rule: str, hints: tuple[str, ...], ignore_case: bool = False) -> Column:
    if not ignore_case:
        found = _all_of([F.contains(code, F.lit(h)) for h in hints])
        return found & code.rlike(pattern(rule))
    # Letters outside ASCII can equal ASCII letters when case is ignored (the Kelvin sign
    # and "k"), so the hints only count for texts of one byte per character.
    lowered = F.lower(code)
    found = _all_of([F.contains(lowered, F.lit(h)) for h in hints])
    other_letters = F.octet_length(code) != F.length(code)
    return (found | other_letters) & code.rlike(pattern(rule, ignore_case=True))


def _any_match(code: Column, rules: list[str], hints: list[tuple], ignore_case: bool = False) -> Column:
    pairs = zip(rules, hints, strict=True)
    return _any_of([_matches(code, rule, hint, ignore_case) for rule, hint in pairs])


def has_sql_injection_risk(code: Column) -> Column:
    """T4."""
    return _any_match(code, C.SQL_INJECTION_PATTERNS, _SQL_INJECTION_HINTS, ignore_case=True)


def has_security_risk(code: Column) -> Column:
    """T5."""
    return has_sql_injection_risk(code) | _any_match(
        code, C.SECURITY_PATTERNS, _SECURITY_HINTS, ignore_case=True
    )


def has_null_reference_risk(code: Column) -> Column:
    """T6."""
    return _any_match(code, C.NULL_REFERENCE_PATTERNS, _NULL_REFERENCE_HINTS)


def has_type_mismatch(code: Column) -> Column:
    """T7."""
    return _any_match(code, C.TYPE_MISMATCH_PATTERNS, _TYPE_MISMATCH_HINTS)


def has_logic_flaw(code: Column) -> Column:
    """T8."""
    return _any_match(code, C.LOGIC_FLAW_PATTERNS, _LOGIC_FLAW_HINTS)


def rule_label(code: Column) -> Column:
    """Class id by rule; the first matching rule decides and ends the evaluation."""
    return (
        F.when(has_security_risk(code), 3)
        .when(has_null_reference_risk(code), 1)
        .when(has_type_mismatch(code), 2)
        .when(has_logic_flaw(code), 4)
        .otherwise(0)
    )


# A stripped line that carries no logic.
_STRUCTURAL = pattern(
    r"^(?:import\s|from\s\S+\s+import\s"
    r"|class\s+\w|def\s+\w|async\s+def\s+\w"
    r"""|pass|\"{3}|'{3}|#)"""
)
_SELF_ASSIGNMENT = pattern(r"^self\.\w+\s*=")
# A line that is surely neither blank nor structural, nor sets an attribute of self: behind its
# blanks it begins with a letter, and with no word that such lines begin with.
_PLAIN_LOGIC = r"(?:^|\n) *+(?!import|from|class|def|async|pass|self)[A-Za-z]"


def logic_lines(code: Column) -> Column:
    """Stripped lines that are neither blank nor structural."""
    stripped = F.transform(raw_lines(code), strip)
    return F.filter(stripped, lambda ln: (ln != "") & ~ln.rlike(_STRUCTURAL))


def is_trivial(code: Column) -> Column:
    """No logic line at all, or a single one that only sets an attribute of self. Lines are cut
    and stripped only where no line is logic at first sight."""
    lines = logic_lines(code)
    by_line = F.coalesce(
        F.aggregate(
            F.slice(lines, 1, 2),
            F.struct(F.lit(0).alias("n"), F.lit(True).alias("plain")),
            lambda acc, ln: F.struct(
                (acc["n"] + 1).alias("n"),
                (acc["plain"] & ln.rlike(_SELF_ASSIGNMENT)).alias("plain"),
            ),
            lambda acc: (acc["n"] == 0) | ((acc["n"] == 1) & acc["plain"]),
        ),
        F.lit(True),
    )
    return F.when(code.rlike(_PLAIN_LOGIC), False).otherwise(by_line)


def _first_target(code: Column, rules: list[tuple], hints: list[tuple]) -> Column:
    found = F.lit(None).cast("string")
    for (rule, target), hint in reversed(list(zip(rules, hints, strict=True))):
        found = F.when(_matches(code, rule, hint), F.lit(target)).otherwise(found)
    return found


def high_signal_type(code: Column) -> Column:
    """Issue type of the first high-signal rule that hits, null if none does."""
    return _first_target(code, C.HIGH_SIGNAL_RULES, _HIGH_SIGNAL_HINTS)


def borderline_type(code: Column) -> Column:
    """Issue type of the first rule for unsure issues that hits, null if none does."""
    return _first_target(code, C.BORDERLINE_RULES, _BORDERLINE_HINTS)


def refined_by(issue_type: Column, confidence: Column, high_signal: Column, borderline: Column) -> Column:
    """``refined_issue_type`` from what the rules say, where they are asked once for several labels."""
    return (
        F.when(confidence >= C.CONFIDENCE_LOCK, issue_type)
        .when(high_signal.isNotNull(), high_signal)
        .when((confidence < C.BORDERLINE_CEILING) & borderline.isNotNull(), borderline)
        .otherwise(issue_type)
    )


def refined_issue_type(issue_type: Column, confidence: Column, code: Column) -> Column:
    """Issue type after the pattern rules; a locked confidence leaves it alone."""
    refined = F.when(confidence >= C.CONFIDENCE_LOCK, issue_type)
    for (rule, target), hints in zip(C.HIGH_SIGNAL_RULES, _HIGH_SIGNAL_HINTS, strict=True):
        refined = refined.when(_matches(code, rule, hints), F.lit(target))
    unsure = confidence < C.BORDERLINE_CEILING
    for (rule, target), hints in zip(C.BORDERLINE_RULES, _BORDERLINE_HINTS, strict=True):
        refined = refined.when(unsure & _matches(code, rule, hints), F.lit(target))
    return refined.otherwise(issue_type)


def suspicious_line_offset(code: Column) -> Column:
    """0-based line of the first hit of the first pattern that hits any line, else 0.

    A hit in a line is a hit in the whole text, so the per-line search runs only where
    the whole text matches.
    """
    lines = raw_lines(code)

    def first_hit(rule: str, ignore_case: bool, hints: tuple[str, ...]) -> Column:
        regex = pattern(rule, ignore_case=ignore_case)
        marks = F.transform(lines, lambda ln: ln.rlike(regex))
        position = F.nullif(F.array_position(marks, True), F.lit(0))
        return F.when(_matches(code, rule, hints, ignore_case), position - 1)

    hits = [
        first_hit(*rule, hints)
        for rule, hints in zip(C.SUSPICIOUS_LINE_PATTERNS, _SUSPICIOUS_LINE_HINTS, strict=True)
    ]
    return F.coalesce(*hits, F.lit(0)).cast("int")


def is_rate_limited(message: Column) -> Column:
    return F.lower(message).rlike("|".join(C.RATE_LIMIT_MARKERS))


def blank_code(code: Column) -> Column:
    return F.coalesce(is_blank(code), F.lit(True))
