"""Rules, languages and text functions."""

import pytest
from pyspark.sql import functions as F

from diffmill import constants
from diffmill.functions import rules, text
from diffmill.functions.languages import language_info, language_of
from diffmill.operators.review import plural_of
from workload.snippets import SNIPPETS



def test_rule_labels_of_the_snippets(values):
    expected = [0, 1, 0, 0, 3, 3, 3, 4, 2, 0, 0, 4, 0, 0, 0, 0, 3, 1, 2, 4, 1, 0, 0, 0]
    assert values(lambda T: rules.rule_label(T), SNIPPETS) == expected


def test_trivial_snippets(values):
    trivial = [i for i, x in enumerate(values(lambda T: rules.is_trivial(T), SNIPPETS)) if x]
    assert trivial == [0, 13, 14, 15, 23]


def test_trivial_edges(values):
    codes = {
        "": True,
        "  \n\t": True,
        "# a\n# b": True,
        "class A:\n    '''text'''": True,
        "import ": False,
        "import": False,
        "from a import b": True,
        "def f(): return eval(x)": True,
        "self.a = 1": True,
        "self.a = 1\nself.b = 2": False,
        "self.a == 1": True,
        '"""text\ninner line"""': False,
        "x = 1": False,
    }
    assert dict(zip(codes, values(lambda T: rules.is_trivial(T), list(codes)))) == codes


def test_plain_logic_is_what_the_lines_say(values):
    """The search for a line of plain logic settles codes before their lines are cut."""
    codes = {
        "import a\n   y": False,
        "self.a = 1\n  pass\r\n# x": True,
        "self.a = 1\n  imports": False,
        "selfish = 1": False,
        "classify(x)": False,
        "self.a = 1\rx = 1": False,
        "#\rx = 1": False,
        "#\r\n  x = 1": False,
        "\u3000x = 1": False,
        "_x = 1": False,
        "é = 1": False,
        "async def f():\n\tpass": True,
    }
    assert dict(zip(codes, values(lambda T: rules.is_trivial(T), list(codes)))) == codes
    assert values(lambda T: T.rlike(rules._PLAIN_LOGIC) & rules.is_trivial(T), SNIPPETS + list(codes)) == [False] * (len(SNIPPETS) + len(codes))
    assert values(lambda T: rules.is_trivial(T), [None]) == [True]


@pytest.mark.parametrize("confidence", [None, 0.5, 0.75, 0.95])
def test_rules_asked_once_refine_alike(values, confidence):
    sure = F.lit(confidence).cast("double")
    one = values(lambda T: rules.refined_issue_type(F.lit("Clean"), sure, T), [*SNIPPETS, None])
    other = values(
        lambda T: rules.refined_by(F.lit("Clean"), sure, rules.high_signal_type(T), rules.borderline_type(T)), [*SNIPPETS, None]
    )
    assert one == other


def test_filters_on_labels_do_not_repeat_the_rules(spark):
    from diffmill import constants as C
    from diffmill.operators.classify import classify, score_without_model
    from diffmill.schemas import CHUNKS

    chunks = spark.createDataFrame([(1, 0, "a.py", 1, "os.system('x')"), (1, 1, "a.py", 5, "x = 1")], CHUNKS)
    found = classify(score_without_model(chunks)).filter("label_id <> 0")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("RLIKE") <= len(C.HIGH_SIGNAL_RULES) + len(C.BORDERLINE_RULES)
    assert [r.label for r in found.collect()] == ["Security Vulnerability"]


@pytest.mark.parametrize(
    ("confidence", "expected"),
    [
        (0.50, {1: "Runtime Bug", 2: "Runtime Bug", 3: "Logic Bug", 5: "Security Vulnerability", 6: "Security Vulnerability"}),
        (0.74, {1: "Runtime Bug", 2: "Runtime Bug", 3: "Logic Bug", 5: "Security Vulnerability", 6: "Security Vulnerability"}),
        (0.75, {1: "Runtime Bug", 2: "Runtime Bug", 3: "Logic Bug"}),
        (0.94, {1: "Runtime Bug", 2: "Runtime Bug", 3: "Logic Bug"}),
        (0.95, {}),
    ],
)
def test_refinement_from_clean(values, confidence, expected):
    found = values(lambda T: rules.refined_issue_type(F.lit("Clean"), F.lit(confidence), T), SNIPPETS[:16])
    assert {i: x for i, x in enumerate(found) if x != "Clean"} == expected


def test_lookahead_rules(values):
    one_letter_call = values(lambda T: rules.has_type_mismatch(T), ['"a" + f(1)', '"a" + fn(1)', '"a" + f', '"a" + f + 1'])
    assert one_letter_call == [False, True, True, True]
    near, far = "while True:\n" + " " * 150 + "break", "while True:\n" + " " * 250 + "break"
    assert values(lambda T: rules.has_logic_flaw(T), [near, far]) == [False, True]


def test_unicode_words(values):
    assert values(lambda T: rules.has_null_reference_risk(T), ["x.fetchone().é", "x.fetchone().-"]) == [True, False]


def test_suspicious_lines(values):
    codes = ["x = 1", "a\nb = None\nreturn eval(x)", "a\nb = None\nc / 0", "q = 'select a '\nr = 'select b ' + c", ""]
    assert values(lambda T: rules.suspicious_line_offset(T), codes) == [0, 2, 1, 1, 0]


def test_rate_limit_messages(values):
    messages = ["HTTP 429", "Rate_Limit hit", "Tokens per MINUTE", "daily QUOTA", "timeout"]
    assert values(lambda T: rules.is_rate_limited(T), messages) == [True, True, True, True, False]


def test_languages(values):
    files = ["a.py", "a.PY", "b/c.tsx", "x.hpp", "Makefile", "", "a.b/Make", "x.", "q.r", "w.unknown", ".bash"]
    assert values(lambda T: language_of(T), files) == [
        "Python", "Python", "TypeScript", "C++", "Unknown", "Unknown", "Unknown", "Unknown", "R", "Unknown", "Shell",
    ]


def test_primary_language_ties_go_to_the_first(spark):
    rows = [(1, 0, "a.go"), (1, 1, "b.py"), (1, 2, "c.py"), (1, 3, "d.go"), (2, 0, "x")]
    info = {r.pr_id: r for r in language_info(spark.createDataFrame(rows, "pr_id long, chunk_index int, file string")).collect()}
    assert info[1].language == "Go" and info[1].languages == {"Go": 2, "Python": 2}
    assert info[2].language == "Unknown"


def test_split_lines(values):
    texts = ["", "a", "a\n", "a\n\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i\u2028j\u2029k", "\n"]
    assert values(lambda T: text.split_lines(T), texts) == [t.splitlines() for t in texts]


def test_texts_without_other_breaks_are_cut_at_newlines(values):
    texts = ["", "\n", "a\nb", "a\r\nb\n", "a\rb", "a\x0b\x0c\x1cb\x85c\u2028d\n\n", "a\r\n\r\n", "é\n日\n", None]
    by_pattern = values(lambda T: F.split(T, constants.LINE_BREAK), texts)
    assert values(text.raw_lines, texts) == by_pattern
    assert by_pattern[3] == ["a", "b", ""] and by_pattern[5] == ["a", "", "", "b", "c", "d", "", ""]


def test_strip_and_blank(values):
    texts = [" a ", "\x1f\u3000a b\x85", "\u2003", "", "\xa0\n"]
    assert values(lambda T: text.strip(T), texts) == [t.strip() for t in texts]
    assert values(lambda T: text.is_blank(T), texts) == [not t.strip() for t in texts]


def test_percent_is_half_even(values):
    shares = ["0.945", "0.955", "0.5", "0.005", "0.015", "1.0", "0.125", "0.285"]
    assert values(lambda T: text.percent(T.cast("double")), shares) == [f"{float(s):.0%}" for s in shares]


def test_plurals(values):
    kinds = ["Security Vulnerability", "Runtime Bug", "Code Quality"]
    assert values(lambda T: plural_of(T, F.lit(2)), kinds) == ["Security Vulnerabilities", "Runtime Bugs", "Code Qualities"]
    assert values(lambda T: plural_of(T, F.lit(1)), kinds) == kinds


def test_plain_searches_never_change_a_rule(spark):
    import random

    from diffmill import constants as C

    rng = random.Random(7)
    tokens = [
        "if ", "x", " = ", "==", "=", " or ", '"a"', "'", '"', "+", " + ", "SELECT ", "select ", "inſert ", "delete ",
        "cursor.execute(", "Cursor.Execute (", "eval(", "os.system(", "oſ.system(", "f'", ".format(", "subprocess.run(",
        "shell=True", "shell = true", "open(", "x)", ")", "None", "= None", ".get(", ".a", ".fetchone()", "return y[", "]",
        "int", "str", "str()", " 1", "/", "0", "range(len(", "x) + 1)", "while True", "\n", " break", "True:", "[len(x)]",
        ":", "exec(", " ", "len(",
    ]
    texts = ["".join(rng.choices(tokens, k=rng.randint(1, 14))) for _ in range(20_000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    plain = {
        "sql": t.rlike(text.pattern(*C.SQL_INJECTION_PATTERNS, ignore_case=True)),
        "sec": t.rlike(text.pattern(*C.SQL_INJECTION_PATTERNS, *C.SECURITY_PATTERNS, ignore_case=True)),
        "null": t.rlike(text.pattern(*C.NULL_REFERENCE_PATTERNS)),
        "type": t.rlike(text.pattern(*C.TYPE_MISMATCH_PATTERNS)),
        "logic": t.rlike(text.pattern(*C.LOGIC_FLAW_PATTERNS)),
    }
    hinted = {
        "sql": rules.has_sql_injection_risk(t),
        "sec": rules.has_security_risk(t),
        "null": rules.has_null_reference_risk(t),
        "type": rules.has_type_mismatch(t),
        "logic": rules.has_logic_flaw(t),
    }
    counts = df.agg(
        *[F.count_if(plain[k] != hinted[k]).alias(f"{k}_wrong") for k in plain],
        *[F.count_if(plain[k]).alias(f"{k}_hits") for k in plain],
    ).first()
    assert all(counts[f"{k}_wrong"] == 0 for k in plain)
    assert all(counts[f"{k}_hits"] > 50 for k in plain)
