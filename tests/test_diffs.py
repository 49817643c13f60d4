"""Cases, and random diffs against a line-by-line statement of the rule."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from diffmill.operators.diffs import added_lines, diff_lines, line_kind, parse_diffs
from diffmill.operators.split_diffs import parse_all, parse_segments, read_diff_segments, segments_of
from pyspark.sql import functions as F


def walk(diff):
    """Added lines as (file, number, text), reading one line after the other."""
    file, number = "unknown", 0
    for raw in diff.splitlines():
        hunk = re.match(r"@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)", raw)
        if raw[:6] == "+++ b/":
            file = raw[6:]
        elif hunk:
            number = int(hunk[1])
        elif raw[:3] != "+++" and raw[:1] != "-":
            if raw[:1] == "+":
                yield file, number, raw[1:]
            number += 1


def expected_chunks(diff):
    files = {}
    for file, number, text in walk(diff):
        files.setdefault(file, []).append((number, text))
    found = []
    for file, lines in files.items():
        spans = [[0]]
        for i in range(1, len(lines)):
            starts_definition = re.match(r"\s*(?:def |class |async def )\w+", lines[i][1])
            if starts_definition or len(spans[-1]) == 40:
                # full means the next chunk follows on, whatever its first line is
                spans.append([])
            spans[-1].append(i)
        follows = False
        for span in spans:
            first = span[0]
            start = lines[first - 1][0] + 1 if follows else lines[first][0]
            follows = len(span) == 40
            code = "\n".join(lines[i][1] for i in span)
            if code.strip():
                found.append((file, start, code))
    return found


def chunks_of(spark, diffs):
    df = spark.createDataFrame(list(enumerate(diffs)), "pr_id long, diff string")
    result = [[] for _ in diffs]
    for row in parse_diffs(df).orderBy("pr_id", "chunk_index").collect():
        assert row.chunk_index == len(result[row.pr_id])
        result[row.pr_id].append((row.file, row.start_line, row.code))
    return result


def block(file, start, *lines):
    return "\n".join([f"--- a/{file}", f"+++ b/{file}", f"@@ -1,2 +{start},9 @@", *lines])


CASES = {
    "empty": "",
    "blank": " \n\t\n",
    "definitions": block("a.py", 1, "+def a():", "+    return 1", "+", "+async def b():", "+    pass", "+class C:", "+    x = 1"),
    "two files": block("a.py", 1, "+x = 1") + "\n" + block("b.py", 4, "+y = 1"),
    "same file twice": block("a.py", 1, "+x = 1") + "\n" + block("b.py", 2, "+z = 1") + "\n" + block("a.py", 9, "+y = 1"),
    "deleted only": block("a.py", 1, "-x = 1", "-y = 2"),
    "deleted file": block("a.py", 1, "+x = 1") + "\n--- a/gone.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-z\n+kept",
    "two hunks": block("a.py", 1, "+x = 1", " c", "@@ -9 +30 @@ def f", " c", "+y = 1"),
    "no hunk header": "+++ b/a.py\n+x = 1\n c\n+y = 1",
    "file marker inside a hunk": block("a.py", 7, "+x = 1") + "\n+++ b/b.py\n+y = 1\n+++ b/c.py\n+z = 1",
    "lost line": block("a.py", 1, "+++x", "++ y"),
    "context": block("a.py", 3, " a", "\\ No newline at end of file", "+x", "", "+y"),
    "cap": block("a.py", 1, "+def f():", *["+    x = 1"] * 50),
    "cap at a definition": block("a.py", 1, "+def f():", *["+    x = 1"] * 39, "+def g():", "+    y = 1"),
    "blank chunk": block("a.py", 1, *["+  "] * 40, "+x = 1"),
    "line ends": block("a.py", 1, "+a", "+b\x0c+c\u2028+d").replace("\n", "\r\n"),
    "no diff": "just a text\nwithout any mark",
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    assert chunks_of(spark, [CASES[name]]) == [expected_chunks(CASES[name])]


def test_start_line_after_the_cap_is_not_the_definition_line(spark):
    diff = block("a.py", 1, "+def f():", *["+    x = 1"] * 39, " ctx", "+def g():", "+    y = 1")
    [found] = chunks_of(spark, [diff])
    assert [start for _, start, _ in found] == [1, 41]


_LINES = st.sampled_from(
    ["+def f():", "+  class A:", "+x = 1", "+", "+ ", "++x", "+++", "+++ b/a.py", "+++ b/b.js", "+++ /dev/null",
     "@@ -1,2 +5,6 @@", "@@ -1 +30 @@ tail", "@@ bad", "-gone", "--- a/a.py", " ctx", "", "\\ No newline", "+async def g(x):"]
)
_BREAKS = st.sampled_from(["\n"] * 6 + ["\r\n", "\r", "\x0b", "\x1e", "\x85"])


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 2**31))
def test_random_diffs(spark, seed):
    rng = random.Random(seed)
    kinds = _LINES.elements
    ends = _BREAKS.elements
    diffs = []
    for _ in range(400):
        n = rng.choice([0, 1, 3, 10, 40, 130])
        long_run = rng.random() < 0.3
        lines = [
            rng.choice(["+x = 1"] * 30 + list(kinds)) if long_run else rng.choice(kinds)
            for _ in range(n)
        ]
        diffs.append("".join(ln + rng.choice(ends) for ln in lines))
    assert chunks_of(spark, diffs) == [expected_chunks(d) for d in diffs]


def test_lines_and_kinds(spark):
    diff = block("a.py", 3, " c", "-d", "+a", "+++ /dev/null") + "\n"
    df = spark.createDataFrame([(1, diff), (2, "  \n")], "pr_id long, diff string")
    rows = diff_lines(df).withColumn("kind", line_kind(F.col("raw"))).orderBy("pr_id", "pos").collect()
    assert [r.kind for r in rows] == ["del", "file", "hunk", "ctx", "del", "add", "hdr"]
    assert [r.pos for r in rows] == list(range(7))


def test_added_lines(spark):
    df = spark.createDataFrame([(1, CASES["two hunks"])], "pr_id long, diff string")
    rows = added_lines(df).collect()
    assert [(r.file, r.line_no, r.code, r.boundary) for r in rows] == [
        ("a.py", 1, "x = 1", False),
        ("a.py", 31, "y = 1", False),
    ]


def test_parsing_has_no_shuffle(spark):
    df = spark.createDataFrame([(1, "+x")], "pr_id long, diff string")
    plan = parse_diffs(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Python" not in plan


def test_parsing_interprets_no_lambdas(spark):
    """Array lambdas run in Spark's interpreter, line by line."""
    df = spark.createDataFrame([(1, "+x")], "pr_id long, diff string")
    assert "lambda" not in parse_diffs(df)._jdf.queryExecution().executedPlan().toString()


def test_parsing_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr("diffmill.operators.diffs._BATCH_CHARS", 5)
    monkeypatch.setattr("diffmill.operators.diffs._ROWS_READ", 2)
    rows = [
        (None, "+a\n+\u3000def f\n+def \u24b6\n+def \u0301\n+def (\n+\x1fdef no"),  # 1f is no space, ( no name
        (4, None),
        (4, "@@ -1 +00000000000000000000007 @@\n+b\n@@ -1 +99999999999999999999 @@\n+c"),  # no number
        (5, "+++ b/x\r\n@@ -1 +3 @@\x1e+d\u2028 e\x85+f"),
    ]
    df = spark.createDataFrame(rows, "pr_id long, diff string")
    broken = spark.sql("SELECT 6L AS pr_id, CAST(X'2B61FF' AS STRING) AS diff")
    found = parse_diffs(df.unionByName(broken)).collect()
    assert sorted([tuple(r) for r in found], key=lambda r: (r[0] or 0, r[1])) == [
        (None, 0, "unknown", 0, "a"),
        (None, 1, "unknown", 1, "\u3000def f"),
        (None, 2, "unknown", 2, "def \u24b6"),
        (None, 3, "unknown", 3, "def \u0301\ndef (\n\x1fdef no"),
        (4, 0, "unknown", 7, "b\nc"),
        (5, 0, "x", 3, "d\nf"),
        (6, 0, "unknown", 0, "a\ufffd"),
    ]


# Known answers for the diffs derived from lineitem: one block of the diff per row, in order.
_ITEM_DIFFS = """
WITH item AS (
 SELECT l_orderkey AS pr_id,
        row_number() OVER (PARTITION BY l_orderkey
          ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn,
        element_at({snippets}, CAST((l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 16 AS INT) + 1) AS code,
        concat('src/m', CAST(l_partkey % 3 AS STRING),
               CASE l_partkey % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.PY'
                                  WHEN 3 THEN '.py' WHEN 4 THEN '.xyz' ELSE '' END) AS file,
        l_suppkey + 1 AS start
 FROM lineitem),
block AS (
 SELECT pr_id, rn, concat('--- a/', file, chr(10), '+++ b/', file, chr(10),
        '@@ -1,2 +', CAST(start AS STRING), ',9 @@', chr(10), ' ctx = 1', chr(10), '-old = 1', chr(10),
        '+', replace({code}, chr(10), concat(chr(10), '+'))) AS txt
 FROM item)
SELECT pr_id, LISTAGG(txt, chr(10)) WITHIN GROUP (ORDER BY rn) AS diff FROM block GROUP BY pr_id
"""


@pytest.mark.parametrize(
    ("code", "n_chunks", "longest"),
    [
        ("code", 57_442, 7),
        (
            "concat(code, repeat(concat(chr(10), '    x = 1'), CASE WHEN rn % 5 = 0 THEN 45 ELSE 0 END))",
            63_054,
            40,
        ),
    ],
)
def test_known_answers(spark, code, n_chunks, longest):
    from workload.snippets import SNIPPETS, sql_text

    spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").createOrReplaceTempView("lineitem")
    snippets = "array(" + ", ".join(sql_text(s) for s in SNIPPETS[:16]) + ")"
    diffs = spark.sql(_ITEM_DIFFS.format(snippets=snippets, code=code))
    found = parse_diffs(diffs).agg(
        F.count("*").alias("n"), F.max(F.size(F.split("code", "\n"))).alias("longest")
    ).first()
    assert (found.n, found.longest) == (n_chunks, longest)


def random_diffs(rng, count):
    kinds, ends, diffs = _LINES.elements, _BREAKS.elements, []
    for _ in range(count):
        many = rng.random() < 0.5
        lines = [rng.choice(["+x = 1"] * 30 + list(kinds)) if many else rng.choice(kinds) for _ in range(rng.choice([0, 1, 3, 10, 40, 130, 300]))]
        diffs.append("".join(ln + rng.choice(ends) for ln in lines))
    return diffs


def rows_of(chunks, count):
    result = [[] for _ in range(count)]
    for row in chunks.orderBy("pr_id", "chunk_index").collect():
        assert row.chunk_index == len(result[row.pr_id])
        result[row.pr_id].append((row.file, row.start_line, row.code))
    return result


@pytest.mark.parametrize("lines", [1, 2, 7, 39, 40, 41, 100_000])
def test_segments_of_any_size(spark, lines):
    diffs = [*CASES.values(), *random_diffs(random.Random(lines), 150)]
    df = spark.createDataFrame(list(enumerate(diffs)), "pr_id long, diff string")
    found = rows_of(parse_segments(segments_of(df, lines).repartition(5)), len(diffs))
    assert found == [expected_chunks(d) for d in diffs]


def test_long_and_short_diffs(spark):
    diffs = [*random_diffs(random.Random(5), 100), None]
    df = spark.createDataFrame(list(enumerate(diffs)), "pr_id long, diff string")
    found = rows_of(parse_all(df, largest=200, lines=11, stage=True), len(diffs))
    assert found == [expected_chunks(d or "") for d in diffs]


def test_one_file_in_many_splits(spark, tmp_path):
    """A file much larger than a split: segments stay small, chunks are those of the whole."""
    rng = random.Random(2)
    kinds = [k for k in _LINES.elements if k != "+++ b/b.js"]
    lines = [rng.choice(["+x = 1", "+    y = f(x)  # " + "z" * 30] * 10 + list(kinds)) for _ in range(60_000)]
    for pr, break_ in ((7, "\n"), (8, "\r\n")):
        (tmp_path / f"pr_{pr}.diff").write_text(break_.join(lines), newline="")
    size = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(size, "100k")
    try:
        segments = read_diff_segments(spark, str(tmp_path), lines=700)
        parts = segments.groupBy("pr_id").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("most")).collect()
        assert len(parts) == 2 and all(p.n > 60 and p.most < 60_000 for p in parts)
        found = parse_segments(segments, stage=True).orderBy("pr_id", "chunk_index").collect()
    finally:
        spark.conf.unset(size)
    wanted = [(i, *c) for i, c in enumerate(expected_chunks("\n".join(lines)))]
    for pr in (7, 8):
        assert [tuple(r)[1:] for r in found if r.pr_id == pr] == wanted


def test_no_window_over_lines_of_a_diff(spark):
    """Windows over a diff run on summaries: no array of lines or code goes through them,
    but for those of the chunks that begin in one segment."""
    df = spark.createDataFrame([(1, "+a")], "pr_id long, diff string")
    plan = parse_segments(segments_of(df, 5))._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) >= 6 and not any("lines#" in w or "sections#" in w for w in windows)
