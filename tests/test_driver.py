"""Driver contract: every query runs, and those with SQL give the same rows."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as driver  # noqa: E402
from tools.check import TABLES, digest  # noqa: E402

QUICK = [
    "s1_submitted_diffs", "s6_webhook_events", "d7_chunks", "d7_document_chunks", "p11_classified",
    "j2_explained_issues", "j3_comments_to_post", "a1_primary_language", "a6_class_metrics", "w1_ranked_issues",
    "w3_subsample", "o_split_stratified", "u2_distinct_code", "u8_entry_fields", "t9_rule_labels", "m4_training_set",
    "m5_reviews", "d7_split_diffs", "s6_broken_payloads", "x2_admitted", "m1_scorer_errors", "u5_independent_labels", "t3_softmax",
]


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert len(driver.queries()) > 80


def test_entry(spark, sf_dir):
    assert driver.entry(spark).columns == ["label", "chunks", "prs"]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cursor = con.execute(driver.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    expected = cursor.fetchall()
    df = driver.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(columns)
    assert digest(df.columns, rows) == digest(columns, expected)
