"""Explicit schemas of the tables the operators read and write."""

from pyspark.sql import types as T

_LONG, _INT, _TEXT = T.LongType(), T.IntegerType(), T.StringType()
_DOUBLE, _BOOL = T.DoubleType(), T.BooleanType()


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


DIFFS = _table(pr_id=_LONG, diff=_TEXT)
CHUNKS = _table(pr_id=_LONG, chunk_index=_INT, file=_TEXT, start_line=_LONG, code=_TEXT)
PREDICTION = _table(
    label=_TEXT, confidence=_DOUBLE, label_id=_INT, all_probs=T.MapType(_INT, _DOUBLE)
)
SCORES = _table(pr_id=_LONG, chunk_index=_INT, prediction=PREDICTION)
CLASSIFICATIONS = _table(
    pr_id=_LONG,
    chunk_index=_INT,
    label_ord=_INT,
    label=_TEXT,
    confidence=_DOUBLE,
    label_id=_INT,
    is_error=_BOOL,
    code=_TEXT,
    file=_TEXT,
    start_line=_LONG,
)
RESPONSES = _table(pr_id=_LONG, response=_TEXT)
ATTEMPTS = _table(pr_id=_LONG, model_rank=_INT, attempt=_INT, error=_TEXT, content=_TEXT)
EXISTING_COMMENTS = _table(
    pr_id=_LONG, path=_TEXT, line=_LONG, original_line=_LONG, body=_TEXT
)
COMMENTS = _table(
    pr_id=_LONG,
    issue_idx=_INT,
    file=_TEXT,
    line=_LONG,
    label=_TEXT,
    confidence=_DOUBLE,
    body=_TEXT,
)
REVIEWS = _table(
    pr_id=_LONG,
    language=_TEXT,
    final_review=_TEXT,
    review_summary=_TEXT,
    issue_count=_LONG,
    issues_found=_INT,
)
STATUS = _table(pr_id=_LONG, status_body=_TEXT)
WEBHOOK_PAYLOAD = _table(
    action=_TEXT,
    repository=_table(full_name=_TEXT),
    pull_request=_table(number=_LONG, head=_table(sha=_TEXT)),
    installation=_table(id=_LONG),
)
CORPUS = _table(func_code_string=_TEXT, whole_func_string=_TEXT)
SAMPLES = _table(sample_key=_TEXT, code=_TEXT, label=_INT, split=_TEXT)
