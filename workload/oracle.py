"""SQL counterparts of the driver queries, for DuckDB.

They are written from the rules, in window form, and share no code with the library:
only fixed values and the derived inputs are the same. Named steps are put in front of a query by
``query(...)`` together with the steps they need.
"""

import re

from diffmill import constants as C
from diffmill.operators.corpus import seed_rows
from workload import snippets as S

WS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(28), chr(29), chr(30), chr(31), chr(133), chr(160), chr(8232), chr(8233))"
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def lit(text: str) -> str:
    """Text literal with newlines spelled out."""
    parts = ["'" + p.replace("'", "''") + "'" for p in text.split("\n")]
    return "concat(" + ", chr(10), ".join(parts) + ")" if len(parts) > 1 else parts[0]


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def hit(x: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({x}, {lit(pattern)}, 'c{flags}')"


def any_hit(x: str, patterns: list[str], flags: str = "") -> str:
    return "(" + " OR ".join(hit(x, p, flags) for p in patterns) + ")"


def percent(x: str) -> str:
    return f"concat(CAST(CAST(round_even({x} * 100, 0) AS INT) AS VARCHAR), '%')"


def case_map(x: str, mapping: dict, default: str) -> str:
    def value(v):
        return f"'{v}'" if isinstance(v, str) else str(v)

    whens = " ".join(f"WHEN {value(k)} THEN {value(v)}" for k, v in mapping.items())
    return f"CASE {x} {whens} ELSE {default} END"


def lines_of(x: str) -> str:
    """Lines of a text as a list, without an empty last one."""
    cut = f"regexp_split_to_array({x}, '{BREAKS}')"
    return f"CASE WHEN {x} = '' THEN [] WHEN {cut}[-1] = '' THEN {cut}[:-2] ELSE {cut} END"


# --- rules in the RE2 dialect: no lookahead ------------------------------------------------

SQL_INJECTION = C.SQL_INJECTION_PATTERNS
SECURITY = C.SECURITY_PATTERNS
# before a full stop the lookahead always holds
NULL_REFERENCE = [p.replace("(?!is None)", "") for p in C.NULL_REFERENCE_PATTERNS]
_NO_CALL = r'"\s*\+\s*\w\w|"\s*\+\s*\w\s*([^\s(]|\z)'
TYPE_MISMATCH = [_NO_CALL if "(?!" in p else p for p in C.TYPE_MISMATCH_PATTERNS]
# the endless loop is below
LOGIC_FLAW = [p for p in C.LOGIC_FLAW_PATTERNS if "(?!" not in p]


def endless_loop(x: str) -> str:
    parts = f"regexp_split_to_array({x}, 'while\\s+True\\b')"
    return (
        f"len(list_filter({parts}[2:], lambda p: NOT contains(substr(p, 1, 205), 'break'))) > 0"
    )


def rule_label(x: str) -> str:
    return (
        f"CASE WHEN {any_hit(x, SQL_INJECTION + SECURITY, 'i')} THEN 3 "
        f"WHEN {any_hit(x, NULL_REFERENCE)} THEN 1 "
        f"WHEN {any_hit(x, TYPE_MISMATCH)} THEN 2 "
        f"WHEN {any_hit(x, LOGIC_FLAW)} OR {endless_loop(x)} THEN 4 ELSE 0 END"
    )


IMPORT = r"^\s*(?:import\s|from\s\S+\s+import\s)"
DECLARATION = r"^\s*(?:class\s+\w+|def\s+\w+|async\s+def\s+\w+)"
NO_LOGIC = r"""^\s*(?:pass|\"\"\"|'''|#)"""


def is_trivial(x: str) -> str:
    stripped = f"list_transform({lines_of(x)}, lambda l: {strip('l')})"
    structural = any_hit("l", [IMPORT, DECLARATION, NO_LOGIC])
    logic = f"list_filter({stripped}, lambda l: l <> '' AND NOT {structural})"
    assigned = hit(f"{logic}[1]", r"^\s*self\.\w+\s*=")
    return f"(len({logic}) = 0 OR (len({logic}) = 1 AND {assigned}))"


def refined(kind: str, conf: str, code: str) -> str:
    high = " ".join(f"WHEN {hit(code, p)} THEN '{t}'" for p, t in C.HIGH_SIGNAL_RULES)
    low = " ".join(f"WHEN {conf} < 0.75 AND {hit(code, p)} THEN '{t}'" for p, t in C.BORDERLINE_RULES)
    return f"CASE WHEN {conf} >= 0.95 THEN {kind} {high} {low} ELSE {kind} END"


def suspicious_offset(x: str) -> str:
    def first(p, f):
        marks = f"list_transform({lines_of(x)}, lambda l: {hit('l', p, 'i' if f else '')})"
        return f"list_position({marks}, true) - 1"

    found = ", ".join(f"nullif(coalesce({first(p, f)}, -1), -1)" for p, f in C.SUSPICIOUS_LINE_PATTERNS)
    return f"coalesce({found}, 0)"


def language(file: str) -> str:
    ext = f"lower(string_split({file}, '.')[-1])"
    known = case_map(ext, C.EXTENSION_LANGUAGES, "'Unknown'")
    return f"CASE WHEN contains({file}, '.') THEN {known} ELSE 'Unknown' END"


def hash_order(x: str) -> str:
    return f"md5(concat(CAST({x} AS VARCHAR), '#42'))"


def hash_number(x: str) -> str:
    return f"CAST(concat('0x', substr({hash_order(x)}, 1, 8)) AS BIGINT)"


def issue_type(x: str) -> str:
    return case_map(x, C.ISSUE_TYPES, "'Code Issue'")


def chosen_names(code: str, draw: str) -> str:
    names = "[" + ", ".join(f"'{n}'" for n in C.RENAMES) + "]"
    present = f"list_filter({names}, lambda n: regexp_matches({code}, concat('\\b', n, '\\b')))"
    order = hash_order(f"concat({draw}, '/', n)")
    drawn = f"list_sort(list_transform({present}, lambda n: {{'o': {order}, 'n': n}}))"
    return f"list_transform(({drawn})[1:2 + {hash_number(draw)} % 2], lambda x: x.n)"


def renamed(code: str, chosen: str, draw: str) -> str:
    for name, options in C.RENAMES.items():
        choice = S.pick(
            [f"'{o}'" for o in options],
            hash_number(f"concat({draw}, ':{name}')") + f" % {len(options)}",
            "duckdb",
        )
        code = (
            f"CASE WHEN list_contains({chosen}, '{name}') "
            f"THEN regexp_replace({code}, '\\b{name}\\b', {choice}, 'g') ELSE {code} END"
        )
    return code


def comment_choice(draw: str) -> str:
    return S.pick(
        [f"'{c}'" for c in C.INJECTED_COMMENTS],
        hash_number(f"concat({draw}, ':comment')") + f" % {len(C.INJECTED_COMMENTS)}",
        "duckdb",
    )


# --- named steps -----------------------------------------------------------------------------

_H = "(pr_id % 1000003 * 31 + chunk_index * 17 + length(code) * 7)"
_BLOCKS = (
    "array_to_string(list_transform(range(0, o_orderkey % 6 + 1), lambda i: "
    + S.block("duckdb")
    + "), chr(10))"
)
_ELEMENTS = (
    "array_to_string(list_transform(range(0, pr_id % 9 + 1), lambda i: "
    + S.response_element()
    + "), ',')"
)


def _field(name: str) -> str:
    raw = f"json_extract(e, '$.{name}')"
    text = f"json_extract_string(e, '$.{name}')"
    return (
        f"CASE json_type({raw}) WHEN 'VARCHAR' THEN {strip(text)} WHEN 'NULL' THEN '' "
        f"WHEN 'BOOLEAN' THEN CASE WHEN {text} = 'true' THEN 'True' ELSE '' END "
        f"ELSE CASE WHEN {raw} IS NULL OR {text} IN ('0', '0.0', '[]', '{{}}') THEN '' ELSE {text} END END"
    )


def _section(lines: list[str]) -> str:
    return "concat_ws(chr(10), " + ", ".join(lines) + ")"


def _item(*parts: str) -> str:
    """A text item with a final newline; null when a part is null."""
    return "(" + " || ".join(parts) + " || chr(10))"


_SEV, _FIX, _FIXED = (
    f"nullif({strip(x)}, '')" for x in ("severity", "recommended_fix", "fixed_code")
)
_FENCED = "'```python' || chr(10) || {} || chr(10) || '```' || chr(10)"

STEPS: dict[str, str] = {
    "diffs": f"SELECT o_orderkey AS pr_id, {S.whole_diff(_BLOCKS)} AS diff FROM orders",
    "corpus": "SELECT " + ", ".join(S.corpus_columns("duckdb")) + " FROM lineitem",
    "payloads": f"SELECT event_id, ts, {S.payload()} AS payload FROM events",
    "responses": (
        f"SELECT pr_id, {S.whole_response(_ELEMENTS)} AS response "
        "FROM (SELECT o_orderkey AS pr_id FROM orders)"
    ),
    # D1 to D5
    "lines": f"""
      SELECT pr_id, pos, raw FROM (
        SELECT pr_id, unnest(range(len(ls))) AS pos, unnest(ls) AS raw
        FROM (SELECT pr_id, {lines_of('diff')} AS ls FROM diffs WHERE {strip('diff')} <> ''))""",
    "kinds": r"""
      SELECT *, CASE WHEN starts_with(raw, '+++ b/') THEN 'file' WHEN starts_with(raw, '+++') THEN 'hdr'
        WHEN regexp_matches(raw, '^@@ -\d+(?:,\d+)? \+(\d+)') THEN 'hunk'
        WHEN starts_with(raw, '-') THEN 'del' WHEN starts_with(raw, '+') THEN 'add' ELSE 'ctx' END AS kind
      FROM lines""",
    "running": r"""
      SELECT *, coalesce(last_value(CASE WHEN kind = 'file' THEN substr(raw, 7) END IGNORE NULLS) OVER w, 'unknown') AS file,
        coalesce(last_value(CASE WHEN kind = 'hunk' THEN CAST(regexp_extract(raw, '^@@ -\d+(?:,\d+)? \+(\d+)', 1) AS BIGINT) END
                 IGNORE NULLS) OVER w, 0) AS base,
        sum(CASE WHEN kind = 'hunk' THEN 1 ELSE 0 END) OVER w AS hunk
      FROM kinds WINDOW w AS (PARTITION BY pr_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "numbered": """
      SELECT *, base + sum(CASE WHEN kind IN ('add', 'ctx') THEN 1 ELSE 0 END) OVER (
          PARTITION BY pr_id, hunk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        - CASE WHEN kind IN ('add', 'ctx') THEN 1 ELSE 0 END AS line_no
      FROM running""",
    "added": r"""
      SELECT pr_id, pos, file, CAST(line_no AS BIGINT) AS line_no, substr(raw, 2) AS code,
        regexp_matches(substr(raw, 2), '^\s*(?:def |class |async def )\w+') AS boundary,
        min(pos) OVER (PARTITION BY pr_id, file) AS file_first
      FROM numbered WHERE kind = 'add'""",
    # D7 to D10
    "segments": """
      SELECT *, sum(CASE WHEN boundary THEN 1 ELSE 0 END) OVER (PARTITION BY pr_id, file ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM added""",
    "placed": """
      SELECT *, row_number() OVER (PARTITION BY pr_id, file, seg ORDER BY pos) - 1 AS in_seg FROM segments""",
    "starts": """
      SELECT *, in_seg // 40 AS sub,
        CASE WHEN lag(line_no) OVER w IS NULL THEN line_no
             WHEN in_seg = 0 AND (lag(in_seg) OVER w + 1) % 40 <> 0 THEN line_no
             ELSE lag(line_no) OVER w + 1 END AS start_line
      FROM placed WINDOW w AS (PARTITION BY pr_id, file ORDER BY pos)""",
    "chunks": f"""
      SELECT pr_id, CAST(row_number() OVER (PARTITION BY pr_id ORDER BY file_first, seg, sub) - 1 AS INT) AS chunk_index,
        file, start_line, code
      FROM (SELECT pr_id, file, file_first, seg, sub, arg_min(start_line, pos) AS start_line,
              string_agg(code, chr(10) ORDER BY pos) AS code
            FROM starts GROUP BY ALL)
      WHERE {strip('code')} <> ''""",
    # languages
    "language_counts": f"""
      SELECT pr_id, {language('file')} AS language, count(*) AS n, min(chunk_index) AS first_chunk
      FROM chunks GROUP BY ALL""",
    "pr_languages": """
      SELECT d.pr_id, coalesce(l.language, 'Unknown') AS language
      FROM diffs d LEFT JOIN (
        SELECT pr_id, language FROM language_counts
        QUALIFY row_number() OVER (PARTITION BY pr_id ORDER BY n DESC, first_chunk) = 1) l USING (pr_id)""",
    # classification
    "reviewable": f"""
      SELECT * FROM chunks
      WHERE length(code) - length(replace(code, chr(10), '')) <= 100 AND NOT {is_trivial('code')}""",
    "scored": f"""
      SELECT *, CASE {_H} % 6 WHEN 5 THEN 'Error' ELSE {case_map(_H + ' % 6', C.CLASS_NAMES, "''")} END AS p_label,
        CASE WHEN {_H} % 6 = 5 THEN 0.0::DOUBLE ELSE ({_H} % 101) / 100.0::DOUBLE END AS p_conf,
        CASE WHEN {_H} % 6 = 5 THEN -1 ELSE CAST({_H} % 6 AS INT) END AS p_id,
        CASE WHEN {_H} % 6 <> 5 AND {_H} % 3 = 0 THEN
          list_transform([0, 1, 2, 3, 4], lambda c: (({_H} + 37 * c) % 101) / 100.0::DOUBLE) END AS probs
      FROM reviewable""",
    "picked": f"""
      SELECT pr_id, chunk_index, code, file, start_line, l.ord AS label_ord, l.name AS raw_label, l.conf AS confidence, l.id AS raw_id
      FROM (
        SELECT *, unnest(CASE
          WHEN p_conf >= 0.6 AND len(several) > 0 THEN several
          ELSE [{{'ord': 0, 'name': p_label, 'conf': p_conf, 'id': p_id}}] END) AS l
        FROM (
          SELECT *, list_transform(kept, lambda c, i: {{'ord': CAST(i - 1 AS INT),
              'name': {case_map('c', C.CLASS_NAMES, "''")}, 'conf': round(probs[c + 1], 4), 'id': CAST(c AS INT)}}) AS several
          FROM (SELECT *, list_filter([1, 2, 3, 4], lambda c: probs[c + 1] >= 0.4) AS kept FROM scored)))""",
    "gated": f"""
      SELECT *, CASE WHEN confidence < 0.6 AND t NOT IN ('Clean', 'Code Quality') THEN 'Code Quality' ELSE t END AS gated
      FROM (SELECT *, {issue_type('raw_label')} AS t FROM picked)""",
    "classified": f"""
      SELECT pr_id, chunk_index, label_ord, label, confidence,
        CASE WHEN label <> gated AND raw_id = 0 THEN {case_map('label', C.ISSUE_TYPE_IDS, '4')} ELSE raw_id END AS label_id,
        raw_id = -1 AS is_error, code, file, start_line
      FROM (SELECT *, {refined('gated', 'confidence', 'code')} AS label FROM gated)""",
    "issues": f"""
      SELECT *, CAST(row_number() OVER (PARTITION BY pr_id ORDER BY {case_map('label_id', C.SEVERITY_RANKS, '0')} DESC,
        confidence DESC, chunk_index, label_ord) AS INT) AS issue_idx
      FROM classified WHERE label_id <> 0""",
    # answers
    "array_texts": r"""
      SELECT pr_id, regexp_extract(CASE WHEN starts_with(t, '```')
          THEN regexp_replace(regexp_replace(t, '^```(?:json)?\s*\n?', ''), '\n?```\s*$', '') ELSE t END,
        '(?s)\[.*\]', 0) AS body
      FROM (SELECT pr_id, """ + strip("response") + """ AS t FROM responses)""",
    "elements": """
      SELECT pr_id, pos, e FROM (
        SELECT pr_id, unnest(range(len(es))) AS pos, unnest(es) AS e
        FROM (SELECT pr_id, CAST(CASE WHEN json_valid(body) THEN body ELSE '[]' END AS JSON[]) AS es
              FROM array_texts WHERE body <> ''))
      WHERE json_type(e) = 'OBJECT'""",
    "entries": f"""
      SELECT pr_id, issue_idx, {', '.join(f"{_field(n)} AS {n}" for n in ('explanation', 'severity', 'recommended_fix', 'fixed_code'))}
      FROM (SELECT *, CAST(CASE WHEN json_extract(e, '$.issue_number') IS NULL THEN pos + 1
              ELSE TRY_CAST(json_extract_string(e, '$.issue_number') AS INT) END AS INT) AS issue_idx FROM elements)
      WHERE issue_idx IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY pr_id, issue_idx ORDER BY pos DESC) = 1""",
    "explained": f"""
      SELECT i.*, coalesce(nullif(explanation, ''), {lit(C.DEFAULT_EXPLANATION)}) AS explanation,
        coalesce(nullif(severity, ''), 'Medium') AS severity,
        coalesce(nullif(recommended_fix, ''), {lit(C.DEFAULT_FIX)}) AS recommended_fix,
        coalesce(fixed_code, '') AS fixed_code
      FROM issues i LEFT JOIN entries USING (pr_id, issue_idx)""",
    # products
    "comments": f"""
      SELECT pr_id, issue_idx, file,
        CAST(greatest(coalesce(nullif(start_line, 0), 1) + {suspicious_offset('code')}, 1) AS BIGINT) AS line, label, confidence,
        {_section([
            _item(lit(C.COMMENT_TITLE), 'label', "' (Confidence: '", percent('confidence'), "')**'"),
            _item("'**Issue**'"), _item(strip('explanation')),
            _item("'**Severity:** '", _SEV),
            f"CASE WHEN {_FIX} IS NOT NULL THEN {_item(lit('**Recommended fix**'))} END", _item(_FIX),
            f"CASE WHEN {_FIXED} IS NOT NULL THEN {_item(lit('**Fixed code**'))} END",
            _FENCED.format(_FIXED),
        ])} AS body
      FROM explained""",
    "sections": f"""
      SELECT pr_id, string_agg({_section([
            _item("'## Issue '", 'CAST(issue_idx AS VARCHAR)', "': '", 'label'),
            _item("'**Confidence:** '", percent('confidence')),
            _item("'**File:** `'", 'file', "'`'"),
            _item("'**Severity:** '", _SEV),
            _item("'**Problematic code:**'"), _FENCED.format('code'),
            _item("'**Explanation:**'"), _item(strip('explanation')),
            f"CASE WHEN {_FIX} IS NOT NULL THEN {_item(lit('**Recommended fix:**'))} END", _item(_FIX),
            f"CASE WHEN {_FIXED} IS NOT NULL THEN {_item(lit('**Fixed code:**'))} END",
            _FENCED.format(_FIXED), _item("'---'"),
        ])}, chr(10) ORDER BY issue_idx) AS sections, count(*) AS total
      FROM explained GROUP BY pr_id""",
    "type_counts": """
      SELECT pr_id, label, count(*) AS n, min(issue_idx) AS first_idx FROM issues GROUP BY ALL""",
    "bullets": r"""
      SELECT pr_id, string_agg('- **' || CASE WHEN n > 1 AND label LIKE '%y' THEN regexp_replace(label, 'y+$', '') || 'ies'
          WHEN n > 1 THEN label || 's' ELSE label END || ':** ' || n, chr(10) ORDER BY n DESC, first_idx) AS bullets,
        CAST(sum(n) AS BIGINT) AS total
      FROM type_counts GROUP BY pr_id""",
    "headers": f"""
      SELECT pr_id, language, '**Language detected:** ' || language || chr(10)
        || CASE WHEN language IN ('Python', 'Unknown') THEN '' ELSE {lit(C.LANGUAGE_WARNING)} END AS header
      FROM pr_languages""",
    "reviews": f"""
      SELECT pr_id, language,
        CASE WHEN sections IS NULL THEN {lit(C.REVIEW_TITLE)} || chr(10) || header || {lit(chr(10) + C.CLEAN_REVIEW)}
          ELSE concat_ws(chr(10), {lit(C.REVIEW_TITLE)}, header || chr(10),
            '**Issues found:** ' || s.total || chr(10), '---' || chr(10), sections) END AS final_review,
        CASE WHEN sections IS NULL THEN {lit(C.REVIEW_TITLE)} || chr(10) || header || {lit(chr(10) + C.CLEAN_REVIEW)}
          ELSE concat_ws(chr(10), {lit(C.REVIEW_TITLE)}, header || chr(10),
            '**' || s.total || CASE WHEN s.total = 1 THEN ' issue' ELSE ' issues' END || ' detected.**' || chr(10),
            bullets, {lit(C.SUMMARY_FOOTER)}) END AS review_summary,
        coalesce(s.total, 0) AS issue_count
      FROM headers LEFT JOIN sections s USING (pr_id) LEFT JOIN bullets b USING (pr_id)""",
    "existing": f"""
      SELECT pr_id, file AS path,
        CASE WHEN (pr_id + issue_idx) % 8 = 0 THEN line WHEN (pr_id + issue_idx) % 3 = 0 THEN 0 END AS line,
        line AS original_line,
        CASE WHEN (pr_id + issue_idx) % 12 = 0 THEN 'by someone else' ELSE 'by {C.PRODUCT}' END AS body
      FROM comments WHERE (pr_id + issue_idx) % 4 = 0""",
    "places": f"""
      SELECT pr_id, coalesce(path, '') AS file, coalesce(nullif(line, 0), nullif(original_line, 0), 0) AS line
      FROM existing WHERE contains(body, '{C.PRODUCT}')""",
    "to_post": """
      SELECT c.* FROM comments c WHERE issue_idx <= 10 AND NOT EXISTS (
        SELECT 1 FROM places p WHERE p.pr_id = c.pr_id AND p.file = c.file AND p.line = c.line)""",
    # events
    "webhook_events": """
      SELECT event_id, ts, coalesce(payload::JSON->>'$.action', '') AS action,
        coalesce(payload::JSON->>'$.repository.full_name', 'unknown') AS repo,
        coalesce(payload::JSON->>'$.pull_request.number', '?') AS pr_number,
        coalesce(payload::JSON->>'$.pull_request.head.sha', '') AS head_sha,
        CAST(payload::JSON->>'$.installation.id' AS BIGINT) AS installation_id
      FROM payloads""",
    # corpus
    "codes": """
      SELECT coalesce(nullif(func_code_string, ''), whole_func_string, '') AS code FROM corpus""",
    "labelled": f"""
      SELECT code, {rule_label('code')} AS label FROM codes WHERE length(code) BETWEEN 1 AND 2048""",
    "distinct_labelled": "SELECT DISTINCT code, label FROM labelled",
    "documents_labelled": """
      SELECT doc_id, text AS code, CAST(quality + 2 * toxic AS INT) AS label
      FROM documents JOIN labels USING (doc_id)""",
    "documents_distinct": """
      SELECT sha256(code) AS sample_key, doc_id, code, label FROM documents_labelled
      QUALIFY row_number() OVER (PARTITION BY code ORDER BY doc_id) = 1""",
    "seeds": "SELECT * FROM (VALUES "
    + ", ".join(f"({lit(code)}, {label})" for code, label in seed_rows())
    + ") AS s(code, label)",
    "seeded": "SELECT code, label, 0 AS source_rank FROM labelled UNION ALL SELECT code, label, 1 FROM seeds",
    "samples": """
      SELECT sha256(code) AS sample_key, code, label FROM seeded
      QUALIFY row_number() OVER (PARTITION BY code ORDER BY source_rank, label) = 1""",
    "class_sizes": "SELECT label, count(*) AS n FROM samples GROUP BY label",
    "targets": "SELECT * FROM (VALUES "
    + ", ".join(f"({label}, {k})" for label, k in C.TARGET_COUNTS.items())
    + ") AS t(label, k)",
    "downsampled": f"""
      SELECT s.* FROM samples s JOIN targets USING (label)
      QUALIFY row_number() OVER (PARTITION BY label ORDER BY {hash_order('sample_key')}) <= any_value(k) OVER (PARTITION BY label)""",
    "numbered_variants": f"""
      SELECT code, label, v_no % 4 AS variant, concat(sample_key, '#', v_no) AS sample_key, needed FROM (
        SELECT s.*, k - n AS needed, unnest(range(0, CAST(ceil((k - n) / (n * 4)) AS BIGINT) * 4)) AS v_no
        FROM samples s JOIN class_sizes USING (label) JOIN targets USING (label) WHERE n < k)""",
    "wanted_variants": f"""
      SELECT * FROM numbered_variants
      QUALIFY row_number() OVER (PARTITION BY label ORDER BY {hash_order('sample_key')}) <= needed""",
    "renamed_variants": f"""
      SELECT *, {renamed('code', 'chosen', 'sample_key')} AS r
      FROM (SELECT *, {chosen_names('code', 'sample_key')} AS chosen FROM wanted_variants)""",
    "variants": f"""
      SELECT CASE WHEN variant >= 2 THEN 'def wrapper():' || chr(10) || array_to_string(
          list_transform({lines_of('t')}, lambda l: '    ' || l), chr(10)) ELSE t END AS code, label, variant, sample_key
      FROM (SELECT *, CASE WHEN variant % 2 = 0 THEN regexp_replace(r, '\\n(\\s*\\S)', chr(10) || chr(10) || '\\1')
              ELSE {comment_choice('sample_key')} || chr(10) || r END AS t FROM renamed_variants)""",
    "balanced": """
      SELECT code, label, sample_key FROM downsampled UNION ALL SELECT code, label, sample_key FROM variants""",
    "predicted": f"""
      SELECT label, CAST(({hash_number('code')}) % 7 % 5 AS INT) AS pred FROM labelled""",
}


def query(final: str, *steps: str) -> str:
    """A query with the named steps it uses and all those they use, in order."""
    needed: list[str] = []

    def need(name: str) -> None:
        if name in needed:
            return
        for other in STEPS:
            if other != name and re.search(rf"\b(?:FROM|JOIN)\s+{other}\b", STEPS[name]):
                need(other)
        needed.append(name)

    for name in STEPS:
        if name in steps or re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", final):
            need(name)
    if not needed:
        return final
    return "WITH " + ",\n".join(f"{n} AS ({STEPS[n]})" for n in needed) + "\n" + final
