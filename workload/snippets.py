"""Texts the derived inputs are made of, and the SQL that both engines share.

The test tables hold no code. Diffs are derived from ``orders`` (one diff per order,
within the row), the code corpus from ``lineitem``, webhook events from ``events``.
"""

SNIPPETS = [
    "import os\nimport sys",
    "def load_row(cur):\n    return cur.fetchone().title",
    "def share(total, parts):\n    return total / len(parts)",
    'def allow(role):\n    if role == "owner" or "editor":\n        return True',
    'def find(term):\n    sql = "SELECT id FROM book WHERE name = " + term\n    return sql',
    'def ping(host):\n    os.system("ping " + host)',
    "def launch(cmd):\n    subprocess.call(cmd, shell=True)",
    "def total(xs):\n    for i in range(len(xs) + 1):\n        use(xs[i])",
    'def tag(n):\n    return "no-" + str(n)',
    'def tag1(n):\n    return "no-" + f(n)',
    "def add(a, b):\n    return a + b",
    "def spin():\n    while True:\n        step()",
    "def spin2():\n    while True:\n        if done():\n            break",
    "class Box:\n    pass",
    "def __init__(self, db):\n    self.db = db",
    "password = read()",
    "def slurp(name):\n    return open(name).read()",
    'def owner(store):\n    return store.get("owner").name',
    "def gap(n):\n    if n = 4:\n        return n",
    "def part(x):\n    y = x\n    return y / 0",
    "def late(rows):\n    row = None\n    return row.key",
    "def join_user(user, data):\n    result = user + data\n    return result",
    "async def items_of(query):\n    value = await query.run()\n\n    return value",
    '"""only text"""\n# note\nfrom box import lid',
]


def sql_text(text: str) -> str:
    """A text as a literal both engines read the same way."""
    parts = [f"'{p}'" for p in text.split("\n")]
    return "concat(" + ", chr(10), ".join(parts) + ")" if len(parts) > 1 else parts[0]


def pick(values: list[str], index: str, dialect: str) -> str:
    """Element of a literal list by a 0-based index expression."""
    if dialect == "spark":
        return f"element_at(array({', '.join(values)}), CAST({index} AS INT) + 1)"
    return f"list_extract([{', '.join(values)}], CAST({index} AS INT) + 1)"


def snippet(index: str, dialect: str) -> str:
    return pick([sql_text(s) for s in SNIPPETS], index, dialect)


def _as_text(expression: str) -> str:
    return f"CAST({expression} AS VARCHAR(20))"


def block(dialect: str) -> str:
    """Diff text of block ``i`` of the order (o_orderkey, o_custkey)."""
    mix = "(o_orderkey * 7 + o_custkey * 3 + i * 5)"
    at = "(o_orderkey + i * (o_orderkey % 3 + 1))"
    extension = pick(["'.py'", "'.js'", "'.PY'", "'.py'", "'.xyz'", "''"], f"{at} % 6", dialect)
    file = f"concat('src/m', {_as_text(at + ' % 3')}, {extension})"
    start = _as_text("(o_custkey + i) % 97 + 1")
    code = (
        f"concat({snippet(mix + ' % 24', dialect)}, "
        f"repeat(concat(chr(10), '    x = 1'), CASE WHEN {mix} % 13 = 0 THEN 45 ELSE 0 END))"
    )
    added = f"concat('+', replace({code}, chr(10), concat(chr(10), '+')))"
    hunk = f"'@@ -1,2 +', {start}, ',9 @@', chr(10), ' ctx = 1', chr(10), '-old = 1', chr(10)"
    style = f"{mix} % 11"
    return f"""concat(
      CASE WHEN {style} = 1 THEN concat('diff --git a/', {file}, chr(10), 'index 1..2', chr(10)) ELSE '' END,
      '--- a/', {file}, chr(10),
      CASE WHEN {style} = 3 THEN '+++ /dev/null' ELSE concat('+++ b/', {file}) END, chr(10),
      CASE {style} WHEN 0 THEN ''
                   WHEN 3 THEN concat('@@ -1,2 +0,0 @@', chr(10), '-old = 1', chr(10))
                   ELSE concat({hunk}) END,
      CASE WHEN {style} = 4 THEN concat('+++ lost', chr(10)) ELSE '' END,
      CASE WHEN {style} = 3 THEN '+left = eval(word)' ELSE {added} END,
      CASE {style} WHEN 2 THEN concat(chr(10), chr(92), ' No newline at end of file')
                   WHEN 4 THEN concat(chr(10), '+', chr(10), '+  ') ELSE '' END)"""


def whole_diff(joined: str) -> str:
    """Diff of an order: some blank, some with other line ends or a final line end."""
    ended = f"concat({joined}, CASE WHEN o_orderkey % 2 = 0 THEN chr(10) ELSE '' END)"
    return f"""CASE WHEN o_orderkey % 101 = 0 THEN concat('  ', chr(10), ' ')
      WHEN o_orderkey % 17 = 0 THEN replace({ended}, chr(10), concat(chr(13), chr(10)))
      ELSE {ended} END"""


def corpus_columns(dialect: str) -> list[str]:
    """func_code_string and whole_func_string from a row of lineitem.

    Snippets of the logic class are rare, so that balancing has to fill the class up.
    """
    mix = "((l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 24)"
    kept = f"CASE WHEN {mix} IN (7, 11, 19) AND l_partkey % 200 <> 0 THEN 10 ELSE {mix} END"
    code = (
        f"concat({snippet(kept, dialect)}, chr(10), '# r', {_as_text('l_partkey')}, "
        "CASE WHEN l_partkey % 97 = 0 THEN repeat('x', 2100) ELSE '' END)"
    )
    return [
        f"CASE WHEN (l_suppkey + l_linenumber) % 19 = 0 THEN '' ELSE {code} END "
        "AS func_code_string",
        f"CASE WHEN l_suppkey % 38 = 5 THEN NULL ELSE concat({code}, chr(10), '# whole') END "
        "AS whole_func_string",
    ]


ACTIONS = {
    "click": "opened",
    "view": "synchronize",
    "signup": "reopened",
    "purchase": "closed",
    "error": "edited",
}


def payload() -> str:
    """JSON payload of a row of events; some fields are missing in some rows."""
    action = "CASE event_type " + " ".join(
        f"WHEN '{event}' THEN '{action}'" for event, action in ACTIONS.items()
    ) + " ELSE 'other' END"
    key = _as_text("event_id % 5000")
    return f"""concat('{{"k":', {_as_text('event_id')},
      CASE WHEN event_id % 11 = 0 THEN '' ELSE concat(',"action":"', {action}, '"') END,
      CASE WHEN event_id % 13 = 0 THEN ''
           ELSE concat(',"repository":{{"full_name":"org/r', {_as_text('user_id')}, '"}}') END,
      CASE WHEN event_id % 17 = 0 THEN ',"pull_request":{{}}'
           ELSE concat(',"pull_request":{{"number":', {key},
                       CASE WHEN event_id % 7 = 0 THEN '' ELSE concat(',"head":{{"sha":"c', {key}, '"}}') END,
                       '}}') END,
      CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 = 1 THEN ',"installation":{{"id":0}}'
           ELSE ',"installation":{{"id":77}}' END, '}}')"""


def response_element() -> str:
    """JSON text of element ``i`` (from 0) of the answer to pull request ``pr_id``."""
    number = _as_text("i + 1")
    named = f"concat('\"issue_number\":', {number}, ',')"
    return f"""CASE
      WHEN (pr_id + i) % 19 = 0 THEN '7'
      WHEN (pr_id + i) % 23 = 0 THEN '{{}}'
      ELSE concat('{{',
        CASE WHEN (pr_id + i) % 5 = 0 THEN ''
             WHEN (pr_id + i) % 5 = 1 THEN concat('"issue_number":"', {number}, '",')
             WHEN (pr_id + i) % 29 = 0 THEN '"issue_number":"none",'
             WHEN (pr_id + i) % 31 = 0 THEN '"issue_number":1,'
             ELSE {named} END,
        CASE WHEN (pr_id + i) % 7 = 0 THEN '' ELSE concat('"explanation":"  why ', {number}, ' ",') END,
        '"severity":"', CASE (pr_id + i) % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Low' WHEN 2 THEN ' ' ELSE 'Critical' END, '",',
        CASE WHEN (pr_id + i) % 3 = 0 THEN '"recommended_fix":null,'
             WHEN (pr_id + i) % 3 = 1 THEN '"recommended_fix":12,'
             ELSE '"recommended_fix":"check it",' END,
        '"fixed_code":"', CASE WHEN (pr_id + i) % 2 = 0 THEN '' ELSE 'y = 1' END, '"}}') END"""


def whole_response(joined: str) -> str:
    """Answer as a bare array, fenced, an object, prose, or followed by more brackets."""
    array = f"concat('[', {joined}, ']')"
    fence = "concat(chr(96), chr(96), chr(96))"
    return f"""CASE pr_id % 6
      WHEN 0 THEN {array}
      WHEN 1 THEN concat({fence}, 'json', chr(10), {array}, chr(10), {fence}, ' ', chr(10))
      WHEN 2 THEN concat('Here it is: ', {array}, ' done')
      WHEN 3 THEN '{{"explanation":"one"}}'
      WHEN 4 THEN concat(chr(10), '  ', {array})
      ELSE CASE WHEN pr_id % 4 = 1 THEN concat({array}, ' and [2]') ELSE 'nothing to add' END END"""
