"""Chat formatting of reply trees (operator 5). DataFrame functions only.

Messages point to the message they answer. Self-joins that double their reach find for
every message the root of its tree, its depth and the summed score of its path, in a
number of joins that grows with the logarithm of the depth. Leaves of a tree are ranked by
the mean score of their paths; the messages of the chosen paths are marked by walking the
same joins from the leaves up. Each chosen path becomes one conversation.

The template marks turns by control strings. Texts may contain anything: the four
characters that begin or end a control string or an escape are escaped, so a control string in
the output is always the template's. The loss mask is a list of spans, in code points of
the output, one for the text of each assistant turn.

Defined results: a null text is empty, a null role has the empty name; messages whose
parent is null or missing are roots; messages that point at each other in a circle belong
to no tree and are left out; a message that is there twice counts once; ties of paths go to
the smaller leaf; an empty table gives no conversations; other columns are left out.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffmill.sources.staging import staged

#: Escapes, in the order of escaping.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&#91;")]
#: Before and after the text, by role; other roles are named in the mark.
USER, ASSISTANT = ("[INST]", "[/INST]"), ("<s>", "</s>")
OTHER = ("<<", ">>", "<</>>")
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescaped(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), text)


def _by_role(role: Column, user: str, assistant: str, other: Column) -> Column:
    return F.when(role == "user", user).when(role == LOSS_ROLE, assistant).otherwise(other)


def formatted(turns: DataFrame) -> DataFrame:
    """``conv_id, root, leaf, formatted, loss_spans`` from a row per turn: ``conv_id, root,
    leaf, depth, role, text``. Places are a running sum over the turns, so the work is in proportion to
    them."""
    own, role = ["conv_id", "root", "leaf"], F.col("role")
    pieces = turns.select(
        *own,
        "depth",
        _by_role(role, USER[0], ASSISTANT[0], F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1]))).alias("head"),
        escaped(F.col("text")).alias("body"),
        _by_role(role, USER[1], ASSISTANT[1], F.lit(OTHER[2])).alias("tail"),
        (role == LOSS_ROLE).alias("loss"),
    )
    before = Window.partitionBy(*own).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + F.length("tail")
    placed = pieces.withColumn("start", (F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head")).cast("int"))
    turn = F.struct("depth", F.concat("head", "body", "tail").alias("turn"), "loss", "start", F.length("body").alias("length"))
    whole = placed.groupBy(*own).agg(F.sort_array(F.collect_list(turn)).alias("all"))
    spans = F.transform(F.filter("all", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return whole.select(
        *own, F.array_join(F.transform("all", lambda t: t["turn"]), "").alias("formatted"), spans.alias("loss_spans")
    )


#: Code points of a block that a text is cut into to find spans in it.
_BLOCK = 1024


def _cut(text: Column, spans: Column) -> Column:
    """The spans of a text. A search from its beginning for each would cost the square of
    a long text; each span looks into its own blocks alone."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))

    def all_spans(blocks: Column) -> Column:
        def one(s: Column) -> Column:
            first = F.floor(s["start"] / _BLOCK).cast("int")
            count = (F.floor((s["start"] + s["length"]) / _BLOCK) - first + 1).cast("int")
            near = F.array_join(F.slice(blocks, first + 1, count), "")
            return F.substring(near, s["start"] - first * _BLOCK + 1, s["length"])

        return F.transform(spans, one)

    # the blocks are formed once for all spans
    return F.get(F.transform(F.array(blocks), all_spans), F.lit(0))


def parsed(output: DataFrame) -> DataFrame:
    """Reads ``formatted`` back: adds ``turns`` and ``loss_text``, both unescaped."""
    mark = r"(\[INST\][^\[<]*\[/INST\]|<s>[^\[<]*</s>|<<[^\[<>]*>>[^\[<]*<</>>)"
    turns = F.regexp_extract_all("formatted", F.lit(mark), F.lit(1))

    def turn(t: Column) -> Column:
        user, assistant = t.startswith(USER[0]), t.startswith(ASSISTANT[0])
        named = F.regexp_extract(t, r"(?s)^<<(.*?)>>", 1)
        body = F.regexp_extract(t, r"(?s)^(?:\[INST\]|<s>|<<.*?>>)(.*?)(?:\[/INST\]|</s>|<</>>)$", 1)
        return F.struct(
            F.when(user, "user").when(assistant, LOSS_ROLE).otherwise(unescaped(named)).alias("role"),
            unescaped(body).alias("text"),
        )

    spans = _cut(F.col("formatted"), F.col("loss_spans"))
    return output.withColumn("turns", F.transform(turns, turn)).withColumn(
        "loss_text", unescaped(F.array_join(spans, ""))
    )


def reach(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Messages with ``root``, ``depth`` and the summed ``path_score``, and the tables
    ``node, up`` of the ancestors at 1, 2, 4, 8, … steps.

    ``messages``: ``node, parent, score`` with distinct nodes. The loop ends when no message
    has further ancestors, or, for circles, once a path would be longer than there are
    messages.
    """
    ids = messages.select(F.col("node").alias("parent"))
    answers = messages.filter(F.col("parent").isNotNull())
    there = answers.join(ids, "parent", "left_semi").withColumn("up", F.col("parent"))
    missing = answers.join(ids, "parent", "left_anti").unionByName(messages.filter(F.col("parent").isNull()))
    state = staged(
        there.unionByName(missing.withColumn("up", F.lit(None).cast(messages.schema["node"].dataType))).select(
            "node",
            "up",
            F.coalesce("score", F.lit(0.0)).alias("path_score"),
            F.lit(1).cast("bigint").alias("depth"),
            F.col("node").alias("root"),
        ),
        "reply-reach",
    )
    steps = []
    for _ in range(state.count().bit_length() + 1):
        if state.filter(F.col("up").isNotNull()).isEmpty():
            break
        steps.append(state.filter(F.col("up").isNotNull()).select("node", "up"))
        above = state.select(
            F.col("node").alias("up"),
            F.col("up").alias("next"),
            F.col("path_score").alias("more"),
            F.col("depth").alias("steps"),
            F.col("root").alias("above"),
        )
        # only those on their way are joined
        climbed = state.filter(F.col("up").isNotNull()).join(above, "up").select(
            "node",
            F.col("next").alias("up"),
            (F.col("path_score") + F.col("more")).alias("path_score"),
            (F.col("depth") + F.col("steps")).alias("depth"),
            F.col("above").alias("root"),
        )
        state = staged(state.filter(F.col("up").isNull()).select(climbed.columns).unionByName(climbed), "reply-reach")
    return state.filter(F.col("up").isNull()).drop("up"), steps


def best_paths(messages: DataFrame, paths: int = 1) -> DataFrame:
    """``root, leaf, node, depth`` for the messages on the ``paths`` best paths of every
    tree. Leaves rank by the mean score of their path, then by the smaller leaf."""
    placed, steps = reach(messages)
    inner = messages.select(F.col("parent").alias("node")).distinct()
    leaves = placed.join(inner, "node", "left_anti")
    mean = F.col("path_score") / F.col("depth")
    if paths == 1:
        # one row per tree by aggregation: no tree is gathered in a task
        top = leaves.groupBy("root").agg(F.max(mean).alias("top"))
        best = leaves.join(top, "root").filter(mean == F.col("top")).groupBy("root").agg(F.min("node").alias("leaf"))
    else:
        rank = F.row_number().over(Window.partitionBy("root").orderBy(mean.desc(), "node"))
        best = leaves.withColumn("rank", rank).filter(F.col("rank") <= paths).select("root", F.col("node").alias("leaf"))
    marked = best.select("leaf", F.col("leaf").alias("node"))
    for up in reversed(steps):
        marked = staged(
            marked.unionByName(marked.join(up, "node").select("leaf", F.col("up").alias("node"))).distinct(),
            "reply-marks",
        )
    return marked.join(placed.select("node", "root", "depth"), "node").select("root", "leaf", "node", "depth")


def chats(messages: DataFrame, paths: int = 1) -> DataFrame:
    """Conversations of the best paths: ``conv_id, root, leaf, formatted, loss_spans``.

    ``messages``: ``conv_id, node, parent, role, text, score``.
    """
    distinct = messages.dropDuplicates(["node"])
    chosen = best_paths(distinct.select("node", "parent", "score"), paths)
    rows = chosen.join(distinct.select("node", "conv_id", "role", "text"), "node")
    return formatted(
        rows.select(
            "conv_id", "root", "leaf", "depth",
            F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        )
    )


def as_trees(conversations: DataFrame) -> DataFrame:
    """Messages of plain conversations: each answers the turn before it.

    The turns of a conversation get their number by a window per conversation, which a
    formatted conversation needs in one row anyway. Equal turns are kept apart.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    name = lambda n: F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.lpad(n.cast("string"), 12, "0"))
    numbered = conversations.select("conv_id", "turn", "role", "text").withColumn("number", F.row_number().over(order))
    return numbered.select(
        "conv_id",
        name(F.col("number")).alias("node"),
        F.when(F.col("number") > 1, name(F.col("number") - 1)).alias("parent"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


def checked(output: DataFrame) -> DataFrame:
    """Digests of conversations, read back from the formatted texts."""
    back = parsed(output)
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
