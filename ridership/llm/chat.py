"""Chat formatting (operator 3): reply trees, their best root-to-leaf paths, one formatted conversation per path.

Only DataFrame functions. Messages are (tree, msg, parent, role, text, score). Iterative self-joins on the ids alone
double the reach of each message's link to its ancestors, with the score summed on the way, so a path of n messages
takes log2(n) joins. Leaves are ranked in their tree by the summed score; the chosen ones are expanded to their
messages by the same links from far to near, each ancestor once. Texts join last.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. In roles and texts one backslash more is put between
``<`` and ``|`` wherever only backslashes stand between them, so no control string is left and taking one away gives
the text back; a line break in a role becomes ``<|nl|>``. ``loss`` lists (start, length) in code points of the texts of
assistant turns.

Defined cases: NULL text or role is empty; a message whose parent is NULL or missing is a root; messages that reach no
root (a cycle of parents) are on no path; ties of score go to the smaller message id; repeated turns of a conversation
are turns each; a NULL ``conv_id`` is one conversation; empty tables give no rows; other columns are ignored. A conversation is one row by
definition, so it must fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridership.session import stage

START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
NO_ID = -(2**63) + 1  # stands for a NULL conv_id


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def best_paths(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """The ``per_tree`` best root-to-leaf paths of each tree: (tree, path, score, msg, from_end)."""
    own = stage(messages.select("tree", "msg", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "messages")
    ids = own.select("tree", F.col("msg").alias("parent"))
    linked = own.join(ids, ["tree", "parent"], "left_semi").select("tree", "msg", F.col("parent").alias("up"))
    total = own.count()
    # links[k]: the ancestor 2^k above; sums: the score of the message and its next 2^k - 1 ancestors
    links, sums = [stage(linked, "links")], own.select("tree", "msg", "score")
    while not links[-1].isEmpty() and 2 ** (len(links) - 1) <= total:
        up = links[-1]
        further = sums.select("tree", F.col("msg").alias("up"), F.col("score").alias("_more"))
        sums = stage(
            sums.join(up, ["tree", "msg"], "left")
            .join(further, ["tree", "up"], "left")
            .select("tree", "msg", (F.col("score") + F.coalesce("_more", F.lit(0.0))).alias("score")),
            "sums",
        )
        over = up.select("tree", F.col("msg").alias("up"), F.col("up").alias("_over"))
        links.append(stage(up.join(over, ["tree", "up"]).select("tree", "msg", F.col("_over").alias("up")), "links"))
    leaves = sums.join(linked.select("tree", F.col("up").alias("msg")), ["tree", "msg"], "left_anti")
    rank = Window.partitionBy("tree").orderBy(F.desc("score"), "msg")
    paths = leaves.withColumn("path", F.row_number().over(rank)).filter(F.col("path") <= per_tree)
    nodes = paths.select("tree", "path", "score", "msg", F.lit(0).cast("long").alias("from_end"))
    for k in range(len(links) - 1, -1, -1):
        higher = nodes.join(links[k], ["tree", "msg"]).select("tree", "path", "score", F.col("up").alias("msg"), (F.col("from_end") + 2**k).alias("from_end"))
        nodes = stage(nodes.unionByName(higher), "paths")
    return nodes


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per path: tree, path, score, formatted, loss (start, length)."""
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit(BREAK))
    turns = paths.join(messages.select("tree", "msg", "role", "text"), ["tree", "msg"]).select(
        "tree", "path", "score", "from_end",
        (F.coalesce("role", F.lit("")) == "assistant").alias("_learned"),
        F.concat(F.lit(START), role, F.lit("\n")).alias("_head"),
        escape(F.coalesce("text", F.lit(""))).alias("_text"),
    )
    size = F.length("_head") + F.length("_text") + len(END)
    so_far = Window.partitionBy("tree", "path").orderBy(F.desc("from_end")).rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("_start", F.coalesce(F.sum(size).over(so_far), F.lit(0)) + F.length("_head"))
    turn = F.struct(
        (-F.col("from_end")).alias("at"),
        F.concat("_head", "_text", F.lit(END)).alias("text"),
        F.col("_learned").alias("learned"),
        F.struct(F.col("_start").cast("long").alias("start"), F.length("_text").cast("long").alias("length")).alias("span"),
    )
    one = placed.groupBy("tree", "path").agg(F.first("score").alias("score"), F.array_sort(F.collect_list(turn)).alias("_turns"))
    return one.select(
        "tree", "path", "score",
        F.concat_ws("", F.col("_turns.text")).alias("formatted"),
        F.transform(F.filter("_turns", lambda t: t["learned"]), lambda t: t["span"]).alias("loss"),
    )


def format_trees(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """Rank the branches of each reply tree and format the best ones."""
    return format_paths(messages, best_paths(messages, per_tree))


def turns_as_messages(conversations: DataFrame) -> DataFrame:
    """Plain conversations (conv_id, turn, role, text) as trees with one branch each."""
    order = Window.partitionBy("tree").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("tree"), "turn", "role", "text")
    numbered = rows.withColumn("msg", F.row_number().over(order).cast("long"))
    return numbered.select("tree", "msg", F.expr("nullif(msg - 1, 0)").alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and learned text as a reader of the formatted text sees them, escapes undone.

    Columns: tree, path, turns (role, text), learned, formatted.
    """
    parts = F.split("formatted", r"<\|im_end\|>\n")
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(p: Column) -> Column:
        role = F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)
        text = F.substr(p, F.length(role) + len(START) + 2)
        return F.struct(unescape(F.replace(role, F.lit(BREAK), F.lit("\n"))).alias("role"), unescape(text).alias("text"))

    learned = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("tree", "path", F.transform(parts, turn).alias("turns"), F.array_join(learned, "").alias("learned"), "formatted")
