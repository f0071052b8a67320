"""Chat formatting: reply trees to formatted conversations.

Messages name their parents.  Iterative self-joins double the reach of every
message's pointer to its ancestors, so a tree of depth d takes log2(d) rounds,
each a join on (tree, message).  Leaves are ranked by the score of their branch,
and the chosen root-to-leaf paths are spelled out by the same pointers, longest
hop first: one row per message of a chosen path and no other.

Template: every turn is ``<|turn|>role<|text|>text<|end|>``.  Inside roles and
texts a backslash is doubled and each control string gets a backslash behind its
first character, so no control string is left in them and the reading is exact.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of this template and of others: none of them survives inside a text.
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
           "<|endoftext|>", "<|eot_id|>", "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>")
_BEHIND_FIRST = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL)
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _BEHIND_FIRST, "\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chain(turns: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as reply trees: each turn answers the one before it.

    Turns are ordered by number, then role and text; a missing number comes first.  Repeated rows stay turns of their own.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = turns.select(F.col(tree).alias("tree"), F.col(turn).alias("turn"), F.col(role).alias("role"),
                        F.col(text).alias("text"), F.lit(0.0).alias("score"))
    rows = rows.withColumn("message", F.row_number().over(order).cast("long"))
    return rows.select("tree", "message", F.when(F.col("message") > 1, F.col("message") - 1).alias("parent"), "role", "text", "score")


def paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """``tree, leaf, branch, depth, role, text``: the messages of every chosen root-to-leaf path.

    ``messages``: tree, message, parent, role, text, score.  ``branch`` ranks the leaves of a tree by the mean score
    along their path, best first, ties by leaf; ``best`` keeps the first so many (all by default).  A missing score
    counts as 0.  A message whose parent is missing or unknown is a root.  Of rows with one id the first by role and text
    counts.  Messages on a cycle, or below one, are on no path from a root and are not returned.
    """
    one = Window.partitionBy("tree", "message").orderBy(F.col("score").desc(), "role", "text")
    kept = (messages.select("tree", "message", "parent", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
            .withColumn("__n", F.row_number().over(one)).filter("__n = 1").drop("__n"))
    kept = cut(kept.withColumn("tree_key", F.coalesce(F.col("tree").cast("string"), F.lit("\x00none"))), "messages")
    known = kept.select("tree_key", F.col("message").alias("parent"), F.lit(True).alias("known"))
    reach = cut(kept.select("tree_key", "message", "parent", "score").join(known, ["tree_key", "parent"], "left")
                .select("tree_key", "message", F.when(F.col("known"), F.col("parent")).alias("up"), F.col("score").alias("sum"),
                        F.lit(1).cast("long").alias("n")), "reach")
    open_, rooted, hops, size = reach.filter("up IS NOT NULL"), reach.filter("up IS NULL"), [], kept.count()
    while not open_.isEmpty() and 2 ** len(hops) < 2 * size:  # only messages that have not reached a root go on
        hops.append(open_.select("tree_key", F.col("message").alias("at"), F.col("up").alias("to")))
        above = open_.union(rooted).select("tree_key", F.col("message").alias("up"), F.col("up").alias("next"),
                                           F.col("sum").alias("s"), F.col("n").alias("m"))
        reach = cut(open_.join(above, ["tree_key", "up"]).select(
            "tree_key", "message", F.col("next").alias("up"), (F.col("sum") + F.col("s")).alias("sum"),
            (F.col("n") + F.col("m")).alias("n")), "reach")
        open_, rooted = reach.filter("up IS NOT NULL"), rooted.union(reach.filter("up IS NULL"))
    parents = kept.select("tree_key", F.col("parent").alias("message")).filter("message IS NOT NULL").distinct()
    leaves = rooted.join(parents, ["tree_key", "message"], "left_anti")
    ranked = leaves.withColumn("branch", F.row_number().over(
        Window.partitionBy("tree_key").orderBy((F.col("sum") / F.col("n")).desc(), "message")))
    if best is not None:
        ranked = ranked.filter(F.col("branch") <= best)
    walk = ranked.select("tree_key", F.col("message").alias("leaf"), "branch", "n", F.col("message").alias("at"), F.lit(0).cast("long").alias("back"))
    for k in reversed(range(len(hops))):
        both = F.array(F.struct("at", "back"), F.struct(F.col("to").alias("at"), (F.col("back") + 2**k).alias("back")))
        here = F.when(F.col("to").isNull(), F.slice(both, 1, 1)).otherwise(both)
        walk = (walk.join(hops[k], ["tree_key", "at"], "left").withColumn("both", here)
                .select("tree_key", "leaf", "branch", "n", F.explode("both").alias("p"))
                .select("tree_key", "leaf", "branch", "n", "p.at", "p.back"))
    return (walk.join(kept.withColumnRenamed("message", "at"), ["tree_key", "at"])
            .select("tree", "leaf", "branch", (F.col("n") - F.col("back")).alias("depth"), "role", "text"))


def formatted(turns: DataFrame) -> DataFrame:
    """``tree, leaf, branch, n_turns, formatted, loss_spans``: one row per path of ``paths``.

    ``loss_spans`` has (start, length) in code points of ``formatted`` of each assistant text.  Missing roles and texts
    count as empty.  A conversation is one row, so its turns do meet in one place.
    """
    role, text = (escape(F.coalesce(F.col(c), F.lit(""))) for c in ("role", "text"))
    spelt = turns.select("tree", "leaf", "branch", "depth", F.concat(F.lit(TURN), role, F.lit(TEXT)).alias("head"),
                         text.alias("body"), (F.coalesce(F.col("role"), F.lit("")) == LOSS_ROLE).alias("loss"))
    spelt = spelt.withColumn("piece", F.concat("head", "body", F.lit(END)))
    path = Window.partitionBy("tree", "leaf", "branch").orderBy("depth")
    before = F.coalesce(F.sum(F.length("piece")).over(path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = spelt.withColumn("span", F.when(F.col("loss"), F.struct(
        (before + F.length("head") + 1).cast("int").alias("start"), F.length("body").alias("length"))))
    rows = placed.groupBy("tree", "leaf", "branch").agg(
        F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("depth", "piece", "span"))).alias("turns"))
    return rows.select("tree", "leaf", "branch", "n_turns", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
                       F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"))


def read_turns(text: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    turns = F.filter(F.split(text, re.escape(END)), lambda t: t != "")
    plain = F.transform(turns, lambda t: F.split(F.substring(t, len(TURN) + 1, 2**31 - 1), re.escape(TEXT)))
    return F.transform(plain, lambda t: F.struct(unescape(F.get(t, F.lit(0))).alias("role"), unescape(F.get(t, F.lit(1))).alias("text")))


def read_loss(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(text, s["start"], s["length"]))), "")


def control_sql(column: str) -> str:
    """The same escape in SQL text, one replacement per control string."""
    return reduce(lambda sql, c: f"replace({sql}, '{c}', '{c[0]}\\{c[1:]}')", CONTROL, f"replace({column}, '\\', '\\\\')")
