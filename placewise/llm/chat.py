"""Chat formatting of reply trees, in column functions alone.

Messages point at the message they answer.  Self-joins that double their reach
tell every message its root, its depth and the score of the path to it, in a
number of rounds that grows with the logarithm of the depth.  Leaves are ranked
by the mean score of their paths; the chosen paths are walked back by the same
jumps, and each becomes one conversation.

A turn is ``<|im_start|>role``, a line break, its text, ``<|im_end|>`` and a
line break.  Inside texts and roles a backslash is put before a bar that
follows ``<`` and any backslashes, so no control string stands there, and one
is taken away on reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placewise.llm.common import drop_written, written

#: Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
#: Rows of the broadcast table that marks trees with messages on their way; a shared slot only costs a look-up more.
SLOTS = 1 << 20


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _escaped_role(role: Column) -> Column:
    # A role is one line.
    return F.regexp_replace(F.regexp_replace(escaped(role), "~", "~0"), "\n", "~1")


def _unescaped_role(role: Column) -> Column:
    return unescaped(F.regexp_replace(F.regexp_replace(role, "~1", "\n"), "~0", "~"))


def reply_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, rank, node, depth) for the ``branches`` best root-to-leaf paths of every root.

    ``messages`` has tree, node (not null, unique in its tree), parent and
    score.  A message whose parent is missing is a root.  Ties in score go to
    the smaller leaf.  Messages that answer each other in a circle reach no
    root and are on no path.  Null scores count as 0.
    """
    known = messages.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_there"))
    links = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")).join(
        known, ["tree", "parent"], "left"
    )
    # up: the message so many steps above, null beyond the root; steps and score up to it, it left out.
    jumps = written(
        links.select(
            "tree", "node", F.when(F.col("_there"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("steps"), "score"
        ),
        "jumps",
    )
    # A message that has reached its root joins no more; it stays to be looked up by those below it.
    climbing, reached = jumps.where("up IS NOT NULL"), jumps.where("up IS NULL")
    levels, last = [], jumps.count().bit_length() + 1
    slot = lambda: F.pmod(F.xxhash64("tree"), F.lit(SLOTS)).alias("_slot")
    while len(levels) < last and not climbing.isEmpty():
        levels.append(climbing)
        # At most SLOTS rows whatever the input.  Trees without a message on its way are left out unshuffled.
        open_ = F.broadcast(climbing.select(slot()).distinct())
        known = climbing.unionByName(reached).withColumn("_slot", slot()).join(open_, "_slot", "left_semi")
        high = known.select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_s"), F.col("score").alias("_c"))
        further = written(
            climbing.join(high, ["tree", "up"]).select(
                "tree",
                "node",
                F.col("_up").alias("up"),
                (F.col("steps") + F.col("_s")).alias("steps"),
                (F.col("score") + F.col("_c")).alias("score"),
            ),
            "jumps",
        )
        climbing, reached = further.where("up IS NOT NULL"), reached.unionByName(further.where("up IS NULL"))
    reached = reached.select("tree", "node", "steps", "score")
    answered = jumps.where("up IS NOT NULL").select("tree", F.col("up").alias("node")).distinct()
    # The root of a leaf is the least-depth message on its path; trees with one root need no more than their name.
    leaves = reached.join(answered, ["tree", "node"], "left_anti")
    rooted = _with_roots(leaves, levels)
    order = Window.partitionBy("tree", "root").orderBy((F.col("score") / F.col("steps")).desc(), "leaf")
    chosen = (
        rooted.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= branches)
        .select("tree", "leaf", "rank", F.col("leaf").alias("node"), F.col("steps").alias("depth"))
    )
    marked = written(chosen, "marked")
    for k in reversed(range(len(levels))):
        above = levels[k].select("tree", "node", "up")
        more = marked.join(above, ["tree", "node"]).select(
            "tree", "leaf", "rank", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth")
        )
        marked, before = written(marked.unionByName(more), "marked"), marked
        drop_written(before)
    return marked


def _with_roots(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """leaf and root of every path: from the leaf, the largest jumps that stay inside, one level after another."""
    at = leaves.select("tree", F.col("node").alias("leaf"), "steps", "score", F.col("node").alias("root"))
    for jumps in reversed(levels):
        far = jumps.select("tree", F.col("node").alias("root"), "up")
        at = at.join(far, ["tree", "root"], "left").select(
            "tree", "leaf", "steps", "score", F.coalesce("up", "root").alias("root")
        )
    return written(at, "rooted")


def formatted(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, rank, formatted, loss): one conversation per chosen path.

    ``messages`` has tree, node, parent, score, role and text; null roles and
    texts count as empty.  ``loss`` lists start and length, in code points of
    ``formatted``, of every assistant text.
    """
    paths = reply_paths(messages, branches)
    body = messages.select(
        "tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turns = paths.join(body, ["tree", "node"])
    head = F.concat(F.lit(START), _escaped_role(F.col("role")), F.lit("\n"))
    turn = F.struct(
        "depth",
        (F.col("role") == LOSS_ROLE).alias("loss"),
        F.char_length("head").alias("skip"),
        F.char_length("body").alias("chars"),
        F.concat("head", "body", F.lit(END + "\n")).alias("turn"),
    )
    # A conversation is one string, so its turns meet in one row.
    rows = (
        turns.select("tree", "leaf", "rank", "depth", "role", head.alias("head"), escaped(F.col("text")).alias("body"))
        .groupBy("tree", "leaf", "rank")
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    )
    long = lambda c: c.cast("long")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("CAST(array() AS array<struct<start: bigint, length: bigint>>)").alias("spans"))

    def span(a: Column, t: Column) -> Column:
        here = F.struct(long(a["at"] + t["skip"]).alias("start"), long(t["chars"]).alias("length"))
        spans = F.when(t["loss"], F.concat(a["spans"], F.array(here))).otherwise(a["spans"])
        return F.struct(long(a["at"] + F.char_length(t["turn"])).alias("at"), spans.alias("spans"))

    return rows.select(
        "tree",
        "leaf",
        "rank",
        F.array_join("turns.turn", "").alias("formatted"),
        F.aggregate("turns", start, span, lambda a: a["spans"]).alias("loss"),
    )


def read_turns(formatted_: Column) -> Column:
    """Array of (role, text) of a formatted conversation."""
    parts = F.slice(F.split(formatted_, r"<\|im_start\|>", -1), 2, 1 << 30)

    def turn(part: Column) -> Column:
        line = F.instr(part, "\n")
        end = F.char_length(part) - len(END) - 1
        return F.struct(
            _unescaped_role(F.substring(part, F.lit(1), line - 1)).alias("role"),
            unescaped(F.substring(part, line + 1, end - line)).alias("text"),
        )

    return F.transform(parts, turn)


def read_loss(formatted_: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, one after another."""
    cut = lambda s: unescaped(F.substring(formatted_, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.transform(loss, cut), "")


def threads(conversations: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each answers the one before it.

    Turns follow by number, nulls first; rows that tie follow by role and text.
    A null conv_id is a conversation of its own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree"),
        "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        F.lit(0.0).alias("score"),
        "role",
        "text",
    )
