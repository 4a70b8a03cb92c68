"""Chat formatting of reply trees, in DataFrame functions only.

Iterative self-joins follow the replies upwards, twice as far in every round: after round k each
message knows the one 2^k above it and the score of what lies between, so that all root-to-leaf
paths, one for each leaf, are known after as many rounds as the deepest path has binary digits.  Paths
are ranked within their tree by the sum of their scores.  The same jumps, largest first, then list the
messages of the chosen paths, and each path becomes one conversation.  Only keys and scores take
part in these joins; texts move when they are put together.

The template marks a turn as ``<|im_start|>role<|im_sep|>text<|im_end|>``.  A ``\\`` is put after every ``<``
and ``[`` of roles and texts, so that no control string (``<|...|>``, ``<s>``, ``</s>``, ``[INST]``,
``[/INST]``) can stand there, and taken out again when the output is read back.  The loss mask lists
the texts of assistant turns as spans of bytes of the UTF-8 output.

Defined cases: null texts and roles are empty; empty texts stay as turns; rows without tree make up one tree;
a row without id of its own is known by its role and text and cannot be replied to; rows of one id are turns at the same place, in the order of role
and text, so repeated rows come repeatedly (the smallest parent and the largest score count); a parent that is not in the tree, or the message itself, counts as none; null scores are 0,
equal ones are decided by length, then id of the leaf; messages in or below a circle of replies belong to no
path; turns of a conversation without number come last; an empty table stays empty; other columns are
not read.  A conversation becomes one row, so its text has to fit into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.joins import lookup_join
from ..session import sized, stage

START, BETWEEN, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
OPENING = ("<", "[")       # control strings begin with these
BREAK = "\\"               # put after them
LEARNT = "assistant"


def escaped(text: Column) -> Column:
    for opening in OPENING:
        text = F.replace(text, F.lit(opening), F.lit(opening + BREAK))
    return text


def unescaped(text: Column) -> Column:
    for opening in OPENING:
        text = F.replace(text, F.lit(opening + BREAK), F.lit(opening))
    return text


def key_of(tree: Column, node: Column) -> Column:
    """One text per message, also of the tree without id."""
    return F.to_json(F.struct(tree.alias("t"), node.alias("n")))


def climbed(rows: DataFrame, jump: DataFrame) -> DataFrame:
    """``rows`` joined on ``up`` to ``jump``, which has one row per key; rows that have arrived stay where they are."""
    going = rows.filter("up is not null")
    met = lookup_join(going, jump, going.groupBy("up").agg(F.count(F.lit(1)).alias("_rows")), "up", "left")
    return met.unionByName(rows.filter("up is null"), allowMissingColumns=True)


def jumps(replies: DataFrame) -> list[DataFrame]:
    """Tables (key, tree, up, total, steps), table k with the ancestor 2^k above and what lies up to there.

    The last one reaches the root from every message, but for circles, whose messages keep an ancestor.
    """
    known = (replies.select("tree", "node", key_of(F.col("tree"), F.col("node")).alias("key"), F.col("score").cast("double").alias("score"),
                            F.when(F.col("parent") != F.col("node"), key_of(F.col("tree"), F.col("parent"))).alias("up"))
             .groupBy("key").agg(F.first("tree").alias("tree"), F.min("up").alias("up"), F.coalesce(F.max("score"), F.lit(0.0)).alias("total")))
    known = stage(known.withColumn("steps", F.lit(1)), "replies")
    there = known.select(F.col("key").alias("up"), F.lit(True).alias("_there"))
    level = stage(climbed(known, there).select("key", "tree", F.when(F.col("_there"), F.col("up")).alias("up"), "total", "steps"), "jumps-0")
    out, nodes = [level], level.count()
    while not level.filter("up is not null").isEmpty() and 1 << (len(out) - 1) <= nodes:
        above = level.select(F.col("key").alias("up"), F.col("up").alias("_up"), F.col("total").alias("_total"), F.col("steps").alias("_steps"))
        level = stage(climbed(level, above).select(
            "key", "tree", F.col("_up").alias("up"), (F.col("total") + F.coalesce("_total", F.lit(0.0))).alias("total"),
            (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps")), f"jumps-{len(out)}")
        out.append(level)
    return out


def reply_paths(replies: DataFrame, best: int | None = None) -> DataFrame:
    """The messages of root-to-leaf paths of ``replies`` (tree, node, parent, score): (key, tree, path, place).

    ``path`` is the key of the leaf, ``place`` counts from the root.  Of each tree the ``best`` paths are chosen, or all.
    """
    levels = jumps(replies)
    parents = levels[0].filter("up is not null").select(F.col("up").alias("key")).distinct()
    leaves = levels[-1].filter("up is null").join(parents, "key", "left_anti")
    if best is not None:
        order = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("steps"), "key")
        leaves = leaves.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= best)
    rows = stage(leaves.select("key", "tree", F.col("key").alias("path"), F.col("steps").alias("place")), "leaves")
    for k in reversed(range(len(levels) - 1)):
        jump = levels[k].filter("up is not null").select(F.col("key").alias("up"), F.col("up").alias("_up"))
        here = F.struct("key", "place")
        above = F.struct(F.col("_up").alias("key"), (F.col("place") - (1 << k)).alias("place"))
        rows = stage(climbed(rows.withColumn("up", F.col("key")), jump)
                     .select("tree", "path", F.inline(F.when(F.col("_up").isNull(), F.array(here)).otherwise(F.array(here, above)))), "paths")
    return rows.select("key", "tree", "path", "place")


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """Each path as one conversation: (tree, path, formatted, loss_mask); ``messages`` has key, role and text."""
    own = messages.select("key", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    along = Window.partitionBy("tree", "path").orderBy("place", "role", "text")
    before = F.concat(F.lit(START), escaped(F.col("role")), F.lit(BETWEEN))
    body = escaped(F.col("text"))
    turns = (own.join(sized(paths), "key")
             .withColumn("_k", F.row_number().over(along))
             .withColumn("_head", before).withColumn("_body", body)
             .withColumn("_bytes", F.octet_length("_head") + F.octet_length("_body") + F.octet_length(F.lit(END)))
             .withColumn("_upto", F.sum("_bytes").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    start = F.col("_upto") - F.col("_bytes") + F.octet_length("_head")
    span = F.when(F.col("role") == LEARNT, F.struct(start.alias("start"), F.octet_length("_body").cast("long").alias("length")))
    turn = F.struct("_k", F.concat("_head", "_body", F.lit(END)).alias("text"), span.alias("span"))
    return (turns.groupBy("tree", "path").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
            .select("tree", "path", F.array_join("_turns.text", "").alias("formatted"),
                    F.filter("_turns.span", lambda s: s.isNotNull()).alias("loss_mask")))


def format_trees(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """The best paths of reply trees as conversations; ``messages`` has tree, node, parent, role, text and score."""
    own = F.sha2(F.to_json(F.struct("parent", "role", "text")), 256)
    named = messages.select(
        "tree", F.coalesce(F.concat(F.lit("="), F.col("node").cast("string")), own).alias("node"),
        F.concat(F.lit("="), F.col("parent").cast("string")).alias("parent"), "role", "text", "score")
    paths = reply_paths(named.select("tree", "node", "parent", "score"), best)
    return format_paths(named.select(key_of(F.col("tree"), F.col("node")).alias("key"), "role", "text"), paths)


def turn_id() -> Column:
    """What a turn is known by in its conversation: its number, role and text."""
    return F.concat_ws(":", F.col("turn").cast("string"), F.substring(F.sha2(F.to_json(F.struct("role", "text")), 256), 1, 24))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as conversations: every turn replies to the one before."""
    named = conversations.select(F.col("conv_id").alias("tree"), "turn", turn_id().alias("node"), "role", "text")
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_last(), "node")
    chain = (named.select("tree", "turn", "node").distinct()
             .select("tree", "node", F.lag("node").over(order).alias("parent"), F.lit(0.0).alias("score")))
    return format_paths(named.select(key_of(F.col("tree"), F.col("node")).alias("key"), "role", "text"), reply_paths(chain, 1))


def read_back(formatted: DataFrame) -> DataFrame:
    """What the output says: (tree, path, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""
    pieces = F.split("formatted", END.replace("|", r"\|"))
    turns = F.slice(pieces, 1, F.size(pieces) - 1)
    role = lambda t: F.substring(F.substring_index(t, BETWEEN, 1), len(START) + 1, 2 ** 31 - 1)
    plain = F.transform("_turns", lambda t: F.concat(unescaped(role(t)), F.lit("\n"), unescaped(F.substring_index(t, BETWEEN, -1)), F.lit("\n")))
    span = lambda s: F.substring(F.col("formatted").cast("binary"), (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string")
    return (formatted.withColumn("_turns", turns).withColumn("_loss", unescaped(F.array_join(F.transform("loss_mask", span), "")))
            .select("tree", "path", F.size("_turns").cast("long").alias("n_turns"),
                    F.sha2(F.array_join(plain, "").cast("binary"), 256).alias("turns_sha256"),
                    F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars")))


def chat_digests(conversations: DataFrame) -> DataFrame:
    """Digest of the formatting: one row per conversation, read back from the written output."""
    written = stage(format_conversations(conversations), "chats")
    return read_back(written).withColumnRenamed("tree", "conv_id").drop("path")
