"""Chat formatting of reply trees.

Messages form trees: each names the message it replies to. A path from a root to
a leaf is one conversation. All paths are listed by self-joins that double their
reach: after round ``r`` each message knows its ancestor 2^r steps up and each
leaf its ancestors less than 2^r steps away, so a chain of n messages takes
log2(n) rounds and no more rows than the paths have messages. Branches are
ranked by the sum of their messages' scores, and the chosen ones are written out:

    ### role: text</turn>

one such line for each turn. Inside roles and texts ``\\``, ``#``, ``<`` and
``:`` (in roles) are written ``\\\\``, ``\\h``, ``\\l`` and ``\\c``, so neither mark
can appear there and reading back gives the very same roles and texts. The loss
mask lists where the assistant's texts stand in the formatted text.

Defined results: null texts count as empty and null roles as the empty role; a
message whose parent is null or absent is a root; messages on a cycle have no
root and belong to no path; equal scores are ranked by the leaf's id; an empty
table gives no rows. A formatted path is one value, so it must fit into memory;
nothing else is gathered by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdlens.session import materialize

# The template's marks.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"


def escaped(text: Column) -> Column:
    for plain, code in (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    """Doubled backslashes are cut out first, so that what follows them is not taken for a code."""

    def plain(part):
        for code, mark in (("\\l", "<"), ("\\h", "#"), ("\\c", ":")):
            part = F.replace(part, F.lit(code), F.lit(mark))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(":"), F.lit("\\c"))


def root_paths(nodes: DataFrame) -> DataFrame:
    """``(leaf, node, up)``: every message on the path of every leaf, ``up`` steps above it.

    ``nodes`` has ``node`` (unique) and ``parent``.
    """
    known = nodes.select(F.col("node").alias("parent"))
    linked = nodes.where("parent IS NOT NULL").join(known, "parent").select("node", F.col("parent").alias("above"))
    jumps = materialize(linked, "chat-jumps")
    leaves = nodes.select("node").join(linked.select(F.col("above").alias("node")), "node", "left_anti")
    zero = F.lit(0).cast("bigint")
    reached = materialize(leaves.select(F.col("node").alias("leaf"), "node", zero.alias("up")), "chat-paths")
    step, links, most = 1, linked.count(), None
    while links:
        # Longer reach for leaves, then for all messages.
        further = reached.join(jumps, "node").select("leaf", F.col("above").alias("node"), (F.col("up") + step).alias("up"))
        reached = materialize(reached.unionByName(further), "chat-paths")
        doubled = jumps.select(F.col("node").alias("low"), F.col("above").alias("node")).join(jumps, "node")
        jumps = materialize(doubled.select(F.col("low").alias("node"), "above"), "chat-jumps")
        step, most, links = step * 2, links, jumps.count()
        if links == most:
            break  # only messages on cycles are left
    return reached


def chat_paths(
    messages: DataFrame, node: str = "node", parent: str = "parent", role: str = "role", text: str = "text",
    score: str | None = None, best: int | None = 1, assistant: str = "assistant",
) -> DataFrame:
    """``(root, leaf, rank, score, n_turns, formatted, mask)`` of each chosen path.

    ``best`` branches of a root are chosen, all if it is None. ``mask`` lists
    (start, length) of the assistant's texts in ``formatted``, from 0, in code points.
    """
    value = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    rows = messages.select(
        F.col(node).alias("node"), F.col(parent).alias("parent"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), value.alias("score"),
    )
    paths = root_paths(rows.select("node", "parent"))
    # Paths without their texts first, so that only the chosen ones carry them.
    scored = paths.join(rows.select("node", "score"), "node").groupBy("leaf").agg(
        F.max("up").alias("depth"), F.max_by("node", "up").alias("root"), F.sum("score").alias("score")
    )
    # A branch that ends in a message on a cycle above it never reaches a root.
    known = rows.select("node")
    roots = rows.select("node", "parent").join(
        known.withColumnRenamed("node", "parent").withColumn("has", F.lit(True)), "parent", "left"
    ).where("has IS NULL").select(F.col("node").alias("root"))
    scored = scored.join(roots, "root", "left_semi")
    chosen = _best(scored, best)
    shown = paths.join(chosen, "leaf").join(rows.drop("score", "parent"), "node")
    turn = F.struct(
        (F.col("depth") - F.col("up")).alias("turn"), "role", "text"
    )
    turns = shown.groupBy("root", "leaf", "rank", "score").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), escaped_role(t["role"]), F.lit(MIDDLE))
    parts = F.transform(
        "turns",
        lambda t: F.struct(head(t).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == assistant).alias("learn")),
    )
    laid = turns.select("root", "leaf", "rank", "score", F.size("turns").cast("bigint").alias("n_turns"), parts.alias("p"))
    start = F.aggregate(
        "p",
        F.struct(F.lit(0).cast("bigint").alias("end"), F.array().cast("array<struct<start: bigint, length: bigint>>").alias("mask")),
        lambda s, t: F.struct(
            (s["end"] + F.char_length(t["head"]) + F.char_length(t["body"]) + len(CLOSE)).alias("end"),
            F.when(
                t["learn"],
                F.array_append(
                    s["mask"],
                    F.struct(
                        (s["end"] + F.char_length(t["head"])).alias("start"),
                        F.char_length(t["body"]).cast("bigint").alias("length"),
                    ),
                ),
            ).otherwise(s["mask"]).alias("mask"),
        ),
    )["mask"]
    text_out = F.array_join(F.transform("p", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    return laid.select("root", "leaf", "rank", "score", "n_turns", text_out.alias("formatted"), start.alias("mask"))


def _best(scored: DataFrame, best: int | None) -> DataFrame:
    """The first ``best`` branches of each root, by score and then by leaf."""
    order = F.struct((-F.col("score")).alias("low"), "leaf")
    if best == 1:
        top = scored.groupBy("root").agg(F.min_by(F.struct("leaf", "depth", "score"), order).alias("b"))
        return top.select("root", "b.*", F.lit(1).cast("bigint").alias("rank"))
    # Ranks by one range sort: place among all branches less that of the root's first.
    from herdlens.operators.skew import numbered

    placed = numbered(scored, ["root", F.desc("score"), "leaf"], "at")
    first = placed.groupBy("root").agg(F.min("at").alias("first"))
    ranked = placed.join(first, "root").withColumn("rank", F.col("at") - F.col("first") + 1)
    ranked = ranked.select("root", "leaf", "depth", "score", "rank")
    return ranked if best is None else ranked.where(F.col("rank") <= best)


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted path, unescaped."""
    lines = F.split(formatted, CLOSE)
    turns = F.slice(lines, 1, F.size(lines) - 1)

    def turn(line):
        at = F.instr(line, MIDDLE)
        return F.struct(
            unescaped(F.substring(line, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"),
            unescaped(F.substring(line, at + len(MIDDLE), F.char_length(line))).alias("text"),
        )

    return F.transform(turns, turn)


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, one span after another."""
    return F.array_join(
        F.transform(mask, lambda m: unescaped(F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))), ""
    )


def linear_replies(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Conversations stored as numbered rows, as trees in which each row replies to the one before.

    Adds ``node`` and ``parent``; rows of equal conversation and turn follow each
    other by role and text. Null conversations are one conversation.
    """
    from herdlens.operators.skew import numbered

    placed = numbered(turns, [F.asc_nulls_first(conv), F.asc_nulls_first(turn), "role", "text"], "node")
    before = placed.select((F.col("node") + 1).alias("node"), F.col(conv).alias("before_conv"), F.col("node").alias("at"))
    same = F.col("at").isNotNull() & F.col(conv).eqNullSafe(F.col("before_conv"))
    linked = placed.join(before, "node", "left")
    return linked.withColumn("parent", F.when(same, F.col("at"))).drop("before_conv", "at")
