"""Prefix trie of conversations, with subtree figures from an Euler tour.

Rebuilding. Turns are ordered by turn (null first), then role and text; a null role or text is empty. For every
conv_id c (rows without one belong to no conversation) with h = crc32(decimal c) mod 9 and base b = c - c % 5 (SQL
remainder), the rebuilt conversation is the first h turns of b (all if fewer, none if b is absent) followed by c's own
turns after its first h. Each distinct sequence of the first d rebuilt turns is a node of depth d; the root (d = 0) has
no text. Members of a node are the rebuilt conversations that start with it, turnless ones included (root only).

Method. A node is named by (d, sums): each turn is hashed with its position into two 64-bit values, and a prefix's
name is the running sums of their 32-bit halves (exact in 64 bits), so equal sequences have equal names and the
running sums come from one window over a conversation. Grouping member rows by name gives each node's smallest member
(its conv_id, unique among nodes of a depth), counts and ending members. Nodes are then numbered by (depth, parent's
conv_id, conv_id), which puts siblings next to each other. Every node has an enter and an exit arc; enter goes to the
first child's enter or, for a leaf, to its own exit; exit goes to the next sibling's enter or to the parent's exit. The
tour is list-ranked by pointer jumping (`ranking.list_ranked`), carrying two weights on enter arcs: 1 for a leaf and
(n_convs - 1) * UTF-8 bytes of the node's last text. A node's subtree figures are the sums at its enter arc less those
at its exit arc, and its tour positions follow from the steps to the end.

Edges. Null roles and texts are empty; rows with a null conv_id are left out; repeated rows are repeated turns; ties of
turn are ordered by role and text, so equal turns are interchangeable. A conversation without rows but named as a
base is absent. Very long texts are hashed and counted whole. An empty table gives the root alone only if some
conversation exists, else no rows. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from payouts.llm import ranking
from payouts.llm.common import cut

# Fixed values of the rebuilding contract.
FOLD = 5
HEAD = 9
LOW32 = 0xFFFFFFFF
NAME = ["s1", "s2", "s3", "s4"]


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text, length) of the rebuilt conversations; turnless ones have one row with null pos."""
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = Window.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = turns.withColumn("pos", F.row_number().over(own) - 1).drop("turn")
    sizes = turns.groupBy("c").agg(F.count(F.lit(1)).alias("len"))
    convs = sizes.select("c", "len", (F.crc32(F.col("c").cast("string")) % HEAD).alias("h"), (F.col("c") - F.col("c") % FOLD).alias("b"))
    base = sizes.select(F.col("c").alias("b"), F.col("len").alias("len_b"))
    convs = convs.join(base, "b", "left").withColumn("hb", F.least(F.col("h"), F.coalesce(F.col("len_b"), F.lit(0))))
    convs = convs.withColumn("length", F.col("hb") + F.greatest(F.col("len") - F.col("h"), F.lit(0)))
    head = turns.filter(F.col("pos") < HEAD).select(F.col("c").alias("b"), "pos", "role", "text")
    taken = convs.select("c", "b", "h", "length").join(head, "b").filter(F.col("pos") < F.col("h")).select("c", "pos", "role", "text", "length")
    kept = turns.join(convs.select("c", "h", "hb", "length"), "c").filter(F.col("pos") >= F.col("h"))
    kept = kept.select("c", (F.col("pos") - F.col("h") + F.col("hb")).alias("pos"), "role", "text", "length")
    empty = convs.filter(F.col("length") == 0).select("c", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "length")
    return taken.unionByName(kept).unionByName(empty).withColumnRenamed("c", "conv_id")


def nodes(conversations: DataFrame) -> DataFrame:
    """(depth, conv_id, parent_conv_id, n_convs, last_bytes, ends_sha256) of every node of the trie."""
    rows = rebuilt(conversations)
    a = F.xxhash64(F.col("pos"), F.col("role"), F.col("text"))
    b = F.xxhash64(F.col("text"), F.col("pos"), F.col("role"), F.lit("second"))
    halves = [a.bitwiseAND(F.lit(LOW32)), F.shiftrightunsigned(a, 32), b.bitwiseAND(F.lit(LOW32)), F.shiftrightunsigned(b, 32)]
    run = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    turned = rows.filter(F.col("pos").isNotNull()).select(
        "conv_id", "length", (F.col("pos") + 1).alias("depth"), F.octet_length("text").cast("long").alias("last_bytes"),
        *[F.sum(x).over(run).alias(s) for x, s in zip(halves, NAME)])
    roots = rows.select("conv_id", "length").distinct().select(
        "conv_id", "length", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("last_bytes"), *[F.lit(0).cast("long").alias(s) for s in NAME])
    members = turned.unionByName(roots)
    ends = F.when(F.col("length") == F.col("depth"), F.col("conv_id"))
    grouped = members.groupBy("depth", *NAME).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("last_bytes").alias("last_bytes"),
        F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(ends)), lambda x: x.cast("string"))), 256).alias("ends_sha256"))
    # a node's parent: the prefix one turn shorter of its smallest member
    parents = members.select(F.col("conv_id").alias("pc"), (F.col("depth") + 1).alias("depth"), *[F.col(s).alias(f"p{s}") for s in NAME])
    named = grouped.select("depth", *NAME, "conv_id").withColumnRenamed("conv_id", "parent_conv_id")
    child = grouped.join(parents, (grouped.conv_id == parents.pc) & (grouped.depth == parents.depth), "left").drop(parents.depth)
    child = child.join(named.select((F.col("depth") + 1).alias("d1"), *[F.col(s).alias(f"q{s}") for s in NAME], "parent_conv_id"),
                       (F.col("depth") == F.col("d1")) & F.expr(" AND ".join(f"p{s} = q{s}" for s in NAME)), "left")
    return child.select("depth", "conv_id", "parent_conv_id", "n_convs", "last_bytes", "ends_sha256")


def trie(conversations: DataFrame) -> DataFrame:
    """Every node with its children, leaves and saved bytes under it, and its enter and exit positions in the tour."""
    found = cut(nodes(conversations))
    numbered = cut(ranking.positions(found, [F.col("depth"), F.col("parent_conv_id").asc_nulls_first(), F.col("conv_id")], "id"))
    kids = numbered.filter(F.col("depth") > 0).groupBy((F.col("depth") - 1).alias("pdepth"), "parent_conv_id").agg(
        F.count(F.lit(1)).alias("n_children"), F.min("id").alias("first_child"))
    up = numbered.select(F.col("depth").alias("pdepth"), F.col("conv_id").alias("parent_conv_id"), F.col("id").alias("parent_id"))
    after = numbered.select((F.col("id") - 1).alias("id"), F.col("depth").alias("sdepth"), F.col("parent_conv_id").alias("sparent"), F.col("id").alias("next_sibling"))
    full = (numbered.join(kids.withColumnRenamed("parent_conv_id", "conv_id").withColumnRenamed("pdepth", "depth"), ["depth", "conv_id"], "left")
            .join(up.withColumn("depth", F.col("pdepth") + 1).drop("pdepth"), ["depth", "parent_conv_id"], "left")
            .join(after, "id", "left"))
    sibling = F.when((F.col("sdepth") == F.col("depth")) & (F.col("sparent") == F.col("parent_conv_id")), F.col("next_sibling"))
    full = cut(full.select("id", "depth", "conv_id", "parent_conv_id", "n_convs", "last_bytes", "ends_sha256",
                           F.coalesce("n_children", F.lit(0)).alias("n_children"), "first_child", "parent_id", sibling.alias("next_sibling")))
    leaf = F.col("n_children") == 0
    enter = full.select((F.col("id") * 2).alias("arc"), F.when(leaf, F.col("id") * 2 + 1).otherwise(F.col("first_child") * 2).alias("succ"),
                        leaf.cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("last_bytes")).alias("saved"))
    leave = full.select((F.col("id") * 2 + 1).alias("arc"), F.coalesce(F.col("next_sibling") * 2, F.col("parent_id") * 2 + 1).alias("succ"),
                        F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    sums = ranking.list_ranked(enter.unionByName(leave), "arc", "succ", ["leaves", "saved"])
    ins = sums.filter(F.col("arc") % 2 == 0).select(F.expr("arc div 2").alias("id"), F.col("leaves").alias("l_in"), F.col("saved").alias("s_in"), F.col("steps").alias("t_in"))
    outs = sums.filter(F.col("arc") % 2 == 1).select(F.expr("arc div 2").alias("id"), F.col("leaves").alias("l_out"), F.col("saved").alias("s_out"), F.col("steps").alias("t_out"))
    arcs = 2 * full.count()  # the tour's length; a position is that less the steps to the end
    return full.join(ins, "id").join(outs, "id").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("l_in") - F.col("l_out")).alias("n_leaves"),
        (F.col("s_in") - F.col("s_out")).alias("saved_tokens"), "ends_sha256",
        (F.lit(arcs) - F.col("t_in")).alias("tour_enter"), (F.lit(arcs) - F.col("t_out")).alias("tour_exit"))
