"""Conversation prefix trie by ROLLUP over positional turn columns.

A conversation is its turns in order (turn, null first; then role, then digest of the text). Turns are numbered without one sort per
conversation: rows are dealt by ranges of (conversation, order), numbered inside each range, and the counts of earlier ranges are added, so a
conversation with a third of all turns is spread over many tasks. Only digests and lengths travel, never texts.

Rebuilding: a conversation's first ``h`` turns are replaced by the first ``h`` turns of the conversation that opens its family of
``FAMILY`` ids; ``h`` is a checksum of its id modulo ``MOST_HEAD + 1``.

Nodes: the turns of a conversation are laid out in blocks of ``BLOCK`` positional columns, t1 to t8. One
``GROUP BY block, prior, ROLLUP(t1, ..., t8)`` makes the prefixes of all blocks together; grouping_id tells how many columns a row keeps. A
block is keyed by the node that ends the block before it (``prior``, 128 bits combined from the digests of all turns so far, each with its
position), so a conversation of any length goes on in further rows and the plan stays the same.

Sums over subtrees are the same ROLLUP over nodes in place of conversations, which sums a block's nodes into their prefixes. What lies in
later blocks is added before, where a block ends: the tree of blocks is summed by pointer doubling, in a number of rounds that is the
logarithm of the longest conversation in blocks. Conversations that end at a node are listed in order as pieces of text, and one streaming
pass hashes the pieces of a node one after the other; no list is held whole.

Defined cases: null role or text is empty; rows without conversation id belong to no conversation; a row with a null turn comes first;
turns that share their number are ordered by role and digest of the text, and rows that repeat all of these are turns of their own; a
conversation whose rebuilt sequence is empty counts at the root only; negative ids belong to the family towards zero; an empty table gives no
node, not even a root; other columns of the table are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.llm.common import ref, shuffle_partitions, stored

BLOCK = 8
FAMILY = 100
MOST_HEAD = 5
PIECE = 4096  # ids in a piece of text that is hashed
STRETCH = 1024  # blocks of a conversation that are summed up together
COLUMNS = [f"t{i}" for i in range(1, BLOCK + 1)]
NODE = ["n1", "n2"]
PRIOR = ["p1", "p2"]
ROOT = 0  # both halves of the root's identity; nothing comes before it


def _halves(turn: Column, position: Column) -> tuple[Column, Column]:
    """What a turn adds to the identity of every node below it; halves of identities are combined by exclusive or."""
    return F.xxhash64(position.cast("long"), turn), F.xxhash64(turn, F.lit(1), position.cast("long"))


def numbered_turns(table: DataFrame) -> DataFrame:
    """(conv_id, position, turn, chars): the turns of every conversation, numbered from 1; ``turn`` is a digest of role and text."""
    role, text = (F.coalesce(ref(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = table.filter(ref("conv_id").isNotNull()).select(
        ref("conv_id").cast("long").alias("conv_id"), ref("turn").alias("at"), role.alias("role"), F.md5(text.cast("binary")).alias("body"),
        F.length(text).cast("long").alias("chars"))
    dealt = rows.repartitionByRange(shuffle_partitions(table.sparkSession), "conv_id", F.col("at").asc_nulls_first(), "role", "body")
    held = stored(dealt.withColumn("part", F.spark_partition_id()), "turns")
    # Equal keys lie in one range, so the order inside a range and the order of the ranges are the order of the conversation.
    inside = Window.partitionBy("conv_id", "part").orderBy(F.col("at").asc_nulls_first(), "role", "body")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    skipped = (held.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("skipped", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "body").cast("binary"))
    return (held.withColumn("nth", F.row_number().over(inside)).join(skipped, ["conv_id", "part"])
            .select("conv_id", (F.col("skipped") + F.col("nth")).alias("position"), digest.alias("turn"), "chars"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, position, turn, chars) of the rebuilt conversations; one without turns has a single row with null position."""
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_HEAD + 1)
    convs = turns.select("conv_id").distinct().withColumn("h", head).withColumn("opens", F.col("conv_id") - F.col("conv_id") % FAMILY)
    heads = (turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("position") <= MOST_HEAD)).groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(F.struct("position", "turn", "chars"))).alias("head")))  # MOST_HEAD turns at most
    convs = (convs.join(heads.withColumnRenamed("conv_id", "opens"), "opens", "left")
             .select("conv_id", "h", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h").cast("int")).alias("head")))
    taken = convs.select("conv_id", F.explode_outer("head").alias("x")).select("conv_id", "x.position", "x.turn", "x.chars")
    lengths = convs.select("conv_id", "h", F.size("head").alias("taken"))
    own = (turns.join(lengths, "conv_id").filter(F.col("position") > F.col("h"))
           .select("conv_id", (F.col("position") - F.col("h") + F.col("taken")).alias("position"), "turn", "chars"))
    return taken.unionByName(own)


def blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, block, p1, p2, t1..t8, c1..c8, steps): a row per conversation and block; block 0 of every conversation is there.

    ``p1, p2`` is the node before the block, ``steps`` the number of its turns, ``c`` the lengths of their texts.
    """
    at = (F.col("position") - 1) % BLOCK + 1
    a, b = (F.when(F.col("turn").isNotNull(), half) for half in _halves(F.col("turn"), F.col("position")))
    laid = turns.groupBy("conv_id", F.coalesce(F.floor((F.col("position") - 1) / BLOCK), F.lit(0)).alias("block")).agg(
        *[F.max(F.when(at == i, F.col("turn"))).alias(f"t{i}") for i in range(1, BLOCK + 1)],
        *[F.max(F.when(at == i, F.col("chars"))).alias(f"c{i}") for i in range(1, BLOCK + 1)],
        F.count("turn").cast("int").alias("steps"), F.coalesce(F.bit_xor(a), F.lit(0)).alias("a"), F.coalesce(F.bit_xor(b), F.lit(0)).alias("b"))
    laid = stored(laid, "laid").withColumn("stretch", F.floor(F.col("block") / STRETCH))
    # Running sums inside a stretch of blocks, and over the stretches before it: a very long conversation is many small windows.
    inside = Window.partitionBy("conv_id", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    earlier = laid.groupBy("conv_id", "stretch").agg(F.bit_xor("a").alias("sa"), F.bit_xor("b").alias("sb")).select(
        "conv_id", "stretch", *[F.coalesce(F.bit_xor(h).over(before), F.lit(ROOT)).cast("long").alias(e) for h, e in (("sa", "ea"), ("sb", "eb"))])
    prior = [F.coalesce(F.bit_xor(h).over(inside), F.lit(ROOT)).cast("long").bitwiseXOR(F.col(f"e{h}")).alias(p) for h, p in zip("ab", PRIOR)]
    return laid.join(earlier, ["conv_id", "stretch"]).select("*", *prior).drop("a", "b", "ea", "eb", "stretch")


def _identity(steps: int | Column) -> list[Column]:
    """The identity of the node after the first ``steps`` columns of a block."""
    found = []
    for half, prior in enumerate(PRIOR):
        value = F.col(prior)
        for i, name in enumerate(COLUMNS, 1):
            part = _halves(F.col(name), F.col("block") * BLOCK + i)[half]
            value = value.bitwiseXOR(F.when(F.lit(i) <= steps, part).otherwise(F.lit(0)))
        found.append(value)
    return found


def _rollup(rows: DataFrame, sums: str) -> DataFrame:
    """All prefixes of the rows' positional columns, block by block; ``kept`` is how many columns a prefix has.

    A prefix that would end in a column which a row does not have is no prefix of it, and is left out.
    """
    spark = rows.sparkSession
    last = " ".join(f"WHEN {i} THEN {name}" for i, name in enumerate(COLUMNS, 1))
    return spark.sql(f"""
        SELECT * FROM (
          SELECT block, p1, p2, {', '.join(COLUMNS)}, {BLOCK} - cast(bit_count(grouping_id()) AS int) AS kept, {sums}
          FROM {{rows}} GROUP BY block, p1, p2, ROLLUP({', '.join(COLUMNS)}))
        WHERE kept = 0 OR CASE kept {last} END IS NOT NULL""", rows=rows)


def trie_nodes(laid: DataFrame) -> DataFrame:
    """A row per node: n1, n2 (its identity), m1, m2 (its parent's), depth, conv_id, n_convs, chars, and block, p1, p2, t1..t8, kept."""
    chars = ", ".join(f"max(c{i}) AS c{i}" for i in range(1, BLOCK + 1))
    found = _rollup(laid, f"count(1) AS n_convs, min(conv_id) AS conv_id, {chars}").filter("kept > 0 OR block = 0")
    own, above = _identity(F.col("kept")), _identity(F.col("kept") - 1)
    chars = F.coalesce(*[F.when(F.col("kept") == i, F.col(f"c{i}")) for i in range(1, BLOCK + 1)], F.lit(0))
    root = F.col("kept") == 0
    return found.select(
        "block", *PRIOR, *COLUMNS, "kept", (F.col("block") * BLOCK + F.col("kept")).alias("depth"), "conv_id", "n_convs", chars.alias("chars"),
        own[0].alias("n1"), own[1].alias("n2"), *[F.when(~root, a).alias(m) for a, m in zip(above, ("m1", "m2"))])


def block_totals(totals: DataFrame) -> DataFrame:
    """Sums over whole subtrees of blocks, by pointer doubling.

    ``totals`` has a row per block group: p1, p2 (its identity), q1, q2 (that of the group before it, null for the first), leaves, saved.
    After round k a sum covers the groups fewer than 2^k steps below, and the pointer leads 2^k steps up. Groups that point nowhere wait.
    """
    held = stored(totals, "block-totals")
    while not held.filter("q1 IS NOT NULL").isEmpty():
        given = held.filter("q1 IS NOT NULL").groupBy(F.col("q1").alias("g1"), F.col("q2").alias("g2")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        summed = held.join(given, (F.col("p1") == F.col("g1")) & (F.col("p2") == F.col("g2")), "left").select(
            "p1", "p2", "q1", "q2", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        up = held.select(F.col("p1").alias("u1"), F.col("p2").alias("u2"), F.col("q1").alias("v1"), F.col("q2").alias("v2")).filter("q1 IS NOT NULL")
        jumped = summed.join(up, (F.col("q1") == F.col("u1")) & (F.col("q2") == F.col("u2")), "left").select(
            "p1", "p2", F.col("v1").alias("q1"), F.col("v2").alias("q2"), "leaves", "saved")
        held = stored(jumped, "block-totals")
    return held.select("p1", "p2", "leaves", "saved")


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """(n1, n2, n_leaves, saved_tokens) of every node; ``nodes`` also has n_children."""
    own = nodes.select("block", *PRIOR, *COLUMNS, "kept", *NODE, F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
                       ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    # The group before a group is the block in which its prior node lies.
    ends = own.filter(F.col("kept") == BLOCK).select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
    later = (own.filter("block > 0").groupBy("p1", "p2").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).join(ends, ["p1", "p2"])
             # the first block's own sums are made by the ROLLUP below, so pointers stop before it
             .withColumn("first", (F.col("q1") == ROOT) & (F.col("q2") == ROOT))
             .select("p1", "p2", *[F.when(~F.col("first"), F.col(q)).alias(q) for q in ("q1", "q2")], "leaves", "saved"))
    below = block_totals(later).select(F.col("p1").alias("n1"), F.col("p2").alias("n2"), F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
    whole = own.join(below, NODE, "left").select(
        "block", *PRIOR, *COLUMNS, (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
    found = _rollup(whole, "sum(leaves) AS n_leaves, sum(saved) AS saved_tokens").filter("kept > 0 OR block = 0")
    node = _identity(F.col("kept"))
    return found.select(node[0].alias("n1"), node[1].alias("n2"), "n_leaves", "saved_tokens")


def _joined_pieces(batches):
    """Runs of ids of one node as text, in parts of ``PIECE`` ids; a run goes on where the next batch begins with the same node."""
    for batch in batches:
        n1, n2, ids = (batch[c].to_numpy() for c in ("n1", "n2", "conv_id"))
        starts = np.flatnonzero(np.concatenate([[True], (n1[1:] != n1[:-1]) | (n2[1:] != n2[:-1])])[: len(ids)])
        cuts = np.concatenate([np.arange(a, b, PIECE) for a, b in zip(starts, np.append(starts[1:], len(ids)))]) if len(ids) else starts
        listed = [",".join(map(str, part.tolist())) for part in np.split(ids, cuts[1:])] if len(ids) else []
        yield pd.DataFrame({"n1": n1[cuts], "n2": n2[cuts], "first": ids[cuts], "listed": listed})


def _hashed_pieces(batches):
    """One running hash: pieces come in order of node and first id."""
    key, running = None, None
    for batch in batches:
        done = []
        for n1, n2, listed in zip(batch["n1"], batch["n2"], batch["listed"]):
            if key == (n1, n2):
                running.update(b"," + listed.encode())
                continue
            if key is not None:
                done.append((*key, running.hexdigest()))
            key, running = (n1, n2), hashlib.sha256(listed.encode())
        yield pd.DataFrame(done, columns=["n1", "n2", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, running.hexdigest())], columns=["n1", "n2", "ends_sha256"])


def ends(laid: DataFrame) -> DataFrame:
    """(n1, n2, ends_sha256): the hash of the ids of the conversations that end at a node, in ascending order."""
    n = shuffle_partitions(laid.sparkSession)
    node = _identity(F.col("steps"))
    last = laid.select("conv_id", "block", F.struct(node[0].alias("n1"), node[1].alias("n2")).alias("node")).groupBy("conv_id").agg(
        F.max_by("node", "block").alias("node"))
    listed = last.select("node.*", "conv_id").repartitionByRange(n, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    pieces = listed.mapInPandas(_joined_pieces, "n1 long, n2 long, first long, listed string")
    return (pieces.repartition(n, *NODE).sortWithinPartitions(*NODE, "first").mapInPandas(_hashed_pieces, "n1 long, n2 long, ends_sha256 string"))


def prefix_trie(table: DataFrame) -> DataFrame:
    """A row per node of the trie of rebuilt conversations: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    laid = stored(blocks(rebuilt(stored(numbered_turns(table), "numbered"))), "blocks")
    nodes = stored(trie_nodes(laid), "nodes")
    children = nodes.filter("m1 IS NOT NULL").groupBy(F.col("m1").alias("n1"), F.col("m2").alias("n2")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = stored(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "counted")
    parents = counted.filter("n_children > 0").select(F.col("n1").alias("m1"), F.col("n2").alias("m2"), F.col("conv_id").alias("parent_conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    return (counted.join(subtree_sums(counted), NODE).join(ends(laid), NODE, "left").join(parents, ["m1", "m2"], "left")
            .select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")))
