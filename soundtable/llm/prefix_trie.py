"""A trie of conversation prefixes, and sums over its subtrees by an Euler tour.

Each node has two arcs, one that enters it and one that leaves it. In the tour a node's enter arc is followed by the enter
arc of its first child (a leaf: by its own exit arc), its exit arc by the enter arc of the next sibling (the last one: by
the parent's exit arc). What lies between a node's two arcs is its subtree, so sums over subtrees are differences of sums
along the tour, whatever the depth of the trie or the number of children.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from soundtable.llm.common import broadcast_within, discard, write_table
from soundtable.llm.ordering import ranked

#: Every FAMILY ids, one conversation lends its first turns to the others; it lends fewer than LENT.
FAMILY, LENT = 20, 4
#: Turns of a conversation that one window runs over.
TURN_BLOCK = 1024
#: Arcs that one task contracts at once.
ARC_BLOCK = 1 << 16
#: Bytes of an id list that are joined before they are hashed.
PIECE_BYTES = 1 << 16
#: Fixed value: SHA-256 of the empty string.
NO_IDS = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _numbered_turns(spark: SparkSession, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, at, c1, c2, words) of each turn, and (conv_id, n, h) of each conversation, both written.

    c1 and c2 are hashes of role and text; texts go no further."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    narrow = df.where("conv_id IS NOT NULL").select(
        "conv_id",
        "turn",
        role.alias("role"),
        F.md5(text).alias("sum"),
        F.xxhash64(role, text).alias("c1"),
        F.xxhash64(F.lit(1), text, role).alias("c2"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    placed = ranked(spark, narrow, ["conv_id", F.col("turn").asc_nulls_first(), "role", "sum"], "place", "turns")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(LENT))
    convs = placed.groupBy("conv_id").agg(F.min("place").alias("p0"), F.count("*").alias("n")).withColumn("h", h)
    convs = write_table(spark, convs, "conversations")
    turns = placed.join(broadcast_within(convs.select(F.col("conv_id").alias("c"), "p0")), F.col("conv_id") == F.col("c"))
    return turns.select("conv_id", (F.col("place") - F.col("p0")).alias("at"), "c1", "c2", "words"), convs.select("conv_id", "n", "h")


def rebuilt_turns(spark: SparkSession, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, at, c1, c2, words) of each turn of the rebuilt conversations, and (conv_id, length) of each, turnless ones too."""
    turns, convs = _numbered_turns(spark, df)
    turns = write_table(spark, turns, "numbered-turns")
    lender = convs.select(F.col("conv_id").alias("lender"), F.col("n").alias("lends"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    plan = convs.withColumn("base", base).join(lender, F.col("base") == F.col("lender"), "left")
    plan = plan.withColumn("shift", F.least("h", F.coalesce("lends", F.lit(0)))).select("conv_id", "base", "h", "shift", (F.greatest(F.col("n") - F.col("h"), F.lit(0)) + F.col("shift")).alias("length"))
    plan = write_table(spark, plan, "plans")
    heads = turns.where(F.col("at") < LENT - 1).withColumnRenamed("conv_id", "lender")
    lent = plan.where("shift > 0").select("conv_id", "base", "shift").join(heads, (F.col("base") == F.col("lender")) & (F.col("at") < F.col("shift")))
    own = turns.join(broadcast_within(plan.select(F.col("conv_id").alias("c"), "h", "shift")), (F.col("conv_id") == F.col("c")) & (F.col("at") >= F.col("h")))
    own = own.withColumn("at", F.col("at") - F.col("h") + F.col("shift"))
    names = ["conv_id", "at", "c1", "c2", "words"]
    return lent.select(*names).union(own.select(*names)), plan.select("conv_id", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words): each prefix of each conversation with its 128-bit key and that of the prefix before.

    A key is the XOR of hashes of the prefix's turns and their places, so it can be taken in blocks of turns: a conversation
    of any length is spread over many windows, and only one row for each block meets in a window of its own.
    """
    keyed = turns.select("conv_id", "at", "words", F.xxhash64("at", "c1", "c2").alias("e1"), F.xxhash64(F.lit(2), "c2", "at", "c1").alias("e2"), F.floor(F.col("at") / TURN_BLOCK).alias("block"))
    inside = W.partitionBy("conv_id", "block").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = keyed.groupBy("conv_id", "block").agg(F.bit_xor("e1").alias("b1"), F.bit_xor("e2").alias("b2"))
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(b).over(before), F.lit(0)).alias(b) for b in ("b1", "b2")])
    run = keyed.select("*", F.bit_xor("e1").over(inside).alias("x1"), F.bit_xor("e2").over(inside).alias("x2")).join(blocks, ["conv_id", "block"])
    k1, k2 = F.col("x1").bitwiseXOR(F.col("b1")), F.col("x2").bitwiseXOR(F.col("b2"))
    return run.select("conv_id", (F.col("at") + 1).alias("depth"), k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("e1")).alias("p1"), k2.bitwiseXOR(F.col("e2")).alias("p2"), "words")


def contract(table: pa.Table) -> pa.Table:
    """The arcs of a block (arc, next, leaf, saved) as pieces of the list: for each arc the first arc of its piece, the sums
    from the arc to the piece's end, and what follows the piece (-1: nothing)."""
    arc, after = table["arc"].to_numpy(), table["next"].to_numpy()
    n = len(arc)
    order = np.argsort(arc)
    at = np.minimum(np.searchsorted(arc, after, sorter=order), n - 1)
    local = np.where(arc[order[at]] == after, order[at], n)  # n: it goes on in another block, or ends
    last = np.where(local == n, np.arange(n), local)
    while (last[last] != last).any():
        last = last[last]
    sums = [np.append(table[c].to_numpy(), 0) for c in ("leaf", "saved")]
    jump = np.append(local, n)
    while (jump != n).any():
        sums, jump = [s + s[jump] for s in sums], jump[jump]
    first = np.ones(n, bool)
    first[local[local < n]] = False
    head = np.zeros(n, np.int64)
    head[last[first]] = arc[first]
    return pa.table([arc, head[last], after[last], sums[0][:n], sums[1][:n]], names=["arc", "head", "follow", "leaf", "saved"])


def list_rank(spark: SparkSession, arcs: DataFrame, block: int = ARC_BLOCK) -> DataFrame:
    """(arc, leaf, saved): for each arc of one list (arc, next, leaf, saved; next -1 at the end) the sums from it to the end.

    Blocks of arcs whose numbers lie together are contracted to pieces first; the pieces are ranked by pointer jumping, one
    equi-join for each doubling; then each arc adds what follows its piece. Numbers that follow the tour make few pieces;
    any numbers give the same sums.
    """
    schema = "arc long, head long, follow long, leaf long, saved long"
    local = arcs.groupBy(F.floor(F.col("arc") / block).alias("block")).applyInArrow(contract, schema)
    local = write_table(spark, local, "tour-pieces")
    now = local.where("arc = head").select("arc", F.col("follow").alias("next"), "leaf", "saved")
    written = None
    while now.where("next >= 0").limit(1).count():
        ahead = now.select(F.col("arc").alias("to"), F.col("next").alias("next2"), F.col("leaf").alias("leaf2"), F.col("saved").alias("saved2"))
        met = now.where("next >= 0").join(ahead, F.col("next") == F.col("to"))
        step = met.select("arc", F.col("next2").alias("next"), (F.col("leaf") + F.col("leaf2")).alias("leaf"), (F.col("saved") + F.col("saved2")).alias("saved"))
        step = write_table(spark, step.union(now.where("next < 0")), "tour-jumps")
        if written is not None:
            discard(spark, written)
        now = written = step
    ahead = now.select(F.col("arc").alias("to"), F.col("leaf").alias("leaf2"), F.col("saved").alias("saved2"))
    done = local.join(broadcast_within(ahead), F.col("follow") == F.col("to"), "left")
    return done.select("arc", *[(F.col(c) + F.coalesce(f"{c}2", F.lit(0))).alias(c) for c in ("leaf", "saved")])


def _id_digests(ends: DataFrame) -> DataFrame:
    """(r, ends_sha256): the SHA-256 of the comma-joined ids (column conv_id, ascending) of each r.

    Ids are range-sorted and joined to pieces by many tasks; one task then hashes a node's pieces one after another and
    holds one of them at a time."""

    def joined(batches):
        for batch in batches:
            rs, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(rs)) + 1).tolist(), len(rs)] if len(rs) else []
            out = [(rs[i], ids[k], ",".join(map(str, ids[k : min(j, k + PIECE_BYTES // 8)].tolist()))) for i, j in zip(cuts, cuts[1:], strict=False) for k in range(i, j, PIECE_BYTES // 8)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], names=["r", "first", "ids"])

    def hashed(batches):
        r, state = None, None
        for batch in batches:
            rs, sums = [], []
            for now, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now != r:
                    if state is not None:
                        rs.append(r)
                        sums.append(state.hexdigest())
                    r, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(rs, pa.int64()), pa.array(sums, pa.string())], names=["r", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int64()), pa.array([state.hexdigest()])], names=["r", "ends_sha256"])

    pieces = ends.select("r", "conv_id").repartitionByRange("r", "conv_id").sortWithinPartitions("r", "conv_id").mapInArrow(joined, "r long, first long, ids string")
    return pieces.repartition("r").sortWithinPartitions("r", "first").select("r", "ids").mapInArrow(hashed, "r long, ends_sha256 string")


def prefix_trie(spark: SparkSession, df: DataFrame, block: int = ARC_BLOCK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row for each node.

    df has conv_id, turn, role and text (other columns are not read). Turns are ordered by turn, null first; ties by role
    and the MD5 of the text. Null roles and texts are empty; rows without a conv_id belong to no conversation. Every
    conversation is rebuilt: the first h turns of its family's first one (id - id % 20, the
    remainder having the sign of the id), then its own after its first h,
    where h is the CRC-32 of its decimal id modulo 4. A node stands for the conversations that begin with the same turns,
    the root for all; conv_id is the smallest of them, which together with the depth is unique. n_leaves and saved_tokens
    (the words of a node's last text, for each conversation but one) are sums over its subtree. Repeated rows are turns of
    their own. An empty table has no node. Nodes are keyed by 128-bit hashes of their turns.
    """
    turns, convs = rebuilt_turns(spark, df)
    rows = write_table(spark, prefixes(turns), "prefixes")
    nodes = rows.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("words").alias("words"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("p1"), zero.alias("p2"), zero.alias("words"))
    nodes = write_table(spark, ranked(spark, nodes.union(root), ["conv_id", "depth"], "r", "sorted-nodes"), "nodes")

    above = nodes.select((F.col("depth") + 1).alias("d"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), F.col("r").alias("parent"))
    below = nodes.where("depth > 0").join(above, (F.col("depth") == F.col("d")) & (F.col("p1") == F.col("q1")) & (F.col("p2") == F.col("q2")))
    sibling = ranked(spark, below.select("parent", "r", "parent_conv_id"), ["parent", "r"], "s", "siblings")
    sibling = write_table(spark, sibling, "ranked-siblings")
    later = sibling.select((F.col("s") - 1).alias("s0"), F.col("parent").alias("parent0"), F.col("r").alias("next_r"))
    aside = sibling.join(later, (F.col("s") == F.col("s0")) & (F.col("parent") == F.col("parent0")), "left").select(F.col("r").alias("child"), "parent", "parent_conv_id", "next_r")
    family = sibling.groupBy("parent").agg(F.count("*").alias("n_children"), F.min("r").alias("first_r")).withColumnRenamed("parent", "of")
    whole = nodes.join(family, F.col("r") == F.col("of"), "left").join(aside, F.col("r") == F.col("child"), "left")
    whole = whole.select("r", "conv_id", "depth", "k1", "k2", "n_convs", "words", F.coalesce("n_children", zero).alias("n_children"), "first_r", "parent", "parent_conv_id", "next_r")
    whole = write_table(spark, whole, "linked-nodes")

    enter, leave = F.col("r") * 2, F.col("r") * 2 + 1
    tour = F.array(
        F.struct(enter.alias("arc"), F.coalesce(F.col("first_r") * 2, leave).alias("next"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")),
        F.struct(leave.alias("arc"), F.coalesce(F.col("next_r") * 2, F.col("parent") * 2 + 1, F.lit(-1).cast("long")).alias("next"), zero.alias("leaf"), zero.alias("saved")),
    )
    sums = list_rank(spark, whole.select(F.inline(tour)), block)
    sign = F.when(F.col("arc") % 2 == 0, 1).otherwise(-1)
    trees = sums.groupBy(F.floor(F.col("arc") / 2).alias("node")).agg(F.sum(F.col("leaf") * sign).alias("n_leaves"), F.sum(F.col("saved") * sign).alias("saved_tokens"))

    lasts = rows.select("conv_id", "depth", "k1", "k2").join(convs.select(F.col("conv_id").alias("c"), "length"), (F.col("conv_id") == F.col("c")) & (F.col("depth") == F.col("length")))
    lasts = lasts.select("conv_id", "depth", "k1", "k2").union(convs.where("length = 0").select("conv_id", zero, zero, zero))
    keys = whole.select(F.col("depth").alias("d"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), "r")
    ends = lasts.join(keys, (F.col("depth") == F.col("d")) & (F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2"))).select("r", "conv_id")
    digests = _id_digests(ends).withColumnRenamed("r", "of")
    out = whole.join(trees, F.col("r") == F.col("node")).join(digests, F.col("r") == F.col("of"), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"))
