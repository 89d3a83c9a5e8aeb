"""The prefix trie of conversations, from digests of blocks of turns.

A conversation is cut into blocks of BLOCK turns. Its digest up to a block is a sum of block digests, each mixed with its place, so conversations
with equal digests up to a block share all turns so far. Grouping by these digests gives the trie at block boundaries for all depths at once;
copies are one row from then on. Only where one boundary is followed by differing blocks are the prefixes inside those blocks grouped too; in every
other block all members share each turn, and its nodes are a chain with the statistics of the block.

Sums over subtrees need no walk. Each node is owned by its smallest member, and what a conversation owns is the end of its path. With A(x) the
code points before node x, U(c) the code points of c before the part it owns, and c0 the owner of x, the sum of (members - 1) * code points over
the subtree of x is the sum of U(c) over the members of x, less U(c0) and (members - 1) * A(x). A leaf counts for the one member that owns it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weekwise.operators.scan import row_numbers, running_sums

from ._common import shared_table

BLOCK = 4  # turns in a block
MASK = (1 << 62) - 1  # digests are two lanes of 62 bits
LANES = (1, 2)
PIECE_BITS = 12  # ids that end at a node travel in pieces of up to 2**12
NODE = ["depth", "k1", "k2"]


def ordered_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, t1, t2, chars): place of each turn from 1, digest of role and text, code points of the text.

    Turns ascend, NULL first; turns of one number by role, then text. NULL role and text are empty. Rows without a conv_id are of no conversation.
    """
    own = [F.coalesce(rows[c], F.lit("")) for c in (role, text)]
    turns = rows.where(rows[conv_id].isNotNull()).select(
        rows[conv_id].cast("bigint").alias("conv_id"), rows[turn].cast("bigint").alias("turn"), own[0].alias("role"), own[1].alias("text")
    )
    placed = row_numbers(turns, "conv_id", "turn", "pos", ["role", "text"])
    digests = [F.xxhash64(F.lit(k), "role", "text").alias(f"t{k}") for k in LANES]
    return placed.select("conv_id", "pos", *digests, F.length("text").cast("bigint").alias("chars"))


def with_shared_heads(turns: DataFrame, span: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id) and their turns (conv_id, d, t1, t2, chars) after each begins like the first of its hundred.

    The first h = crc32(conv_id) % ``most`` turns come from conversation conv_id - conv_id % ``span`` (as many as it has), then
    its own turns after the first h.
    """
    ids = turns.select("conv_id").distinct()
    first = turns.where((F.col("conv_id") % span == 0) & (F.col("pos") < most))
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "t1", "t2", "chars"))).alias("head"))
    plan = ids.select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % span).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % most).cast("int").alias("h")
    )
    plan = plan.join(heads, "base", "left").select("conv_id", "h", F.coalesce(F.slice("head", 1, F.col("h")), F.array()).alias("head"))
    begun = plan.select("conv_id", F.explode("head").alias("e")).select("conv_id", F.col("e.pos").alias("d"), "e.t1", "e.t2", "e.chars")
    rest = turns.join(plan.select("conv_id", "h", F.size("head").alias("m")), "conv_id").where("pos > h")
    return ids, begun.union(rest.select("conv_id", (F.col("m") + F.col("pos") - F.col("h")).alias("d"), "t1", "t2", "chars"))


def _lane(k: int, turns: Column) -> Column:
    digest = F.xxhash64(F.lit(k), F.col("b"), F.transform(turns, lambda t: t["t1"]), F.transform(turns, lambda t: t["t2"]))
    return digest.bitwiseAND(F.lit(MASK))


def blocks_of(turns: DataFrame, block: int) -> DataFrame:
    """(conv_id, b, ts, p1, p2, k1, k2, a): turns of each block, digests up to it without and with it, code points before it."""
    cut = turns.groupBy("conv_id", F.floor((F.col("d") - 1) / block).alias("b")).agg(
        F.sort_array(F.collect_list(F.struct("d", "t1", "t2", "chars"))).alias("ts")
    )
    cut = cut.withColumns({f"x{k}": _lane(k, F.col("ts")) for k in LANES} | {"n": F.aggregate("ts", F.lit(0).cast("bigint"), lambda s, t: s + t["chars"])})
    exact = cut.withColumns({f"y{k}": F.col(f"x{k}").cast("decimal(20,0)") for k in LANES})
    summed = running_sums(exact, {"k1": "y1", "k2": "y2", "a": "n"}, "conv_id", "b")
    summed = summed.withColumns({f"k{k}": (F.col(f"k{k}") % F.lit(MASK + 1).cast("decimal(20,0)")).cast("bigint") for k in LANES})
    before = [(F.col(f"k{k}") - F.col(f"x{k}")).bitwiseAND(F.lit(MASK)).alias(f"p{k}") for k in LANES]
    return summed.select("conv_id", "b", "ts", *before, "k1", "k2", (F.col("a") - F.col("n")).alias("a"))


def _nodes(distinct: DataFrame, block: int, sums: Mapping[str, Column]) -> DataFrame:
    """Nodes of all depths from distinct blocks; ``sums`` merge the statistics of blocks that begin with the same turns.

    ``split`` marks blocks whose boundary before them has others after it: only their prefixes need grouping.
    """
    each = distinct.withColumn("j", F.explode(F.sequence(F.lit(1), F.size("ts"))))
    part = F.slice("ts", 1, F.col("j"))
    before = F.slice("ts", 1, F.col("j") - 1)

    def key(k: int, turns: Column, n: Column) -> Column:
        return F.when(n == 0, F.col(f"p{k}")).otherwise((F.col(f"p{k}") + _lane(k, turns)).bitwiseAND(F.lit(MASK)))

    fixed = {
        "depth": F.col("b") * block + F.col("j"), **{f"k{k}": key(k, part, F.col("j")) for k in LANES},
        **{f"q{k}": key(k, before, F.col("j") - 1) for k in LANES},
        "a": F.col("a") + F.aggregate(before, F.lit(0).cast("bigint"), lambda s, t: s + t["chars"]),
    }
    out = each.select("split", *[c.alias(n) for n, c in fixed.items()], *sums)
    grouped = out.where("split").groupBy(*NODE).agg(*[F.first(c).alias(c) for c in ("q1", "q2", "a")], *[c.alias(n) for n, c in sums.items()])
    return out.where("NOT split").select(grouped.columns).union(grouped)


def _end_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of (depth, k1, k2, conv_id): the ids in ascending order, comma-joined, as one SHA-256.

    Ids of a range travel as one text, and a task hashes the texts of a node as they come: no list of ids is held.
    """
    pieces = ends.groupBy(*NODE, F.shiftright("conv_id", PIECE_BITS).alias("range")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, done = None, None, []

        def emit() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*done, strict=True)] if done else [[]] * 4
            done.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], [*NODE, "ends_sha256"])

        for batch in batches:
            for *key, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if key != node:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if len(done) > 10_000:
                yield emit()
        if node is not None:
            done.append((*node, digest.hexdigest()))
        yield emit()

    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "range").mapInArrow(run, "depth BIGINT, k1 BIGINT, k2 BIGINT, ends_sha256 STRING")


def prefix_trie(ids: DataFrame, turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``ids`` holds the conv_id of every conversation, ``turns`` (conv_id, d, t1, t2, chars) their turns, d from 1 without gaps. Conversations
    without turns are members of the root; the root has no parent. Without conversations there are no nodes.
    """
    blocks = shared_table(blocks_of(turns, block), "blocks")
    boundary = ["b", "p1", "p2", "k1", "k2"]
    one = blocks.groupBy(*boundary).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("ts").alias("ts"), F.first("a").alias("a"))
    one = shared_table(one, "distinct-blocks")
    followed = one.groupBy("b", "p1", "p2").agg((F.count("*") > 1).alias("split"))
    distinct = shared_table(one.join(followed, ["b", "p1", "p2"]), "split-blocks")
    nodes = _nodes(distinct, block, {"n_convs": F.sum("n_convs"), "conv_id": F.min("conv_id")})
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("bigint")
    blank = F.lit(None).cast("bigint")
    root = root.select(*[zero.alias(c) for c in NODE], blank.alias("q1"), blank.alias("q2"), zero.alias("a"), "n_convs", "conv_id")
    nodes = shared_table(nodes.unionByName(root), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(F.count("*").alias("n_children"))
    known = shared_table(nodes.join(children, NODE, "left").na.fill(0, ["n_children"]), "counted-nodes")

    # of each conversation: code points before the part it owns (all of them if it owns none), and whether it owns a leaf
    owners = known.groupBy("conv_id").agg(F.min("a").alias("u"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    last = F.max(F.struct("b", F.size("ts").alias("size"), "k1", "k2", (F.col("a") + F.aggregate("ts", zero, lambda s, t: s + t["chars"])).alias("chars")))
    path = ids.join(blocks.groupBy("conv_id").agg(last.alias("last")), "conv_id", "left").join(owners, "conv_id", "left")
    convs = shared_table(path.select(
        "conv_id", F.coalesce("u", "last.chars", zero).alias("u"), F.coalesce("leaf", F.lit(0)).cast("bigint").alias("leaf"),
        F.coalesce(F.col("last.b") * block + F.col("last.size"), zero).alias("depth"), F.coalesce("last.k1", zero).alias("k1"), F.coalesce("last.k2", zero).alias("k2"),
    ), "conversations")
    sums = {"u": F.sum("u"), "n_leaves": F.sum("n_leaves"), "owner": F.min("owner")}
    per_conv = {"u": F.sum("u"), "n_leaves": F.sum("leaf"), "owner": F.min(F.struct("conv_id", "u"))}
    met = blocks.drop("ts", "a").join(convs.select("conv_id", "u", "leaf"), "conv_id").groupBy(*boundary).agg(*[c.alias(n) for n, c in per_conv.items()])
    below = _nodes(distinct.join(met, boundary), block, sums).select(*NODE, *sums)
    top = convs.agg(*[c.alias(n) for n, c in per_conv.items()]).select(*[zero.alias(c) for c in NODE], *sums)
    parents = known.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    found = known.join(below.union(top), NODE).join(_end_digests(convs.select(*NODE, "conv_id")), NODE, "left")
    found = found.join(parents, ["depth", "q1", "q2"], "left")
    saved = F.col("u") - F.col("owner.u") - (F.col("n_convs") - 1) * F.col("a")
    none = hashlib.sha256(b"").hexdigest()
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )
