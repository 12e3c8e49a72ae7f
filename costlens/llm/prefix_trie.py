"""Prefix trie of conversations, by fixed-length block hashing.

A conversation's path is the chained digest of its turns: equal digests are equal
beginnings.  Conversations are grouped by blocks of ``BLOCK`` turns first: a block is
a digest to start from and the digests inside, so a group is a distinct continuation
with its number of members, combined before the shuffle.  Only where blocks part, that
is where several start from one digest, the groups are cut at turn boundaries and
grouped anew; a block without siblings gives its nodes as it is.

The smallest member of a node stands for it.  As it also stands for all nodes below
on its path, sums over subtrees take no climbing: a running sum along each member's own
nodes, and the total of its topmost node for the ancestors of that one.  Which blocks
part goes out as a bit map of at most 8 MB, false marks of which only cost a regrouping.
Ids that end at a node are joined in runs of ``RUN`` and hashed in a stream.

Defined results: turns without conversation are left out; turns are ordered by number
(null first), then role and text, so ties and repeated rows have one order; a null role
or text is empty; texts of any length are hashed whole before anything is grouped;
conversations without turns end at the root; an empty table gives no rows; only the
named columns are read, so other columns may have any names.  One conversation's digests
are one row (24 bytes a turn).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costlens.llm.common import maybe_in, stored, whole

BLOCK = 4
#: Ids that end at a node are joined by ranges of so many.
RUN = 4096
#: Bytes of a digest.
WIDTH = 16
ROOT = bytes(WIDTH)
TURNS = "array<struct<digest:binary,size:bigint>>"


def turn_lists(rows: DataFrame, together: Column | None = None) -> DataFrame:
    """Per conversation its turns, in order, as digests and UTF-8 lengths of the texts.

    Conversations of one value of ``together`` are put in one task, and it is kept.
    """
    role, text = whole(F.col("role").cast("string")), whole(F.col("text").cast("string"))
    conv = F.col("conv_id").cast("long")
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = rows.where(F.col("conv_id").isNotNull()).select(
        (conv if together is None else together).alias("together"),
        conv.alias("conv_id"),
        F.col("turn"),
        role.alias("role"),
        text.alias("text"),
    )
    turns = turns.repartition("together")
    order = Window.partitionBy("together", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = turns.select(
        "together",
        "conv_id",
        F.row_number().over(order).alias("n"),
        F.substring(F.unhex(F.sha2(both, 256)), 1, WIDTH).alias("digest"),
        F.octet_length("text").cast("long").alias("size"),
    )
    listed = F.array_sort(F.collect_list(F.struct("n", "digest", "size")))
    short = F.transform(listed, lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size")))
    return numbered.groupBy("together", "conv_id").agg(short.cast(TURNS).alias("turns"))


def paths(lists: DataFrame) -> DataFrame:
    """Per conversation the digests of its beginnings and the lengths of their last texts."""

    def each(batches):
        for batch in batches:
            out = []
            for turns in batch.column(1).to_pylist():
                node, nodes = ROOT, []
                for t in turns or ():
                    node = hashlib.sha256(node + t["digest"]).digest()[:WIDTH]
                    nodes.append(node)
                out.append((nodes, [t["size"] for t in turns or ()]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x for x, _ in out], pa.list_(pa.binary())),
                    pa.array([x for _, x in out], pa.list_(pa.int64())),
                ],
                ["conv_id", "nodes", "sizes"],
            )

    rows = lists.select("conv_id", "turns")
    return rows.mapInArrow(each, "conv_id bigint, nodes array<binary>, sizes array<bigint>")


def _blocks(found: DataFrame) -> DataFrame:
    """Distinct blocks: where they start, the digests inside, members, the smallest of
    them, and how many end with the block."""
    n, k = F.size("nodes"), F.col("block")
    cut = found.where(n > 0).select(
        "conv_id", "nodes", "sizes", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))).alias("block")
    )
    inside = F.slice("nodes", k * BLOCK + 1, F.lit(BLOCK))
    each = cut.select(
        F.when(k == 0, F.lit(ROOT)).otherwise(F.get("nodes", k * BLOCK - 1)).alias("start"),
        (k * BLOCK).alias("above"),
        inside.alias("inside"),
        F.slice("sizes", k * BLOCK + 1, F.lit(BLOCK)).alias("sizes"),
        "conv_id",
        (n == k * BLOCK + F.size(inside)).cast("long").alias("ends"),
    )
    return each.groupBy("start", "above", "inside", "sizes").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("ends").alias("n_ends")
    )


def _cut(blocks: DataFrame) -> DataFrame:
    """The nodes inside blocks, one row for each block and turn."""
    i, inside = F.col("i"), F.col("inside")
    rows = blocks.select("*", F.posexplode("inside").alias("i", "node"))
    return rows.select(
        "node",
        F.when(i == 0, F.col("start")).otherwise(F.get(inside, i - 1)).alias("parent"),
        (F.col("above") + i + 1).cast("long").alias("depth"),
        F.get("sizes", i).alias("size"),
        "n_convs",
        "conv_id",
        F.when(i == F.size(inside) - 1, F.col("n_ends")).otherwise(0).alias("n_ends"),
    )


def _nodes(found: DataFrame) -> DataFrame:
    """All nodes below the root: digest, parent's digest, depth, size of the last text,
    members, the smallest of them, and how many end there."""
    blocks = stored(_blocks(found), "blocks")
    parting = blocks.groupBy("start").agg(F.count("*").alias("n")).where("n > 1").select("start")
    marked = maybe_in(blocks, F.col("start"), parting, "start")
    alone = _cut(marked.where("not maybe").drop("maybe"))
    refined = _cut(marked.where("maybe").drop("maybe"))
    refined = refined.groupBy("node", "parent", "depth", "size").agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_ends").alias("n_ends")
    )
    return alone.union(refined.select(*alone.columns))


def endings(found: DataFrame) -> DataFrame:
    """Per node at which conversations end: SHA-256 of their ids, ascending, comma-joined."""
    last = F.coalesce(F.get("nodes", F.size("nodes") - 1), F.lit(ROOT))
    runs = (
        found.select(last.alias("node"), "conv_id", F.floor(F.col("conv_id") / RUN).alias("run"))
        .groupBy("node", "run")
        .agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
        .select("node", "run", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    )

    def each(batches):
        node, sha = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key == node:
                    sha.update(b"," + ids.encode())
                    continue
                if node is not None:
                    done.append((node, sha.hexdigest()))
                node, sha = key, hashlib.sha256(ids.encode())
            yield _pairs(done)
        if node is not None:
            yield _pairs([(node, sha.hexdigest())])

    ordered = runs.repartition("node").sortWithinPartitions("node", "run").select("node", "ids")
    return ordered.mapInArrow(each, "node binary, ends_sha256 string")


def _pairs(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([a for a, _ in rows], pa.binary()), pa.array([b for _, b in rows], pa.string())],
        ["node", "ends_sha256"],
    )


def trie(lists: DataFrame) -> DataFrame:
    """Per distinct beginning of conversations: smallest member, depth, parent's smallest
    member, members, children, leaves and saved bytes below, and the hash of the ids ending there.

    ``lists`` has ``conv_id`` and ``turns`` (``TURNS``); ids are unique.
    """
    found = stored(paths(lists), "paths")
    top = found.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).first()
    nodes = _nodes(found)
    own = Window.partitionBy("conv_id")
    saved = (F.col("n_convs") - 1) * F.col("size")
    nodes = stored(
        nodes.select(
            "node",
            "parent",
            "depth",
            "n_convs",
            "conv_id",
            F.sum(saved).over(own.orderBy(F.desc("depth"))).alias("saved"),
            F.max((F.col("n_ends") == F.col("n_convs")).cast("long")).over(own).alias("leaves"),
            (F.col("depth") == F.min("depth").over(own)).alias("topmost"),
        ),
        "nodes",
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")

    def row(node, conv=none, depth=none, n=none, kids=zero, leaves=zero, saved=zero):
        named = {"node": node, "conv_id": conv, "depth": depth, "n_convs": n, "n_children": kids}
        named |= {"n_leaves": leaves, "saved_tokens": saved}
        return F.struct(*[c.alias(name) for name, c in named.items()])

    col = F.col
    itself = row(col("node"), col("conv_id"), col("depth"), col("n_convs"), leaves=col("leaves"), saved=col("saved"))
    parts = nodes.select(F.explode(F.array(itself, row(col("parent"), kids=F.lit(1).cast("long")))).alias("_")).select("_.*")
    # what a member's own nodes sum to counts for all above its topmost one
    climbing = nodes.where("topmost").join(found.select("conv_id", "nodes"), "conv_id")
    above = F.concat(F.array(F.lit(ROOT)), F.slice("nodes", F.lit(1), (col("depth") - 1).cast("int")))
    above = climbing.select(F.explode(above).alias("over"), "leaves", "saved").select(
        row(col("over"), leaves=col("leaves"), saved=col("saved")).alias("_")
    ).select("_.*")
    root = found.sparkSession.range(1 if top.n else 0).select(
        row(F.lit(ROOT), F.lit(top.least).cast("long"), zero, F.lit(top.n).cast("long")).alias("_")
    ).select("_.*")
    summed = parts.union(above).union(root).groupBy("node").agg(
        *[F.max(c).alias(c) for c in ("conv_id", "depth", "n_convs")],
        *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")],
    )
    # a node below another of its smallest member has that one for a parent, too
    named = nodes.select(col("node").alias("parent"), col("conv_id").alias("parent_conv_id"))
    tops = nodes.where("topmost and depth > 1").select("node", "parent").join(named, "parent")
    tops = tops.select("node", "parent_conv_id")
    joined = summed.join(tops, "node", "left").join(endings(found), "node", "left")
    parent = F.when(col("depth") == 1, F.lit(top.least)).otherwise(F.coalesce("parent_conv_id", "conv_id"))
    return joined.select(
        "conv_id",
        "depth",
        F.when(col("depth") > 0, parent).cast("long").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.when(col("n_children") == 0, 1).otherwise(col("n_leaves")).cast("long").alias("n_leaves"),
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
