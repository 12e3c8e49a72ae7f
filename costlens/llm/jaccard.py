"""Exact Jaccard join of documents over word shingles, by pivots and regions.

The Jaccard distance is a metric.  Documents with equal sets are one point.  Points
that can be within the radius of each other meet in a region; every region has a
pivot, its most central point, and the distances to the pivot decide the rest by the
triangle inequality:

* points within the radius of the pivot are linked through it and need no comparing
  among themselves,
* two points whose distances to a common pivot differ by more than the radius can't
  be linked,
* what is left on both sides of a region's border is compared in the next round,
* where much is left, because points of one region share passages but few are linked,
  distances all lie within the radius of each other; such a crowd is split by further
  shared shingles, again and again, until its cells are small (``split``).

Voronoi cells of a few sampled documents can't carry this alone: unrelated texts
share no shingle, so their distance to nearly every pivot is 1 and each window would
copy them to every cell.  Regions are therefore keyed by shingles.  Shingles that no
other document has can't be shared; they come first in the order, frequent ones
last, and a document enters the regions of the first ``n - ceil(0.8 n) + 1`` of its
shingles in that order: two linked documents always meet in one of them.  Counts
cover all shingles of all documents, in 2 ** 44 hash buckets; counting several
shingles as one makes a bound weaker, never wrong.

Defined results: null and empty texts have an empty set and are linked with nothing;
a text of fewer than five words is one shingle; rows with the same id are one
document and share its component; rows without id have no component; an empty table
gives no rows; only the named columns are read, so other columns may have any names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.llm.common import UPPER, as_row, maybe_in, of_row, portions, sparing, stored

WORDS = 5
#: Two sets are linked when 100 * intersection >= LINK * union.
LINK = 80
RADIUS = 1 - LINK / 100
#: Shingles are counted by so many bits of their hash.
COUNTED_BITS = 44
#: From this count on a shingle is frequent; at most so many of them are sent out.
FREQUENT, MOST_FREQUENT = 32, 2**20
#: Bits of the map that says which shingles several documents may have (16 MB).
SHARED_BITS = 2**27
#: Regions of up to so many points are compared directly.
SMALL_REGION = 16
#: Points outside a region's main component that are compared with all of it; more are split.
CROWD = 64
#: A cell is split if so much of its pairs is left, or less.
LEAST_GAIN = 0.75
SALTS = 32

LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    words = [x.encode().translate(LOWER).split() for x in texts]
    counts = np.array([len(w) for w in words], np.int64)
    hashes = np.fromiter(
        (xxhash.xxh3_64_intdigest(w) for text in words for w in text), np.uint64, int(counts.sum())
    )
    factor = np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(max(len(hashes) - WORDS + 1, 0), np.uint64)
    for k in range(WORDS):
        rolled = rolled * factor + hashes[k : k + len(rolled)]
    rolled = _mixed(rolled)
    ends = np.cumsum(counts)
    sets = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= WORDS:
            sets.append(np.unique(rolled[end - n : end - WORDS + 1]))
        elif n:
            one = np.uint64(n)
            for h in hashes[end - n : end]:
                one = np.uint64((int(one) * int(factor) + int(h)) % 2**64)
            sets.append(_mixed(np.array([one])))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - COUNTED_BITS)).astype(np.int64)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def shingle_counts(docs: DataFrame) -> DataFrame:
    """Shingle buckets that several documents may share, with their counts."""

    def each(batches):
        for _, texts in portions(sparing(batches)):
            sets = shingle_sets(texts)
            if sets:
                found, n = np.unique(_bucket(np.concatenate(sets)), return_counts=True)
                yield pa.RecordBatch.from_arrays([_longs(found), _longs(n)], ["bucket", "n"])

    rows = docs.mapInArrow(each, "bucket bigint, n bigint")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > 1)


def _shared_map(counts: DataFrame) -> np.ndarray:
    """Which positions (bucket modulo SHARED_BITS) shared shingles have, as packed bits."""
    at = F.pmod("bucket", F.lit(SHARED_BITS)) + 1
    rows = (
        counts.groupBy(F.bitmap_bucket_number(at).alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
        .collect()  # SHARED_BITS / 8 bytes at most
    )
    bits = np.zeros((SHARED_BITS // 8 // 4096, 4096), np.uint8)
    for r in rows:
        bits[r.part - 1] = np.frombuffer(r.bits, np.uint8)
    return bits.ravel()


def _frequent(counts: DataFrame) -> np.ndarray:
    top = counts.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "bucket").limit(MOST_FREQUENT)
    table = top.select("bucket").toArrow()  # MOST_FREQUENT longs at most
    return np.sort(table.column(0).to_numpy())


def points(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Per document: set size, digest of the set, shingles others may have, regions."""
    context = docs.sparkSession.sparkContext
    shared_map = context.broadcast(_shared_map(counts))
    frequent = context.broadcast(_frequent(counts))

    def each(batches):
        bits, often = shared_map.value, frequent.value
        for ids, texts in portions(sparing(batches)):
            sizes, digests, most, regions = [], [], [], []
            for shingles in shingle_sets(texts):
                n = len(shingles)
                bucket = _bucket(shingles)
                at = bucket % SHARED_BITS
                shared = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                m = int(shared.sum())
                # The first places go to shingles of one document; they need no region.
                left = n - -(-n * LINK // 100) + 1 - (n - m)
                own = shingles[:0]
                if n and left > 0 and 100 * m >= LINK * n:
                    own, bucket = shingles[shared], bucket[shared]
                    near = np.searchsorted(often, bucket)
                    near[near == len(often)] = 0
                    last = often[near] == bucket if len(often) else np.zeros(m, bool)
                    own = own[np.argsort(last, kind="stable")[:left]]
                sizes.append(n)
                most.append(m)
                digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                regions.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(most, pa.int64()),
                    pa.array(regions, pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "digest", "m", "regions"],
            )

    return docs.mapInArrow(
        each, "doc_id bigint, n bigint, digest binary, m bigint, regions array<bigint>"
    )


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Whole sets of the documents in ``nodes``."""
    some = maybe_in(docs, F.col("doc_id"), nodes, "node").where("maybe").drop("maybe")
    some = some.join(nodes, some["doc_id"] == nodes["node"], "left_semi")

    def each(batches):
        for ids, texts in portions(sparing(batches)):
            sets = [x.view(np.int64) for x in shingle_sets(texts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"]
            )

    return some.mapInArrow(each, "node bigint, shingles array<bigint>")


def _can_link(a: str, b: str) -> Column:
    """Whether two points' counts leave room for a link: the shared part is at most m."""
    both = F.least(f"{a}.m", f"{b}.m")
    return 100 * both >= LINK * (F.col(f"{a}.n") + F.col(f"{b}.n") - both)


def _can_meet(a: str, b: str) -> Column:
    """Whether this can be the first region that two linked points have in common.

    Linked points share at least ``alpha`` shingles, of which at most ``m - o`` lie
    behind the regions of one of them; so they have ``t`` regions in common, and the
    first of these has at least ``t - 1`` behind it on either side.
    """
    alpha = F.ceil(F.lit(LINK) * (F.col(f"{a}.n") + F.col(f"{b}.n")) / F.lit(100 + LINK))
    behind = F.greatest(F.col(f"{a}.m") - F.col(f"{a}.o"), F.col(f"{b}.m") - F.col(f"{b}.o"))
    t = F.greatest(alpha - behind, F.lit(1))
    early = lambda x: F.col(f"{x}.place") <= F.col(f"{x}.o") - t
    return _can_link(a, b) & early(a) & early(b)


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact distance of each pair (a, b), and whether the two are linked."""
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    with_b = with_a.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    counted = with_b.select(
        "a", "b", both.alias("both"), (F.size("sa") + F.size("sb") - both).alias("either")
    )
    return counted.select(
        "a",
        "b",
        (1 - F.col("both") / F.col("either")).alias("distance"),
        (100 * F.col("both") >= LINK * F.col("either")).alias("linked"),
    )


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node in ``edges`` (a, b), by alternating stars.

    Each round hangs larger neighbours, then smaller ones, on the smallest neighbour;
    a hub's edges meet only in a minimum, so no node's edges are gathered anywhere.
    """
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        way = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = way.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("low").alias("a"), F.col("v").alias("b"))
        large = stored(large.distinct(), "large")
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(low, "b")
        hung = small.select(F.col("low").alias("a"), F.col("b")).union(
            small.where("a > low").select(F.col("low").alias("a"), F.col("a").alias("b"))
        )
        edges = stored(hung.distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    own = edges.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return own.distinct().union(edges.select(F.col("b").alias("node"), F.col("a").alias("component")))


def links(docs: DataFrame, found: DataFrame, first: DataFrame) -> DataFrame:
    """Edges that connect exactly what linked pairs connect, between points.

    One document stands for all with its set: ``first`` has its id, the smallest.
    """
    heads = found.where(F.size("regions") > 0).join(
        first.select("digest", F.col("node").alias("doc_id"), "node"), ["doc_id", "digest"]
    )
    entries = stored(
        heads.dropDuplicates(["digest", "node"]).select(
            "node", "n", "m", F.size("regions").alias("o"), F.posexplode("regions").alias("place", "region")
        ),
        "entries",
    )
    central = F.struct((F.col("m") / F.col("n")).alias("share"), (-F.col("node")).alias("order"))
    regions = entries.groupBy("region").agg(
        F.count("*").alias("points"), F.max_by("node", central).alias("pivot")
    )
    regions = regions.where("points > 1")
    inside = stored(entries.join(regions, "region"), "regions")

    small = inside.where(F.col("points") <= SMALL_REGION)
    pairs = small.alias("x").join(
        small.alias("y"),
        (F.col("x.region") == F.col("y.region")) & (F.col("x.node") < F.col("y.node")) & _can_meet("x", "y"),
    )
    pairs = stored(
        pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "pairs"
    )
    large = inside.where(F.col("points") > SMALL_REGION)
    tops = large.where(F.col("node") == F.col("pivot")).select("region", "n", "m", F.col("node").alias("top"))
    to_pivot = large.alias("x").join(
        tops.alias("y"),
        (F.col("x.region") == F.col("y.region")) & (F.col("x.node") != F.col("y.top")) & _can_link("x", "y"),
    )
    to_pivot = to_pivot.select(F.col("y.top").alias("a"), F.col("x.node").alias("b")).distinct()
    # In small regions each point first goes to its smallest possible neighbour.
    to_first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    nodes = stored(
        pairs.select(F.explode(F.array("a", "b")).alias("node")).union(large.select("node")).distinct(),
        "nodes",
    )
    sets = stored(sets_of(docs, nodes), "sets")
    near = stored(distances(to_pivot.union(to_first).distinct(), sets), "distances")

    # Second round: pairs across components that the pivots' distances don't rule out.
    known = components(near.where("linked").select("a", "b"))
    known = stored(nodes.join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "known")
    ca, cb = (known.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    across = pairs.join(ca, "a").join(cb, "b").where("ca <> cb").select("a", "b")
    further, certain = _across(large, known, near, sets)
    rest = across.union(further).distinct()
    rest = rest.join(near, ["a", "b"], "left_anti")
    more = distances(rest, sets).where("linked").select("a", "b")
    linked = known.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    return linked.union(more).union(certain)


def _across(large: DataFrame, known: DataFrame, near: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of large regions between points outside the main component and all others, and links.

    A ring is what lies ``RADIUS`` around a point's distance to the region's pivot;
    points outside it are further away than a link allows.  Regions with more than ``CROWD``
    points outside are split further instead.
    """
    d = near.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "distance")
    placed = large.where("node <> pivot").join(known, "node").join(d, ["pivot", "node"], "left")
    placed = stored(placed, "placed")
    shares = placed.groupBy("region", "component").agg(F.count("*").alias("k"))
    main = shares.groupBy("region").agg(
        F.max_by("component", F.struct("k", "component")).alias("main"),
        F.count("*").alias("parts"),
        (F.sum("k") - F.max("k")).alias("others"),
    )
    main = stored(main.where("parts > 1"), "main")
    outside = placed.join(main.where(F.col("others") <= CROWD), "region").where("component <> main")
    x, y = outside.alias("x"), placed.alias("y")
    ring = F.abs(F.col("x.distance") - F.col("y.distance")) <= RADIUS + 1e-9
    pairs = x.join(
        y,
        (F.col("x.region") == F.col("y.region"))
        & (F.col("x.component") != F.col("y.component"))
        & _can_meet("x", "y")
        & F.coalesce(ring, F.lit(True)),
    )
    a, b = F.col("x.node"), F.col("y.node")
    pairs = pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    crowded = main.where(F.col("others") > CROWD)
    if crowded.isEmpty():
        return pairs, pairs.limit(0)
    crowd = placed.join(crowded, "region", "left_semi").select("node", "component").distinct()
    further, certain = split(crowd, sets)
    return pairs.union(further), certain


def _blocks(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """Each point of a crowd as its list of blocks, rare and long ones first.

    A block is all shingles that the same points of the crowd have; a long one leaves a point
    little to skip.  ``upto[i]`` counts the shingles of the first i blocks; ``spare`` of
    them may be missing in a linked point.
    """
    members = sets.join(crowd, "node").withColumn("own", F.xxhash64("node", "shingles"))
    each = members.select("node", "own", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    # Sums over the same points are equal, also where a row of ``sets`` is repeated.
    again = F.xxhash64("own", F.lit(1))
    halves = [h for x in (F.col("own"), again) for h in (x.bitwiseAND(F.lit(2**32 - 1)), F.shiftrightunsigned(x, 32))]
    same = [f"s{i}" for i in range(len(halves))]
    met = each.groupBy("shingle").agg(F.count("*").alias("k"), *[F.sum(h).alias(s) for h, s in zip(halves, same, strict=True)])
    blocks = met.where("k > 1").groupBy("k", *same).agg(F.min("shingle").alias("shingle"), F.count("*").alias("w"))
    blocks = stored(blocks.select("shingle", "k", "w"), "blocks")
    lists = each.join(blocks, "shingle").groupBy("own").agg(
        F.first("node").alias("node"),
        F.first("component").alias("component"),
        F.first("n").cast("long").alias("n"),
        F.sort_array(F.collect_set(F.struct((F.col("k") / F.col("w")).alias("rank"), "shingle", "w"))).alias("blocks"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.array(F.lit(0).cast("long")).alias("all"))

    def add(so_far, block):
        total = so_far["sum"] + block["w"]
        return F.struct(total.alias("sum"), F.concat(so_far["all"], F.array(total)).alias("all"))

    lists = lists.select(
        "own", "node", "component", "n", F.col("blocks.shingle").alias("blocks"), F.aggregate("blocks", zero, add)["all"].alias("upto")
    )
    spare = F.element_at("upto", -1) - F.ceil(F.col("n") * LINK / F.lit(100))
    return stored(lists.withColumn("spare", spare.cast("long")).where("spare >= 0"), "lists")


def _further(cells: DataFrame, lists: DataFrame) -> DataFrame:
    """Every cell's points in the cells of the next block they may have in common, or of none.

    A point skips blocks only while it has shingles to spare; one that can skip all
    the rest also enters the cell's end.
    """
    rows = cells.join(lists.select("own", "blocks", "upto"), "own")
    skipped = lambda j: F.get("upto", j) - F.get("upto", F.col("at"))
    ways = F.filter(F.sequence("at", F.size("blocks")), lambda j: skipped(j) <= F.col("spare"))
    rows = rows.withColumn("j", F.explode(ways))
    block, j = F.get("blocks", F.col("j")), F.col("j")
    return rows.select(
        F.col("c1").alias("p1"),
        F.col("c2").alias("p2"),
        F.xxhash64("c1", F.coalesce(block, F.lit(0))).alias("c1"),
        F.xxhash64(F.lit(1), "c2", F.coalesce(block, F.lit(0))).alias("c2"),
        "own",
        "node",
        "component",
        "n",
        (j + 1).alias("at"),
        (F.col("spare") - skipped(j)).alias("spare"),
        (F.col("shared") + F.coalesce(F.get("upto", j + 1) - F.get("upto", j), F.lit(0))).alias("shared"),
        F.coalesce(F.element_at("upto", -1) - F.get("upto", j + 1), F.lit(0)).alias("rest"),
        (j == F.size("blocks")).alias("ended"),
        "pairs",
    )


def _compared(cells: DataFrame) -> DataFrame:
    """Pairs of each cell that are of two components and have room for a link."""
    x, y = cells.alias("x"), cells.alias("y")
    both = F.col("x.shared") + F.least("x.rest", "y.rest")
    found = x.join(
        y,
        (F.col("x.c1") == F.col("y.c1"))
        & (F.col("x.c2") == F.col("y.c2"))
        & (F.col("x.own") < F.col("y.own"))
        & (F.col("x.component") != F.col("y.component"))
        & (100 * both >= LINK * (F.col("x.n") + F.col("y.n") - both)),
    )
    a, b = F.col("x.node"), F.col("y.node")
    return found.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def split(crowd: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs to compare, and certain links, that connect what links connect in a crowd.

    Two linked points have a sequence of blocks in common, and each of them skips no more
    between these than it has to spare.  A cell holds the points that can have its
    sequence in common; it is split by the block that comes next, until few
    pairs of two components are left or splitting leaves over ``LEAST_GAIN`` of them.  At the
    end of a sequence the common part is known: points are linked if their sizes
    are small enough, which they then are with the smallest.
    """
    lists = _blocks(crowd, sets)
    none = F.lit(0).cast("long")
    cells = lists.select(
        none.alias("c1"), none.alias("c2"), "own", "node", "component", "n", F.lit(0).alias("at"), "spare",
        none.alias("shared"), none.alias("rest"), F.lit(float("inf")).alias("pairs"),
    )
    compared, certain = [], []
    while True:
        grown = stored(_further(cells, lists), "cells")
        ended = grown.where("ended")
        heads = ended.groupBy("c1", "c2").agg(F.min(F.struct("n", "node", "own")).alias("head"))
        ends = ended.join(heads, ["c1", "c2"]).where(
            (F.col("node") != F.col("head.node"))
            & (100 * F.col("shared") >= LINK * (F.col("n") + F.col("head.n") - F.col("shared")))
        )
        certain.append(stored(ends.select(F.col("head.node").alias("a"), F.col("node").alias("b")), "ends"))
        inner = grown.where(~F.col("ended"))
        k = F.col("k").cast("double")
        sizes = inner.groupBy("p1", "p2", "c1", "c2", "component").agg(F.count("*").alias("k"), F.first("pairs").alias("own"))
        sizes = sizes.groupBy("p1", "p2", "c1", "c2").agg(
            F.sum(k).alias("points"), ((F.sum(k) * F.sum(k) - F.sum(k * k)) / 2).alias("left"), F.first("own").alias("own")
        )
        sizes = stored(sizes.where("left > 0"), "sizes")
        gain = sizes.groupBy("p1", "p2").agg((F.sum("left") <= LEAST_GAIN * F.first("own")).alias("better"))
        gain = stored(gain, "gain")
        whole = gain.where(~F.col("better")).select(F.col("p1").alias("c1"), F.col("p2").alias("c2"))
        sizes = sizes.join(gain.where("better"), ["p1", "p2"], "left_semi")
        small = F.col("left") <= SMALL_REGION * F.col("points")
        fine = sizes.where(small).select("c1", "c2")
        compared += [
            stored(_compared(cells.join(whole, ["c1", "c2"], "left_semi")), "compared"),
            stored(_compared(inner.join(fine, ["c1", "c2"], "left_semi")), "compared"),
        ]
        coarse = sizes.where(~small).select("c1", "c2", F.col("left").alias("pairs"))
        if coarse.isEmpty():
            break
        cells = stored(inner.drop("pairs", "p1", "p2", "ended").join(coarse, ["c1", "c2"]), "cells")
    return reduce(DataFrame.union, compared).distinct(), reduce(DataFrame.union, certain).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, size of its set, and the smallest id it is connected to."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = stored(shingle_counts(docs), "counts")
    found = stored(points(docs, counts), "points")
    named = found.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    first = stored(
        named.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("k")), "first"
    )
    joined = components(_with_equal_ids(links(docs, named, first), named, first))
    # Only sets that several documents or a link share; one may be everywhere, hence salts.
    classes = first.join(joined, "node", "left").where((F.col("k") > 1) | F.col("component").isNotNull())
    classes = classes.select(
        "digest",
        F.coalesce("component", "node").alias("component"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    rows = found.select("doc_id", "n", "digest", salt.alias("salt"))
    own = F.coalesce("component", "doc_id")
    return rows.join(classes, ["digest", "salt"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), own).otherwise(F.col("doc_id")).alias("component_id"),
    )


def _with_equal_ids(edges: DataFrame, named: DataFrame, first: DataFrame) -> DataFrame:
    """``edges`` plus those between the sets of documents that repeat an id."""
    again = named.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y")
    several = named.join(again.select("doc_id"), "doc_id", "left_semi").select("doc_id", "digest").distinct()
    more = several.join(first, "digest").where("doc_id <> node")
    return edges.union(more.select(F.col("node").alias("a"), F.col("doc_id").alias("b")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the smallest id stays.

    Of rows that repeat an id one stays; rows without id all stay.
    """
    found = stored(near_duplicates(docs), "near_duplicates")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    special = stored(gone.union(again).distinct(), "special")
    rows = docs.select(as_row(docs), F.col("doc_id"))
    marked = maybe_in(rows, F.col("doc_id"), special, "doc_id")
    certain = ~F.col("maybe") | F.col("doc_id").isNull()
    # Only texts that may go are shuffled.
    doubtful = marked.where(~certain).select("row", "doc_id")
    kept = doubtful.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return marked.where(certain).select("row").union(kept.select("row")).select(*of_row(docs))
