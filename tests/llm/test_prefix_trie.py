"""The prefix trie against sets of plain beginnings."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from costlens.llm import prefix_trie
from tests.llm import brute


def plain(convs):
    """Rows of the trie of (id, turns) pairs."""
    members = defaultdict(list)
    for i, turns in convs:
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(i)
    ends = defaultdict(list)
    for i, turns in convs:
        ends[tuple(turns)].append(i)
    out = []
    for node, ids in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        kids = sum(len(x) == len(node) + 1 for x in below)
        listed = brute.sha(",".join(map(str, sorted(ends.get(node, [])))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ids), len(node), parent, len(ids), kids, len(leaves), saved, listed))
    return sorted(out, key=repr)


def rows_of(convs):
    return [(i, n, *turn) for i, turns in convs for n, turn in enumerate(turns)]


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def trie(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    table = table.withColumns({c: F.lit(0) for c in ("node", "n", "nodes", "maybe", "together", "a.b", "start", "size")})
    return sorted(map(tuple, prefix_trie.trie(prefix_trie.turn_lists(table)).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_plain_beginnings(spark, seed):
    draw = random.Random(seed)
    convs = []
    for i in range(60):
        size = draw.choice([1, 2, 4, 5, 8, 9, 13])
        convs.append((i * 3, [(draw.choice(["user", "é"]), draw.choice(["", "hi", "ünd"])) for _ in range(size)]))
    convs += [(1000 + i, list(convs[0][1])) for i in range(50)]  # copies
    convs += [(2000 + i, [*convs[5][1], ("user", str(i))]) for i in range(50)]  # many children of one node
    convs.append((-7, convs[2][1][:3]))
    assert trie(spark, rows_of(convs)) == plain(convs)


def test_odd_turns(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "A"), (1, 0, "user", "A"), (None, 0, "user", "a"),
        (2, 5, "", ""), (2, 9, "user", "A"), (3, None, None, ""), (4, 0, "user", "z" * 1_000_000),
    ]
    a, z = ("user", "A"), ("user", "z" * 1_000_000)
    convs = [(1, [("", ""), a, a, ("user", "a")]), (2, [("", ""), a]), (3, [("", "")]), (4, [z])]
    assert trie(spark, rows) == plain(convs)
    assert trie(spark, []) == []


def test_conversations_without_turns_end_at_the_root(spark):
    lists = spark.createDataFrame([(5, []), (3, []), (4, None)], f"conv_id bigint, turns {prefix_trie.TURNS}")
    (row,) = prefix_trie.trie(lists).collect()
    assert tuple(row) == (3, 0, None, 3, 0, 1, 0, brute.sha("3,4,5"))


def test_many_ids_end_at_one_node(spark):
    n = 3 * prefix_trie.RUN + 5
    table = spark.range(n).select(
        F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("hi").alias("text")
    )
    rows = {r.depth: r for r in prefix_trie.trie(prefix_trie.turn_lists(table)).collect()}
    assert rows[1].ends_sha256 == brute.sha(",".join(map(str, range(n))))
    assert (rows[1].n_convs, rows[1].saved_tokens, rows[0].saved_tokens) == (n, 2 * (n - 1), 2 * (n - 1))


def test_only_parting_blocks_are_cut(spark):
    shared = [("user", str(i)) for i in range(8)]
    convs = [(i, [*shared, ("user", f"own {i}")]) for i in range(20)]
    lists = prefix_trie.turn_lists(spark.createDataFrame(rows_of(convs), SCHEMA))
    blocks = prefix_trie._blocks(prefix_trie.paths(lists)).collect()
    starts = [bytes(b.start) for b in blocks]
    assert len(blocks) == 22 and sum(starts.count(s) > 1 for s in set(starts)) == 1
