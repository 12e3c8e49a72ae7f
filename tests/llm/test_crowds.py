"""Regions in which many documents share passages but few are linked."""

import random

import pytest

from costlens.llm import jaccard
from tests.llm import brute

SCHEMA = "doc_id bigint, text string"


def shared_passages(n, some=6, of=20, words=60):
    draw = random.Random(n)
    new = lambda k: [f"w{draw.randrange(10**6)}" for _ in range(k)]
    head, passages = new(120), [new(words) for _ in range(of)]
    texts = []
    for _ in range(n):
        chosen = sorted(draw.sample(range(of), some))
        texts.append(" ".join(head + [w for j in chosen for w in passages[j]] + new(draw.randrange(6))))
    return list(enumerate(texts))


def edited(n):
    """Copies of one text with none to very many words changed, cut to several lengths."""
    draw = random.Random(n)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(draw.choice([0, 1, 2, 4, 8, 12])):
            words[draw.randrange(len(words))] = f"x{draw.randrange(40)}"
        rows.append((i, " ".join(words[: draw.choice([150, 140, 120, 90])])))
    return rows


def component_ids(spark, rows):
    got = jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    return {r.doc_id: r.component_id for r in got}


def test_compared_pairs_of_a_crowd(spark, monkeypatch):
    real, compared = jaccard.distances, []

    def counting(pairs, sets):
        compared.append(pairs.count())
        return real(pairs, sets)

    monkeypatch.setattr(jaccard, "distances", counting)
    rows = shared_passages(600)
    assert component_ids(spark, rows) == brute.components(rows)
    assert len(compared) == 2 and compared[1] < 50 * len(rows)  # of 300 a document


@pytest.mark.parametrize("rows", [edited(120), shared_passages(120, 3, 5, 12)], ids=["edited", "passages"])
def test_splitting_to_the_end(spark, monkeypatch, rows):
    monkeypatch.setattr(jaccard, "CROWD", 1)
    monkeypatch.setattr(jaccard, "SMALL_REGION", 1)
    monkeypatch.setattr(jaccard, "LEAST_GAIN", 0.95)
    rows = rows + [(7, rows[50][1]), (7, rows[7][1]), (9, "a b"), (10, ""), (1_000, None)]  # repeated ids
    assert component_ids(spark, rows) == brute.components(rows)


def test_ends_link_without_comparing(spark, monkeypatch):
    """Points whose common blocks use up their lists are linked by their sizes alone."""
    monkeypatch.setattr(jaccard, "SMALL_REGION", 0)
    monkeypatch.setattr(jaccard, "LEAST_GAIN", float("inf"))
    rows = shared_passages(60, 2, 3, 30)
    docs = spark.createDataFrame(rows, SCHEMA)
    nodes = docs.selectExpr("doc_id node")
    sets = jaccard.stored(jaccard.sets_of(docs, nodes), "sets")
    pairs, certain = jaccard.split(nodes.selectExpr("node", "node component"), sets)
    assert pairs.count() == 0
    joined = {r.node: r.component for r in jaccard.components(certain).collect()}
    assert {i: joined.get(i, i) for i, _ in rows} == brute.components(rows)
    wrong = jaccard.distances(certain, sets).where("not linked")
    assert wrong.count() == 0
