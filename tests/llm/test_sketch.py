"""Scaled sketches: estimates, unions, neighbours, odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from costlens.llm import common, sketch
from costlens.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.test_operators import ODD, counted, frame


def plain_sketch(text, share=sketch.SHARE):
    hashes = {hashlib.md5(" ".join(s).encode()).hexdigest()[:16] for s in brute.shingles(text)}
    below = sorted(h for h in hashes if int(h, 16) < share * 2**64)
    return below or sorted(hashes)[:1]


def plain_likeness(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_rows(rows):
    """Rows of the query; no two rows of one id with different texts."""
    rows = [(i, t or "") for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    out = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        own, other, later = map(plain_sketch, (text, changed, following))
        near = plain_likeness(own, other), plain_likeness(own, later)
        out.append((i, len(text), brute.sha(changed), ",".join(own), ",".join(other), *near))
    return out


def test_query_on_odd_rows(spark, tmp_path):
    few = [(5, "one single document of eight words or so")]
    hot = [*[(3, "all the same words in each of these rows")] * 50, (-4, "é🙂" * 9), (2**60, "x y z"), (7, None)]
    for k, rows in enumerate((ODD, few, hot, [])):
        frame(spark, rows).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        got = [tuple(r)[:7] for r in QUERIES["op13_scaled_sketch"](spark, f"{tmp_path}/{k}").collect()]
        assert counted(got) == counted(plain_rows(rows))


def test_rows_of_one_id_are_spread(spark):
    texts = [f"text number {i} of a great many" for i in range(2000)]
    rows = [(None if i % 3 == 0 else 8 if i % 3 == 1 else i, t) for i, t in enumerate(texts)]
    docs = frame(spark, rows)
    order = common.Order(docs, "doc_id", "text")
    placed = docs.select(order.id.alias("id"), order.tie.alias("tie"), order.part().alias("part")).collect()
    assert max(sum(r.part == p for r in placed) for p in range(30)) < 2 * 2000 / 8
    by_place = sorted(placed, key=lambda r: (r.id, r.tie))
    assert [r.part for r in by_place] == sorted(r.part for r in placed)
    found = sketch.with_next(docs).collect()
    assert counted(r.text for r in found) == counted(texts) == counted(r.next_text for r in found)
    assert sum(r.doc_id is None for r in found) == 667


def test_estimates_and_unions(spark):
    draw = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    long = draw.choices(words, k=8000)
    short = long[1000:1600] + draw.choices(words, k=400)
    pairs = [(" ".join(long), " ".join(short)), (" ".join(short), " ".join(short[:700])), ("", ""), ("", "a b"), ("a b", "a b")]
    a, b = sketch.sketch(F.col("a")), sketch.sketch(F.col("b"))
    rows = spark.createDataFrame(pairs, "a string, b string").select(
        a.alias("a"), b.alias("b"), sketch.merge(a, b).alias("both"), sketch.likeness(a, b).alias("likeness"),
        sketch.containment(b, a).alias("contained"), sketch.hashes_of(sketch.fingerprint(a)).alias("again"),
    )
    for (x, y), r in zip(pairs, rows.collect(), strict=True):
        assert r.a == r.again == plain_sketch(x)
        one, two = brute.shingles(x), brute.shingles(y)
        joint = {hashlib.md5(" ".join(s).encode()).hexdigest()[:16] for s in one | two}
        below = sorted(h for h in joint if int(h, 16) < sketch.SHARE * 2**64)
        assert r.both == (below or sorted(joint)[:1])
        assert r.likeness == pytest.approx(plain_likeness(one, two), abs=0.05)
        assert r.contained == pytest.approx(len(one & two) / len(two) if two else 1.0, abs=0.12)
