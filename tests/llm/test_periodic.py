"""Periodic runs against a plain search over all periods."""

import random
import zlib

from pyspark.sql import functions as F

from costlens.llm import periodic
from costlens.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.test_operators import ODD, both, counted, documents, frame


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(12, 2 * q):
                stop = start + length
                if not any(q % k == 0 and words[start : stop - k] == words[start + k : stop] for k in range(1, q)):
                    out.append((start, length, q))
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def odd_texts():
    draw = random.Random(4)
    fibonacci = ["a", "b"]
    while len(fibonacci[-1]) < 600:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    texts = [" ".join(fibonacci[-1]), "x " * 1000, "a b " * 6, "a b " * 5 + "a", "a b " * 5 + "a b", "ü\x0bü\t" * 9]
    for size in (30, 200, 700):
        for letters in ("ab", "abc", "abcdefgh"):
            words = draw.choices(letters, k=size)
            at, period = draw.randrange(size // 2), 1 + size // draw.choice([4, 5, 9])
            texts.append(" ".join(w if i < at else words[at + (i - at) % period] for i, w in enumerate(words)))
            texts.append(" ".join(draw.choices(letters, k=size)))
    return texts


def test_runs_equal_a_plain_search(spark):
    rows = [*ODD, *((100 + i, t) for i, t in enumerate(odd_texts()))]
    for docs, own in ((frame(spark, rows), rows), (frame(spark, [], extra=False), [])):
        got = periodic.periodic_runs(docs).collect()
        found = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got]
        want = []
        for i, text in own:
            words = brute.WORD.findall(text or "")
            runs = plain_runs(words)
            want.append((i, len(words), runs, collapsed(words, runs)))
        assert counted(found) == counted(want)


def test_a_sum_that_only_vanishes_modulo_the_prime_is_no_run():
    # 49 * 13 more words than the prime allows would be needed in a text; ids are given by hand
    import numpy as np

    ids = np.arange(40)
    ids[20:22] = [0, 1]
    ids[20] = 0
    assert len(periodic.find_runs(ids, 40)) == 0
    block, lag = periodic._occurrences(np.array([0, 0, periodic.PRIME, 0, 7, 7, 7, 7, 7, 7, 7, 7], np.uint64), np.array([0]), 2, 1, 4)
    runs = {}
    periodic._extend(np.array([0, 0, periodic.PRIME, 0, 7, 7, 7, 7, 7, 7, 7, 7]), 4, block, lag, 2, runs)
    assert len(lag) and not runs


def test_longest_run_prefers_the_first_then_the_shorter_period(spark):
    kind = "runs array<struct<start:bigint,length:bigint,period:bigint>>"
    rows = [([(9, 20, 3), (4, 20, 7), (4, 20, 5), (0, 12, 1)],), ([],)]
    got = spark.createDataFrame(rows, kind).select(periodic.longest(F.col("runs")).alias("x")).collect()
    assert [r.x and tuple(r.x) for r in got] == [(4, 20, 5), None]


def test_query_equals_a_plain_search(spark, sf_dir, tmp_path):
    rows = [(i * 10 + k, t) for i, (_, t) in enumerate(ODD) for k in range(10)] + [(None, "a b " * 20), (-10, "a " * 20)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    for folder, own in ((str(tmp_path), rows), (sf_dir, documents(spark, sf_dir)[1][:60])):
        want = {}
        for i, text in own:
            words = brute.WORD.findall(text or "")
            h = zlib.crc32(str(i).encode()) if i is not None else 1
            n, g = len(words), h // 10
            if h % 10 == 0 and n:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
            if n > 1500:
                continue  # the plain search is quadratic
            runs = plain_runs(words)
            best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
            report = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
            want[i] = (len(runs), *report, brute.sha(listed), brute.sha(collapsed(words, runs)), n)
        got = QUERIES["op11_periodic_runs"](spark, folder).collect()
        found = {r.doc_id: tuple(r)[1:] for r in got if r.doc_id in want}
        assert found == want and len(want) > 20


def test_keys_of_any_type_and_name(spark, sf_dir):
    for docs, rows in both(spark, sf_dir):
        renamed = docs.select(F.col("doc_id").cast("string").alias("a.b"), F.col("text").alias("id"))
        assert periodic.periodic_runs(renamed, "a.b", "id").count() == len(rows)
