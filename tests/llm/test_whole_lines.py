"""Line dedup against a plain template tree; it leaves no recurring line and takes no own one."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from costlens.llm import templates
from tests.llm import brute
from tests.llm.test_operators import ODD, counted, frame

DRAW = random.Random(5)


def own(n):
    """A sentence of ``n`` words that nothing else has."""
    return " ".join("".join(DRAW.choices("bcdfghklmnprstvz", k=9)) for _ in range(n)) + "."


def cleaned(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {r.row.doc_id: r.cleaned for r in templates.clean(docs, **options).collect()}


def test_shared_passages_go(spark):
    passages = [own(60) for _ in range(4)]
    rows = [(i, f"{own(60)} {x}") for i, x in enumerate(passages)]
    rows.append((7, " ".join([*passages, own(20)])))
    for spare in (False, True):  # four documents have parts of 7, it is a copy of none
        got = cleaned(spark, rows, spare_copies=spare)
        assert (got[7].n_recurring, got[7].n_dropped) == (4, 4)
        assert not any(x in got[7].clean for x in passages)
        assert all(got[i].clean == text for i, text in rows[:4])


def test_copies_lose_their_lines_unless_spared(spark):
    text = " ".join(own(20) for _ in range(8))
    rows = [(1, text), (2, text + " " + own(9)), (3, text), (3, text), (4, None), (None, text)]
    got = cleaned(spark, rows)
    assert got[1].clean == text and len(got[2].clean.split()) == 9
    assert got[3].clean == got[None].clean == ""
    assert not templates.drop_lines(spark.createDataFrame(rows[2:4] + rows[:1], "doc_id bigint, text string")).where("doc_id = 3").count()
    spared = cleaned(spark, rows, spare_copies=True)
    assert all(spared[i].clean == t and spared[i].n_dropped == 0 for i, t in rows if t)


def test_variable_fields_are_generalised(spark):
    log = "User logged {} in at noon from host {} behind the gate"
    rows = [(i, log.format(f"name{'abcd'[i]}", f"place{'wxyz'[i]}") + f"\n{own(30)}") for i in range(4)]
    rows += [(5, f"Chapter 1\n{own(30)}"), (6, f"Chapter 2\n{own(30)}")]
    rows += [(7, f"One two three four five six seven eight\n{own(9)}"), (8, f"One two three four other words are here\n{own(9)}")]
    got, texts = cleaned(spark, rows), dict(rows)
    assert [got[i].n_dropped for i in range(9) if i != 4] == [0, 1, 1, 1, 0, 1, 0, 0]
    assert all(got[i].clean == texts[i].split("\n")[1] for i in (1, 2, 3, 6))


def test_own_short_lines_between_recurring_ones_stay(spark):
    header, footer = own(12), own(12)
    verse = [own(4) for _ in range(100)]
    rows = [(1, f"{header}\n{footer}\n{own(30)}"), (2, "\n".join([header, *verse, footer]))]
    got = cleaned(spark, rows)
    assert (got[2].n_recurring, got[2].n_dropped) == (2, 2)
    assert got[2].clean == "\n".join(verse) + "\n"


def test_blank_lines_between_recurring_ones_go(spark):
    header, footer = own(12), own(12)
    rows = [(1, f"{header}\n{own(30)}\n{footer}"), (2, f"{header}\n\n \n{footer}\n\n{own(40)}")]
    got = cleaned(spark, rows)
    assert (got[2].n_recurring, got[2].n_dropped) == (2, 4)
    assert got[2].clean == rows[1][1].split(footer + "\n")[1]


def test_short_sentences_recur_one_by_one(spark):
    passage = " ".join(own(5) for _ in range(14))
    rows = [(1, f"{passage} {own(40)}"), (2, f"{own(40)} {passage}"), (3, f"Accept cookies\n{own(40)}")]
    rows += [(4, f"Accept cookies\n{own(30)}")]
    got, texts = cleaned(spark, rows), dict(rows)
    assert (got[2].n_recurring, got[2].n_dropped) == (14, 14)
    assert passage not in got[2].clean and texts[2].startswith(got[2].clean)
    assert got[4].clean == texts[4].split("\n")[1]
    assert all(got[i].clean == texts[i] for i in (1, 3))


def test_lines_and_tokens_go_together():
    draw = random.Random(2)
    for _ in range(200):
        texts = ["".join(draw.choices("ab1. \n\t!?é\x0b\r", k=draw.choice([0, 1, 5, 60]))) for _ in range(3)]
        found, want, hashes = templates.Lines(texts), [], {}
        for k, text in enumerate(texts):
            parts = templates.lines(text)
            assert "".join(parts) == text and parts == [x for x in brute.LINE.split(text) if x]
            masked = [b" ".join(templates.mask(x.encode()).split()) for x in parts]
            want += [(k, at, len(x.split()), x) for at, x in enumerate(masked) if x]
        rows = range(len(found.at))
        assert [(found.text[i], found.at[i], found.size[i], found.tokens[i]) for i in rows] == want
        for i in rows:
            own = want[i][3].split()
            assert hashes.setdefault(found.line[i], own) == own
            beginning = (len(own), own[:2]) if len(own) > 3 else own
            assert hashes.setdefault(("leaf", found.leaf[i]), beginning) == beginning


@pytest.mark.parametrize("leaf", [1000, 5])
def test_templates_equal_a_plain_tree(spark, leaf):
    """Many lines with one beginning, so small leaves are split several times."""
    words, rows = "abcdef", [*ODD]
    for i in range(40):
        parts = [" ".join(["go", "on", *DRAW.choices(words, k=DRAW.choice([1, 2, 4, 8]))]) for _ in range(8)]
        rows.append((20 + i, "\n".join(parts)))
    got = templates.clean(frame(spark, rows), leaf=leaf).select("row.doc_id", "cleaned.*").collect()
    assert counted((i, x or "", *rest) for i, x, *rest in got) == counted((i, *x) for (i, _), x in zip(rows, brute.clean(rows, leaf=leaf), strict=True))
    assert templates.clean(frame(spark, [], extra=False), leaf=leaf).count() == 0


def test_lines_of_a_crowded_leaf_are_generalised_too(spark):
    """Other lines with the same beginning, however many, change nothing."""
    log = "User logged {} in at noon from host {} behind the gate"
    rows = [(i, log.format(f"name{'abcd'[i]}", "x")) for i in range(4)]
    crowd = "\n".join(f"User logged {own(9)}" for _ in range(1100))
    alone, among = cleaned(spark, rows), cleaned(spark, [*rows, (9, crowd)])
    assert [alone[i].n_dropped for i in range(4)] == [among[i].n_dropped for i in range(4)] == [0, 1, 1, 1]
    assert among[9].clean == crowd


def test_an_indexed_leaf_equals_a_plain_one():
    for n, words in [(4, "abc"), (9, "abcd"), (12, "ab"), (17, "abcdefghij")] * 3:
        base = [DRAW.choices(words, k=n - 2) for _ in range(9)]
        some = {("go", "on", *[DRAW.choice(words) if DRAW.random() < 0.2 else x for x in DRAW.choice(base)]) for _ in range(200)}
        want, leaf, began = brute.tree(some, leaf=len(some)), templates.Leaf(n), []
        for line in sorted(some, key=lambda t: " ".join(t).encode()):
            t, begins = leaf.add(list(line))
            began += [line] if begins else []
            assert began[t] == want[line]


def test_a_copy_of_any_keeper_of_half_is_spared(spark):
    first, second = own(30), own(30)
    rows = [(1, first), (2, f"{first} {second}"), (3, f"{first} {second}")]
    got = cleaned(spark, rows + rows[2:], spare_copies=True)
    assert got[3].clean == rows[2][1] and got[3].n_dropped == 0
    assert got[2].n_dropped == 1


@pytest.mark.parametrize("spare", [False, True])
def test_whole_table(spark, sf_dir, spare):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = templates.clean(docs, spare_copies=spare).select("row.doc_id", "cleaned.*").collect()
    want = Counter((i, *x) for (i, _), x in zip(rows, brute.clean(rows, spare), strict=True))
    # an untouched text without any text is null, as it was
    assert Counter((i, x or "", *rest) for i, x, *rest in got) == want
    assert sum(r.n_dropped for r in got)


def test_other_columns_stay_as_they_are(spark):
    docs = frame(spark, ODD).withColumns({c: F.col("doc_id") * 2 for c in ("a.b", "_id", "_key", "_bits", "_bucket")})
    got = templates.drop_lines(docs)
    assert got.columns == docs.columns
    kept = {r.doc_id: r for r in docs.collect()}
    for r in got.collect():
        changed = {k: v for k, v in r.asDict().items() if v != kept[r.doc_id][k]}
        assert set(changed) <= {"text", "n_chars"}
