"""Document fingerprints: threshold-scaled sketches of word shingles.

A text's shingles are its distinct runs of five words (all words, if there are fewer),
A-Z in lower case.  Its sketch keeps each shingle hash below a fixed share of the hash
space (``SHARE``), and the smallest hash where none is below, so only texts without
words have an empty one.  Whether a hash is kept doesn't depend on the text, so the
sketch of several texts together is the union of theirs (``merge``), and the part of
one text that lies in another is estimated without bias however unequal their lengths
(``containment``); ``likeness`` estimates the Jaccard similarity.

``edited`` pairs every document with the next one by ascending id.  Rows are cut into
parts that follow each other (``common.Order``); every part also gets the first row of
the next one, so the neighbour is found within the part, the last document's being
the first.  A text is shuffled once.

Defined results: null and empty texts have an empty sketch, and two empty sketches
have likeness and containment 1; texts of any length are sketched whole; rows without
id come first; rows of one id are ordered by the hash of their text, so equal rows are
neighbours; a single document is its own neighbour; an empty table gives no rows; only
the named columns are read, so other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costlens.llm.common import BLANKS, NO_ID, Order, ascii_lower, let, longs, pieces, whole

WORDS = 5
#: Share of the hash space whose hashes are kept.
SHARE = 1 / 8


def _hashes(text: Column) -> Column:
    """Hashes of all shingles, as 16 hex digits."""

    def of(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (WORDS - 1), F.lit(1)))
        shingle = lambda i: F.substring(F.md5(F.array_join(F.slice(words, i, WORDS), " ")), 1, 16)
        return F.when(F.size(words) > 0, F.transform(starts, shingle)).otherwise(F.array().cast("array<string>"))

    return let(pieces(ascii_lower(whole(text)), BLANKS), of)


def _scaled(hashes: Column, share: float) -> Column:
    """The hashes below the threshold, or the smallest; sorted."""
    threshold = F.lit(format(min(int(share * 2**64), 2**64 - 1), "016x"))

    def kept(all_: Column) -> Column:
        below = F.filter(all_, lambda h: h < threshold)
        smallest = F.filter(F.array(F.array_min(all_)), lambda h: h.isNotNull())
        return F.when(F.size(below) > 0, F.array_sort(F.array_distinct(below))).otherwise(smallest)

    return let(hashes, kept)


def sketch(text: Column, share: float = SHARE) -> Column:
    """The kept hashes of a text, sorted, as an array."""
    return _scaled(_hashes(text), share)


def merge(a: Column, b: Column, share: float = SHARE) -> Column:
    """The sketch of two texts' shingles together, from their sketches."""
    return _scaled(F.concat(a, b), share)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second one has, 0 to 1."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(both / F.size(a))


def fingerprint(kept: Column) -> Column:
    """A sketch as text."""
    return F.array_join(kept, ",")


def hashes_of(print_: Column) -> Column:
    """The sketch that a fingerprint was made of."""
    return F.filter(F.split(print_, ","), lambda x: x != "")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """Per document: id, text, ``print`` and the next document's ``next_text`` and ``next_print``."""
    order = Order(docs, id_col, text_col)
    text = whole(F.col(f"`{text_col}`").cast("string"))
    placed = docs.select(order.id.alias("id"), order.tie.alias("tie"), order.part().alias("part"))
    place = F.struct("id", "tie")
    first = {r.part: r.first for r in placed.groupBy("part").agg(F.min(place).alias("first")).collect()}
    used = sorted(first)  # a row a part
    last = max(used, default=-1)
    before = {p: used[i - 1] for i, p in enumerate(used)}
    at = lambda name: longs([getattr(first[p], name) if p in first else 0 for p in range(last + 1)])
    part = F.col("part")
    here = lambda values: F.get(values, part)
    is_first = (F.col("id") == here(at("id"))) & (F.col("tie") == here(at("tie")))
    own = F.struct(part.cast("long").alias("part"), F.lit(False).alias("guest"))
    guest = F.struct(
        here(longs([before.get(p, 0) for p in range(last + 1)])).alias("part"), F.lit(True).alias("guest")
    )
    rows = docs.select(
        order.id.alias("id"),
        order.tie.alias("tie"),
        order.part().alias("part"),
        text.alias("text"),
        fingerprint(sketch(text, share)).alias("print"),
    )
    rows = rows.select(
        "id", "tie", "text", "print", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))).alias("at")
    ).select("id", "tie", "text", "print", "at.part", "at.guest")
    following = Window.partitionBy("part").orderBy("guest", "id", "tie")
    found = rows.withColumns(
        {"next_text": F.lead("text").over(following), "next_print": F.lead("print").over(following)}
    )
    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType
    known = F.when(F.col("id") != NO_ID, F.col("id")).cast(kind)
    return found.where(~F.col("guest")).select(known.alias(id_col), "text", "print", "next_text", "next_print")


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last half replaced by as much of the next one's beginning."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(next_text, F.lit(1), half))
