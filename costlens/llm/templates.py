"""Line dedup by a log-template tree.

A line is what a newline or the end of a sentence closes.  Its tokens are routed by
their number and the first ``LEAD`` of them, runs of digits masked; what ends at one
leaf is parsed into templates.  Distinct lines of a leaf are taken in the order of
their text: a line joins the template with which most places agree, at least
``AGREE`` of all, and the places that differ become open; else it begins a template.
Lines of fewer than four tokens can't differ and agree, so they meet by equal tokens.

A first pass combines hashes by leaf: smallest and largest id and line.  Only leaves with
several lines of several documents are read again as text, as distinct lines with
the smallest and the largest id that has them.  They stream through a task in the order of
their text, which holds a leaf's templates only; of many templates an index by equal blocks
of places names those that a line can join (``Leaf``), so leaves of any size give
what comparing with every template would.  ``leaf`` asks for another tree: leaves with more distinct lines
are split by further tokens, and places they were split by stay closed.

A template is recurring when two documents have it.  The document with the smallest
id keeps its lines; all others lose theirs, copies included, together with lines
without any word that lost ones enclose.  With ``spare_copies`` a document whose exact
Jaccard similarity links it with one that keeps half of its words or more
stays whole, for a near-duplicate stage that follows.

Defined results: null and empty texts have no lines and stay as they are; a text of any
length is one row; documents without id never keep a line, nor make one recurring;
rows of one id are one document, and repeated rows get equal results; an empty table
gives no rows; only the named columns are read, so other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cached_property
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.llm import jaccard
from costlens.llm.common import FILTER_BITS, maybe_in, portions, stored, whole

#: Leading tokens of the tree.
LEAD = 2
#: Places of a line that must agree with its template, in quarters of all.
AGREE = 3
WORD = re.compile(r"[^\x20\x09-\x0D]")
#: A code point that no text in UTF-8 has.
CUT = "\udcff"


def lines(text: str) -> list[str]:
    """The lines of a text; joined, they are the text."""
    for end in ". ", "! ", "? ":
        text = text.replace(end, f"{end[0]}{CUT} ")
    return [x for x in text.replace("\n", f"\n{CUT}").split(CUT) if x]


#: All digits become 0, and then a run of them one.
ZERO = bytes.maketrans(b"123456789", b"000000000")


def mask(data: bytes) -> bytes:
    """``data`` with 0 for each run of digits."""
    data = data.translate(ZERO)
    while b"00" in data:
        data = data.replace(b"00", b"0")
    return data


def needed(n: int) -> int:
    """Places in which a line of ``n`` tokens must agree with its template."""
    return (AGREE * n + 3) // 4


#: White space within a line; words of this library end at \x20 and \x09 to \x0d.
BLANK = bytes.maketrans(b"\t\x0b\x0c\r", b"    ")


class Lines:
    """The lines with a word of some texts: which text, which line of it, number of tokens,
    leaf, hash, and the masked tokens.  Lines that have to be equal to meet are leaves of their own."""

    def __init__(self, texts: list[str]):
        parts, n = [], []
        for x in texts:
            data = mask(x.encode())
            # the space after an end would only be stripped
            for end in (b".", b"!", b"?"):
                data = data.replace(end + b" ", end + b"\n")
            data = data.translate(BLANK)
            while b"  " in data:
                data = data.replace(b"  ", b" ")
            data = data.replace(b"\n ", b"\n").replace(b" \n", b"\n").strip(b" ")
            own = data.split(b"\n")
            parts += own
            n.append(len(own))
        n = np.array(n, np.int64)
        filled = np.fromiter(map(bool, parts), bool, len(parts))
        self.text = np.repeat(np.arange(len(n)), n)[filled]
        self.at = (np.arange(len(parts)) - np.repeat(n.cumsum() - n, n))[filled]
        self.tokens = [*filter(None, parts)]
        self.size = np.fromiter([x.count(b" ") + 1 for x in self.tokens], np.int64, len(self.tokens))
        self.line = np.fromiter(map(xxhash.xxh64_intdigest, self.tokens), np.uint64, len(self.tokens))

    def leaves(self, some: np.ndarray) -> np.ndarray:
        """The leaves of the lines ``some``."""
        digest, tokens, n = xxhash.xxh64_intdigest, self.tokens, self.size[some]
        out = self.line[some]
        open_ = np.flatnonzero((AGREE * n + 3) // 4 < n)
        found = []
        for i, k in zip(some[open_].tolist(), n[open_].tolist(), strict=True):
            words = tokens[i]
            found.append(digest(words[: words.find(b" ", words.find(b" ") + 1)], k))
        out[open_] = np.array(found, np.uint64)
        return out

    @cached_property
    def leaf(self) -> np.ndarray:
        return self.leaves(np.arange(len(self.tokens)))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def _each_text(batches):
    """Ids, hashes of texts and ``Lines`` of portions of rows (doc_id, version, text)."""
    for batch in batches:
        ids = batch.column(0)
        versions = batch.column(1).to_pylist()
        done = 0
        for _, texts in portions([pa.RecordBatch.from_arrays([ids, batch.column(2)], ["id", "text"])]):
            stop = done + len(texts)
            yield ids.slice(done, len(texts)), versions[done:stop], Lines(texts)
            done = stop


def _leaves(docs: DataFrame) -> DataFrame:
    """Leaves that two documents reach: smallest and largest id, smallest and largest line."""

    def each(batches):
        for ids, _, own in _each_text(batches):
            rows = [ids.take(pa.array(own.text)), _signed(own.leaf), _signed(own.line)]
            yield pa.RecordBatch.from_arrays(rows, ["doc_id", "leaf", "line"])

    found = docs.mapInArrow(each, "doc_id bigint, leaf bigint, line bigint").groupBy("leaf")
    found = found.agg(
        F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), F.min("line").alias("line"), F.max("line").alias("other")
    )
    return stored(found.where("keeper < last"), "leaves")


def _bits(keys: DataFrame, name: str) -> bytes:
    """A map of ``FILTER_BITS`` with the positions of ``keys[name]`` set (8 MB)."""
    place = F.pmod(F.col(name), F.lit(FILTER_BITS)) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    out = bytearray(FILTER_BITS // 8)
    for r in rows.collect():  # 2,048 at most
        at = (r.bucket - 1) * len(r.bits)
        out[at : at + len(r.bits)] = r.bits
    return bytes(out)


def _among(bits: bytes, keys: np.ndarray) -> np.ndarray:
    """Which of the keys may be in the map."""
    place = keys & np.uint64(FILTER_BITS - 1)
    octets = np.frombuffer(bits, np.uint8)[place >> np.uint64(3)]
    return np.flatnonzero(octets >> (place & np.uint64(7)).astype(np.uint8) & 1)


def _members(docs: DataFrame, leaves: DataFrame) -> DataFrame:
    """Distinct lines of the given leaves, with the smallest and the largest id that has
    them.  Lines of a few more leaves may pass; they do no harm."""
    shared = docs.sparkSession.sparkContext.broadcast(_bits(leaves, "leaf"))

    def each(batches):
        for ids, _, own in _each_text(batches):
            some = _among(shared.value, own.leaf)
            words = pa.array([own.tokens[i].decode() for i in some.tolist()], pa.string())
            rows = [ids.take(pa.array(own.text[some])), _signed(own.leaf[some]), _signed(own.line[some]), words]
            yield pa.RecordBatch.from_arrays(rows, ["doc_id", "leaf", "line", "words"])

    found = docs.mapInArrow(each, "doc_id bigint, leaf bigint, line bigint, words string")
    return found.groupBy("leaf", "line", "words").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"))


def _split(members: DataFrame, leaf: int) -> DataFrame:
    """``members`` with ``key``: the leaf, split by further tokens where it is large."""
    done, depth, step = None, LEAD, 1
    rest = members.withColumn("key", F.col("leaf"))
    while True:
        rest = stored(rest, "leaves")
        large = rest.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > leaf).select("key")
        if large.isEmpty():
            return rest if done is None else done.union(rest)
        marked = rest.join(large.withColumn("large", F.lit(True)), "key", "left")
        small = marked.where("large is null").drop("large")
        done = small if done is None else done.union(small)
        further = F.slice(F.split("words", " "), depth + 1, step)
        rest = marked.where("large").drop("large").withColumn("key", F.xxhash64("key", further))
        depth, step = depth + step, 2 * step


#: Templates of a leaf up to which a line is compared with all of them.
FEW = 12


class Leaf:
    """Templates of lines that have one length and beginning, taken one after the other.

    A line that can join a template differs from it, open places included, in no more than
    ``spare`` places, so among any ``spare + 1`` places they have one in common.  Once there are more
    than ``FEW`` templates an index holds those with a token at a place, and a line looks at
    the places where fewest templates have its token.
    """

    def __init__(self, n: int):
        self.least, self.templates, self.index = needed(n), [], None
        self.spare = n - self.least
        self.places = range(LEAD, n)
        self.known: dict[str, int] = {}
        self.table = np.empty((0, n), np.int64)

    def _enter(self, t: int) -> None:
        row = self.templates[t]
        for i in self.places:
            if row[i] is not None:
                self.index.setdefault((i, row[i]), set()).add(t)
        if t >= len(self.table):
            more = np.full((len(self.table) + FEW, self.table.shape[1]), -1, np.int64)
            self.table = np.concatenate([self.table, more])
        self.table[t] = [-1 if x is None else self.known.setdefault(x, len(self.known)) for x in row]

    def _nearest(self, row: list[str]) -> tuple[int, int]:
        """The template with which most places agree, the first of several, and their number."""
        if len(self.templates) <= FEW:
            agree = [sum(map(eq, places, row)) for places in self.templates]
            best = agree.index(max(agree)) if agree else 0
            return best, agree[best] if agree else -1
        if self.index is None:
            self.index = {}
            for t in range(len(self.templates)):
                self._enter(t)
        having = sorted((self.index.get((i, row[i]), ()) for i in self.places), key=len)
        some = set().union(*having[: self.spare + 1])
        if not some:
            return 0, -1
        some = np.array(sorted(some))
        # a token that no template has yet agrees with nothing, like an open place
        agree = (self.table[some] == [self.known.get(x, -2) for x in row]).sum(1)
        best = int(agree.argmax())
        return int(some[best]), int(agree[best])

    def add(self, row: list[str]) -> tuple[int, bool]:
        """The number of the template that a line joins or begins, and whether it begins it."""
        best, agree = self._nearest(row)
        if agree >= self.least:
            places = self.templates[best]
            opened = [i for i, (a, b) in enumerate(zip(places, row, strict=True)) if a is not None and a != b]
            if self.index is not None and opened:
                self.table[best, opened] = -1
                for i in opened:
                    self.index[i, places[i]].discard(best)
            for i in opened:
                places[i] = None
            return best, False
        self.templates.append(list(row))
        if self.index is not None:
            self._enter(len(self.templates) - 1)
        return len(self.templates) - 1, True


TEMPLATE = "leaf bigint, line bigint, keeper bigint, last bigint, template bigint"


def _templates(members: DataFrame) -> DataFrame:
    """Lines that share a template with others or recur themselves, with their ids, and the line that began it."""

    def each(batches):
        key = leaf = None
        for batch in batches:
            out = []
            for k, words, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                places = words.split(" ")
                if leaf is None or k != key:
                    key, leaf, began, waiting = k, Leaf(len(places)), [], {}
                t, begins = leaf.add(places)
                if begins:
                    began.append(row[1])
                    waiting[t] = row
                first = waiting.get(t)
                if first and (not begins or row[2] is not None and row[2] < row[3]):
                    out.append((*waiting.pop(t), began[t]))
                if not begins:
                    out.append((*row, began[t]))
            yield _template_batch(out)

    # lines of one leaf have as many tokens, also where a leaf is split
    ordered = members.repartition("key").sortWithinPartitions("key", "words")
    return ordered.select("key", "words", "leaf", "line", "keeper", "last").mapInArrow(each, TEMPLATE)


def _template_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in TEMPLATE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names)


def _recurring_lines(docs: DataFrame, leaf: int | None) -> DataFrame:
    """Lines whose template two documents have: leaf, hash, and the smallest id of the template."""
    leaves = _leaves(docs)
    alone = leaves.where("line = other").select("leaf", "line", "keeper")
    members = _members(docs, leaves.where("line <> other"))
    members = members.withColumn("key", F.col("leaf")) if leaf is None else _split(members, leaf)
    joined = stored(_templates(members), "templates")
    ranges = joined.groupBy("leaf", "template").agg(F.min("keeper").alias("keeper"), F.max("last").alias("last"))
    general = joined.drop("keeper", "last").join(ranges.where("keeper < last"), ["leaf", "template"])
    found = alone.union(general.select(*alone.columns))
    return stored(found.groupBy("leaf", "line").agg(F.min("keeper").alias("keeper")), "recurring")


HITS = "doc_id bigint, version bigint, words int, at int, size int, leaf bigint, line bigint"


def _hits(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The lines that other documents keep: document, its number of words, place, size and keeper."""
    shared = docs.sparkSession.sparkContext.broadcast(_bits(found, "line"))
    names = [x.split()[0] for x in HITS.split(", ")]

    def each(batches):
        for ids, versions, own in _each_text(batches):
            total = np.bincount(own.text, own.size, minlength=len(versions)).astype(np.int32)
            some = _among(shared.value, own.line)
            of = own.text[some]
            rows = [ids.take(pa.array(of)), pa.array(np.array(versions, np.int64)[of]), pa.array(total[of])]
            rows += [pa.array(own.at[some].astype(np.int32)), pa.array(own.size[some].astype(np.int32))]
            rows += [_signed(own.leaves(some)), _signed(own.line[some])]
            yield pa.RecordBatch.from_arrays(rows, names)

    rows = docs.mapInArrow(each, HITS).join(found, ["leaf", "line"])
    return rows.where(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("keeper")))


def _node():
    return F.xxhash64("doc_id", "version")


def lost_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    spare_copies: bool = False,
    leaf: int | None = None,
) -> DataFrame:
    """Per document that has any: the places of the lines it loses.  ``version`` is its text's hash."""
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    hits = _hits(docs, _recurring_lines(docs, leaf))
    if spare_copies:
        hits = stored(hits, "hits")
        # Every document that keeps half of this one's words or more; two may, with half each.
        own = F.collect_set(F.struct("at", "size"))  # a repeated row has each line once
        words = F.aggregate(own, F.lit(0), lambda n, x: n + x["size"])
        shared = hits.groupBy("doc_id", "version", "words", "keeper").agg(words.alias("shared"))
        near = shared.where(2 * F.col("shared") >= F.col("words"))
        copies = _copies(docs, stored(near.select(_node().alias("b"), F.col("keeper").alias("original")), "near"))
        hits = hits.withColumn("b", _node()).join(copies, "b", "left_anti")
    return stored(hits.groupBy("doc_id", "version").agg(F.collect_set("at").alias("lost")), "lost")


def _copies(docs: DataFrame, near: DataFrame) -> DataFrame:
    """The nodes ``b`` of ``near`` that are linked with a text of their ``original``."""
    originals = docs.select(F.col("doc_id").alias("original"), _node().alias("a"))
    some = maybe_in(originals, F.col("original"), near, "original").where("maybe")
    pairs = stored(near.join(some, "original").select("a", "b").distinct(), "pairs")
    nodes = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    texts = docs.select(_node().alias("doc_id"), "text")
    sets = stored(jaccard.sets_of(texts, nodes).dropDuplicates(["node"]), "sets")
    return jaccard.distances(pairs, sets).where("linked").select("b").distinct()


def _cut(text: str, lost: Iterable[int]) -> tuple[str, int, int]:
    """The text without lost lines; recurring and dropped lines."""
    parts = lines(text)
    gone = [False] * len(parts)
    for i in lost:
        gone[i] = True
    n_recurring, last = sum(gone), None
    for i, x in enumerate(parts):  # blank lines enclosed by lost ones go with them
        if gone[i]:
            if last is not None:
                gone[last + 1 : i] = [True] * (i - last - 1)
            last = i
        elif WORD.search(x):
            last = None
    kept = "".join(x for x, out in zip(parts, gone, strict=True) if not out)
    return kept, n_recurring, sum(gone)


CLEANED = "clean string, n_recurring bigint, n_dropped bigint"


def _cleaned(texts: pd.Series, lost: pd.Series) -> pd.DataFrame:
    rows = [_cut(t, x) for t, x in zip(texts, lost, strict=True)]
    return pd.DataFrame(rows, columns=["clean", "n_recurring", "n_dropped"])


def clean(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    spare_copies: bool = False,
    leaf: int | None = None,
) -> DataFrame:
    """All rows as a struct ``row``, and ``cleaned``: the text without recurring lines, and
    the numbers of recurring and dropped lines."""
    lost = lost_lines(docs, id_col, text_col, spare_copies, leaf).select(
        _node().alias("_key"), F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "lost"
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("version"),
    ).withColumn("key", _node())
    # Only texts that may have lost lines are shuffled.
    rows = maybe_in(rows, F.col("key"), lost, "_key")
    same = (
        (F.col("key") == F.col("_key"))
        & F.col("doc_id").eqNullSafe(F.col("_id"))
        & (F.col("version") == F.col("_version"))
    )
    joined = rows.where("maybe").join(lost, same, "left")
    text, zero = F.col("row").getField(text_col), F.lit(0).cast("long")
    untouched = F.struct(text.alias("clean"), zero.alias("n_recurring"), zero.alias("n_dropped"))
    changed = F.pandas_udf(_cleaned, CLEANED)(whole(text), F.coalesce("lost", F.array().cast("array<int>")))
    # one branch for both, or the texts would be shuffled twice
    cut = joined.select("row", F.when(F.col("lost").isNull(), untouched).otherwise(changed).alias("cleaned"))
    return rows.where("not maybe").select("row", untouched.alias("cleaned")).union(cut)


def drop_lines(docs: DataFrame, spare_copies: bool = False) -> DataFrame:
    """``docs`` with cleaned texts; rows that lost every word go."""
    done = clean(docs, spare_copies=spare_copies)
    text = F.col("cleaned.clean")
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns]
    columns[docs.columns.index("text")] = text.alias("text")
    if "n_chars" in docs.columns:
        columns[docs.columns.index("n_chars")] = F.length(text).cast("long").alias("n_chars")
    return done.where((F.col("cleaned.n_dropped") == 0) | text.rlike(r"[^\x20\x09-\x0D]")).select(*columns)
