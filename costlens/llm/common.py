"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.scratch import scratch_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read again.

    Cuts the lineage: a lost executor costs a read, not a recomputation, and the
    planner knows the real size of what follows.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole(text: Column) -> Column:
    """The text; empty where it is null."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed."""
    only_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def pieces(text: Column, gap: str) -> Column:
    """What is left between matches of ``gap``, without empty strings."""
    return F.array_remove(F.split(text, gap), "")


def as_row(docs: DataFrame) -> Column:
    """All columns of a row as one struct ``row``, so helper columns beside it clash with none."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def of_row(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` again, from the struct ``row``."""
    return [F.col("row").getField(c).alias(c) for c in docs.columns]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def give_back() -> None:
    """Hands memory that Arrow and the C library keep for later back to the system.

    Workers outlive their tasks; what an idle one keeps is missing beside those at work.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's only
    if trim:
        trim(0)


def sparing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, with memory given back after each."""
    for batch in batches:
        yield batch
        give_back()


#: Characters a worker handles at once; one longer text is handled alone.
CHARS_AT_ONCE = 1_000_000


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Keys and whole texts (null: empty) of Arrow batches, in portions of bounded length."""
    for batch in batches:
        keys, texts, size = [], [], 0
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            keys.append(key.as_py())
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= CHARS_AT_ONCE:
                yield keys, texts
                keys, texts, size = [], [], 0
        if keys:
            yield keys, texts


#: Positions of the filter that spares rows without a partner a shuffle.
FILTER_BITS = 2**26


def maybe_in(rows: DataFrame, key: Column, partners: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``maybe``: false only where ``key`` surely isn't in ``partners[name]``.

    The partners' hashes set bits in a map of ``FILTER_BITS``, at most 8 MB whatever
    their number, which is what gets broadcast.  With very many partners it filters
    less; the exact join that follows gives the same result.
    """

    def at(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1

    own = at(F.col(name))
    bits = partners.groupBy(F.bitmap_bucket_number(own).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(own)).alias("_bits")
    )
    place = F.bitmap_bit_position(at(key)).cast("int")
    octet = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10)
    is_set = octet.cast("int").bitwiseAND(F.call_function("shiftleft", F.lit(1), place % 8)) != 0
    found = rows.join(F.broadcast(bits), F.bitmap_bucket_number(at(key)) == F.col("_bucket"), "left")
    return found.withColumn("maybe", F.coalesce(is_set, F.lit(False))).drop("_bucket", "_bits")


#: Bytes of text that a part of an ordered table takes, about.
PART_BYTES = 32 * 2**20
#: Stands for a missing id in an order; it comes first.
NO_ID = -(2**63)


class Order:
    """Cuts a table into parts that follow each other by id, then by the hash of the text.

    The cuts are quantiles of the ids (one pass over ids and text lengths, one number
    a part for the driver).  An id that fills several parts alone, or the missing
    one, is cut further by the hash, so no part grows with one id's rows unless these
    are equal.  There are as many parts as the text needs, and no fewer than
    ``spark.sql.shuffle.partitions``.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.id = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
        self.tie = F.xxhash64(F.col(f"`{text_col}`").cast("string"))
        size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0
        least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = max(least, math.ceil(size / PART_BYTES))
        steps = [i / parts for i in range(1, parts)]
        at = docs.select(self.id.alias("id")).approxQuantile("id", steps, 0.1 / parts) if steps else []
        most = 2**63 - 1
        cuts = []
        for bound, times in sorted(Counter(int(x) for x in at).items()):
            if times > 1:  # its rows are parts of their own
                cuts.append((max(bound - 1, NO_ID), most if bound > NO_ID else NO_ID))
                cuts += [(bound, NO_ID + 2**64 * k // times) for k in range(1, times)]
            cuts.append((bound, most))
        self.cuts = sorted(set(cuts))

    def _below(self, cuts: list[tuple[int, int]]) -> Column:
        ids, ties = longs([c[0] for c in cuts]), longs([c[1] for c in cuts])
        return F.arrays_zip(ids.alias("id"), ties.alias("tie"))

    def part(self) -> Column:
        """How many cuts lie below a row's place: first among every k-th, then among the k that follow."""
        if not self.cuts:
            return F.lit(0)
        k = math.isqrt(len(self.cuts)) + 1
        before = lambda c: (c["id"] < self.id) | ((c["id"] == self.id) & (c["tie"] < self.tie))
        passed = F.size(F.filter(self._below(self.cuts[::k]), before))
        rest = F.size(F.filter(F.slice(self._below(self.cuts), (F.greatest(passed, F.lit(1)) - 1) * k + 1, F.lit(k)), before))
        return F.when(passed > 0, (passed - 1) * k + rest).otherwise(0)


def longs(values: list[int]) -> Column:
    """An array of fixed numbers, one literal whatever their count."""
    if not values:
        return F.array().cast("array<bigint>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
