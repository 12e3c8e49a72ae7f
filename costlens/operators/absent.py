"""Anti join as the NOT IN of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits and buckets of the map that says which keys may be listed: 8 MB whatever the list's length.
BUCKETS = 2_048
BITS = BUCKETS * 32_768


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS)) + 1


def may_be_listed(key: Column, listed: DataFrame, name: str) -> Column:
    """False only where ``key`` surely isn't in ``listed[name]``.

    The listed keys' hashes set bits, combined before the shuffle; the map is one value of
    ``BITS`` bits, so the query that makes it runs once and no side is broadcast for it.  Over
    some 50 million listed keys most bits are set and the answer is mostly true, never wrong.
    """
    place = _place(F.col(name))
    buckets = listed.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    entries = F.map_from_entries(F.collect_list(F.struct("bucket", "bits")))
    every = F.transform(F.sequence(F.lit(1), F.lit(BUCKETS)), lambda b: F.col("found")[b.cast("bigint")])
    bits = buckets.agg(entries.alias("found")).select(every).scalar()
    at = F.bitmap_bit_position(_place(key)).cast("int")
    own = F.get(bits, (F.bitmap_bucket_number(_place(key)) - 1).cast("int"))
    octet = F.conv(F.hex(F.substring(own, F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(octet, at % 8) == 1, F.lit(False))


def rows_absent(
    df: DataFrame, key: str, listed: DataFrame, null_aware: bool = False, prefilter: bool = False
) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not NULL and not among ``listed[key]`` (J-02).

    By default NULLs in the list say nothing about other keys.  ``null_aware``
    follows SQL's ``NOT IN``: one NULL in the list leaves no rows at all.  Written
    as a plain anti join plus an uncorrelated EXISTS (one row, evaluated once),
    because ``NOT IN`` itself would broadcast the whole list.

    ``prefilter``  rows whose key has no bit in the list's map are absent and stay where
                   they are; only those that may be listed are shuffled to the exact anti
                   join.  It pays where rows are many and wide and few of them listed: the
                   map costs a job over the list, and ``df`` is read once for each branch.
    """
    known = listed.filter(F.col(key).isNotNull()).select(key).distinct()
    rows = df.filter(F.col(key).isNotNull())
    if prefilter:
        maybe = may_be_listed(F.col(key), known, key)
        doubtful = rows.filter(maybe).join(known, key, "left_anti")
        rest = rows.filter(~maybe).union(doubtful.select(*rows.columns))
    else:
        rest = rows.join(known, key, "left_anti")
    if null_aware:
        nulls = listed.filter(F.col(key).isNull()).select(key).limit(1)
        rest = rest.where(~nulls.exists())
    return rest
