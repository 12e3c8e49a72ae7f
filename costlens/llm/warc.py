"""WARC archives with a two-level capture index.

Records are written with Spark's text writer (a record ends with the separator the
format asks for), so any file system and a repeated task are fine.  The index reads the
headers of archives, also of others' uncompressed ones, and sorts capture keys (reversed host
first, from target and record id) into compressed blocks.  A task appends its blocks to a file
with a name of its own; the sparse directory (first and last key, file, place and
length of each block) is a table that only names files of tasks that succeeded.

A lookup finds the part of a key by binary search over the parts' first keys, its blocks by
binary search in the part's directory, and its entries by binary search in the block.  Only blocks
that may hold an asked key are read, once each.  The places found are sorted by file, and
neighbouring records are read together, with one open file.

Of records with equal payloads of at least ``LEAST_BYTES`` the one with the smallest
page id is a response and the others revisit it.

Defined results: a null payload is empty; a null url has an empty target; rows that
repeat a page id and payload are equal records; rows that repeat page id and url are
found together, however many blocks they fill; pages without id are always responses; a
payload of any length is one record; an empty table writes no record; records whose id
isn't that of a page have none; only the named columns are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.llm.common import maybe_in, stored, table, whole
from costlens.scratch import scratch_dir

LEAST_BYTES = 100
#: Records per archive file and entries per index block.
FILE_RECORDS = 20_000
BLOCK_ENTRIES = 500
#: Entries of an index part, about; a part's directory has one row a block.
PART_ENTRIES = 5_000_000
#: Records of one file are read together if at most so far apart, and up to so many bytes at once.
GAP, WINDOW = 64 << 10, 4 << 20
SALTS = 32
DATE = "1970-01-01T00:00:00Z"

# Names and line ends of the format.
CRLF = "\r\n"
RECORD_END = CRLF + CRLF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def capture_key(url: Column, page_id: Column) -> Column:
    """Host labels from the last to the first, then the rest of the url, then the page."""
    parts = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?"
    text = whole(url)
    host = F.lower(F.regexp_extract(text, parts, 1))
    labels = F.concat_ws(",", F.reverse(F.split(host, r"\.")))
    rest = F.regexp_replace(text, parts, "")
    page = whole(page_id.cast("string"))
    page = F.when(F.length(page) < 20, F.lpad(page, 20, "0")).otherwise(page)
    return F.concat_ws(" ", F.concat(labels, F.lit(")"), rest), page)


def target(url: Column) -> Column:
    """The url as a record names it."""
    return F.regexp_replace(whole(url), r"[\x00-\x20\x7F]", "%20")


def _revisits(pages: DataFrame) -> DataFrame:
    """Pages whose payload one with a smaller id has, with that id."""
    long = pages.where(F.col("page_id").isNotNull() & (F.col("n") >= LEAST_BYTES))
    first = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("k"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    several = first.where("k > 1").select("digest", "first", salts.alias("salt"))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    copies = long.select("page_id", "digest", salt.alias("salt")).join(several, ["digest", "salt"])
    return copies.where("page_id <> first").select("page_id", "digest", "first").distinct()


def _record(refers: Column) -> Column:
    """The text of a record without its end."""
    is_revisit = refers.isNotNull()
    line = lambda name, *value: F.concat(F.lit(f"{name}: "), *value, F.lit(CRLF))
    named = lambda c: F.concat(F.lit("<urn:page:"), whole(c.cast("string")), F.lit(">"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
        line("Content-Length", F.col("n").cast("string")),
        F.lit(CRLF),
    )
    block = F.concat(http, F.when(is_revisit, F.lit("")).otherwise(F.col("payload")))
    revisit = F.concat(line("WARC-Refers-To", named(refers)), line("WARC-Profile", F.lit(PROFILE)))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", named(F.col("page_id"))),
        line("WARC-Target-URI", target(F.col("url"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.lit("sha256:"), F.col("digest")),
        F.when(is_revisit, revisit).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
    )
    return F.concat(head, block)


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> None:
    """One record per row of ``pages``."""
    payload = whole(F.col(html_col))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).alias("n"),
        F.sha2(payload, 256).alias("digest"),
    )
    copies = stored(_revisits(rows), "revisits")
    marked = maybe_in(rows, F.col("page_id"), copies, "page_id")
    # Only payloads of pages that may be revisits are shuffled.
    sure = marked.where("not maybe").select(_record(F.lit(None).cast("long")).alias("record"))
    asked = marked.where("maybe").join(copies, ["page_id", "digest"], "left")
    records = sure.union(asked.select(_record(F.col("first")).alias("record")))
    records.write.option("lineSep", RECORD_END).option("maxRecordsPerFile", FILE_RECORDS).text(folder)


def _place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store, of any kind pyarrow knows, and the path in it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri.replace("file:/", "file:///", 1)
    return pyarrow.fs.FileSystem.from_uri(uri)


def _open(uri: str) -> pa.NativeFile:
    """A file, for reads at any place."""
    store, path = _place(uri)
    return store.open_input_file(path)


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split(CRLF)[1:]
    return dict(x.split(": ", 1) for x in lines if ": " in x)


def _scan(file: pa.NativeFile, at_once: int = 4 << 20):
    """Place, length and headers of each record, holding one record at most."""
    held, at, read, size = b"", 0, 0, file.size()  # bytes read, and how far they are done
    mark, end = RECORD_END.encode(), len(RECORD_END)
    while read - len(held) + at < size:
        stop = held.find(mark, at)
        known = _headers(held[at:stop]) if stop >= 0 else None
        needed = stop - at + end + int(known["Content-Length"]) + end if known else None
        if needed is None or at + needed > len(held):
            held, at = held[at:], 0
            more = file.read_at(max(at_once, (needed or 0) - len(held)), read)
            if not more:
                raise ValueError("an archive ends within a record")
            held, read = held + more, read + len(more)
            continue
        yield read - len(held) + at, needed - end, known
        at += needed


class _Blocks:
    """A new file of blocks; nothing is written until the first block comes."""

    def __init__(self, folder: str):
        self.uri, self.out, self.size = f"{folder}/{uuid.uuid4().hex}", None, 0

    def add(self, part: int, rows: list) -> tuple:
        """The directory's row of a block."""
        if self.out is None:
            store, path = _place(self.uri)
            store.create_dir(path.rsplit("/", 1)[0])
            self.out = store.open_output_stream(path)
        data = zlib.compress("\n".join(json.dumps(r) for r in rows).encode())
        self.out.write(data)
        self.size += len(data)
        return part, rows[0][0], rows[-1][0], self.uri, self.size - len(data), len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def _rows(columns: str):
    """Arrow batches of rows (tuples), by a schema in Spark's words."""
    kinds = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}
    names, types = zip(*(x.split() for x in columns.split(", ")), strict=True)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        values = zip(*rows, strict=True) if rows else [[] for _ in names]
        arrays = [pa.array(v, kinds[t]) for v, t in zip(values, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, list(names))

    return batch


CAPTURES = "url string, id string, path string, place bigint, length bigint"
DIRECTORY = "part int, first_key string, last_key string, path string, place bigint, length bigint"
PAGE = re.compile(r"<urn:page:(-?[0-9]*)>")


def _captures(spark: SparkSession, archives: str) -> DataFrame:
    """Target, record id, file, place and length of every response and revisit."""
    files = spark.read.format("binaryFile").load(archives).where("length > 0").select("path")
    of_rows = _rows(CAPTURES)

    def each(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with _open(path) as file:
                    for place, n, h in _scan(file):
                        if h["WARC-Type"] in ("response", "revisit"):
                            name = h["WARC-Record-ID"]
                            known = PAGE.fullmatch(name)
                            rows.append((h["WARC-Target-URI"], known[1] if known else name, path, place, n))
                        if len(rows) == FILE_RECORDS:
                            yield of_rows(rows)
                            rows = []
                yield of_rows(rows)

    return files.mapInArrow(each, CAPTURES)


def build_index(spark: SparkSession, archives: str, folder: str) -> None:
    """Reads the archives' headers and writes sorted, compressed blocks and their directory."""
    key = capture_key(F.col("url"), F.col("id")).alias("key")
    found = stored(_captures(spark, archives).select(key, "path", "place", "length"), "captures")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(found.count() / PART_ENTRIES))
    ordered = found.repartitionByRange(parts, "key").sortWithinPartitions("key", "path", "place")
    numbered = ordered.withColumn("part", F.spark_partition_id())
    home = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/blocks")
    home = home.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(home).toString()
    of_rows = _rows(DIRECTORY)

    def blocks(batches):
        file, held, part = _Blocks(home), [], 0
        for batch in batches:
            out = []
            for *entry, part in zip(*[c.to_pylist() for c in batch.columns], strict=True):  # noqa: B007
                held.append(entry)
                if len(held) == BLOCK_ENTRIES:
                    out.append(file.add(part, held))
                    held = []
            yield of_rows(out)
        if held:
            last = file.add(part, held)
            yield of_rows([last])
        file.close()

    numbered.mapInArrow(blocks, DIRECTORY).write.parquet(f"{folder}/directory")


FOUND = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, "
    "record_type string, refers_to bigint"
)


def read_record(data: bytes) -> dict:
    """What a record says of its page; the digest is that of the bytes, if it has them."""
    head, block = data.split(RECORD_END.encode(), 1)
    headers = _headers(head)
    http, payload = block.split(RECORD_END.encode(), 1)
    revisit = headers["WARC-Type"] == "revisit"
    digest = headers.get("WARC-Payload-Digest", "").removeprefix("sha256:")

    def number(name: str) -> int | None:
        known = PAGE.fullmatch(headers.get(name, ""))
        return int(known[1]) if known and known[1] else None

    return {
        "page_id": number("WARC-Record-ID"),
        "url": headers["WARC-Target-URI"],
        "payload_bytes": int(_headers(http).get("Content-Length", 0)) if revisit else len(payload),
        "payload_digest": digest if revisit else hashlib.sha256(payload).hexdigest(),
        "record_type": headers["WARC-Type"],
        "refers_to": number("WARC-Refers-To") if revisit else None,
    }


BLOCKS = "key string, path string, place bigint, length bigint"
PLACES = "path string, place bigint, length bigint"


def blocks_of(spark: SparkSession, index: str, keys: DataFrame) -> DataFrame:
    """Per distinct key of ``keys.key`` the blocks whose range holds it, by search in the directory."""
    directory = spark.read.schema(DIRECTORY).parquet(f"{index}/directory")
    tops = directory.groupBy("part").agg(F.min("first_key").alias("k")).collect()  # one row per part
    tops = sorted((r.k, r.part) for r in tops)
    firsts, numbers = [k for k, _ in tops], [p for _, p in tops]

    def part_of(key: pd.Series) -> pd.Series:
        at = (max(bisect_right(firsts, k) - 1, 0) for k in key)
        return pd.Series([numbers[i] if numbers else 0 for i in at], dtype="int32")

    asked = keys.select("key").where("key is not null").distinct()
    asked = asked.select(F.pandas_udf(part_of, "int")("key").alias("part"), "key")
    # A part's directory comes before the keys that are looked up in it.
    both = directory.unionByName(asked, allowMissingColumns=True)
    both = both.repartitionById(max(numbers, default=0) + 1, "part")
    both = both.sortWithinPartitions(F.col("key").isNotNull(), "part", "first_key", "last_key", "path", "place", "key")
    of_rows = _rows(BLOCKS)

    def search(batches):
        begins, ends, places = [], [], []
        for batch in batches:
            out = []
            for key, first, last, *place in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key is None:
                    begins.append(first)
                    ends.append(last)
                    places.append(place)
                    continue
                out += [(key, *x) for x in places[bisect_left(ends, key) : bisect_right(begins, key)]]
            yield of_rows(out)

    return both.select("key", "first_key", "last_key", "path", "place", "length").mapInArrow(search, BLOCKS)


def _entries(batches):
    """Places of the records of keys, from their blocks; a block is read once for keys that follow each other."""
    of_rows, file, opened, at, names, entries = _rows(PLACES), None, None, None, [], []
    for batch in batches:
        out = []
        for key, path, place, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if at != (path, place):
                if opened != path:
                    if file is not None:
                        file.close()
                    file, opened = _open(path), path
                entries = [json.loads(x) for x in zlib.decompress(file.read_at(length, place)).split(b"\n")]
                at, names = (path, place), [e[0] for e in entries]
            out += [tuple(e[1:]) for e in entries[bisect_left(names, key) : bisect_right(names, key)]]
        yield of_rows(out)
    if file is not None:
        file.close()


def _together(places: list[tuple]) -> list[list[tuple]]:
    """Ordered (path, place, length) in groups that are read at once."""
    groups: list[list[tuple]] = []
    for path, place, length in places:
        if groups:
            (first, start, _), (_, before, n) = groups[-1][0], groups[-1][-1]
            if first == path and place - before - n <= GAP and place + length - start <= WINDOW:
                groups[-1].append((path, place, length))
                continue
        groups.append([(path, place, length)])
    return groups


def _records(batches):
    """The records at sorted places, with one open file."""
    schema, file, opened = _rows(FOUND)([]).schema, None, None
    for batch in batches:
        for group in _together(list(zip(*[c.to_pylist() for c in batch.columns], strict=True))):
            path, start, _ = group[0]
            if opened != path:
                if file is not None:
                    file.close()
                file, opened = _open(path), path
            data = file.read_at(group[-1][1] + group[-1][2] - start, start)
            out = [read_record(data[place - start : place - start + n]) for _, place, n in group]
            yield pa.RecordBatch.from_pylist(out, schema)
    if file is not None:
        file.close()


def lookup(spark: SparkSession, index: str, keys: DataFrame) -> DataFrame:
    """The records of the capture keys in ``keys.key``, by index and range reads."""
    places = blocks_of(spark, index, keys).mapInArrow(_entries, PLACES)
    # Neighbours of a file meet in one task, and a large file is several tasks' work.
    stretch = F.floor(F.col("place") / (16 * WINDOW))
    ordered = places.repartition("path", stretch).sortWithinPartitions("path", "place")
    return ordered.mapInArrow(_records, FOUND)


def write_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives, indexed, and read back by their keys."""
    pages = table(spark, sf_dir, "pages")
    folder = scratch_dir(spark, "warc")
    write_archives(pages, f"{folder}/archives")
    build_index(spark, f"{folder}/archives", f"{folder}/index")
    key = capture_key(target(F.col("url")), F.col("page_id"))
    return lookup(spark, f"{folder}/index", pages.select(key.alias("key")))
