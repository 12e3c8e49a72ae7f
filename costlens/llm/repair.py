"""Token ids in grammar-compressed shards, after Re-Pair.

Every shard replaces its frequent neighbouring ids by nonterminals, again and again;
a pair never reaches across a document's end.  A shard stores its rules, the length
every rule expands to, and its symbols, so any range of ids is decoded from the
symbols that cover it.  Shards are rows of a Parquet table (``FORMAT``), in ascending
document order; ``before`` counts the ids of earlier shards of the same part.

Documents are dealt to parts by id and text hash (``common.Order``), so neither one id nor
the rows without any fill a part that grows with them, unless their texts are equal.

Defined results: null and empty texts hold the end id only; a text's added tokens
(``<|endoftext|>``) are one id each, as the library has it; rows that repeat an id
follow each other, ordered by the hash of their text; rows without id come first; texts of
any length stay within one shard; an empty table gives no rows; only the named columns
are read, so other columns may have any names.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import islice, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.llm import bpe
from costlens.llm.common import NO_ID, Order, portions
from costlens.scratch import scratch_dir

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END = 2
#: Pieces whose ids a worker remembers (about 300 MB): asking the library costs more
#: than all else that is done for a piece.
REMEMBERED = 1_500_000
#: Ids after which a shard is closed.
SHARD_IDS = 1_000_000
#: Neighbours that are replaced occur at least so often in a shard.
LEAST_COUNT = 4
COUNTERS = 2**21
#: Free symbols that are used up in one round.
LAST_RULES = 1024
#: Documents of a shard that are decoded at once.
TOGETHER = 256
#: Symbols are 16-bit; rules fill what the vocabulary leaves.
SYMBOLS = 2**16

FORMAT = (
    "part int, shard int, before bigint, n_ids bigint, first_rule int, "
    "doc_ids binary, counts binary, rules binary, lengths binary, symbols binary"
)


#: Below this code point the regex module's classes are the library's; a text beyond it
#: is cut by the code-point classes of ``bpe``.
WIDE = re.compile("[^\\x00-\u04ff]")
PIECES = regex.compile(public_tokenizers.PATTERN)
#: Blanks other than the space and the line feed, and two blanks side by side.  Without them every blank
#: begins a piece, and what comes before it ends one, so a text is cut at its blanks.
ODD_BLANKS = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0]")
TWO_BLANKS = ("  ", " \n", "\n ", "\n\n")


def by_blanks(text: str) -> list[str] | None:
    """A text's words with the line feed before them, the first with a carriage return; all others
    follow a space.  None for a text whose blanks are not the bounds of its pieces."""
    if ODD_BLANKS.search(text) or any(x in text for x in TWO_BLANKS):
        return None
    words = text.replace("\n", " \n").split(" ")
    words[0] = "\r" + words[0]
    return words


class Library:
    """The tokenizers library, asked once per distinct piece of text.

    Texts are cut at blanks where these are bounds of pieces, which is cheaper than to find
    the pieces; only words that are new are cut into pieces.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        (self.newline,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        # Added tokens are cut out of a text before it is cut into pieces, as the library does.
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.apart = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None

    def _new(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces.  Newlines between visible ones keep them apart in one text."""
        found: dict[str, bytes] = {}
        apart = [x for x in pieces if not x.isspace()]
        for i in range(0, len(apart), 2000):
            some = apart[i : i + 2000]
            (coded,) = self.tokenizer.encode_batch_fast(["\n".join(some)], add_special_tokens=False)
            ids = np.array(coded.ids, "<i4")
            # a newline is one id, which no visible piece has
            ends = np.append(np.flatnonzero(ids == self.newline), len(ids)) * 4
            flat, starts = ids.tobytes(), np.concatenate([[0], ends[:-1] + 4])
            found.update(
                (x, flat[a:b]) for x, a, b in zip(some, starts.tolist(), ends.tolist(), strict=True)
            )
        for x in pieces:
            if x not in found:
                found[x] = np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, "<i4").tobytes()
        return [found[x] for x in pieces]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without added tokens."""
        wide = [x for x in texts if WIDE.search(x)]
        if wide:
            coded = iter(bpe.encode_pieces(wide, self.known, self._new, REMEMBERED))
            rest = iter(self._plain([x for x in texts if not WIDE.search(x)]))
            return [next(coded if WIDE.search(x) else rest) for x in texts]
        if len(self.known) + len(self.words) > REMEMBERED:
            self.known.clear()
            self.words.clear()
        cut = [by_blanks(x) for x in texts]
        odd = iter(self._by_pieces([x for x, own in zip(texts, cut, strict=True) if own is None]))
        words = [x for own in cut if own for x in own]
        found = list(map(self.words.get, words))
        if new := [i for i, x in enumerate(found) if x is None]:
            self._learn(list({words[i] for i in new}))
            for i in new:
                found[i] = self.words[words[i]]
        coded = iter(found)
        joined = [next(odd) if own is None else b"".join(islice(coded, len(own))) for own in cut]
        return [np.frombuffer(x, "<i4") for x in joined]

    def _learn(self, words: list[str]) -> None:
        """Ids of words of :func:`by_blanks`, with the blank before them."""
        line = np.array([self.newline], "<i4").tobytes()
        shown = [x[1:] if x[:1] in ("\r", "\n") else f" {x}" for x in words]
        # nothing, or a space that ends a text, would run together with the line feeds between words
        alone = {x: self._by_pieces([x])[0] for x in ("", " ")}
        ids = np.frombuffer(self._by_pieces(["\n".join(x for x in shown if x not in alone)])[0], "<i4")
        # a line feed keeps two words apart, and is one id, which no word has
        ends = np.append(np.flatnonzero(ids == self.newline), len(ids)) * 4
        flat, begins = ids.tobytes(), [0, *(ends[:-1] + 4).tolist()]
        parted = iter([flat[a:b] for a, b in zip(begins, ends.tolist(), strict=True)])
        coded = [alone[x] if x in alone else next(parted) for x in shown]
        self.words.update(
            (x, line + found if x[:1] == "\n" else found) for x, found in zip(words, coded, strict=True)
        )

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, by their pieces."""
        cut = [PIECES.findall(x) for x in texts]
        pieces = [x for own in cut for x in own]
        if new := list(set(pieces).difference(self.known)):
            self.known.update(zip(new, self._new(new), strict=True))
        coded = iter(map(self.known.__getitem__, pieces))
        return [b"".join(islice(coded, len(own))) for own in cut]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not (self.apart and any(map(self.apart.search, texts))):
            return self._plain(texts)
        out = []
        for x in texts:
            parts = self.apart.split(x)
            ids = self._plain(parts[::2])
            for k, token in enumerate(parts[1::2]):
                ids[k] = np.append(ids[k], self.added[token])
            out.append(np.concatenate(ids))
        return out


@lru_cache(2)
def library(path: str) -> Library:
    return Library(path)


def token_ids(docs: DataFrame, path: str, id_col: str, text_col: str, order: Order) -> DataFrame:
    """Per document its place and its ids with the end id, as little-endian 16-bit integers."""

    def each(batches):
        tokenizer = library(path)
        if tokenizer.size >= SYMBOLS:
            raise ValueError("the vocabulary leaves no room for rules in 16 bits")
        end = np.array([END], np.uint16)
        for batch in batches:
            done = 0
            for ids, texts in portions([batch]):
                coded = [np.concatenate([x.astype("<u2"), end]).tobytes() for x in tokenizer.encode(texts)]
                place = [batch.column(i).slice(done, len(ids)) for i in (2, 3)]
                done += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(coded, pa.binary()), *place], ["doc_id", "ids", "part", "tie"]
                )

    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        order.part().alias("part"),
        order.tie.alias("tie"),
    )
    return rows.mapInArrow(each, "doc_id bigint, ids binary, part int, tie bigint")


def compress(ids: np.ndarray, last: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and rules (pairs of symbols; rule i is symbol ``first_rule + i``).

    ``last`` marks the ids that end a document.  A round replaces, side by side, the pairs
    that are more frequent than both pairs overlapping them, the most frequent first, until
    no pair that can be replaced occurs ``LEAST_COUNT`` times or the symbols are used up.  Hashed
    counts, which are never too small, pick the places; a pair's own places are counted exactly.
    """
    symbols, rules = ids.astype(np.uint32), [np.zeros((0, 2), np.uint32)]
    free = SYMBOLS - first_rule
    while len(symbols) > 1 and free > 0:
        left, right = symbols[:-1], symbols[1:]
        slot = ((left * np.uint32(2654435761)) ^ (right * np.uint32(40503))) & np.uint32(COUNTERS - 1)
        often = np.bincount(slot, minlength=COUNTERS).astype(np.int32)[slot]
        often[last[:-1] | (often < LEAST_COUNT)] = 0
        padded = np.concatenate([[0], often, [0]])
        at = np.flatnonzero((often >= padded[:-2]) & (often >= padded[2:]) & (often > 0))
        # of equals side by side every second one
        run = np.cumsum(np.diff(at, prepend=-2) > 1)
        begin = np.flatnonzero(np.diff(run, prepend=0))
        at = at[(at - at[begin][run - 1]) % 2 == 0]
        codes = left[at] << np.uint32(16) | right[at]
        pairs, which, counts = np.unique(codes, return_inverse=True, return_counts=True)
        # Half of the symbols left go to one round, so that later ones can build on its rules.
        rank = np.lexsort((pairs, -counts))[: max(free // 2, min(free, LAST_RULES))]
        rank = rank[counts[rank] >= LEAST_COUNT]
        if not len(rank):
            break
        name = np.full(len(pairs), -1, np.int64)
        name[rank] = first_rule + sum(map(len, rules)) + np.arange(len(rank))
        named = name[which]
        at, named = at[named >= 0], named[named >= 0]
        chosen = pairs[rank]
        rules.append(np.stack([chosen >> np.uint32(16), chosen & np.uint32(SYMBOLS - 1)], 1))
        free -= len(rank)
        symbols[at] = named
        last = last.copy()
        last[at] = last[at + 1]
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        symbols, last = symbols[stays], last[stays]
    return symbols, np.concatenate(rules)


def rule_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    """Ids every rule stands for; a rule uses only earlier ones."""
    lengths = np.ones(first_rule + len(rules), np.int64)
    done = 0
    while done < len(rules):
        # as far as rules refer to symbols whose length is known
        known = (rules[done:] < first_rule + done).all(1)
        stop = done + (len(known) if known.all() else int(known.argmin()))
        lengths[first_rule + done : first_rule + stop] = lengths[rules[done:stop]].sum(1)
        done = stop
    return lengths[first_rule:]


def expand(symbols: np.ndarray, rules: np.ndarray, first_rule: int) -> np.ndarray:
    """The ids that symbols stand for."""
    symbols = symbols.astype(np.uint32)
    while len(symbols) and int(symbols.max()) >= first_rule:
        pairs = symbols >= first_rule
        place = np.cumsum(1 + pairs) - 1 - pairs
        out = np.empty(len(symbols) + int(pairs.sum()), np.uint32)
        out[place] = symbols
        halves = rules[symbols[pairs] - first_rule]
        out[place[pairs]], out[place[pairs] + 1] = halves[:, 0], halves[:, 1]
        symbols = out
    return symbols


class Shard:
    """A row of the shard table, decoded on demand."""

    def __init__(self, row: dict):
        self.row = row
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.first_rule = row["first_rule"]
        self.doc_ids, self.counts = read("doc_ids", "<i8"), read("counts", "<i8")
        self.rules = read("rules", "<u2").reshape(-1, 2)
        self.lengths, self.symbols = read("lengths", "<i4"), read("symbols", "<u2")

    def ids(self) -> np.ndarray:
        return self.spelled(self.symbols)

    @cached_property
    def spellings(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids that symbols stand for, one after the other, and where each symbol's begin."""
        every = np.arange(self.first_rule + len(self.rules), dtype=np.uint32)
        return expand(every, self.rules, self.first_rule), np.cumsum(self.spans) - self.spans

    @cached_property
    def spans(self) -> np.ndarray:
        """Ids that each symbol stands for."""
        return np.concatenate([np.ones(self.first_rule, np.int64), self.lengths])

    def spelled(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for."""
        flat, begins = self.spellings
        spans = self.spans[symbols]
        ends = np.cumsum(spans)
        return flat[np.repeat(begins[symbols] - ends + spans, spans) + np.arange(spans.sum())]

    @cached_property
    def ends(self) -> np.ndarray:
        """Ids up to the end of each symbol."""
        return np.cumsum(self.spans[self.symbols])

    @cached_property
    def stops(self) -> np.ndarray:
        return np.cumsum(self.counts)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard, from the symbols that cover them."""
        a, b = np.searchsorted(self.ends, [start, stop - 1], "right").tolist()
        first = int(self.ends[a - 1]) if a else 0
        return self.spelled(self.symbols[a : b + 1])[start - first : stop - first]

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of every document, decoded from the symbols that cover ``TOGETHER`` of them."""
        for first in range(0, len(self.counts), TOGETHER):
            stops = self.stops[first : first + TOGETHER].tolist()
            start = stops[0] - int(self.counts[first])
            ids = self.slice(start, stops[-1])
            for a, b in pairwise([start, *stops]):
                yield ids[a - start : b - start]

    def document(self, i: int) -> np.ndarray:
        stop = int(self.stops[i])
        return self.slice(stop - int(self.counts[i]), stop)


def _shard(part: int, shard: int, before: int, doc_ids: list, coded: list, first_rule: int) -> dict:
    counts = np.array([len(x) for x in coded], "<i8")
    ids = np.concatenate(coded)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(counts) - 1] = True
    symbols, rules = compress(ids, last, first_rule)
    known = [NO_ID if x is None else x for x in doc_ids]
    return {
        "part": part,
        "shard": shard,
        "before": before,
        "n_ids": len(ids),
        "first_rule": first_rule,
        "doc_ids": np.array(known, "<i8").tobytes(),
        "counts": counts.tobytes(),
        "rules": rules.astype("<u2").tobytes(),
        "lengths": rule_lengths(rules, first_rule).astype("<i4").tobytes(),
        "symbols": symbols.astype("<u2").tobytes(),
    }


def write_shards(
    docs: DataFrame, folder: str, path: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encodes ``docs`` and writes their shards, ordered by document id, to ``folder``."""
    order = Order(docs, id_col, text_col)
    found = token_ids(docs, path, id_col, text_col, order)
    placed = found.repartitionById(len(order.cuts) + 1, "part")
    ordered = placed.sortWithinPartitions("doc_id", "tie", "ids").select("doc_id", "ids", "part")

    def each(batches):
        first_rule = library(path).size
        shard, before, size, part, ids, coded = 0, 0, 0, 0, [], []

        def close():
            row = _shard(part, shard, before, ids, coded, first_rule)
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for i, data, p in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                part = p
                ids.append(i)
                coded.append(np.frombuffer(data, "<u2"))
                size += len(coded[-1])
                if size >= SHARD_IDS:
                    yield close()
                    shard, before, size, ids, coded = shard + 1, before + size, 0, [], []
        if ids:
            yield close()

    schema = pa.schema(
        [
            (name, {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[kind])
            for name, kind in (x.split() for x in FORMAT.split(", "))
        ]
    )
    ordered.mapInArrow(each, FORMAT).write.parquet(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the shards: id, first position, number of ids, and their CRC-32."""
    shards = spark.read.schema(FORMAT).parquet(folder)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # one row per part
    sizes = {r.part: r.n for r in totals}
    offsets, so_far = [], 0
    for part in range(max(sizes, default=0) + 1):
        offsets.append(so_far)
        so_far += sizes.get(part, 0)

    def each(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                shard = Shard(row)
                sums = [zlib.crc32(x.astype("<u4", copy=False)) for x in shard.documents()]
                starts = offsets[row["part"]] + row["before"] + shard.stops - shard.counts
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, mask=shard.doc_ids == NO_ID),
                        pa.array(starts, pa.int64()),
                        pa.array(shard.counts, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.mapInArrow(each, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def write_and_read(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """The documents of a fresh set of shards in the cluster's shared folder."""
    folder = scratch_dir(docs.sparkSession, "shards")
    write_shards(docs, folder, path)
    return read_documents(docs.sparkSession, folder)
