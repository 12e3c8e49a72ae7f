"""Byte-level BPE encoding and decoding.

Texts are cut without a regular expression.  Each code point gets a class; a small
automaton over the classes says where a piece begins.  A code point's transition is
a function from state to state, and functions compose associatively, so blocks of
text are scanned side by side: first the function of every block, then a prefix
scan over blocks, then all positions.  The pieces go through a cache of merged
pairs; token ends (in bytes) are kept, so any token can be decoded in place.

Defined results: null and empty texts have no tokens; texts of any length are
scanned whole, those without tokens end at byte 0; repeated rows get equal results; an empty table gives no rows; only
the named columns are read, so other columns may have any names.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from costlens.llm.common import portions

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Pieces whose merges a worker remembers.
REMEMBERED = 500_000
#: Pieces of more bytes are merged with a heap; others side by side, so many at once.
LONG_PIECE = 96
MERGED_AT_ONCE = 20_000
NO_PAIR = np.int32(2**31 - 1)
#: Positions in a block of the scan.
BLOCK = 256
#: Bytes of a text that are decoded at once.
DECODED_AT_ONCE = 2**16

# The white space of the cutting pattern.
WHITE_SPACE = [(0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
               (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
               (0x3000, 0x3000)]
# Letters and digits of Unicode 16 that Python's tables don't have yet.
NEW_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3),
               (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
               (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
               (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
               (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
               (0x1E5F0, 0x1E5F0)]
NEW_DIGITS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139),
              (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

# What a code point is, seen with its right neighbours.
#   WHITE   white space before more white space, or before the end
#   LAST    other white space just before a visible character
#   HOLD    a space just before a visible character, which it joins
#   SHORT, LONG   an apostrophe before an ending of one or two letters
WHITE, LAST, HOLD, LETTER, DIGIT, OTHER, SHORT, LONG = range(8)
FIRST = 8  # added to the first code point of a text
# States: in white space, holding a space, in letters, digits or others, in an ending
# with one or two letters to come, at the end of an ending.
IN_WHITE, HELD, IN_LETTERS, IN_DIGITS, IN_OTHER, ONE_LEFT, TWO_LEFT, DONE = range(8)


@lru_cache(1)
def _classes() -> np.ndarray:
    """LETTER, DIGIT, OTHER or WHITE for every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = DIGIT
    for ranges, kind in ((WHITE_SPACE, WHITE), (NEW_LETTERS, LETTER), (NEW_DIGITS, DIGIT)):
        for first, last in ranges:
            table[first : last + 1] = kind
    return table


@lru_cache(1)
def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a piece begins, by symbol * 8 + state."""
    goes = np.zeros((16, 8), np.uint8)
    begins = np.ones((16, 8), bool)
    goes[[WHITE, LAST]] = IN_WHITE
    begins[WHITE, IN_WHITE] = False
    goes[HOLD] = HELD
    goes[DIGIT] = IN_DIGITS
    begins[DIGIT, [IN_DIGITS, HELD]] = False
    goes[OTHER] = IN_OTHER
    begins[OTHER, [IN_OTHER, HELD]] = False
    goes[LETTER] = IN_LETTERS
    goes[LETTER, [ONE_LEFT, TWO_LEFT]] = [DONE, ONE_LEFT]
    begins[LETTER, [IN_LETTERS, HELD, ONE_LEFT, TWO_LEFT]] = False
    goes[SHORT], goes[LONG] = ONE_LEFT, TWO_LEFT
    for mark in (SHORT, LONG):
        goes[mark, [IN_OTHER, HELD]] = IN_OTHER
        begins[mark, [IN_OTHER, HELD]] = False
    goes[FIRST:] = goes[:FIRST, IN_WHITE, None]  # nothing comes before
    goes[FIRST + WHITE] = IN_WHITE
    begins[FIRST:] = True
    return goes.ravel(), begins.ravel()


def _symbols(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The automaton's input; ``firsts`` are the places where a text begins."""
    kind = _classes()[points]
    n = len(points)
    first = np.zeros(n + 3, bool)
    first[firsts] = True
    first[n:] = True
    after = np.concatenate([kind, np.full(1, WHITE, np.uint8)])[1:]
    visible_next = (after != WHITE) & ~first[1 : n + 1]
    symbols = kind.copy()
    edge = (kind == WHITE) & visible_next
    symbols[edge] = np.where(points[edge] == 0x20, HOLD, LAST)
    marks = np.flatnonzero(points == ord("'"))
    if len(marks):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[marks + 1], padded[marks + 2]
        here, there = ~first[marks + 1], ~first[marks + 2]
        short = here & np.isin(one, [ord(c) for c in "stmd"])
        pair = one.astype(np.int64) << 32 | two
        long = here & there & np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])
        symbols[marks[short]] = SHORT
        symbols[marks[long]] = LONG
    return symbols + FIRST * first[:n].astype(np.uint8)


def _composed(symbols: np.ndarray, goes: np.ndarray) -> np.ndarray:
    """The function of each block (a row of ``symbols``), as eight next states."""
    step = symbols.T.astype(np.intp) * 8
    one = np.zeros(len(symbols), np.uint8)
    for row in step:
        one = goes[row + one]
    functions = np.repeat(one[:, None], 8, 1)
    # A block without a constant transition needs all eight states followed.
    constant = (goes.reshape(16, 8) == goes.reshape(16, 8)[:, :1]).all(1)
    open_ = np.flatnonzero(~constant[symbols].any(1))
    if len(open_):
        states = np.repeat(np.arange(8, dtype=np.uint8)[None], len(open_), 0)
        for row in step[:, open_]:
            states = goes[row[:, None] + states]
        functions[open_] = states
    return functions


def starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Places where pieces begin."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    goes, begins = _automaton()
    blocks = -(-n // BLOCK)
    symbols = np.full(blocks * BLOCK, WHITE, np.uint8)
    symbols[:n] = _symbols(points, firsts)
    symbols = symbols.reshape(blocks, BLOCK)
    scan, reach = _composed(symbols, goes), 1
    while reach < blocks:  # inclusive prefix scan: earlier function first
        scan[reach:] = np.take_along_axis(scan[reach:], scan[:-reach], 1)
        reach *= 2
    state = np.concatenate([[np.uint8(IN_WHITE)], scan[:-1, IN_WHITE]])
    found = np.empty((BLOCK, blocks), bool)
    for i, row in enumerate(symbols.T.astype(np.intp) * 8):
        at = row + state
        found[i] = begins[at]
        state = goes[at]
    return np.flatnonzero(found.T.ravel()[:n])


def encode_pieces(
    texts: list[str],
    known: dict[str, bytes],
    merge: Callable[[list[str]], Iterable[bytes]],
    remembered: int = REMEMBERED,
) -> list[np.ndarray]:
    """Ids of each text; ``merge`` gives those of pieces not ``known`` yet, as 32-bit integers."""
    edges = np.fromiter(accumulate(map(len, texts), initial=0), np.int64, len(texts) + 1)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = starts(points, edges[:-1][edges[:-1] < len(points)])
    pieces: list[str] = []
    firsts = np.searchsorted(begins, edges)
    for text, edge, a, b in zip(texts, edges.tolist(), firsts.tolist(), firsts[1:].tolist(), strict=False):
        # cut from its own text: one of narrow characters is copied without a look at each
        places = (begins[a:b] - edge).tolist()
        places.append(len(text))
        pieces += [text[i:j] for i, j in zip(places, places[1:], strict=False)]
    if len(known) > remembered:
        known.clear()
    merged = list(map(known.get, pieces))
    unknown = [i for i, x in enumerate(merged) if x is None]
    if unknown:
        new = list({pieces[i] for i in unknown})
        known.update(zip(new, merge(new), strict=True))
        for i in unknown:
            merged[i] = known[pieces[i]]
    counts = np.fromiter(map(len, merged), np.int64, len(merged)) // 4
    ids = np.frombuffer(b"".join(merged), "<i4")
    # pieces before each text's first one, then ids before it
    cuts = np.concatenate([[0], np.cumsum(counts)])[firsts]
    return np.split(ids, cuts[1:-1])


class Vocabulary:
    """Ranks of a byte-level vocabulary, with remembered merges."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.lengths = np.array([len(b) for b in self.bytes])
        self.names = [str(i) for i in range(len(self.bytes))]
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        splits = [
            (self.ranks[a] << 32 | self.ranks[b], rank)
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if (a := token[:i]) in self.ranks and (b := token[i:]) in self.ranks
        ]
        self.pairs, self.pair_ranks = np.array(sorted(splits), np.int64).T.copy()
        self.pair_ranks = self.pair_ranks.astype(np.int32)
        self.known: dict[str, bytes] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NO_PAIR where the two don't join."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pairs, keys)
        at[at == len(self.pairs)] = 0
        return np.where((self.pairs[at] == keys) & (right >= 0), self.pair_ranks[at], NO_PAIR)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece: its pair of lowest rank is joined until none is left.

        All pieces of about one length are merged side by side, one pair each a round.
        """
        out = [b""] * len(pieces)
        alike: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > LONG_PIECE:
                out[i] = np.array(self._merge_long(piece), "<i4").tobytes()
            else:
                alike.setdefault(-(-len(piece) // 8) * 8, []).append(i)
        for width, rows in alike.items():
            for some in range(0, len(rows), MERGED_AT_ONCE):
                self._merge_alike([*rows[some : some + MERGED_AT_ONCE]], width, pieces, out)
        return out

    def _merge_alike(self, rows, width: int, pieces: list[bytes], out: list[bytes]) -> None:
        filled = b"".join(pieces[i].ljust(width, b"\0") for i in rows)
        sizes = np.array([len(pieces[i]) for i in rows])
        ids = self.single[np.frombuffer(filled, np.uint8).reshape(-1, width)]
        ids[np.arange(width) >= sizes[:, None]] = -1
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        rows, columns = np.array(rows), np.arange(width - 1)
        while len(rows):
            at = ranks.argmin(1)
            best = np.take_along_axis(ranks, at[:, None], 1)[:, 0]
            open_ = best < NO_PAIR
            if not open_.all():
                done = ~open_
                ended = ids[done]
                flat = ended[ended >= 0].astype("<i4").tobytes()
                cuts = np.concatenate([[0], np.cumsum((ended >= 0).sum(1) * 4)]).tolist()
                for i, a, b in zip(rows[done].tolist(), cuts, cuts[1:], strict=False):
                    out[i] = flat[a:b]
                rows, ids, ranks, at, best = (x[open_] for x in (rows, ids, ranks, at, best))
                if not len(rows):
                    break
            line = np.arange(len(rows))
            # The right half goes and what follows moves up.
            follow = columns + (columns > at[:, None])
            ids[:, :-1] = np.take_along_axis(ids, follow, 1)
            ids[:, -1] = -1
            ids[line, at] = best
            ranks[:, :-1] = np.take_along_axis(ranks, follow[:, :-1], 1)
            ranks[:, -1] = NO_PAIR
            ranks[line, at] = self._ranks(best, ids[line, at + 1])
            left = at > 0
            ranks[line[left], at[left] - 1] = self._ranks(ids[line[left], at[left] - 1], best[left])

    def _merge_long(self, piece: bytes) -> list[int]:
        n = len(piece)
        end = list(range(1, n + 1))  # of the part that begins here; 0 once swallowed
        before = list(range(-1, n - 1))
        rank = self.ranks.get

        def pair(i: int) -> int | None:
            j = end[i]
            return rank(piece[i : end[j]]) if j < n else None

        heap = [(r, i, i + 2) for i in range(n - 1) if (r := pair(i)) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            if not end[i] or end[i] >= n or end[end[i]] != stop:
                continue  # one of the two has grown since
            j = end[i]
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
            for k in (before[i], i):
                if k >= 0 and (r := pair(k)) is not None:
                    heappush(heap, (r, k, end[end[k]]))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        return encode_pieces(
            texts, self.known, lambda new: self.merge([x.encode("utf-8", "surrogatepass") for x in new])
        )

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Bytes up to the end of each token."""
        return np.cumsum(self.lengths[ids])

    def decode(self, ids: np.ndarray, ends: np.ndarray, start: int, stop: int) -> bytes:
        """Bytes ``start`` to ``stop`` of what the ids stand for, from the tokens that cover them."""
        a, b = np.searchsorted(ends, [start, stop - 1], "right").tolist()
        first = int(ends[a - 1]) if a else 0
        return b"".join(map(self.bytes.__getitem__, ids[a : b + 1].tolist()))[start - first : stop - first]

    def spell(self, ids: np.ndarray) -> str:
        return " ".join(map(self.names.__getitem__, ids.tolist()))


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _arrow(field: T.StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def _mapped(docs: DataFrame, id_col: str, text_col: str, columns: str, rows) -> DataFrame:
    """``rows(keys, texts)`` gives the columns after the key, as Arrow arrays."""
    docs = docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias("text"))
    key_type = _arrow(docs.schema[0])

    def each(batches):
        for keys, texts in portions(batches):
            arrays = [pa.array(keys, key_type), *rows(texts)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = T.StructType([docs.schema[0], *T._parse_datatype_string(columns).fields])
    names = schema.names
    return docs.mapInArrow(each, schema)


def encode(
    docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: ``ids``, and ``ends``, the byte at which each token ends."""

    def rows(texts):
        vocab = vocabulary(path)
        ids = vocab.encode(texts)
        return pa.array(ids, pa.list_(pa.int32())), pa.array(map(vocab.ends, ids), pa.list_(pa.int64()))

    return _mapped(docs, id_col, text_col, "ids array<int>, ends array<bigint>", rows)


def decode(
    encoded: DataFrame,
    path: str = VOCABULARY,
    id_col: str = "doc_id",
    start: int = 0,
    stop: int | None = None,
) -> DataFrame:
    """Per document: the ``bytes`` its ``ids`` stand for, or those from ``start`` to ``stop``.

    ``ends`` says which tokens cover the range; the others aren't looked at.  A range
    beyond the end of a text is cut there.
    """
    encoded = encoded.select(id_col, "ids", "ends")

    def part(vocab, ids, ends):
        size = int(ends[-1]) if len(ends) else 0
        last = size if stop is None else min(stop, size)
        return vocab.decode(ids, ends, start, last) if start < last else b""

    def each(batches):
        vocab = vocabulary(path)
        for batch in batches:
            rows = zip(batch.column(1), batch.column(2), strict=True)
            data = [
                part(vocab, np.asarray(x.values or [], np.int32), np.asarray(y.values or [], np.int64))
                for x, y in rows
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names)

    schema = T.StructType([encoded.schema[0], T.StructField("bytes", T.BinaryType())])
    names = schema.names
    return encoded.mapInArrow(each, schema)


def round_trip(
    docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: token count, digest of the ids, digest of what they decode to, and
    the byte at which the last token ends.

    The same as encode() and decode() in a row, in one pass over the texts.  Bytes are
    decoded in ranges of ``DECODED_AT_ONCE`` by the token ends.
    """

    def decoded(vocab, ids, ends) -> str:
        digest, size = hashlib.sha256(), int(ends[-1]) if len(ends) else 0
        for at in range(0, size, DECODED_AT_ONCE):
            digest.update(vocab.decode(ids, ends, at, min(at + DECODED_AT_ONCE, size)))
        return digest.hexdigest()

    def rows(texts):
        vocab = vocabulary(path)
        ids = vocab.encode(texts)
        ends = [vocab.ends(x) for x in ids]
        return (
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(vocab.spell(x).encode()).hexdigest() for x in ids], pa.string()),
            pa.array([decoded(vocab, x, y) for x, y in zip(ids, ends, strict=True)], pa.string()),
            pa.array([int(y[-1]) if len(y) else 0 for y in ends], pa.int64()),
        )

    columns = "n_tokens bigint, ids_sha256 string, decoded_sha256 string, last_end bigint"
    return _mapped(docs, id_col, text_col, columns, rows)
