"""Lines of many texts at once are those that each text has by itself, taken line by line."""

import random

import numpy as np
import xxhash

from costlens.llm.templates import AGREE, Lines, lines, mask


def expected(texts):
    for k, text in enumerate(texts):
        for i, x in enumerate(lines(text)):
            words = b" ".join(w for w in mask(x.encode()).translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w)
            if words:
                n = words.count(b" ") + 1
                own = xxhash.xxh64_intdigest(words)
                lead = b" ".join(words.split(b" ")[:2])
                leaf = xxhash.xxh64_intdigest(lead, n) if -(-AGREE * n // 4) < n else own
                yield k, i, n, own, leaf, words


def test_lines_of_odd_texts():
    draw = random.Random(5)
    pieces = ["a", "bb", ".", "!", "?", " ", "  ", "\t", "\r", "\n", "\x0b", "\x0c", "1", "22", ". ", "! ", "\n ", " \n", "é", "　", "\x00"]
    texts = ["", " ", "\n", " . ", ".  a. \n b.\tc", *["".join(draw.choices(pieces, k=draw.randrange(60))) for _ in range(3000)]]
    found = Lines(texts)
    columns = [found.text, found.at, found.size, found.line, found.leaf]
    assert [c.dtype.name for c in columns] == ["int64"] * 3 + ["uint64"] * 2
    assert list(zip(*[c.tolist() for c in columns], found.tokens, strict=True)) == list(expected(texts))
    some = np.arange(0, len(found.tokens), 3)
    assert (found.leaves(some) == found.leaf[some]).all()


def test_no_lines():
    for texts in [], [""], [" \n\t"]:
        found = Lines(texts)
        assert len(found.text) == len(found.line) == len(found.leaf) == len(found.tokens) == 0
