"""op10 cuts texts at blanks where these bound the tokenizer's pieces, and decodes documents many at once."""

import random

import numpy as np

from costlens.llm import repair

BITS = [" ", "  ", "\n", "\n\n", "\t", "\r", "\xa0", "\x1c", "\x85", "a", "Cat", "'s", "'", "!", "?!", "12", "é", ",", ". ", "<|endoftext|>", "　", "中"]


def test_ids_are_the_library_s():
    library, draw = repair.Library(repair.TOKENIZER), random.Random(5)
    weights = [12, 1, 4, 0.4, 0.2, 0.2, 0.2, 0.1, 0.1, *[5] * 10, 0.2, 0.1, 0.2]
    texts = ["", " ", "\n", "a ", "a\n", " a", "\na", "a\nb", "a  b", "a \nb", "it's 3 o'clock,\nsaid \"she\". "]
    texts += ["".join(draw.choices(BITS, weights, k=draw.randint(0, 30))) for _ in range(3000)]
    cut = [x for x in texts if repair.by_blanks(x) is not None]
    assert len(texts) / 5 < len(cut) < len(texts)
    # a second time from what is remembered, and in another order
    for _ in range(2):
        draw.shuffle(texts)
        for text, ids in zip(texts, library.encode(texts), strict=True):
            assert ids.tolist() == library.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(repair, "REMEMBERED", 50)
    library = repair.Library(repair.TOKENIZER)
    for k in range(20):
        texts = [f"word{k} and{i} more{i + k}" for i in range(10)]
        want = [library.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
        assert [x.tolist() for x in library.encode(texts)] == want
        assert len(library.words) + len(library.known) < 50 + 100


def test_documents_are_decoded_many_at_once(monkeypatch):
    draw = np.random.default_rng(4)
    texts = [np.append(np.tile(draw.integers(0, 60, 20), draw.integers(0, 40)), 2).astype("<u2") for _ in range(70)]
    shard = repair.Shard(repair._shard(0, 0, 0, list(range(70)), texts, 50_257))
    assert len(shard.symbols) < sum(map(len, texts)) / 1.5
    assert (shard.ids() == repair.expand(shard.symbols, shard.rules, shard.first_rule)).all()
    for together in (1, 7, 70, 256):
        monkeypatch.setattr(repair, "TOGETHER", together)
        found = list(shard.documents())
        assert len(found) == 70 and all((a == b).all() and len(a) == len(b) for a, b in zip(found, texts))
    assert (shard.document(11) == texts[11]).all()
