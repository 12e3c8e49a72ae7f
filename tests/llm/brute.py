"""Plain Python versions of the corpus operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    inside = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    n = len(words)
    failed = n < 10 or 100 * len(inside) > 20 * n
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside), failed


def contamination(docs, items):
    """Per document: n_words, n_hit, items, contaminated"""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    spans = defaultdict(set)
    for item, text in items:
        words = cut(text)
        n = min(len(words), 13)
        for i in range(len(words) - n + 1 if n else 0):
            spans[tuple(words[i : i + n])].add(item)
    sizes = {len(s) for s in spans}
    out = []
    for text in docs:
        words, hit, found = cut(text), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if items_ := spans.get(tuple(words[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= items_
        out.append((len(words), len(hit), sorted(map(str, found)), bool(hit) and 20 * len(hit) >= len(words)))
    return out


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def components(rows):
    """doc_id -> smallest reachable id, from (doc_id, text) rows"""
    sets = defaultdict(set)
    for i, text in rows:
        sets[i].add(shingles(text))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    by_shingle = defaultdict(set)
    flat = [(i, s) for i, many in sets.items() for s in many if s]
    for k, (_, s) in enumerate(flat):
        for x in s:
            by_shingle[x].add(k)
    for k, (i, s) in enumerate(flat):
        both = Counter(j for x in s for j in by_shingle[x] if j > k)
        for j, n in both.items():
            if 100 * n >= 80 * (len(s) + len(flat[j][1]) - n):
                join(i, flat[j][0])
    return {i: find(i) for i in sets}


LINE = re.compile(r"(?<=\n)|(?<=[.!?])(?=\x20)")


def tree(lines, lead=2, leaf=1000):
    """line -> template, for token tuples; leaves with more lines are split by 1, 2, 4, ... further tokens"""
    out, waiting = {}, [(lead, 1, sorted(lines, key=lambda t: " ".join(t).encode()))]
    while waiting:
        depth, step, some = waiting.pop()
        leaves = defaultdict(list)
        for t in some:
            leaves[len(t), t[:depth]].append(t)
        for key, own in leaves.items():
            if len(own) > leaf and key[0] > 3:
                waiting.append((depth + step, 2 * step, own))
                continue
            known = []  # (number, places)
            for t in own:
                agree = [sum(a == b for a, b in zip(t, places, strict=True)) for _, places in known]
                best = max(range(len(known)), key=lambda k: (agree[k], -k)) if known else None
                if known and 4 * agree[best] >= 3 * len(t):
                    known[best][1][:] = [a if a == b else None for a, b in zip(known[best][1], t, strict=True)]
                else:
                    best = len(known)
                    known.append((t, list(t)))
                out[t] = known[best][0]
    return out


def clean(rows, spare_copies=False, leaf=1000):
    """(text, n_recurring, n_dropped) of each (doc_id, text) row"""
    cut = lambda t: [x for x in LINE.split(t or "") if x]
    masked = lambda x: tuple(WORD.findall(re.sub("[0-9]+", "0", x)))
    template = tree({masked(x) for _, t in rows for x in cut(t)}, leaf=leaf)
    owners, texts = defaultdict(set), defaultdict(set)
    for i, text in rows:
        texts[i].add(text)
        for x in cut(text):
            if i is not None and masked(x):
                owners[template[masked(x)]].add(i)
    out = []
    for i, text in rows:
        parts = cut(text)
        sizes = [len(masked(x)) for x in parts]
        of = [owners[template[masked(x)]] if masked(x) else () for x in parts]
        gone = [len(ids) > 1 and min(ids) != i for ids in of]
        if spare_copies and any(gone):
            shared = Counter()
            for n, ids, lost in zip(sizes, of, gone, strict=True):
                shared[min(ids) if lost else None] += n if lost else 0
            shared.pop(None, None)
            first = min(shared, key=lambda k: (-shared[k], k))
            a = shingles(text)
            if 2 * shared[first] >= sum(sizes) and any(
                100 * len(a & b) >= 80 * len(a | b) for b in map(shingles, texts[first])
            ):
                gone = [False] * len(parts)
        drop = list(gone)
        for k, n in enumerate(sizes):
            if not n:
                left = next((gone[j] for j in range(k - 1, -1, -1) if sizes[j]), False)
                right = next((gone[j] for j in range(k + 1, len(sizes)) if sizes[j]), False)
                drop[k] = left and right
        kept = "".join(x for x, out_ in zip(parts, drop, strict=True) if not out_)
        out.append((kept, sum(gone), sum(drop)))
    return out
