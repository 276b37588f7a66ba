"""Spelling variants against a comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from tablefold.llm import spelling

LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    form, around = {}, {}
    for w in words:
        links = [v for v in words if near(w, v)]
        around[w] = len(links)
        top = min(links, key=lambda v: (-words[v], v), default=None)
        form[w] = top if top is not None and words[top] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], around[w], words.get(form[w])))
    return out


def sample():
    r = random.Random(5)
    base = ["étionnère", "wordss", "aabbaabb", "Straße", "ÀÉÎõü", "çouelle", "abcdef", "letters", "ÿÿÿÿÿÿÿ", "x" * 70, "short", "×÷×÷×÷"]
    rows = []
    for b in base:
        variants = {b: 200 + r.randrange(400)}
        for _ in range(25):
            i, w = r.randrange(len(b)), r.choice([b, *list(variants)])
            i = min(i, len(w) - 1)
            new = r.choice([w[:i] + w[i + 1:], w[:i] + r.choice("abzé") + w[i:], w[:i] + r.choice("abzé") + w[i + 1:]])
            variants.setdefault(new, r.choice([4, 5, 6, 5, 12, 30, 60]))
        for w, n in variants.items():
            rows += [(r.randrange(5000), f"1{w}2 {w.upper() if w.isascii() else w}, {w}") for _ in range(n // 3 + 1)]
    return rows + [(None, "nothing letters letterz " * 9), (3, None), (4, ""), (3, "letters " * 5000)]


def test_variants_equal_all_pairs(make):
    rows = sample()
    want = brute(rows)
    assert sum(x[1] is not None for x in want) > 20 and any(x[1] not in (None, x[2]) for x in want)
    got = spelling.variants(make(rows)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_filters_in_several_passes(make, monkeypatch):
    monkeypatch.setattr(spelling, "PASS_BLOCKS", 3)
    monkeypatch.setattr(spelling, "PROBES", 500)
    rows = sample()
    assert {tuple(r) for r in spelling.variants(make(rows)).collect()} == brute(rows)


def test_empty_tables(make):
    assert spelling.variants(make([])).collect() == []
    assert spelling.variants(make([(1, "a few words"), (2, None)])).collect() == []


def test_edits_reach_every_partner():
    layout = {6: (0, 1), 7: (1, 1), 8: (2, 1)}
    alphabet = np.array(sorted(map(ord, "abcé")), np.uint64)
    r = random.Random(1)
    for _ in range(200):
        a = "".join(r.choice("abcé") for _ in range(r.choice([6, 7])))
        i = r.randrange(len(a))
        b = r.choice([a[:i] + r.choice("abcé") + a[i:], a[:i] + r.choice("abcé") + a[i + 1:]])
        if a == b:
            continue
        made = set()
        for side, other in ((a, b), (b, a)):
            for _, at, code, *_ in spelling.edits([side], alphabet, layout):
                texts = [side[:k] + (chr(x) if x else "") + side[k + 1:] for k, x in zip(at.tolist(), code.tolist())]
                assert len(set(texts)) == len(texts)
                made |= {(side, t) for t in texts if t == other}
        assert len(made) == 1                              # from one side only
