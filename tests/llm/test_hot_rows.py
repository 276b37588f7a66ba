"""Rows that share an id, a text or both, or have none, in mixing and packing."""

from collections import defaultdict

import pytest

from tablefold.llm import mixing, packing
from tablefold.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, source string, grp string, item string"


def rows_of():
    """A third of the rows without an id and with one text; another part shares an id; sources of different sizes."""
    out = [(None, "same text again", "a", "x", "y")] * 700
    out += [(5, f"word {'w ' * (i % 7)}", "b", "x", "y") for i in range(400)]
    out += [(100 + i, "w " * (1 + i % 40), "abc"[i % 3], "x", "y") for i in range(900)]
    return out + [(None, None, "a", "x", "y"), (9, "", None, "x", "y"), (None, "w " * 3000, None, "x", "y")]


@pytest.mark.parametrize("parts", [1, 7])
def test_equal_rows_are_numbered_alike(spark, parts, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 3)
    df = spark.createDataFrame([(None, "a")] * 10 + [(1, "b")] * 3 + [(2, None)], "doc_id long, text string").repartition(parts)
    got = sorted((r.text or "", r.nth) for r in mixing.numbered(df).collect())
    assert got == [("", 0)] + [("a", i) for i in range(10)] + [("b", i) for i in range(3)]
    assert mixing.numbered(df.where("false")).count() == 0


def test_sources_of_hot_rows_come_near_their_targets(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA)
    got = mixing.mix(df).collect()
    taken, goal, most = defaultdict(int), {}, defaultdict(int)
    for r in got:
        key = (r.source_size, r.target)
        taken[key] += r.taken
        goal[key] = r.target
        most[key] = max(most[key], r.size)
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
    assert len(got) == len(rows_of()) and len(goal) == 4
    for key, target in goal.items():
        assert abs(taken[key] - target) <= most[key]
    again = mixing.mix(df.repartition(9)).collect()
    order = lambda rs: sorted(tuple((x is None, x or 0) for x in r) for r in rs)
    assert order(again) == order(got)


def test_copies_are_packed_whole(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 300)
    rows = rows_of()
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), *vocabulary()).collect()
    ids = packing.tokenizer(*vocabulary())
    want, have = defaultdict(int), defaultdict(int)
    for doc, text, *_ in rows:
        total, at = len(ids(text or "")) + 1, 0
        for n in packing.cuts(total):
            want[doc, at, n, total] += 1
            at += n
    places = defaultdict(list)
    for r in got:
        have[r.doc_id, r.start, r.length, r.doc_tokens] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for spans in places.values():
        end = 0
        for a, n in sorted(spans):
            assert a == end
            end += n
        assert end <= packing.LENGTH
    assert len({s >> 32 for s in places}) > 3
    assert packing.pack(spark.createDataFrame([], SCHEMA), *vocabulary()).collect() == []
