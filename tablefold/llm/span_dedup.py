"""Substring dedup: drop words covered by a long window that an earlier document holds too.

The reference of a document is the whole corpus before it, so broadcasting suffix automata of the
references has no size bound and would stream every document past every shard (README). The same
matches are found by exchanging hashes, in two stages that both run over all documents:

1. Anchors. Of the 7-grams inside a 13-word window the one with the least hash is the window's
   anchor; equal windows have equal anchors, and a text has an anchor every few words only. Anchors
   that two documents hold are found in one exchange.
2. Windows. Those windows whose anchor is shared are exchanged by their own 64-bit hash; each is
   found in every document but the smallest doc_id that holds it.

A key that many documents share is combined in every task to its smallest and largest document, so
no group is gathered anywhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefold.llm import common as C

WINDOW = 13
ANCHOR = 7
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def window_anchors(words: C.Words, window: int, anchor: int) -> np.ndarray:
    """For each word that starts a window inside its row: the window's anchor; 0 elsewhere."""
    grams = words.grams(anchor)
    n = len(grams) - window + 1
    out = np.zeros(len(grams), np.uint64)
    if n > 0:
        least = grams[:n].copy()
        for i in range(1, window - anchor + 1):
            np.minimum(least, grams[i:n + i], out=least)
        out[:n] = least
    out[words.left() < window] = 0
    return out


def shared_anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """Anchors of each document that another document holds too."""
    bits = C.bucket_bits(docs.sparkSession)

    def settle(first, last, owner):
        return first != last

    def send(batches):
        out = C.Sender(bits, settle)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for w in C.word_blocks(batch.column(1)):
                a = window_anchors(w, window, anchor)
                new = a != 0
                new[1:] &= (a[1:] != a[:-1]) | (w.left()[1:] > w.left()[:-1])
                yield from out.add(a[new], ids[w.lo:w.hi][w.rows()[new]])
        yield from out.flush()

    return C.exchange(docs.mapInArrow(send, C.KEYED), settle)


def earlier_windows(docs: DataFrame, anchors: DataFrame, window: int, anchor: int) -> DataFrame:
    """Windows of each document that a smaller doc_id holds, of those whose anchor is shared."""
    bits = C.bucket_bits(docs.sparkSession)

    def settle(first, last, owner):
        return owner > first

    def send(batch, keys, owners):
        out = C.Sender(bits, settle)
        ids = batch.column(2).to_numpy(zero_copy_only=False)
        for w in C.word_blocks(batch.column(3)):
            mine = ids[w.lo:w.hi]
            known = np.unique(keys[np.isin(owners, mine)])
            if not len(known):
                continue
            a = window_anchors(w, window, anchor)
            keep = a != 0
            keep[keep] = np.isin(a[keep], known)
            yield from out.add(w.grams(window)[keep], mine[w.rows()[keep]])
        yield from out.flush()

    return C.exchange(C.with_found(docs, anchors, send, C.KEYED), settle)


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256 [, kept]) for every row of ``docs`` (doc_id, text, ...).

    Words are ``[^\\x20\\x09-\\x0D]+`` of the unchanged text. A word is removed when a window of
    ``window`` words covers it whose word sequence also starts in a document with a smaller doc_id;
    windows are judged on the input. Kept words are joined by one space (``kept`` with ``texts``).
    A null text has no words. Rows that repeat a doc_id are judged one by one, and are not earlier
    than each other; a row with a null doc_id loses nothing and is nobody's reference. Other
    columns are ignored; an empty table gives an empty result.
    """
    C.prepared(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    named = rows.where("doc_id IS NOT NULL")
    windows = earlier_windows(named, shared_anchors(named, window, anchor), window, anchor)

    def cut(batch, keys, owners):
        ids = batch.column(2).to_numpy(zero_copy_only=False) if not batch.column(2).null_count else \
            batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)
        named_row = np.asarray(batch.column(2).is_valid())
        lo, hi = np.searchsorted(owners, ids, "left"), np.searchsorted(owners, ids, "right")
        for w in C.word_blocks(batch.column(3)):
            covered = np.zeros(len(w.hashes) + 1, np.int64)
            hit = np.flatnonzero((hi[w.lo:w.hi] > lo[w.lo:w.hi]) & named_row[w.lo:w.hi])
            if len(hit):
                grams, left = w.grams(window), w.left()
                for i in hit.tolist():
                    a, b = w.offsets[i], w.offsets[i + 1]
                    at = a + np.flatnonzero((left[a:b] >= window) & np.isin(grams[a:b], keys[lo[w.lo + i]:hi[w.lo + i]]))
                    covered[at] += 1
                    covered[at + window] -= 1
            gone = np.cumsum(covered[:-1]) > 0
            sums = np.concatenate([[0], np.cumsum(gone)])
            removed = sums[w.offsets[1:]] - sums[w.offsets[:-1]]
            left_over = []
            for i, (a, b) in enumerate(zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist())):
                if removed[i]:
                    keep = a + np.flatnonzero(~gone[a:b])
                    left_over.append(b" ".join([w.raw[s:e] for s, e in zip(w.starts[keep].tolist(), w.ends[keep].tolist())]))
                else:
                    left_over.append(b" ".join(w.raw[w.starts[a]:w.ends[b - 1]].split()) if b > a else b"")
            cols = [batch.column(2).slice(w.lo, w.hi - w.lo), pa.array(np.diff(w.offsets), pa.int64()), pa.array(removed, pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in left_over])]
            if texts:
                cols.append(pa.array([t.decode() for t in left_over]))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][:len(cols)])

    return C.with_found(rows, windows, cut, RESULT + (", kept string" if texts else ""))
