"""N-gram Jaccard join by universe-partition pigeonhole, with near-duplicate classes.

A document's set holds its distinct word shingles. Two sets of at least similarity t differ in at
most ``H = (1 - t) / (1 + t) * (|r| + |s|)`` tokens. Tokens are hashed into m segments, so some
segments of a similar pair hold equal (or nearly equal) subsets:

* Sizes are cut into bands. The scheme of a band serves all pairs whose smaller set lies in it;
  a document takes part in its own band's scheme and in those smaller bands' whose partners reach
  its size. ``H``, and with it m, is fixed by the band.
* A segment of threshold 0 is indexed by its subset, one of threshold 1 also by the subset's
  one-deletion neighbours. Thresholds plus one add up to more than H (pigeonhole). How many
  segments get threshold 1 is chosen by expected cost: entries written plus chance matches.
* Empty subsets would match everywhere and are not indexed. The sum over a set's usable segments
  must then still exceed H; the few sets where it does not also index their empty subsets, among
  themselves, so no pair is lost.
* Subset hashes are sums of mixed token hashes: a deletion is one subtraction.

Documents that meet no other under any key are done. Of the rest each takes a hub: of all sets that it
shares a key with the one that meets most others (the text that copies were made from, for instance).

* Same hub: a set is looked at as its difference from the hub. ``r`` and ``s`` differ by the symmetric
  difference of their differences, so that similar ones must have ``(|Dr| + |Ds| - H) / 2`` tokens of
  these in common. Sets that are similar to their hub are linked by it; a pair that is not must have at
  least one such token. Tokens are ordered from the rarest on, so only the first of a difference are
  indexed, and a common one counts only if enough may follow it (prefix and place filter). The edits
  of copies are rare tokens: groups of thousands of copies give few candidates.
* Other hubs: the same filters over the index keys themselves, of which similar sets share ``least``.

All candidates are verified in full: the two sets are intersected.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablefold.llm import common as C

SHINGLE = 5
PERCENT = 80              # linked when 100 * intersection >= PERCENT * union
BAND_RATIO = 1.4
CHANCE_COST = 25.0        # cost of verifying a chance match, in index entries
SPARE = 0.25              # segments beyond what the pigeonhole needs: similar sets share so many keys more
WIDTH = 5                 # bytes of a key that travel, besides those of its bucket; matches are verified


# ---------------------------------------------------------------------------
# schemes
# ---------------------------------------------------------------------------
@lru_cache(maxsize=None)
def schemes(largest: int, percent: int = PERCENT) -> tuple[np.ndarray, ...]:
    """(lo, hi, reach, H, m, ones) of each band up to a set size; ``ones`` segments have threshold 1."""
    rows, lo = [], 1
    while lo <= largest:
        hi = max(lo, int(lo * BAND_RATIO))
        reach = hi * 100 // percent
        differ = (hi + reach) * (100 - percent) // (100 + percent)
        best = (math.inf, 1, 0)
        need = differ + 1 + (1 + math.ceil(SPARE * (differ + 1)) if differ else 0)
        mid = (lo + hi) / 2
        common = min(0.5, 0.05 + 5 / mid)                      # share of tokens that other sets hold too
        for step in range(9):
            ones = math.ceil(need / 2) * step // 8
            zeros = max(0, need - 2 * ones)
            m = ones + zeros
            load = mid / m
            cost = zeros * (1 + CHANCE_COST * math.exp(-load * (1 - common)))
            cost += ones * (1 + load) * (1 + CHANCE_COST * math.exp(-max(0.0, load - 1) * (1 - common)))
            best = min(best, (cost, m, ones))
        rows.append((lo, hi, reach, differ, best[1], best[2]))
        lo = hi + 1
    return tuple(np.array(x, np.int64) for x in zip(*rows))


def index_keys(tokens: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, ...]:
    """Index keys of sets given as sorted distinct hashes one after another: (keys, set number, least, back).

    A set's usable segments add up to ``held`` (a segment of threshold 1 counts ``per`` = 2). Segments
    that differ by more than their threshold use up what two sets may differ by, so a similar set
    shares at least ``(held - differ) / per`` keys of the scheme; ``least`` is that for the largest
    partner of the set. ``back`` tells a set's schemes apart: 0 is that of its own band, 1 that of the
    band below, and so on. A pair's scheme is that of its smaller set.
    """
    largest = int(sizes.max()) if len(sizes) else 0
    if largest == 0:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    lo, hi, reach, differ, segments, ones = schemes(1 << max(6, largest.bit_length()), percent)
    band = np.searchsorted(lo, sizes, "right") - 1
    starts = np.concatenate([[0], np.cumsum(sizes)])
    value = C.mix(tokens ^ np.uint64(0xD6E8FEB86659FD93))
    keys_out, sets_out, more_out = [], [], []
    for back in range(len(lo)):
        scheme = band - back
        sets = np.flatnonzero((scheme >= 0) & (sizes > 0) & (sizes <= reach[np.maximum(scheme, 0)]) &
                              (differ[np.maximum(scheme, 0)] > 0))
        if not len(sets):
            if not ((band - back) >= 0).any():
                break
            continue
        n, sch = sizes[sets], scheme[sets]
        total = int(n.sum())
        own = np.repeat(np.arange(len(sets)), n)                            # set of each token
        at = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[sets], n)
        h, v = tokens[at], value[at]
        seg = (((h >> np.uint64(32)) * np.repeat(segments[sch], n).astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        new = np.ones(total, bool)                                          # hashes ascend, so segments do
        new[1:] = (seg[1:] != seg[:-1]) | (own[1:] != own[:-1])
        cut = np.flatnonzero(new)
        sums = np.add.reduceat(v, cut)
        size = np.diff(np.append(cut, total))
        c_own, c_seg = own[cut], seg[cut]
        one = c_seg < ones[sch][c_own]
        tag = C.mix(c_seg.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + sch[c_own].astype(np.uint64) + np.uint64(1))
        # usable segments: threshold 0 with any token, threshold 1 with two at least
        weight = np.where(one, np.where(size > 1, 2, 0), 1)
        held = np.bincount(c_own, weight, len(sets)).astype(np.int64)
        partner = np.minimum(reach[sch] if back == 0 else hi[sch], n * 100 // percent)      # the largest; of a smaller band: that band's
        spare = held - (n + partner) * (100 - percent) // (100 + percent)
        per = np.where(ones[sch] > 0, 2, 1)
        more = np.stack([np.maximum(1, -(-spare // per)), np.full(len(sets), back)])
        keys_out.append(C.mix(sums + tag))
        sets_out.append(sets[c_own])
        more_out.append(more[:, c_own])
        cell = np.cumsum(new) - 1
        cut_one = one[cell] & (size[cell] > 1)                              # one-deletion neighbours
        keys_out.append(C.mix(sums[cell[cut_one]] - v[cut_one] + tag[cell[cut_one]]))
        sets_out.append(sets[own[cut_one]])
        more_out.append(more[:, own[cut_one]])
        for k in np.flatnonzero(spare <= 0):                       # rare: index empty subsets too
            s = int(sch[k])
            mine = c_own == k
            empty = np.setdiff1d(np.arange(segments[s]), c_seg[mine])
            empty = np.union1d(empty, c_seg[mine & one & (size == 1)])
            t = C.mix(empty.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(s + 1))
            keys_out.append(C.mix(t ^ np.uint64(0xA0761D6478BD642F)))
            sets_out.append(np.full(len(empty), sets[k]))
            more_out.append(np.repeat(more[:, k:k + 1], len(empty), axis=1))
    if not keys_out:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    return (np.concatenate(keys_out), np.concatenate(sets_out), *np.concatenate(more_out, axis=1))


def block_sets(words: C.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row of a block, ascending, one row after another; sizes."""
    n = np.diff(words.offsets)
    grams = words.grams(k)
    whole = (n > 0) & (n < k)                       # a short text is one shingle
    keep = words.left() >= k
    if whole.any():
        at, short = words.offsets[:-1][whole], n[whole]
        g = words.hashes[at] + short.astype(np.uint64)
        for j in range(1, k - 1):
            more = short > j
            g[more] = C.mix(g[more] * np.uint64(3) + words.hashes[at[more] + j])
        grams[at] = C.mix(g)
        keep[at] = True
    row = words.rows()[keep]
    out = grams[keep]
    ends = np.cumsum(np.bincount(row, minlength=len(n)))
    a = 0
    for b in ends.tolist():
        if b - a > 1:
            out[a:b].sort()
        a = b
    first = np.ones(len(out), bool)
    first[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[first], np.bincount(row[first], minlength=len(n))


# ---------------------------------------------------------------------------
# the operator
# ---------------------------------------------------------------------------
def needed(tokens: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """For each set the least number of index keys, over its schemes, that it shares with a similar one."""
    _, row, least, *_ = index_keys(tokens, sizes, percent)
    out = np.full(len(sizes), np.iinfo(np.int64).max)
    np.minimum.at(out, row, least)
    return out


def nodes(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set, from its tokens and size; 0 for the empty set."""
    node = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        cut = (np.cumsum(sizes) - sizes)[full]
        node[full] = C.mix(np.add.reduceat(C.mix(tokens), cut) + sizes[full].astype(np.uint64))
    return node.view(np.int64)


def shingle_sets(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, node, need) of every row; need: index keys it shares with a similar set at least."""
    def sets(batches):
        for batch in batches:
            for w in C.word_blocks(batch.column(1), lower=True):
                tokens, sizes = block_sets(w, k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.lo, w.hi - w.lo), pa.array(sizes, pa.int64()), pa.array(nodes(tokens, sizes)),
                     pa.array(needed(tokens, sizes, percent), pa.int64())], ["doc_id", "n_shingles", "node", "need"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sets, "doc_id long, n_shingles long, node long, need long")


def token_sets(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(node, tokens) of every row."""
    def sets(batches):
        for batch in batches:
            for w in C.word_blocks(batch.column(1), lower=True):
                tokens, sizes = block_sets(w, k)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(nodes(tokens, sizes)), pa.ListArray.from_arrays(offsets, pa.array(tokens.view(np.int64)))],
                                                 ["node", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(sets, "node long, tokens array<long>")


def met(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, hits): documents that share index keys with others, and how many of their keys."""
    bits = C.bucket_bits(docs.sparkSession)

    def settle(first, last, owner):
        return first != last

    def send(batches):
        out = C.Sender(bits, settle, WIDTH)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for w in C.word_blocks(batch.column(1), lower=True):
                keys, row, *_ = index_keys(*block_sets(w, k), percent)
                yield from out.add(keys, ids[w.lo:w.hi][row])
        yield from out.flush()

    def count(batches):
        held, parts = None, []

        def counted():
            ids, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "hits"])

        for batch in batches:
            for grp, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if grp != held and parts:
                    yield counted()
                    parts = []
                held = grp
                parts.append(C.unpack(blob.as_py())[1])
        if parts:
            yield counted()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text")).where("doc_id IS NOT NULL")
    found = C.exchange(rows.mapInArrow(send, C.KEYED), settle)
    return (found.repartition(C.shuffle_partitions(docs.sparkSession), "grp").sortWithinPartitions("grp")
            .mapInArrow(count, "doc_id long, hits long"))


def linked(a: str, b: str, percent: int):
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) pairs of nodes with ``ok``: whether their sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", linked("ta", "tb", percent).alias("ok"))


def index_rows(sets: DataFrame, percent: int) -> DataFrame:
    """(key, node, back, least, n) of sets (node, tokens); n is the set's size."""
    def index(batches):
        for batch in batches:
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            tokens = batch.column(1)
            for lo in range(0, len(nodes), 500):
                some = tokens.slice(lo, 500)
                sizes = np.diff(some.offsets.to_numpy())
                keys, row, least, back = index_keys(some.flatten().to_numpy(zero_copy_only=False).view(np.uint64), sizes, percent)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(nodes[lo:lo + 500][row]), pa.array(back, pa.int32()),
                                                  pa.array(least, pa.int32()), pa.array(sizes[row], pa.int32())], ["key", "node", "back", "least", "n"])

    return sets.select("node", "tokens").mapInArrow(index, "key long, node long, back int, least int, n int")


def hubs(shared: DataFrame) -> DataFrame:
    """(node, hub): of the nodes under a node's keys, itself included, the one that meets most others."""
    central = shared.join(shared.groupBy("node").agg(F.sum("others").alias("central")), "node")
    top = central.groupBy("key").agg(F.max(F.struct("central", "node")).alias("top"))
    return shared.join(top, "key").groupBy("node").agg(F.max("top").alias("top")).select("node", F.col("top.node").alias("hub"))


def differences(sets: DataFrame, hub: DataFrame, percent: int) -> DataFrame:
    """(node, hub, n, nh, diff, ok): what each set and its hub don't share, and whether they are similar.

    A hub's set is sent once to each part of its nodes, so that no task gets all nodes of a hub;
    there are no more copies of sets than nodes.
    """
    parts = C.shuffle_partitions(sets.sparkSession)
    mine = sets.join(hub, "node").withColumn("part", F.pmod(F.xxhash64("node"), F.lit(parts)))
    wanted = hub.select("hub", F.pmod(F.xxhash64("node"), F.lit(parts)).alias("part")).distinct()
    heads = wanted.join(sets.select(F.col("node").alias("hub"), F.col("tokens").alias("other")), "hub")
    both = mine.join(heads, ["hub", "part"])
    diff = F.concat(F.array_except("tokens", "other"), F.array_except("other", "tokens"))
    rows = both.select("node", "hub", F.size("tokens").alias("n"), F.size("other").alias("nh"), diff.alias("diff"))
    return rows.withColumn("ok", F.size("diff") <= F.expr(f"(n + nh) * {100 - percent} DIV {100 + percent}"))


def same_hub(diffs: DataFrame, percent: int) -> DataFrame:
    """(a, b) pairs of one hub that may be similar, but for those that are both linked to it."""
    c = f"{100 - percent} / {100 + percent}D"
    flat = diffs.select("node", "n", "nh", "ok", F.size("diff").alias("d"), "hub", F.explode("diff").alias("token"))
    flat = flat.select("node", "n", "nh", "ok", "d", F.xxhash64("hub", "token").alias("key"))
    often = flat.groupBy("key").agg(F.count("*").alias("others")).where("others > 1")
    mine = Window.partitionBy("node")
    rows = flat.join(often, "key").withColumn("at", F.row_number().over(mine.orderBy("others", "key")) - 1 + F.col("d") - F.count("*").over(mine))
    # what a partner must share at least: it is not linked to the hub if this set is; else it may be any
    most = f"(n + n * 100 DIV {percent}) * {100 - percent} DIV {100 + percent}"
    need = f"greatest(1, d - {most}, CASE WHEN ok THEN cast(floor((d + (nh - n) * {c}) / 2) AS int) + 1 ELSE (d + 2 - {most}) DIV 2 END)"
    rows = rows.where(F.expr(f"at <= d - {need}")).select("key", "node", "n", "ok", "d", "at")
    differ = f"(l.n + o.n) * {100 - percent} DIV {100 + percent}"
    return rows.alias("l").join(rows.alias("o"), "key").where(
        f"l.node < o.node AND NOT (l.ok AND o.ok) AND 100 * least(l.n, o.n) >= {percent} * greatest(l.n, o.n) "
        f"AND 2 * least(l.d - l.at, o.d - o.at) >= l.d + o.d - {differ}").select(F.col("l.node").alias("a"), F.col("o.node").alias("b"))


def other_hub(shared: DataFrame, hub: DataFrame, percent: int) -> DataFrame:
    """(a, b) pairs of two hubs that may be similar, from the index keys."""
    named = shared.join(hub, "node")
    keys = named.groupBy("key").agg(F.min("hub").alias("lo"), F.max("hub").alias("hi")).where("lo <> hi").select("key")
    mine = Window.partitionBy("node", "back")
    rows = named.join(keys, "key").withColumn("held", F.count("*").over(mine)).withColumn("at", F.row_number().over(mine.orderBy("others", "key")) - 1)
    rows = rows.where("held - at >= least").select("key", "node", "hub", "n", "least", F.expr("held - at").alias("rest"))
    return rows.alias("l").join(rows.alias("o"), "key").where(
        f"l.node < o.node AND l.hub <> o.hub AND 100 * least(l.n, o.n) >= {percent} * greatest(l.n, o.n) "
        "AND least(l.rest, o.rest) >= greatest(l.least, o.least)").select(F.col("l.node").alias("a"), F.col("o.node").alias("b"))


def links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) of all nodes that are linked, from ``sets`` (node, tokens), one row a set."""
    rows = index_rows(sets, percent)
    lists = rows.groupBy("key").agg(F.count("*").alias("others")).where("others > 1")
    shared = C.written(rows.join(lists, "key"), "ngram-shared")
    hub = C.written(hubs(shared), "ngram-hubs")
    diffs = C.written(differences(sets, hub, percent), "ngram-differences")
    pairs = C.written(same_hub(diffs, percent).union(other_hub(shared, hub, percent)).distinct(), "ngram-pairs")
    found = verified(pairs, sets, percent).where("ok").select("a", "b")
    return C.components(found.union(diffs.where("ok AND node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))), "ngram-components")


def near_classes(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text, ...).

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a text of fewer than ``k``
    words is one shingle, one without words (or a null text) has the empty set and links with
    nothing. ``component_id`` is the smallest doc_id reachable by links, the document's own
    included. Rows that repeat a doc_id stay, each judged by its own text; rows with a null doc_id
    link with nothing and have a null component. Other columns are ignored. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    C.prepared(spark)
    base = C.written(shingle_sets(docs, k, percent), "ngram-documents")
    heads = base.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("head"))
    cand = base.join(met(docs, k, percent), "doc_id").where("hits >= need").select("node").distinct()
    chosen = cand.join(heads, "node").select(F.col("head").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(chosen, "doc_id")
    sets = C.bucketed(token_sets(texts, k).dropDuplicates(["node"]), "node", "ngram_sets")
    comp = links(sets, percent)
    named = base.join(comp, "node", "left").withColumn("comp", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")))
    least = named.where("comp IS NOT NULL AND doc_id IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = named.join(C.written(least, "ngram-least"), "comp", "left")         # written: Spark splits a large component's rows
    return out.select("doc_id", "n_shingles",
                      F.when(F.col("doc_id").isNull(), F.lit(None).cast("long"))
                      .otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))
