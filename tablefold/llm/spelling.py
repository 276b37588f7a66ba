"""Spelling variants: words one edit apart, found through Bloom filters of the vocabulary.

Words and their counts come from one aggregate. The vocabulary (words with ``LEAST`` occurrences and
more) goes into blocked Bloom filters, one for each word length, that lie one after the other in one row of
256-bit blocks; Spark builds them by OR-ing bits by block. For every word the tasks generate the
edits that can lead to a partner (each pair from one side only: deletions from the longer word,
replacements by a greater code point from the other) and probe them, as hashes in numpy, against the filter
of the edit's length. Only edits that the filter knows become strings and are shuffled to a join with
the vocabulary, which removes the false ones. Blocks are broadcast ``PASS_BLOCKS`` at a time (a fixed number of bytes):
a larger vocabulary takes more passes, each over the probes that fall into its blocks.

A word's form is its near word with the largest count, if that is ``RATIO`` times its own; chains of forms
are followed by pointer doubling.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefold.llm import common as C

LETTERS = 6                   # code points of a word at least
LEAST = 5                     # occurrences of a word at least
RATIO = 5                     # a form's count over its word's
EVERY = 199                   # of the runs, one in so many loses a code point
BITS = 16                     # of a filter for each word
PASS_BLOCKS = 1 << 20         # blocks (32 bytes) broadcast at once: 32 MB
LONGEST = 64                  # words of this length and longer share a filter
PROBES = 1 << 19              # probed at once in a task
#: Odd multipliers of the eight 32-bit lanes of a block.
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)
BASE, INVERSE = np.uint64(C.BASE), np.uint64(C.INVERSE)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---------------------------------------------------------------------------
# words
# ---------------------------------------------------------------------------
def word_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(word, n): words of all texts with ``least`` occurrences and more.

    A run of letters shorter than a word can't become one, so that the pattern leaves it out. A null text
    has no words; a null doc_id counts as no characters in the run's hash.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"),
                       F.explode(F.expr(f"regexp_extract_all(text, '[A-Za-z\\u00C0-\\u00FF]{{{LETTERS},}}', 0)")).alias("run"))
    runs = runs.select("d", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % EVERY == 0, less).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row for each word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64).reshape(len(words), -1)


def by_length(words: list[str]):
    """(length, positions) of a list of words."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes).tolist():
        yield size, np.flatnonzero(sizes == size)


def powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), BASE, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def placed(sums: np.ndarray, size: int, layout: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Block and lane hash of words of length ``size`` with polynomial ``sums``; layout: first block and blocks by length."""
    first, blocks = layout[min(size, LONGEST)]
    h = C.mix(sums + np.uint64(size))
    return first + (((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64), h & np.uint64(0xFFFFFFFF)


def lane_bits(low: np.ndarray, lane: int) -> np.ndarray:
    """The bit of a lane (0 to 31) for each hash."""
    return ((low * SALTS[lane]) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)


# ---------------------------------------------------------------------------
# filters
# ---------------------------------------------------------------------------
def layout_of(vocabulary: DataFrame) -> dict[int, tuple[int, int]]:
    """First block and number of blocks of each length's filter."""
    sizes = vocabulary.groupBy(F.least(F.length("word"), F.lit(LONGEST)).alias("size")).count().collect()   # LONGEST rows at most
    out, first = {}, 0
    for size, n in sorted(map(tuple, sizes)):
        blocks = max(1, -(-n * BITS // 256))
        out[size] = (first, blocks)
        first += blocks
    return out


def filters(vocabulary: DataFrame, layout: dict[int, tuple[int, int]]) -> DataFrame:
    """(block, l0 ... l7): the blocks that have bits."""
    def run(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            for size, rows in by_length(words):
                block, low = placed(codes([words[i] for i in rows]) @ powers(size), size, layout)
                lanes = [(np.uint64(1) << lane_bits(low, k)).astype(np.int64) for k in range(8)]
                yield pa.RecordBatch.from_arrays([pa.array(block), *map(pa.array, lanes)], ["block", *[f"l{k}" for k in range(8)]])

    bits = vocabulary.select("word").mapInArrow(run, "block long, " + ", ".join(f"l{k} long" for k in range(8)))
    return bits.groupBy("block").agg(*[F.bit_or(f"l{k}").alias(f"l{k}") for k in range(8)])


def edits(words: list[str], alphabet: np.ndarray, layout: dict[int, tuple[int, int]]):
    """Blocks of (rows, positions, code points, block, lane hash) of the edits of words; code point 0 is a deletion."""
    top = len(alphabet)
    for size, rows in by_length(words):
        step = max(1, PROBES // (size * top))
        power = powers(size)
        for lo in range(0, len(rows), step):
            part = rows[lo:lo + step]
            c = codes([words[i] for i in part])
            terms = c * power
            total = terms.sum(1, dtype=np.uint64)
            if min(size - 1, LONGEST) in layout and size > LETTERS:
                ahead = np.cumsum(terms, axis=1, dtype=np.uint64)
                sums = ahead - terms + (total[:, None] - ahead) * INVERSE
                last = np.ones(c.shape, bool)                 # equal neighbours give one word: only the last of them
                last[:, :-1] = c[:, :-1] != c[:, 1:]
                w, i = np.nonzero(last)
                yield part[w], i, np.zeros(len(w), np.int64), *placed(sums[w, i], size - 1, layout)
            wide = max(1, PROBES // (len(part) * top))        # positions at once, for very long words
            for at in range(0, size, wide):
                here = c[:, at:at + wide]
                w, i, a = np.nonzero(alphabet[None, None, :] > here[:, :, None])
                sums = total[w] + (alphabet[a] - here[w, i]) * power[at + i]
                yield part[w], at + i, alphabet[a].astype(np.int64), *placed(sums, size, layout)


def candidates(vocabulary: DataFrame, layout: dict[int, tuple[int, int]], blocks: np.ndarray, first: int, alphabet: np.ndarray) -> DataFrame:
    """(word, n, other): edits of every word that the blocks from ``first`` on know."""
    sent = vocabulary.sparkSession.sparkContext.broadcast(blocks)

    def run(batches):
        known = sent.value
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for row, at, code, block, low in edits(words, alphabet, layout):
                hit = np.flatnonzero((block >= first) & (block < first + len(known)))
                for k in range(8):
                    hit = hit[(known[block[hit] - first, k] >> lane_bits(low[hit], k).astype(np.uint32)) & 1 == 1]
                if not len(hit):
                    continue
                row, at, code = row[hit], at[hit].tolist(), code[hit].tolist()
                mine = [words[i] for i in row]
                other = [w[:i] + (chr(x) if x else "") + w[i + 1:] for w, i, x in zip(mine, at, code)]
                yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(counts[row]), pa.array(other)], ["word", "n", "other"])

    return vocabulary.mapInArrow(run, "word string, n long, other string")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of words of the vocabulary one edit apart, once. ``vocabulary``: a written table (word, n)."""
    spark = vocabulary.sparkSession
    C.prepared(spark)
    layout = layout_of(vocabulary)
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()   # 90 at most
    alphabet = np.array(sorted(ord(r.c) for r in letters), np.uint64)
    table = C.written(filters(vocabulary, layout), "spelling-filters")
    total = sum(n for _, n in layout.values())
    found = None
    for first in range(0, total, PASS_BLOCKS):
        part = table.where((F.col("block") >= first) & (F.col("block") < first + PASS_BLOCKS)).toArrow()
        blocks = np.zeros((min(PASS_BLOCKS, total - first), 8), np.uint32)
        blocks[part.column(0).to_numpy() - first] = np.stack([part.column(k + 1).to_numpy() for k in range(8)], 1).astype(np.uint32)
        more = candidates(vocabulary, layout, blocks, first, alphabet)
        found = more if found is None else found.union(more)
    if found is None:
        return vocabulary.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("word").alias("b"), F.col("n").alias("b_n")).where("false")
    exact = vocabulary.select(F.col("word").alias("b"), F.col("n").alias("b_n"))
    return found.join(exact, F.col("other") == F.col("b")).select(F.col("word").alias("a"), F.col("n").alias("a_n"), "b", "b_n")


# ---------------------------------------------------------------------------
# forms and roots
# ---------------------------------------------------------------------------
def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): pointer doubling, a join a round, until no pointer moves."""
    cur = C.written(forms.select("word", F.col("form").alias("to"), F.lit(True).alias("moved")), "spelling-roots")
    while cur.where("moved").limit(1).count():
        ahead = cur.select(F.col("word").alias("mid"), F.col("to").alias("far"))
        cur = C.written(cur.join(ahead, cur["to"] == ahead["mid"], "left").select("word", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")), "spelling-roots")
    return cur.select("word", F.col("to").alias("root"))


def variants(docs: DataFrame, least: int = LEAST, ratio: int = RATIO) -> DataFrame:
    """Words of ``docs`` (doc_id, text, ...) with their near words, form and root.

    (word, form, root string; n, n_near, form_n long), a row for each word. Repeated rows count as
    often as they occur; other columns are ignored; an empty table or no words give an empty result.
    Ties between near words of equal count go to the smallest in code-point order.
    """
    vocabulary = C.written(word_counts(docs, least), "spelling-words")
    pairs = C.written(near_pairs(vocabulary), "spelling-pairs")
    sides = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).union(
        pairs.select("b", "b_n", "a", "a_n"))
    best = sides.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))).alias("best"))
    enough = -F.col("best.m") >= ratio * F.col("n")
    near = C.written(best.select("word", "n_near", F.when(enough, F.col("best.w")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n")), "spelling-near")
    ends = roots(near.where("form IS NOT NULL"))
    return (vocabulary.join(near, "word", "left").join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
