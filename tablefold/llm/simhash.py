"""SimHash document fingerprints in DataFrame functions, and search by permuted block tables.

Terms are word trigrams (two empty words stand before the first), so that shared function words
alone do not make documents alike. A term's weight is how often it occurs. Every term's hash votes
with its weight on each bit; a bit is set where the votes for it exceed half the weight. Votes are
counted two bits to a long (32 bits each), so one aggregate of ``2 * BITS / 4`` sums over the
exploded terms does all of it, with partial sums in each task.

Search: the bits are cut into blocks; fingerprints within Hamming radius r agree on at least
``blocks - r`` of them. Each choice of that many blocks is a table keyed by their bits, so every
pair within the radius meets in one of the tables; pairs are verified by ``bit_count``.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablefold.llm import common as C

WORDS = 2                      # 64-bit words of a fingerprint
LANES = 32                     # longs a 64-bit word is counted in, two votes each
LOW = 0x0000000100000001


def word_hashes(text: Column) -> Column:
    """Array of the hashes of a text's words."""
    return F.transform(F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and ``f``: struct of the fingerprint's longs, null for a text without words.

    ``keys`` must tell the rows apart. Where they start with what the rows are already partitioned
    by, counting needs no exchange.
    """
    words = rows.select(*keys, word_hashes(F.col(text)).alias("w"))
    one, two = F.lit(1).cast("long"), F.lit(2).cast("long")
    grams = F.arrays_zip(F.concat(F.array(one, two), "w").alias("a"), F.concat(F.array(one), "w").alias("b"), F.col("w").alias("c"))
    terms = words.select(*keys, F.inline_outer(grams).alias("a", "b", "c")).withColumn("t", F.when(F.col("c").isNotNull(), F.xxhash64("a", "b", "c")))
    halves = terms.select(*keys, F.col("t").alias("h0"), *[F.xxhash64("t", F.lit(k)).alias(f"h{k}") for k in range(1, WORDS)])
    sums = [F.sum(F.expr(f"shiftrightunsigned(h{k}, {lane}) & {LOW}L")).alias(f"v{k}_{lane}")
            for k in range(WORDS) for lane in range(LANES)]
    votes = halves.groupBy(*keys).agg(F.count("h0").alias("n"), *sums)

    def word(k: int) -> Column:
        bits = F.lit(0).cast("long")
        for lane in range(LANES):
            v = F.col(f"v{k}_{lane}")
            bits = bits.bitwiseOR(F.shiftleft((v.bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("n")).cast("long"), lane))
            bits = bits.bitwiseOR(F.shiftleft((F.shiftrightunsigned(v, 32) * 2 > F.col("n")).cast("long"), lane + 32))
        return bits

    return votes.select(*keys, F.when(F.col("n") > 0, F.struct(*[word(k).alias(f"f{k}") for k in range(WORDS)])).alias("f"))


def likeness(a: str, b: str) -> Column:
    """Likeness of two fingerprints, 0 to 1: the cosine that the share of differing bits tells."""
    differ = F.lit(0)
    for k in range(WORDS):
        differ = differ + F.bit_count(F.col(a)[f"f{k}"].bitwiseXOR(F.col(b)[f"f{k}"]))
    both = F.greatest(F.lit(0.0), F.cos(differ * math.pi / (64 * WORDS)))
    return F.when(F.col(a).isNull() & F.col(b).isNull(), 1.0).when(F.col(a).isNull() | F.col(b).isNull(), 0.0).otherwise(both)


def as_text(f: str) -> Column:
    digits = [F.lpad(F.lower(F.hex(F.col(f)[f"f{k}"])), 16, "0") for k in range(WORDS)]
    return F.coalesce(F.concat(*digits), F.lit(""))


def within_radius(prints: DataFrame, key: str = "doc_id", radius: int = 3, blocks: int = 6) -> DataFrame:
    """All pairs (a, b, distance) of distinct fingerprints within ``radius``, each named by its least key.

    ``prints``: key and f (struct). Equal fingerprints are one row, so copies are not paired. Each
    choice of ``blocks - radius`` blocks is a table of the bits in them; a pair may meet in several
    tables and is returned once. Null fingerprints pair with nothing.
    """
    if radius >= blocks:
        raise ValueError("more blocks than the radius are needed")
    names = [f"f{k}" for k in range(WORDS)]
    one = prints.where("f IS NOT NULL").select(key, "f.*").groupBy(*names).agg(F.min(key).alias("id"))
    width = 64 * WORDS
    cuts = [width * i // blocks for i in range(blocks + 1)]

    def masks(chosen) -> list[int]:
        bits = sum(((1 << cuts[b + 1]) - (1 << cuts[b])) for b in chosen)
        longs = [(bits >> 64 * k) & ((1 << 64) - 1) for k in range(WORDS)]
        return [m - (1 << 64) if m >= 1 << 63 else m for m in longs]

    tables = F.array(*[F.struct(F.lit(t).alias("t"), *[F.col(n).bitwiseAND(F.lit(m)).alias(f"k{k}") for k, (n, m) in enumerate(zip(names, masks(c)))])
                       for t, c in enumerate(combinations(range(blocks), blocks - radius))])
    rows = one.select("id", *names, F.explode(tables).alias("e")).select("id", *names, "e.*")
    on = ["t", *[f"k{k}" for k in range(WORDS)]]
    pairs = rows.alias("x").join(rows.alias("y"), on).where("x.id < y.id")
    distance = F.lit(0)
    for n in names:
        distance = distance + F.bit_count(F.col(f"x.{n}").bitwiseXOR(F.col(f"y.{n}")))
    return (pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), distance.alias("distance"))
            .where(F.col("distance") <= radius).distinct())


def ring(lengths: DataFrame) -> DataFrame:
    """(doc_id, prev_id, prev_chars): the document before in descending doc_id, round from the last to the first.

    Only ids and lengths are sorted, over all partitions; ranks come from offsets, one row a
    partition, so the order does not pass through one task.
    """
    ids = lengths.orderBy(F.col("doc_id").desc()).withColumn("at", F.monotonically_increasing_id())
    ids = C.written(ids, "simhash-order").withColumn("part", F.shiftright("at", 33))
    counts = ids.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    counts = counts.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))     # one row a partition
    ranked = ids.join(counts, "part").select("doc_id", "n_chars", (F.col("at") - F.col("first") + F.col("before")).alias("rank"))
    n = max(1, ids.count())
    before = ranked.select(F.col("doc_id").alias("prev_id"), F.col("n_chars").alias("prev_chars"), ((F.col("rank") + 1) % n).alias("rank"))
    return ranked.join(before, "rank").select("doc_id", "prev_id", "prev_chars")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, for ``docs`` (doc_id, text, ...).

    A null text is empty. The edited text replaces the last floor(n_chars / 2) code points by the
    first as many (or all) of the next document in descending doc_id, after the last the first;
    with one document that is itself. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint (32 hex digits; empty for a text without words), near_edited, near_next
    (likeness; 1 between two texts without words, 0 between one with and one without). Of rows that
    repeat a doc_id the shortest text counts, of those the one of the least MD5; a row with a null
    doc_id has no place in the order and is left out. Other columns are ignored; an empty table
    gives an empty result.
    """
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("md5")]
    lengths = rows.groupBy("doc_id").agg(F.min(F.struct(*order)).alias("s")).select("doc_id", "s.n_chars")
    places = C.written(ring(lengths), "simhash-ring")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(*order, "text")).alias("s")).select("doc_id", "s.n_chars", "s.text")
    tail = rows.join(places, "doc_id").select(F.col("prev_id").alias("doc_id"), F.col("doc_id").alias("next_id"),
                                              F.expr("left(text, CAST(prev_chars DIV 2 AS INT))").alias("tail"))
    edited = rows.join(tail, "doc_id").withColumn("edited", F.concat(F.expr("left(text, CAST(n_chars - n_chars DIV 2 AS INT))"), "tail"))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))
    keys = ["doc_id", "next_id", "n_chars", "edited_sha256", "kind"]
    two = edited.select("doc_id", "next_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.explode(kinds).alias("s")).select("*", "s.*")
    prints = fingerprints(two, keys, "t")
    prints = prints.groupBy(*keys[:-1]).agg(F.max(F.when(F.col("kind") == 0, F.col("f"))).alias("a"), F.max(F.when(F.col("kind") == 1, F.col("f"))).alias("b"))
    prints = C.written(prints, "simhash-prints")
    following = prints.select(F.col("doc_id").alias("next_id"), F.col("a").alias("c"))
    out = prints.join(following, "next_id")
    return out.select("doc_id", "n_chars", "edited_sha256", as_text("a").alias("fingerprint"), as_text("b").alias("edited_fingerprint"),
                      likeness("a", "b").alias("near_edited"), likeness("a", "c").alias("near_next"))
