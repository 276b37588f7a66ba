"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions.

A source's target over its size is the number of copies every one of its documents should get:
the whole part is certain, the fraction is a probability. Pivotal rounding takes two documents with
fractional probabilities and moves words from one to the other (at random, so that expectations
stay) until one of them is 0 or 1. The words taken by a source therefore never drift from its
target: what remains in the end is one document.

The tree: documents of a source are dealt into blocks by a seeded hash; a block is one ordered fold
that leaves one fractional document; residuals meet in blocks of blocks, level by level, until one
is left in each source, which is rounded to the nearer side. Blocks hold about ``BLOCK`` documents however
large a source is, so a source with a third of all rows is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablefold.llm import common as C

WEIGHTS = (1, 2, 3)
MOST = 3                       # a document is taken so many times at most
BLOCK_BITS = 7                 # a block of blocks joins 2**BLOCK_BITS of them
BLOCK = 1 << BLOCK_BITS
CHUNK = 10_000                 # equal rows numbered at once
ITEM = "struct<doc_id:bigint,size:bigint,source_size:bigint,target:double,whole:int,p:double,place:bigint>"


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs in a text; 0 for null."""
    blank = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(blank, " "), lambda w: w != "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Weights repeat over the sources by code point, null last. A target is min(most * size, x * weight)
    for the one x that makes targets add up to all sizes; sharing what is cut off again and again
    ends there. With sources ordered by cap over weight, x is found at the first that isn't cut off.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())          # one row a source
    w = sizes.withColumn("at", (F.row_number().over(order) - 1) % len(weights))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("at") + 1).cast("int"))
    w = w.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    by_level = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    w = w.withColumn("x", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) /
                     F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    w = w.withColumn("open", F.col("x") * F.col("weight") <= F.col("cap"))
    x = F.min_by(F.when(F.col("open"), F.col("x")), F.when(F.col("open"), F.col("cap") / F.col("weight"))).over(everything)
    w = w.withColumn("level", x)
    return w.select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def chance(seed: int, *cols) -> Column:
    """Uniform in [0, 1) from the columns' hash: the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / float(1 << 53)


def fold(items: Column, seed: int) -> Column:
    """struct<done: array<item>, open: item>: one ordered pivotal pass over a block's items."""
    def step(acc, x):
        o = acc["open"]
        # words that can move to the open document from x, and the other way
        give = F.least((1 - o["p"]) * o["size"], x["p"] * x["size"])
        take = F.least(o["p"] * o["size"], (1 - x["p"]) * x["size"])
        first = chance(seed, o["place"], x["place"]) < take / (give + take)
        o_new = F.when(first, F.when(give < x["p"] * x["size"], 1.0).otherwise(o["p"] + give / o["size"])) \
            .otherwise(F.when(take < (1 - x["p"]) * x["size"], 0.0).otherwise(o["p"] - take / o["size"]))
        x_new = F.when(first, F.when(give < x["p"] * x["size"], x["p"] - give / x["size"]).otherwise(0.0)) \
            .otherwise(F.when(take < (1 - x["p"]) * x["size"], x["p"] + take / x["size"]).otherwise(1.0))
        o2, x2 = o.withField("p", o_new), x.withField("p", x_new)
        o_done = (o_new <= 0) | (o_new >= 1)
        return F.when(o.isNull(), F.struct(acc["done"].alias("done"), x.alias("open"))).otherwise(F.struct(
            F.concat(acc["done"], F.array(F.when(o_done, o2).otherwise(x2))).alias("done"),
            F.when(o_done, x2).otherwise(o2).alias("open")))

    start = F.struct(F.array().cast(f"array<{ITEM}>").alias("done"), F.lit(None).cast(ITEM).alias("open"))
    return F.aggregate(items, start, step)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``nth``, which tells equal rows apart: they are counted (map-side first) and written out again from their number.

    The number is the same in every run, whatever the files; it comes in chunks, so that no array is long.
    """
    each = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    chunk = each.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
    last = F.least(F.col("chunk") + CHUNK, F.col("n")) - 1
    return chunk.withColumn("nth", F.explode(F.sequence("chunk", last))).drop("n", "chunk")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs`` (doc_id, text, source, ...).

    ``size`` counts words (null text: 0), ``taken`` is size times the copies the mix takes, at most
    ``most``. Documents without words are never taken. Decisions hash doc_id, size, text, the number among equal
    rows and the seed, so reruns agree and rows that share a doc_id, or have none, are dealt into many blocks and
    decided one by one. A null source is a source of its own, a null doc_id an ordinary id. Other columns are ignored; an empty table gives an
    empty result.
    """
    rows = C.written(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), n_words(F.col("text")).alias("size"),
                                 F.xxhash64("text").alias("text_hash")), "mix-sizes")
    goal = C.written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix-targets")
    named = numbered(rows).join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    copies = F.when(F.col("size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    item = named.withColumn("copies", copies).select("source", F.struct(
        "doc_id", "size", "source_size", "target", F.floor("copies").cast("int").alias("whole"),
        (F.col("copies") - F.floor("copies")).alias("p"), F.xxhash64(F.lit(seed), "doc_id", "size", "text_hash", "nth").alias("place")).cast(ITEM).alias("item"))
    certain = item.where("item.p <= 0").select("item")
    open_ = item.where("item.p > 0")
    blocks = max(0, -(-rows.count() // BLOCK) - 1).bit_length()
    done = [certain]
    while True:
        # an item's block: the leading bits of its place; the next level drops BLOCK_BITS of them
        block = F.shiftrightunsigned(F.col("item.place"), 64 - blocks) if blocks else F.lit(0).cast("long")
        folded = open_.groupBy("source", block.alias("block")).agg(F.array_sort(F.collect_list(
            F.struct(F.col("item.place"), F.col("item.doc_id"), F.col("item.size"), F.col("item").alias("item")))).alias("items"))
        folded = C.written(folded.select("source", fold(F.col("items.item"), seed).alias("r")), "mix-level")
        done.append(folded.select(F.explode("r.done").alias("item")))
        open_ = folded.where("r.open IS NOT NULL").select("source", F.col("r.open").alias("item"))
        if not blocks:
            break
        blocks = max(0, blocks - BLOCK_BITS)
    done.append(open_.select(F.col("item").withField("p", F.round("item.p")).alias("item")))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    taken = F.col("item.size") * (F.col("item.whole") + (F.col("item.p") >= 1).cast("int"))
    return out.select("item.doc_id", "item.size", "item.source_size", "item.target", taken.alias("taken"))
