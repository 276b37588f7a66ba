"""Helpers shared by the operators: written tables, word hashing in numpy, key exchange, components.

Word hashing works on whole Arrow buffers: a document's words are the maximal runs of bytes
outside ``[\\x20\\x09-\\x0D]``, each hashed to 64 bits by a polynomial over its bytes (prefix sums,
no loop over words). Two different words share a hash with probability about 2**-64.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefold.session import ensure_checkpoint_dir, ship_package

BASE = 0x9E3779B97F4A7C15          # odd, so that it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BLOCK_BYTES = 1 << 20              # text hashed at once; a longer document is a block of its own
FLUSH_ENTRIES = 1 << 20            # keys gathered in a task before they are sent on

_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


# ---------------------------------------------------------------------------
# written tables
# ---------------------------------------------------------------------------
def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts lineage: a lost executor costs a re-read, not a recomputation. The folder belongs to the
    application (``<spark.checkpoint.dir>/tablefold-llm/<application id>``) and goes with it.
    """
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), "tablefold-llm", spark.sparkContext.applicationId,
                        f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Write ``df`` bucketed by ``key`` under the shared checkpoint folder: joins on the key don't move it again."""
    spark = df.sparkSession
    n = shuffle_partitions(spark)
    table = f"{name}_{uuid.uuid4().hex}"
    path = os.path.join(ensure_checkpoint_dir(spark), "tablefold-llm", spark.sparkContext.applicationId, table)
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(table)
    return spark.table(table)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prepared(spark: SparkSession) -> None:
    """Make the package importable in Python workers."""
    ship_package(spark)


# ---------------------------------------------------------------------------
# words and their hashes
# ---------------------------------------------------------------------------
def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for k, base in enumerate((BASE, INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


class Words:
    """The words of rows ``lo`` to ``hi`` of a column: byte spans, hashes and first word per row."""

    def __init__(self, lo: int, hi: int, raw: bytes, offsets: np.ndarray):
        self.lo, self.hi, self.raw = lo, hi, raw
        buf = np.frombuffer(raw, np.uint8)
        n = len(buf)
        inside = ~SPACE[buf]
        first = np.zeros(n + 1, bool)
        first[offsets] = True                      # a row's first byte starts a new word
        edge = np.ones(n + 1, bool)                # edge[i]: no word goes on over the cut before byte i
        edge[1:n] = ~inside[:-1]
        edge |= first
        self.starts = np.flatnonzero(inside & edge[:n])
        after = np.ones(n + 1, bool)
        after[:n] = ~inside
        after |= first
        self.ends = np.flatnonzero(inside & after[1:]) + 1
        self.offsets = np.searchsorted(self.starts, offsets)   # of each row's first word; one more at the end
        power, inverse = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64, out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * inverse[self.starts]
        self.hashes = mix(h + (self.ends - self.starts).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on, over row ends too: mask with ``left``."""
        h = self.hashes
        out = np.zeros(len(h), np.uint64)
        n = len(h) - k + 1
        if n > 0:
            g = h[:n].copy()
            for i in range(1, k):
                g = mix(g * np.uint64(3) + h[i:n + i])
            out[:n] = g
        return out

    def left(self) -> np.ndarray:
        """Words from each word to the end of its row, itself included."""
        n = np.diff(self.offsets)
        return np.repeat(self.offsets[1:], n) - np.arange(len(self.hashes))

    def rows(self) -> np.ndarray:
        """Row (from 0 in this block) of each word."""
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.offsets))


def word_blocks(texts, lower: bool = False):
    """``Words`` of a string column, block by block; null texts have no words."""
    arr = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    arr = arr.cast(pa.large_string()).fill_null("")
    n = len(arr)
    if not n:
        return
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + n + 1]
    data = memoryview(arr.buffers()[2] or b"")
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + BLOCK_BYTES, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        raw = bytes(data[offsets[lo]:offsets[hi]])
        yield Words(lo, hi, raw.lower() if lower else raw, offsets[lo:hi + 1] - offsets[lo])
        lo = hi


# ---------------------------------------------------------------------------
# key exchange: (key, owner) entries to the task that owns the key's bucket
# ---------------------------------------------------------------------------
KEYED = "bucket int, payload binary"
GROUPED = "grp int, payload binary"


def pack(keys: np.ndarray, owners: np.ndarray, width: int = 8) -> bytes:
    """Entries as bytes, by owner; owners as steps of the fewest bytes that hold them.

    Of the keys the lowest ``width`` bytes are kept (fewer where matches are verified later on).
    """
    order = np.argsort(owners, kind="stable")
    keys, owners = keys[order], owners[order]
    steps = np.diff(owners)
    most = int(steps.max()) if len(steps) and steps.min() >= 0 else (0 if not len(steps) else -1)
    size = next((w for w, top in ((1, 1 << 8), (2, 1 << 16), (4, 1 << 32)) if 0 <= most < top), 0)
    head = bytes([size, width]) + len(keys).to_bytes(8, "little") + int(owners[0]).to_bytes(8, "little", signed=True)
    rest = np.concatenate([[0], steps]).astype(f"<u{size}").tobytes() if size else owners.tobytes()
    return head + rest + np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, width, n = blob[0], blob[1], int.from_bytes(blob[2:10], "little")
    at = 18 + n * (size or 8)
    if size:
        first = int.from_bytes(blob[10:18], "little", signed=True)
        owners = first + np.cumsum(np.frombuffer(blob[18:at], f"<u{size}").astype(np.int64))
    else:
        owners = np.frombuffer(blob[18:at], np.int64)
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :width] = np.frombuffer(blob[at:], np.uint8).reshape(n, width)
    return keys.reshape(-1).view("<u8"), owners


def by_key(keys: np.ndarray, owners: np.ndarray):
    """Distinct entries ordered by key and owner; for each its key group's first and last owner."""
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    if len(keys):
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
        keys, owners = keys[new], owners[new]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(keys)))
    return keys, owners, np.repeat(owners[starts], sizes), np.repeat(owners[starts + sizes - 1], sizes)


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    return (ids ^ (ids >> 17)) % groups


def group_column(spark: SparkSession, name: str = "doc_id"):
    """The group of an id as ``group_of`` has it; null ids are in group 0."""
    return F.coalesce(F.expr(f"pmod({name} ^ shiftright({name}, 17), {groups_of(spark)}L)"), F.lit(0)).cast("int")


def groups_of(spark: SparkSession) -> int:
    return shuffle_partitions(spark) | 1


def grouped(keys: np.ndarray, owners: np.ndarray, groups: int):
    """Entries as an Arrow batch of one row for each group of owners."""
    grp = group_of(owners, groups)
    order = np.argsort(grp, kind="stable")
    keys, owners, grp = keys[order], owners[order], grp[order]
    cuts = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1]])) if len(grp) else np.zeros(0, int)
    blobs = [pack(keys[a:b], owners[a:b]) for a, b in zip(cuts, [*cuts[1:], len(grp)])]
    return pa.RecordBatch.from_arrays([pa.array(grp[cuts].astype(np.int32)), pa.array(blobs, pa.binary())], ["grp", "payload"])


class Sender:
    """Gathers entries in a task and turns them into rows for the exchange.

    A key that many owners of one task share is combined here: only its smallest and largest
    owner travel on, the others are settled at once (``settle(first, last, owner)`` says which of
    them are found), so that a key held by a third of all documents sends two entries from each
    task. Found entries go as bucket -1 - b, which the receiving side passes on.
    """

    def __init__(self, bits: int, settle, width: int = 8):
        self.bits, self.settle, self.width = bits, settle, width
        self.keys: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.n = 0

    def add(self, keys: np.ndarray, owners: np.ndarray):
        self.keys.append(keys)
        self.owners.append(owners)
        self.n += len(keys)
        if self.n >= FLUSH_ENTRIES:
            yield from self.flush()

    def flush(self):
        if not self.n:
            return
        keys, owners, first, last = by_key(np.concatenate(self.keys), np.concatenate(self.owners))
        self.keys, self.owners, self.n = [], [], 0
        ends = (owners == first) | (owners == last)
        done = ~ends & self.settle(first, last, owners)
        shift = np.uint64(64 - self.bits)
        rows: list[tuple[int, bytes]] = []
        for part, sign in ((ends, 0), (done, 1)):
            k, o = keys[part], owners[part]
            bucket = (k >> shift).astype(np.int64)          # keys are in order, so buckets are runs
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(k) else []
            for a, b in zip(cuts, [*cuts[1:], len(k)]):
                rows.append((int(-1 - bucket[a]) if sign else int(bucket[a]), pack(k[a:b], o[a:b], self.width)))
        for lo in range(0, len(rows), 64):
            part = rows[lo:lo + 64]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()),
                                              pa.array([r[1] for r in part], pa.binary())], ["bucket", "payload"])


def exchange(sent: DataFrame, settle) -> DataFrame:
    """Bring each bucket's entries together and keep those that ``settle`` finds: (grp, payload).

    A task holds one bucket at a time; there are several buckets to a partition, and their number
    follows ``spark.sql.shuffle.partitions``, which has to grow with the data. Found entries come
    out in blobs for groups of owners, see ``with_found``.
    """
    groups = groups_of(sent.sparkSession)

    def receive(batches):
        held, keys, owners = None, [], []
        found_k, found_o, n = [], [], 0

        def settled():
            if keys:
                k, o, first, last = by_key(np.concatenate(keys), np.concatenate(owners))
                found = settle(first, last, o)
                found_k.append(k[found])
                found_o.append(o[found])

        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                k, o = unpack(blob.as_py())
                if bucket < 0:
                    found_k.append(k)
                    found_o.append(o)
                else:
                    if bucket != held:
                        settled()
                        held, keys, owners = bucket, [], []
                    keys.append(k)
                    owners.append(o)
                n = sum(map(len, found_k))
                if n >= FLUSH_ENTRIES:
                    yield grouped(np.concatenate(found_k), np.concatenate(found_o), groups)
                    found_k, found_o = [], []
        settled()
        if sum(map(len, found_k)):
            yield grouped(np.concatenate(found_k), np.concatenate(found_o), groups)

    n = shuffle_partitions(sent.sparkSession)
    return sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(receive, GROUPED)


def with_found(docs: DataFrame, found: DataFrame, handle, schema: str) -> DataFrame:
    """Run ``handle(batch of docs, keys, owners)`` with the found entries of the documents' group.

    Documents (doc_id, text) and found entries are dealt by group and sorted so that a group's
    entries come before its documents; a task holds the entries of one group and streams the
    documents past them. Owners ascend, and a document's keys are a slice of them.
    """
    spark = docs.sparkSession
    rows = docs.select(group_column(spark).alias("grp"), F.lit(1).alias("kind"), "doc_id", "text", F.lit(None).cast("binary").alias("payload"))
    blobs = found.select("grp", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "payload")
    both = rows.union(blobs).repartition(shuffle_partitions(spark), "grp").sortWithinPartitions("grp", "kind")

    def stream(batches):
        held, parts = None, []
        keys, owners = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            grp, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (grp[1:] != grp[:-1]) | (kind[1:] != kind[:-1])]))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(grp)]):
                if grp[a] != held:
                    held, parts = grp[a], []
                    keys, owners = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if kind[a] == 0:
                    parts += [unpack(x.as_py()) for x in batch.column(4).slice(a, b - a)]
                    continue
                if parts:
                    keys, owners = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    order = np.argsort(owners, kind="stable")
                    keys, owners, parts = keys[order], owners[order], []
                yield from handle(batch.slice(a, b - a), keys, owners)

    def columns(batches):
        yield from stream(batches)

    return both.mapInArrow(columns, schema)


def bucket_bits(spark: SparkSession) -> int:
    return max(4, (2 * shuffle_partitions(spark)).bit_length())


# ---------------------------------------------------------------------------
# connected components
# ---------------------------------------------------------------------------
def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) links of any two distinct longs -> (node, component): the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): every round is an
    aggregate and a join on the node, written out, until the links stop changing; rounds grow with
    the logarithm of the largest component, not with its diameter. Hot nodes are pre-aggregated
    (``min``) and joined back, so no group is collected. Nodes without links are not returned.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def stats(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    cur = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = stats(cur)
    while before[0]:
        sides = both(cur)                                           # large star: greater neighbours to the least one
        least = sides.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = (sides.where("b > a").join(least, "a").where("b <> m")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))       # small star: smaller neighbours and itself to the least
        small = (large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least.select("a", F.col("m").alias("b"))).distinct())
        cur = written(small, name)
        after = stats(cur)
        if after == before:
            break
        before = after
    stars = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(cur.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
