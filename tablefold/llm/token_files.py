"""Token ids and masks in Arrow files of fixed-size lists.

Documents go in ascending ``doc_id`` order (nulls first) into as many ranges as the text's size asks
for. A task streams its range: it encodes each document, appends the end id and lets the ids run on
through sequences of ``LENGTH`` ids, which it writes batch by batch as one Arrow file with the columns
``ids`` (fixed-size list of uint16 or uint32, by the vocabulary's size) and ``mask`` (fixed-size list of
booleans, false where the last sequence of a file is padded). Every sequence has the same place in its
batch's buffer, so that ``TokenFile`` reads any sequence, mask or run of ids as a view of the mapped
file, without copying or decoding. A second Arrow file holds the documents' places (doc_id, start,
n_tokens). A file counts only if the manifest, which Spark writes when all tasks are done, has it:
attempts of lost executors leave files that nobody reads.

The files go to ``spark.checkpoint.dir`` (or the folder given) through Arrow's file systems, the manifest
through Spark. A file's first id is the sum of all earlier files' ids, by a window over the manifest.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablefold.llm import common as C
from tablefold.session import ensure_checkpoint_dir

LENGTH = 1024                 # ids of a sequence
BATCH = 512                   # sequences of a record batch
RANGE_BYTES = 48 << 20        # text of a range, which becomes a file
CACHE = 1 << 18               # distinct pieces of text whose ids a task keeps, twice
BLOCK_BYTES = 8 << 20         # text encoded at once
END = 2                       # the id that closes a document
MANIFEST = "part int, data string, places string, docs long, tokens long"


# ---------------------------------------------------------------------------
# files
# ---------------------------------------------------------------------------
def file_system(path: str):
    """Arrow's file system and the path in it, for a URI or a local path."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def opened(path: str):
    system, place = file_system(path)
    return pa.memory_map(place) if system.type_name == "local" else system.open_input_file(place)


class Writer:
    """Sequences of ids, batch by batch, and the places of documents beside them."""

    def __init__(self, folder: str, name: str, width: np.dtype, length: int = LENGTH, batch: int = BATCH):
        self.width, self.length, self.room = np.dtype(width), length, batch * length
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.width), length)), ("mask", pa.list_(pa.bool_(), length))])
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        self.data, self.places = f"{folder}/{name}.arrow", f"{folder}/{name}-places.arrow"
        self.place_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.streams = [system.open_output_stream(f"{base}/{name}{end}.arrow") for end in ("", "-places")]
        self.out = pa.ipc.new_file(self.streams[0], self.schema)
        self.index = pa.ipc.new_file(self.streams[1], self.place_schema)
        self.held: list[np.ndarray] = []
        self.n = 0
        self.rows: list[tuple] = []
        self.docs = self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray):
        self.rows.append((doc_id, self.tokens, len(ids)))
        self.docs += 1
        self.tokens += len(ids)
        self.held.append(ids.astype(self.width))
        self.n += len(ids)
        if self.n >= self.room:
            self._write(False)
        if len(self.rows) >= 1 << 14:
            self._write_places()

    def _write(self, last: bool):
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.width)
        while len(ids) >= self.room or (last and len(ids)):
            part, ids = ids[:self.room], ids[self.room:]
            rows = -(-len(part) // self.length)
            values = np.zeros(rows * self.length, self.width)
            values[:len(part)] = part
            mask = np.arange(rows * self.length) < len(part)
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (values, mask)]
            self.out.write_batch(pa.record_batch(arrays, schema=self.schema))
        self.held, self.n = [ids], len(ids)

    def _write_places(self):
        cols = list(zip(*self.rows)) if self.rows else [()] * 3
        self.index.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in cols], schema=self.place_schema))
        self.rows = []

    def close(self) -> tuple[str, str, int, int]:
        self._write(True)
        self._write_places()
        for x in (self.out, self.index, *self.streams):
            x.close()
        return self.data, self.places, self.docs, self.tokens


class TokenFile:
    """Random access to a file of sequences: views of the mapped bytes, nothing is copied."""

    def __init__(self, path: str):
        self.file = pa.ipc.open_file(opened(path))
        self.length = self.file.schema.field("ids").type.list_size
        self.batches: dict[int, pa.RecordBatch] = {}
        first = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self.per = max(1, first)                     # all batches but the last hold as many sequences

    def _batch(self, k: int) -> pa.RecordBatch:
        if k not in self.batches:
            self.batches = {k: self.file.get_batch(k)}
        return self.batches[k]

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return 0 if not n else (n - 1) * self.per + self.file.get_batch(n - 1).num_rows

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """The ids and the mask of sequence ``i``."""
        row = self._batch(i // self.per)
        at = i % self.per
        ids = row.column(0).values.to_numpy()[at * self.length:(at + 1) * self.length]
        return ids, row.column(1).values.slice(at * self.length, self.length)

    def run(self, start: int, n: int):
        """``n`` ids from place ``start`` on, as views, one for each batch they lie in."""
        step = self.per * self.length
        while n > 0:
            k, at = divmod(start, step)
            part = self._batch(k).column(0).values.to_numpy()[at:at + n]
            yield part
            start, n = start + len(part), n - len(part)


# ---------------------------------------------------------------------------
# encoding
# ---------------------------------------------------------------------------
class Encoder:
    """Texts -> ids, block by block.

    If the tokenizer's own pattern drops white space (``spaced``), a text's ids are those of its pieces
    between blanks, tabs and line breaks, in lower case as the tokenizer has it: Arrow cuts a block of texts
    into pieces and numbers the distinct ones, each of which is encoded once and kept in a bounded table.
    A full stop or comma after a small Latin letter is a piece too. Other tokenizers, and texts that hold a
    special token's string, get whole texts.
    """

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.spaced = spaced
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces as bytes."""
        known, older = self.known, self.older
        new = []
        for p in pieces:
            if p not in known:
                if p in older:
                    known[p] = older[p]
                else:
                    new.append(p)
        if new:
            e = self.tok.encode(new, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(e.ids, "<u4").tobytes()
            ends = np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(new)), "right") * 4
            at = 0
            for p, end in zip(new, ends.tolist()):
                known[p] = ids[at:end]
                at = end
        out = [known[p] for p in pieces]
        if len(known) > CACHE:
            self.known, self.older = {"": b""}, known
        return out

    def block(self, texts: pa.Array):
        """Ids of every text of a block, in order."""
        if not self.spaced:
            for t in texts:
                yield self.whole(t.as_py())
            return
        low = pc.ascii_lower(texts)
        odd = np.zeros(len(texts), bool)
        for s in self.special:
            odd |= pc.match_substring(low, s.lower()).to_numpy(zero_copy_only=False)
        for blank in "\n\t\r":
            low = pc.replace_substring(low, blank, " ")
        low = pc.replace_substring_regex(low, "([a-z\u00DF-\u00F6\u00F8-\u00FF])([.,]) ", r"\1 \2 ")
        lists = pc.split_pattern(low, " ")
        ends = lists.offsets.to_numpy()
        pieces = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        parts = self._pieces(pieces.dictionary.to_pylist())
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        ids, starts = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes
        index = pieces.indices.to_numpy()
        n = sizes[index]
        after = np.concatenate([[0], np.cumsum(n)])
        flat = ids[np.repeat(starts[index] - after[:-1], n) + np.arange(after[-1])]
        cuts = after[ends - ends[0]].tolist()
        for row, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            yield self.whole(texts[row].as_py()) if odd[row] else flat[lo:hi]

    def __call__(self, texts: pa.Array):
        """Ids of every text, in order; blocks of ``BLOCK_BYTES``, a longer text is a block of its own."""
        texts = texts.cast(pa.large_string())
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < len(texts):
            before = sizes[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(sizes, before + BLOCK_BYTES, "right")))
            yield from self.block(texts.slice(lo, hi - lo))
            lo = hi


def drops_space(path: str) -> bool:
    """Whether the tokenizer's pattern matches no white space and drops what it doesn't match, ids of a
    piece not depending on its neighbours (a lower-casing, white-space folding normalizer at most)."""
    import json
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    flat = lambda x, key: sum((flat(y, key) for y in x[key]), []) if x and key in x else [x] if x else []
    pre = flat(spec["pre_tokenizer"], "pretokenizers")
    norm = {n["type"] for n in flat(spec["normalizer"], "normalizers")}
    split = [p for p in pre if p["type"] == "Split"]
    spans = any(p["type"] == "ByteLevel" and (p["add_prefix_space"] or p["use_regex"]) for p in pre)
    return (len(split) == 1 and split[0]["behavior"] == "Removed" and split[0]["invert"] and r"[^\s\p{L}\p{N}]" in split[0]["pattern"].get("Regex", "")
            and not spans and norm <= {"NFC", "Replace", "Lowercase"} and not any(t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]))


# ---------------------------------------------------------------------------
# Spark
# ---------------------------------------------------------------------------
def write_files(docs: DataFrame, json_path: str, folder: str | None = None, end: int = END, length: int = LENGTH) -> DataFrame:
    """Encode ``docs`` (doc_id, text, ...) into files; the manifest (part, data, places, docs, tokens, base).

    Order: doc_id ascending, nulls first, rows of one doc_id by the hash of their text (equal rows are
    interchangeable). A null text is empty: the end id alone. Other columns are ignored; an empty table
    gives an empty manifest. Ranges follow the size of all texts, and a doc_id that many rows share is
    split by the text's hash; a row is the least a task can get. A task holds one batch and one document.
    """
    spark = docs.sparkSession
    C.prepared(spark)
    if folder is None:
        folder = os.path.join(ensure_checkpoint_dir(spark), "tablefold-llm", spark.sparkContext.applicationId, f"token-files-{uuid.uuid4().hex}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    ranges = max(min(spark.sparkContext.defaultParallelism, 1 + size // (1 << 20)), -(-size // RANGE_BYTES), 1)
    dealt = (rows.withColumn("h", F.xxhash64("text")).repartitionByRange(int(ranges), F.col("doc_id").asc_nulls_first(), "h")
             .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").drop("h"))
    spaced = drops_space(json_path)

    def run(batches):
        from pyspark import TaskContext
        encode = writer = None
        part = TaskContext.get().partitionId()
        for batch in batches:
            if writer is None and batch.num_rows:
                encode = Encoder(json_path, spaced)
                width = np.uint16 if max(encode.tok.get_vocab_size(with_added_tokens=True) - 1, end) < 1 << 16 else np.uint32
                writer = Writer(folder, f"{part:08d}-{uuid.uuid4().hex}", width, length)
            if batch.num_rows:
                for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                    writer.add(doc, np.append(ids, np.uint32(end)))
        if writer is not None:
            data, places, n, tokens = writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data]), pa.array([places]), pa.array([n], pa.int64()),
                                              pa.array([tokens], pa.int64())], ["part", "data", "places", "docs", "tokens"])

    manifest = C.written(dealt.mapInArrow(run, MANIFEST), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_files(manifest: DataFrame) -> DataFrame:
    """Documents from the files of a manifest: (doc_id, start, n_tokens, ids_crc32), start counting all files."""
    def run(batches):
        for batch in batches:
            for data, places, base in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ids, index = TokenFile(data), pa.ipc.open_file(opened(places))
                for k in range(index.num_record_batches):
                    doc, start, n = (c.to_numpy(zero_copy_only=False) if c.null_count == 0 else c for c in index.get_batch(k).columns)
                    crcs = []
                    for at, count in zip(start.tolist(), n.tolist()):
                        crc = 0
                        for part in ids.run(at, count):
                            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                        crcs.append(crc)
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start + base), pa.array(n), pa.array(crcs, pa.int64())],
                                                     ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("data", "places", "base")
    spark = manifest.sparkSession
    return files.repartition(C.shuffle_partitions(spark)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, json_path: str) -> DataFrame:
    """Write ``docs`` as token files and read every document back from them."""
    return read_files(write_files(docs, json_path))
