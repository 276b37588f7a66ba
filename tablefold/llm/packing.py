"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

Documents are tokenised once, where they are read, and cut there: full sequences first, the rest
into powers of two down to ``LEAST`` and a shorter tail. Only the pieces' places, lengths and
checksums travel on, written once as a table. A group of about ``GROUP_PIECES`` pieces, dealt by a hash of id, start and place in that
table (so that a hot source, and rows that share an id or have none, are spread), is packed by one task: pieces in descending order go to the sequence of least cost that still has room, where
a piece of n tokens costs ``LINEAR * n + QUADRATIC * n * n`` (attention stays inside a piece).
Descending powers of two fill sequences without gaps; the tails close what they leave, so padding is
a few tokens a sequence and the compute of sequences is alike. Each group has one short sequence.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefold.llm import common as C

LENGTH = 2048
LEAST = 16
END = 1                       # the id that closes a document
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
GROUP_PIECES = 1 << 14
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenizer(json_path: str, ranks_path: str):
    """text -> ids of the vocabulary in ``json_path``.

    The same vocabulary as byte ranks runs several times faster and gives the same ids; texts that
    contain a special token's string, or that the fast encoder refuses, go to the original one.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(json_path)
    special = [t.content for t in exact.get_added_tokens_decoder().values()]
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> list[int]:
        if not any(s in text for s in special):
            try:
                return fast.encode_ordinary(text)
            except Exception:  # noqa: BLE001  the fast encoder's own limits, e.g. its regex stack
                pass
        return exact.encode(text, add_special_tokens=False).ids

    return ids


def cuts(total: int, length: int = LENGTH, least: int = LEAST) -> list[int]:
    """Lengths of a document's pieces in order."""
    out = [length] * (total // length)
    rest = total % length
    size = 1 << max(0, length.bit_length() - 1)
    while rest >= least:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


def pack_group(lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces given in descending length."""
    full = int(np.count_nonzero(lengths >= length))
    rest = lengths[full:]
    bins = full + -(-int(rest.sum()) // length)
    seq = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    seq[:full] = np.arange(full)
    used = [0] * bins
    heap = [(0.0, b) for b in range(full, bins)]
    waiting: dict[int, list] = {}                # sequences by the room they have, too little for the last piece
    last = length
    for i, n in enumerate(rest.tolist(), full):
        for room in range(n, last):              # lengths descend: these have room again
            for entry in waiting.pop(room, ()):
                heapq.heappush(heap, entry)
        last = n
        while heap:
            cost, b = heap[0]
            room = length - used[b]
            if room >= n:
                break
            heapq.heappop(heap)
            if room:
                waiting.setdefault(room, []).append((cost, b))
        else:
            cost, b = 0.0, len(used)
            used.append(0)
            heapq.heappush(heap, (cost, b))
        seq[i], offset[i] = b, used[b]
        used[b] += n
        heapq.heapreplace(heap, (cost + LINEAR * n + QUADRATIC * n * n, b))
    return seq, offset


def pieces(docs: DataFrame, json_path: str, ranks_path: str, length: int = LENGTH) -> DataFrame:
    """Tokenise and cut every document."""
    def run(batches):
        ids_of = tokenizer(json_path, ranks_path)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array(ids_of(text.as_py() or "") + [END], "<u4")
                at = 0
                for n in cuts(len(ids), length):
                    out.append((doc, at, n, zlib.crc32(ids[at:at + n].tobytes()), len(ids)))
                    at += n
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, json_path: str, ranks_path: str, length: int = LENGTH) -> DataFrame:
    """Pack every row of ``docs`` (doc_id, text, ...): one output row for each piece.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset). A null text is empty: its
    document is the closing id alone. Rows that repeat a doc_id, or whose doc_id is null, are packed
    like any other. Other columns are ignored; an empty table gives an empty result.
    """
    C.prepared(docs.sparkSession)
    cut = C.written(pieces(docs, json_path, ranks_path, length), "packing-pieces")
    groups = max(1, -(-cut.count() // GROUP_PIECES))
    # places come from written files, so that a task that runs again deals its pieces alike
    cut = cut.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(groups)))

    def run(pdf):
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        seq, offset = pack_group(pdf["length"].to_numpy(), length)
        return pdf.drop(columns="grp").assign(sequence_id=seq + (int(pdf["grp"].iloc[0]) << 32), offset=offset)

    return cut.groupBy("grp").applyInPandas(run, PIECES + ", sequence_id long, offset long")
