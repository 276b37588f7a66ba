"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Terms of a document are word unigrams and unigrams to trigrams of word shapes (runs of upper case,
lower case and digits become one sign each, other signs stay, a word that repeats the one before is
marked), each hashed into ``BUCKETS`` indicators. On the labelled sample an indicator is scaled by the
log ratio of how often the two classes show it; a linear model with squared hinge loss is fitted to
the scaled indicators by dual coordinate descent, and its margin is put between 0 and 1 by a
logistic curve fitted on part of the sample that the model did not see.

The sample is at most ``SAMPLE`` labelled rows in the order of a hash, as the model's bound; scoring
runs over all rows and whole texts, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefold.llm import common as C

SAMPLE = 12_000               # labelled rows the model is fitted on, at most
BUCKETS = 1 << 18
WORD_PART = 1 << 17           # of them for words; the others for shapes
SMOOTH = 1.0
COST, PASSES = 0.1, 12
THRESHOLD = 0.7
SHAPE = np.zeros(256, np.uint8)
SHAPE[ord("a"):ord("z") + 1] = 1
SHAPE[ord("A"):ord("Z") + 1] = 2
SHAPE[ord("0"):ord("9") + 1] = 3
SHAPE[128:] = 1                # letters beyond ASCII
for _i in range(33, 127):
    if SHAPE[_i] == 0:
        SHAPE[_i] = _i


SIGNS = C.mix(np.arange(256 * 64, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))      # a sign at a place


def shape_hashes(w: C.Words) -> np.ndarray:
    """Hash of each word's shape: its signs with runs of one kind taken as one, with a mark for repeats."""
    buf = np.frombuffer(w.raw, np.uint8)
    kind = SHAPE[buf]
    first = np.ones(len(buf), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[w.starts] = True
    chars = np.flatnonzero(first & ~C.SPACE[buf])            # the kept signs, word by word
    start = np.searchsorted(chars, w.starts)
    rank = np.arange(len(chars)) - np.repeat(start, np.diff(np.append(start, len(chars))))
    out = np.add.reduceat(SIGNS[kind[chars].astype(np.int64) * 64 + np.minimum(rank, 63)], start)
    same = np.zeros(len(out), bool)
    same[1:] = w.hashes[1:] == w.hashes[:-1]
    same[w.offsets[:-1][w.offsets[:-1] < len(out)]] = False
    return C.mix(out + same.astype(np.uint64))


def terms(w: C.Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct indicators of a block's rows, by row."""
    row = w.rows()
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left = w.left()
    shapes = shape_hashes(w)
    rows, buckets = [row], [(w.hashes % np.uint64(WORD_PART)).astype(np.int64)]
    gram = shapes.copy()
    for k in range(1, 4):
        if k > 1:
            gram = C.mix(gram[:-1] * np.uint64(3) + shapes[k - 1:])
        ok = left[:len(gram)] >= k
        rows.append(row[:len(gram)][ok])
        buckets.append(((C.mix(gram[ok] + np.uint64(k)) % np.uint64(BUCKETS - WORD_PART)).astype(np.int64)) + WORD_PART)
    flat = np.concatenate(rows) * BUCKETS + np.concatenate(buckets)
    flat.sort()
    flat = flat[np.concatenate([[True], flat[1:] != flat[:-1]])]
    return flat // BUCKETS, flat % BUCKETS


def fit(rows: list[np.ndarray], labels: np.ndarray) -> dict:
    """Fit to the indicators of documents: {weights, a, b}; score = 1 / (1 + exp(-(a * margin + b)))."""
    weights = np.zeros(BUCKETS)
    if not len(rows) or labels.min() == labels.max():
        share = float(np.clip(labels.mean(), 0.05, 0.95)) if len(rows) else 0.5
        return {"weights": weights, "a": 0.0, "b": float(np.log(share / (1 - share)))}
    held = np.arange(len(rows)) % 5 == 0
    train = np.flatnonzero(~held)
    counts = []
    for c in (1, 0):
        chosen = [rows[i] for i in train if labels[i] == c]
        n = np.bincount(np.concatenate(chosen), minlength=BUCKETS) + SMOOTH if chosen else np.full(BUCKETS, SMOOTH)
        counts.append(n / n.sum())
    ratio = np.log(counts[0] / counts[1])
    y = np.where(labels == 1, 1.0, -1.0)
    x = [ratio[r] / max(1.0, np.sqrt(len(r))) for r in rows]
    share = np.array([1 / max(1, np.count_nonzero(y[train] == s)) for s in (-1, 1)])
    cost = COST * len(train) * np.where(y > 0, share[1], share[0]) / 2          # classes weigh the same
    alpha, w, bias = np.zeros(len(rows)), np.zeros(BUCKETS), 0.0
    norm = np.array([float(v @ v) + 1.0 for v in x]) + 1 / (2 * cost)
    rng = np.random.default_rng(5)
    for _ in range(PASSES):
        for i in rng.permutation(train):
            g = y[i] * (w[rows[i]] @ x[i] + bias) - 1 + alpha[i] / (2 * cost[i])
            new = max(0.0, alpha[i] - g / norm[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * x[i]
                bias += step
                alpha[i] = new
    margin = np.array([w[r] @ v + bias for r, v in zip(rows, x)])
    # logistic curve on the held part, the classes as they are
    m, t = margin[held], (labels[held] == 1).astype(float)
    a, b = 2.0, 0.0
    if 0 < t.sum() < len(t):
        hi, lo = (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2)
        t = np.where(t > 0, hi, lo)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -35, 35)))
            v = np.maximum(p * (1 - p), 1e-9)
            grad = np.array([((p - t) * m).sum() + 1e-3 * a, (p - t).sum()])
            hess = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-6]])
            step = np.linalg.solve(hess, grad)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-8:
                break
    return {"weights": w * ratio, "a": float(a), "b": float(b + a * bias)}


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> dict:
    """Fit on the labelled rows that are not held out. Labels null or other than 0 and 1 are ignored."""
    spark = docs.sparkSession
    C.prepared(spark)
    chosen = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    chosen = chosen.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")      # at most ``most`` rows

    def features(batches):
        for batch in batches:
            for w in C.word_blocks(batch.column(1)):
                row, bucket = terms(w)
                ends = np.searchsorted(row, np.arange(w.hi - w.lo + 1))
                lists = [bucket[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, w.hi - w.lo), batch.column(2).slice(w.lo, w.hi - w.lo),
                                                  pa.array(lists, pa.binary())], ["doc_id", "quality", "terms"])

    got = rows.select("doc_id", "text", "quality").mapInArrow(features, "doc_id long, quality int, terms binary").collect()
    got = sorted(got, key=lambda r: (r.doc_id, bytes(r.terms)))
    return fit([np.frombuffer(bytes(r.terms), np.int32).astype(np.int64) for r in got], np.array([r.quality for r in got], np.int64))


def held_out(name: str):
    return F.coalesce(F.crc32(F.col(name).cast("string")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, score [, kept columns]) of every row, from its text alone; a null text is empty."""
    C.prepared(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model["weights"].astype(np.float32), model["a"], model["b"]))

    def run(batches):
        weights, a, b = shared.value
        for batch in batches:
            for w in C.word_blocks(batch.column(1)):
                row, bucket = terms(w)
                n = np.bincount(row, minlength=w.hi - w.lo)
                margin = np.bincount(row, weights[bucket], w.hi - w.lo) / np.maximum(1.0, np.sqrt(n))
                scores = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
                cols = [c.slice(w.lo, w.hi - w.lo) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       *[F.col(c) for c in keep or [] if c not in ("doc_id", "text")])
    schema = rows.schema.simpleString()[len("struct<"):-1]
    return rows.mapInArrow(run, schema + ",score:double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text, ...).

    ``labels`` (doc_id, quality, ...) teach only where crc32(doc_id as text) mod 4 is not 2; a doc_id
    labelled twice counts as its larger label. Empty and null texts get the score of no indicators;
    rows that repeat a doc_id are scored one by one; a null doc_id is not held out. Without labels of
    both classes every score is the same. Other columns are ignored; an empty table gives an empty
    result.
    """
    rows = score(docs, train(docs, labels, most))
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
