"""PII spans: exact patterns, and a skip-chain conditional random field that makes labels consistent.

Patterns find e-mail, IP, card and phone spans in every whole text; they stay as they are. The field
then looks at a document's candidate tokens: tokens outside the spans that hold a digit, ``@`` or
``+``, and the spans themselves, whose labels are known. Unary potentials come from token features;
neighbours in the text share a chain potential, and equal or similar tokens at any distance a skip
potential. Loopy sum-product message passing gives each token's label distribution; a token whose
label is certain enough becomes a span.

The potentials are trained: a softmax over features, and the agreement of chain and skip pairs, on the
candidate tokens of at most ``SAMPLE`` documents in the order of a hash, with the patterns' spans as
labels. Documents are independent, so the work is one pass without a shuffle.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefold.llm import common as C

KINDS = ("email", "ip", "card", "phone")          # fixed values, in the contract's order
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[0-9@+][^\x20\x09-\x0D]*")
SAMPLE = 3000                                     # documents the potentials are trained on, at most
ROUNDS, CERTAIN = 8, 0.9
N = len(KINDS) + 1                                # label 0: none
FEATURES = 24
RESULT = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' spans, ordered."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:                                 # around each @, as the leftmost match would be
        lo = at
        while lo > end and text[lo - 1] in LOCAL_CHARS:
            lo -= 1
        m = DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            end = m.end()
            out.append((lo, 0, end))
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def features(token: str) -> list[int]:
    """Indicators of a token, as places in a vector of FEATURES."""
    digits = sum("0" <= c <= "9" for c in token)
    out = [0, 1 + min(digits, 20) // 4]                                              # 1..6
    at = token.find("@")
    if at >= 0:
        out.append(7)
        out.append(8 if "." in token[at:] else 9)
    dots = token.count(".")
    out.append(10 + min(dots, 4))                                                    # 10..14
    if token[:1] == "+":
        out.append(15)
    if digits * 2 >= len(token):
        out.append(16)
    if digits == len(token):
        out.append(17)
    if 12 <= digits <= 19:
        out.append(18)
        if luhn("".join(c for c in token if "0" <= c <= "9")):
            out.append(19)
    if "-" in token:
        out.append(20)
    if any(c in "\"'=/:" for c in token):
        out.append(21)
    if re.search("[A-Za-z]", token):
        out.append(22)
    if len(token) > 24:
        out.append(23)
    return out


def norm(token: str) -> str:
    return token.strip(".,;:!?\"'()[]{}<>*#$%&").lower()


def tokens(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label) of the candidate tokens; label 0 where no span is, -1 where a span overlaps in part."""
    out, k = [], 0
    for m in TOKEN.finditer(text):
        a, b = m.span()
        while a and text[a - 1] not in "\x20\t\n\x0b\f\r":       # from the start of its word
            a -= 1
        while k < len(spans) and spans[k][2] <= a:
            k += 1
        if k < len(spans) and spans[k][0] < b:
            continue
        out.append((a, b, 0))
    out += [(a, b, kind + 1) for a, kind, b in spans]
    return sorted(out)


def skips(names: list[str]) -> list[tuple[int, int]]:
    """Links of equal tokens, and of similar ones (one character left out at either end), as chains.

    Each token is linked to the one before it under each of its forms, so links grow with the tokens.
    """
    last: dict[str, int] = {}
    out = []
    for i, t in enumerate(names):
        if len(t) < 5:
            continue
        for form in {t, t[1:], t[:-1]}:
            j = last.get(form)
            if j is not None and j != i:
                out.append((j, i))
            last[form] = i
    return sorted(set(out))


def infer(unary: np.ndarray, known: np.ndarray, pairs: list[tuple[int, int, int]], potentials: np.ndarray) -> np.ndarray:
    """Label distributions by loopy sum-product; ``known`` >= 0 fixes a label. pairs: (i, j, which potential)."""
    local = unary - unary.max(axis=1, keepdims=True)
    fixed = known >= 0
    local[fixed] = -30.0
    local[fixed, known[fixed]] = 0.0
    local = np.exp(local)
    if not pairs:
        return local / local.sum(1, keepdims=True)
    i, j, which = (np.array(x) for x in zip(*pairs))
    src, dst, pot = np.concatenate([i, j]), np.concatenate([j, i]), np.exp(potentials[np.concatenate([which, which])])
    back = np.concatenate([np.arange(len(i)) + len(i), np.arange(len(i))])
    messages = np.full((len(src), N), 1.0 / N)
    for _ in range(ROUNDS):
        logs = np.log(messages)
        total = np.log(local)
        np.add.at(total, dst, logs)
        into = total[src] - logs[back]
        into = np.exp(into - into.max(1, keepdims=True))
        new = np.einsum("el,elm->em", into, pot)
        messages = 0.5 * messages + 0.5 * new / new.sum(1, keepdims=True)
    total = np.log(local)
    np.add.at(total, dst, np.log(messages))
    out = np.exp(total - total.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True)


def matrix(found: list[str]) -> np.ndarray:
    x = np.zeros((len(found), FEATURES))
    for r, t in enumerate(found):
        x[r, features(t)] = 1
    return x


def train(docs: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(feature weights [FEATURES, N], pair potentials [chain, skip][N, N]) from a bounded sample."""
    def gather(batches):
        for batch in batches:
            total = np.zeros((2, N, N))
            seen: dict[tuple, int] = {}
            for text in batch.column(0):
                t = text.as_py() or ""
                found = tokens(t, base_spans(t))
                names = [norm(t[a:b]) for a, b, _ in found]
                for a, b, label in found:
                    key = (label, *features(t[a:b]))
                    seen[key] = seen.get(key, 0) + 1
                for i in range(1, len(found)):
                    total[0, found[i - 1][2], found[i][2]] += 1
                for i, j in skips(names):
                    total[1, found[i][2], found[j][2]] += 1
            rows = [("f", list(map(int, k)), float(n)) for k, n in seen.items()]
            rows += [("p", [p, a, b], float(total[p, a, b])) for p in range(2) for a in range(N) for b in range(N) if total[p, a, b]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                                              pa.array([r[2] for r in rows], pa.float64())], ["what", "k", "n"])

    ids = docs.select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)                       # ids alone are ordered; at most ``most`` are broadcast
    sample = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids), "doc_id").select("text")
    got = sample.mapInArrow(gather, "what string, k array<int>, n double").groupBy("what", "k").agg(F.sum("n").alias("n")).orderBy("what", "k").collect()
    pairs = np.full((2, N, N), 0.5)
    x, y, n = [], [], []
    for r in got:
        if r.what == "p":
            p, a, b = r.k
            pairs[p, a, b] += r.n
            pairs[p, b, a] += r.n
        else:
            row = np.zeros(FEATURES)
            row[r.k[1:]] = 1
            x.append(row)
            y.append(r.k[0])
            n.append(r.n)
    weights = np.zeros((FEATURES, N))
    if x:
        x, y, n = np.array(x), np.eye(N)[y], np.array(n)[:, None] / sum(n)
        for _ in range(600):                                   # softmax by gradient steps on the whole (bounded) table
            s = x @ weights
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            weights -= 2.0 * (x.T @ (n * (p - y)) + 1e-5 * weights)
    joint = pairs / pairs.sum(axis=(1, 2), keepdims=True)
    side = joint.sum(2)
    return weights, np.log(joint / (side[:, :, None] * side[:, None, :]))       # pointwise mutual information


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def added_spans(text: str, spans: list[tuple[int, int, int]], weights: np.ndarray, potentials: np.ndarray) -> list[tuple[int, int, int]]:
    found = tokens(text, spans)
    labels = np.array([f[2] for f in found])
    if not len(found) or not (labels == 0).any():
        return []
    x = matrix([text[a:b] for a, b, _ in found])
    names = [norm(text[a:b]) for a, b, _ in found]
    links = skips(names)
    pairs = [(i - 1, i, 0) for i in range(1, len(found))] + [(i, j, 1) for i, j in links]
    p = infer(x @ weights, np.where(labels > 0, labels, -1), pairs, potentials)
    out = []
    for (a, b, label), row in zip(found, p):
        best = int(row.argmax())
        if label == 0 and best and row[best] >= CERTAIN:
            t = text[a:b]
            core = norm(t)
            at = a + t.lower().find(core)
            out.append((at, best - 1, at + len(core)))
    return out


def find(docs: DataFrame, model=None, keep: list[str] | None = None) -> DataFrame:
    """Spans of every row of ``docs`` (doc_id, text, ...).

    Returns doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the patterns' spans, ``spans``
    (all spans, ``kind:start:end`` in code points, end exclusive, by start and then kind) and n_added
    (spans that the field added). A null text is empty and has no spans. Rows that repeat a doc_id, or
    have none, are treated like any other; other columns are ignored unless named in ``keep``. An
    empty table gives an empty result.
    """
    C.prepared(docs.sparkSession)
    weights, potentials = model or train(docs)

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                t = text.as_py() or ""
                spans = base_spans(t)
                more = added_spans(t, spans, weights, potentials)
                n = [sum(k == i for _, k, _ in spans) for i in range(4)]
                rows.append((*n, hashlib.sha256(joined(spans).encode()).hexdigest(), joined(spans + more), len(more)))
            cols = list(zip(*rows)) if rows else [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types)], *batch.columns[2:]],
                                             ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", *(keep or [])])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"), *[F.col(c) for c in keep or []])
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(run, RESULT + more)
