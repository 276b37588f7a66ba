"""Repair of conversation structure by dynamic programming over a shared grammar.

Each row of a conversation is one symbol: its role's initial (s, u, a, other) and fault (none, truncated,
must go). A symbol's edits are a min-plus matrix over what precedes (nothing, s, u, a): entry (i, j) is the
least cost of leading from i to j, with the ASCII-least edit letters of that cost. Re-Pair builds one
grammar for all conversations: Spark counts neighbouring symbols over the distinct sequences, the
most frequent pairs that don't overlap become rules, and the sequences are rewritten, round by round.
The matrices of the rules are products, evaluated bottom-up once and shared by all conversations; a
conversation is the product of the few symbols that are left of it.

Audits are ropes: a product keeps for each entry only the middle state, and texts are written out at
the end. Ties need no texts either: two audits of one row count that lead to different states are never
a prefix of each other (each ends with a row's letter), so that their order is that of their first
halves, and ranks in each matrix row decide it.

A conversation's rows are dealt by its id and sorted, and tasks stream them: rows' places, roles and hashes
first (no texts), then once more with texts for the hash of the repaired conversation. A task holds
a few bytes for each row of one conversation, as the audit itself does, never its texts.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefold.llm import common as C

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5       # costs of edits and of a truncated row that stays
PIECE = 512                   # symbols of a piece of a sequence
RULES = 256                   # of the grammar at most
ROUND_RULES = 32              # taken in a round at most
FIRST_RULE = 0x100            # code point of the first rule's symbol
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
START, S, U, A = range(4)
STATE = {"s": S, "u": U, "a": A}
ROLE = {"u": "user", "a": "assistant"}
NEXT = {START: "u", S: "u", U: "a", A: "u"}          # the role that an inserted or rerolled row gets
FAR = 1 << 60


# ---------------------------------------------------------------------------
# min-plus matrices with ropes
# ---------------------------------------------------------------------------
class Matrix:
    """cost, rank of the audit in its row, and the audit itself: letters of a symbol, or the middle state of a product."""

    def __init__(self, cost, rank, letters=None, parts=None, via=None):
        self.cost, self.rank, self.letters, self.parts, self.via = cost, rank, letters, parts, via


def symbol_matrix(symbol: str) -> Matrix:
    """Inserts before the row, then its edit. ``d``: the row must go; capitals: truncated."""
    best: list[list] = [[None] * 4 for _ in range(4)]
    role, stay = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    for start in range(4):
        state, spent, done = start, 0, ""
        for _ in range(3):
            edits = [(DELETE, "D", state)]
            if symbol != "d":
                edits.append((REROLE + stay, "R", STATE[NEXT[state]]))
                if role == NEXT[state] or (role == "s" and state == START):
                    edits.append((stay, "K", STATE[role]))
            for cost, letter, to in edits:
                new = (spent + cost, done + letter)
                if best[start][to] is None or new < best[start][to]:
                    best[start][to] = new
            state, spent, done = STATE[NEXT[state]], spent + INSERT, done + "I"
    cost = [[e[0] if e else FAR for e in row] for row in best]
    letters = [[e[1] if e else "" for e in row] for row in best]
    return Matrix(cost, [_ranks([(c >= FAR, x) for c, x in zip(*r)]) for r in zip(cost, letters)], letters=letters)


def _ranks(keys: list) -> list[int]:
    order = sorted(range(len(keys)), key=keys.__getitem__)
    out = [0] * len(keys)
    for place, k in enumerate(order):
        out[k] = place
    return out


def product(left: Matrix, right: Matrix) -> Matrix:
    cost, via, rank = [], [], []
    for i in range(4):
        row = []
        for j in range(4):
            row.append(min((left.cost[i][k] + right.cost[k][j], left.rank[i][k], k) for k in range(4)))
        cost.append([min(c, FAR) for c, _, _ in row])
        via.append([k for _, _, k in row])
        rank.append(_ranks([(c >= FAR, r, right.rank[k][j]) for j, (c, r, k) in enumerate(row)]))
    return Matrix(cost, rank, parts=(left, right), via=via)


def written_out(m: Matrix, i: int, j: int) -> str:
    """The rope's letters."""
    out, todo = [], [(m, i, j)]
    while todo:
        m, i, j = todo.pop()
        if m.letters is not None:
            out.append(m.letters[i][j])
        else:
            k = m.via[i][j]
            todo += [(m.parts[1], k, j), (m.parts[0], i, k)]
    return "".join(out)


class Grammar:
    """Rules (pair of symbols -> symbol) and the matrices of all symbols, bottom-up."""

    def __init__(self, pairs: list[str]):
        self.of = {x: symbol_matrix(x) for x in "suaxSUAXd"}
        for n, (a, b) in enumerate(pairs):
            self.of[chr(FIRST_RULE + n)] = product(self.of[a], self.of[b])

    def repair(self, code: str) -> tuple[int, str]:
        """Least cost and its ASCII-least audit of a sequence that starts with nothing and may end so or after an assistant."""
        cost, rank, steps = [0, FAR, FAR, FAR], [0, 1, 2, 3], []
        for symbol in code:
            m = self.of[symbol]
            row = [min((cost[k] + m.cost[k][j], rank[k], k) for k in range(4)) for j in range(4)]
            rank = _ranks([(c >= FAR, r, m.rank[k][j]) for j, (c, r, k) in enumerate(row)])
            cost = [min(c, FAR) for c, _, _ in row]
            steps.append((m, [k for _, _, k in row]))
        ends = [(cost[START], rank[START], START, ""), (cost[A], rank[A], A, ""),
                (cost[U] + INSERT, rank[U], U, "I"), (cost[S] + 2 * INSERT, rank[S], S, "II")]
        least, _, state, tail = min(ends)
        parts = [tail]
        for m, via in reversed(steps):
            parts.append(written_out(m, via[state], state))
            state = via[state]
        return least, "".join(reversed(parts))


# ---------------------------------------------------------------------------
# Re-Pair
# ---------------------------------------------------------------------------
def rewritten(seq, pairs: list[str]):
    """A sequence column with every rule applied in order."""
    if not pairs:
        return F.col(seq)
    rules = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(chr(FIRST_RULE + n)).alias("x")) for n, p in enumerate(pairs)])
    return F.aggregate(rules, F.col(seq), lambda s, r: F.replace(s, r["p"], r["x"]))


def repair_pairs(pieces: DataFrame, most: int = RULES) -> list[str]:
    """The rules' pairs, in order. ``pieces`` (seq, ...): sequences of at most ``PIECE`` symbols.

    A round counts the neighbours in the distinct sequences, as often as they occur, and takes the most frequent ones
    of which none starts with what another ends with, so that they can't overlap. It stops when no
    pair occurs twice or the grammar has ``most`` rules; what is left unpaired is evaluated symbol by symbol.
    """
    distinct = C.written(pieces.groupBy("seq").agg(F.count("*").alias("n")), "repair-sequences")
    rules: list[str] = []
    while len(rules) < most:
        letters = distinct.select(F.filter(F.split(rewritten("seq", rules), ""), lambda x: x != "").alias("x"), "n").where(F.size("x") > 1)
        pairs = letters.select(F.explode(F.zip_with(F.slice(F.col("x"), F.lit(1), F.size("x") - 1), F.slice(F.col("x"), F.lit(2), F.size("x") - 1), lambda a, b: F.concat(a, b))).alias("pair"), "n")
        top = pairs.groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "pair").limit(4 * ROUND_RULES).collect()
        firsts, seconds, new = set(), set(), []
        for pair, _ in top:
            a, b = pair
            if len(new) < min(ROUND_RULES, most - len(rules)) and a not in seconds and b not in firsts:
                firsts.add(a)
                seconds.add(b)
                new.append(pair)
        if not new:
            break
        rules += new
    return rules


# ---------------------------------------------------------------------------
# rows
# ---------------------------------------------------------------------------
def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after damage by crc32 of ``conv_id:turn``; ``gone`` marks dropped rows."""
    one = F.lit(" ")
    d = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one)).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), one).alias("role"), F.coalesce(F.col("text").cast("string"), one).alias("text"), d.alias("d"))
    text = F.when(F.col("d").isin(0, 1), "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("d") == 0).alias("gone"),
                       F.explode(F.array_repeat(F.lit(1), F.when(F.col("d") == 3, 2).otherwise(1))).alias("one")).drop("one")
    return rows.withColumn("h", F.xxhash64("role", "text"))


def symbols(rows: DataFrame) -> DataFrame:
    """Each row's symbol but for duplicates, which only the order of rows shows."""
    body = F.rtrim("text", F.lit(SPACES))
    role = F.substring("role", 1, 1)
    role = F.when(role.isin("s", "u", "a"), role).otherwise("x")
    fault = F.when(F.length(body) == 0, "d").when(F.right(body, F.lit(1)).isin(".", "!", "?"), role).otherwise(F.upper(role))
    return rows.select("conv_id", "turn", "role", "h", "gone", role.alias("initial"), fault.alias("fault"))


STATS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
PIECES = "conv_id long, piece long, seq string, " + ", ".join(f"{s} long" for s in STATS)


def conversation(turns: list, hashes: np.ndarray, initials: str, faults: str):
    """(symbols, gaps, blank, duplicate, truncated, illegal) of one conversation's rows in order."""
    n = len(initials)
    if not n:
        return "", 0, 0, 0, 0, 0
    first = np.zeros(n, bool)
    first[np.unique(hashes, return_index=True)[1]] = True
    blank = faults.count("d")
    f = np.frombuffer(faults.encode(), np.uint8).copy()
    again = ~first & (f != ord("d"))
    f[again] = ord("d")
    seq = f.tobytes().decode()
    known = np.array([t for t in turns if t is not None], np.int64)
    gaps = int(known[-1] - known[0]) + 1 - len(np.unique(known)) if len(known) else 0
    legal = sum(initials.count(x) for x in ("su", "ua", "au"))
    return seq, gaps, blank, int(again.sum()), int(((f >= 65) & (f <= 90)).sum()), n - 1 - legal


def pieces_of(rows: DataFrame) -> DataFrame:
    """Sequences in pieces of ``PIECE`` symbols, with the conversation's counts; one empty piece where no row is left."""
    dealt = symbols(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "h")
    dealt = dealt.select("conv_id", "turn", "h", "gone", "initial", "fault")

    def run(batches):
        held, parts = None, None                             # parts: turns, hashes, initials, faults

        def ended():
            seq, *stats = conversation(sum(parts[0], []), np.concatenate(parts[1] or [np.zeros(0, np.int64)]), "".join(parts[2]), "".join(parts[3]))
            return [(held, k, seq[at:at + PIECE], *stats) for k, at in enumerate(range(0, max(1, len(seq)), PIECE))]

        out: list[tuple] = []
        for batch in batches:
            ids, turns, gone = (batch.column(k).to_pylist() for k in (0, 1, 3))
            initials, faults = (batch.column(k).to_pylist() for k in (4, 5))
            hashes = batch.column(2).to_numpy()
            n, lo = len(ids), 0
            while lo < n:
                hi = lo + 1
                while hi < n and ids[hi] == ids[lo]:
                    hi += 1
                if parts is None or ids[lo] != held:
                    if parts is not None:
                        out += ended()
                    held, parts = ids[lo], ([], [], [], [])
                keep = [i for i in range(lo, hi) if not gone[i]]
                parts[0].append([turns[i] for i in keep])
                parts[1].append(hashes[keep])
                parts[2].append("".join(initials[i] for i in keep))
                parts[3].append("".join(faults[i] for i in keep))
                lo = hi
            if len(out) > 4096:
                yield batch_of(out, PIECES)
                out = []
        if parts is not None:
            out += ended()
        if out:
            yield batch_of(out, PIECES)

    return dealt.mapInArrow(run, PIECES)


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [name for name, _ in fields])


RESULT = "conv_id long, " + ", ".join(f"{s} long" for s in STATS) + ", cost long, audit string, repaired_sha256 string"


class Repaired:
    """Hash of a repaired conversation, row by row, as its audit says."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.first = audit, 0, START, hashlib.sha256(), True

    def _line(self, role: bytes, text: bytes):
        self.hash.update((b"" if self.first else b"\n") + role + b":")
        self.hash.update(text)
        self.first = False

    def _inserted(self):
        while self.audit[self.at:self.at + 1] == "I":
            role = NEXT[self.state]
            self._line(ROLE[role].encode(), b"")
            self.state, self.at = STATE[role], self.at + 1

    def row(self, role: bytes, text: bytes):
        self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "D":
            return
        if letter == "R":
            role = ROLE[NEXT[self.state]].encode()
        self.state = STATE[chr(role[0])]
        self._line(role, text)

    def done(self) -> str:
        self._inserted()
        return self.hash.hexdigest()


def repaired(conversations: DataFrame, most_rules: int = RULES) -> DataFrame:
    """Damage, check and repair ``conversations`` (conv_id, turn, role, text, ...): a row for each conv_id.

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256). Nulls read as one
    space in ids' texts, roles and texts; a null conv_id is a conversation of its own. Rows of one turn are in the
    order of their roles and then of a hash of role and text; equal rows follow each other. A role whose initial is not s,
    u or a can be rerolled or deleted. Conversations without rows after damage give zeros, an empty audit and the hash of
    the empty text; an empty table gives an empty result. Other columns are ignored.
    """
    spark = conversations.sparkSession
    C.prepared(spark)
    rows = damaged(conversations)
    pieces = C.written(pieces_of(rows), "repair-pieces")
    pairs = repair_pairs(pieces, most_rules)
    none = lambda kind: F.lit(None).cast(kind)
    heads = pieces.select("conv_id", F.lit(0).alias("kind"), F.col("piece").alias("turn"), rewritten("seq", pairs).alias("role"), none("long").alias("h"), none("binary").alias("text"),
                          *STATS)
    lines = rows.where(~F.col("gone")).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "h", F.col("text").cast("binary").alias("text"), *[none("long").alias(s) for s in STATS])
    both = heads.union(lines).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "h")
    both = both.select("conv_id", "kind", F.col("role").cast("binary").alias("role"), "text", *STATS)

    def run(batches):
        grammar = Grammar(pairs)
        solved = cache(grammar.repair)                       # conversations of one code share the result
        code, held, stats, state, out = [], None, None, None, []

        def opened():
            text = "".join(code)
            if solved.cache_info().currsize > 1 << 16:
                solved.cache_clear()
            cost, audit = solved(text) if len(text) <= 64 else grammar.repair(text)
            return cost, audit, Repaired(audit)

        def ended():
            cost, audit, hashed = state or opened()
            out.append((held, *stats, cost, audit, hashed.done()))

        for batch in batches:
            ids, kinds, roles = (batch.column(k).to_pylist() for k in range(3))
            counts = list(zip(*(batch.column(4 + k).to_pylist() for k in range(len(STATS)))))
            for n, (conv, kind, role) in enumerate(zip(ids, kinds, roles)):
                if stats is None or conv != held:
                    if stats is not None:
                        ended()
                    code, held, stats, state = [], conv, counts[n], None
                if kind == 0:
                    code.append(role.decode())
                    continue
                if state is None:
                    state = opened()
                state[2].row(role, batch.column(3)[n].as_py())
            if len(out) > 4096:
                yield batch_of(out, RESULT)
                out.clear()
        if stats is not None:
            ended()
        if out:
            yield batch_of(out, RESULT)

    return both.mapInArrow(run, RESULT)
