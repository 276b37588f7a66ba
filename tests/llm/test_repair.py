"""Conversation repair against an enumeration of edits and a plain search."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tablefold.llm import repair

LEGAL = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\f\r"


def plain(rows):
    """Least (cost, audit) over rows of (initial, must_go, truncated): best edits for each state, row by row, as texts."""
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "")}
    for row in [*rows, None]:
        for _ in range(3):                                  # inserts before the row, or at the end
            for state, (cost, audit) in list(best.items()):
                new = (cost + 5, audit + "I")
                best[step[state]] = min(best.get(step[state], new), new)
        if row is None:
            break
        initial, go, cut = row
        after = {}
        for state, (cost, audit) in best.items():
            options = [(2, "D", state)]
            if not go:
                options.append((1 + 5 * cut, "R", step[state]))
                if initial == step[state] or (initial == "s" and state == ""):
                    options.append((5 * cut, "K", initial))
            for more, letter, to in options:
                new = (cost + more, audit + letter)
                after[to] = min(after.get(to, new), new)
        best = after
    return min(best[x] for x in ("", "a") if x in best)


def enumerated(rows):
    """The same by trying all edits of a few rows, with up to two inserts in each gap."""
    found = []
    gaps = [""] + ["I", "II"]
    for inserts in itertools.product(gaps, repeat=len(rows) + 1):
        for letters in itertools.product("DKR", repeat=len(rows)):
            for targets in itertools.product("ua", repeat="".join(letters).count("R") + sum(map(len, inserts))):
                pick, roles, cost, ok = iter(targets), "", 0, True
                for gap, letter, row in itertools.zip_longest(inserts, letters, rows):
                    for _ in gap:
                        roles += next(pick)
                        cost += 5
                    if letter is None:
                        continue
                    initial, go, cut = row
                    ok &= letter == "D" or not go
                    cost += {"D": 2, "K": 0, "R": 1}[letter] + (5 if cut and letter != "D" else 0)
                    roles += "" if letter == "D" else initial if letter == "K" else next(pick)
                if ok and LEGAL.fullmatch(roles):
                    audit = "".join(g + (x or "") for g, x in itertools.zip_longest(inserts, letters))
                    found.append((cost, audit))
    return min(found)


def code(rows):
    return "".join("d" if go else i.upper() if cut else i for i, go, cut in rows)


KINDS = [(i, False, cut) for i in "suax" for cut in (False, True)] + [("x", True, False)]


def test_audits_equal_enumeration():
    grammar = repair.Grammar([])
    for n in range(3):
        for rows in itertools.product(KINDS, repeat=n):
            assert grammar.repair(code(rows)) == plain(rows) == enumerated(rows), rows


def test_rules_change_nothing():
    r = random.Random(8)
    pairs = ["ua", "ĀĀ", "sĀ", "uu", "da", "āā", "Uu", "ăx"]
    grammar = repair.Grammar(pairs)
    for _ in range(1500):
        rows = [r.choice(KINDS) if r.random() < .4 else (r.choice("ua"), False, False) for _ in range(r.choice([1, 3, 8, 20, 60]))]
        seq = code(rows)
        for n, p in enumerate(pairs):
            seq = seq.replace(p, chr(repair.FIRST_RULE + n))
        assert grammar.repair(seq) == plain(rows)


def brute(conversations):
    """Result rows by conv_id."""
    groups = {}
    for conv, turn, role, text in conversations:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        rows = groups.setdefault(conv, [])
        if d == 1:
            text = ""
        if d == 2:
            text = re.sub("[.!?]", "", text)
        if d == 4:
            role = "user"
        rows += [(turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        seen, marks, n = set(), [], [0, 0, 0]
        for turn, role, text in rows:
            body = text.strip(SPACE)
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                n[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            marks.append((initial, fault in (0, 1), fault == 2))
        initials = [r[:1] for _, r, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = plain(marks)
        lines, state, left = [], "", iter(rows)
        step = {"": "user", "s": "user", "u": "assistant", "a": "user"}
        for letter in audit:
            role, text = step[state], ""
            if letter != "I":
                _, mine, text = next(left)
                role = mine if letter == "K" else role
            if letter != "D":
                lines.append(f"{role}:{text}")
                state = role[:1]
        out[conv] = (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def sample():
    r = random.Random(2)
    rows = []
    for conv in range(400):
        for turn in range(r.choice([1, 2, 4, 8])):
            if r.random() < .1:
                continue
            role = "system" if turn == 0 and r.random() < .3 else ("user", "assistant")[turn % 2] if r.random() < .9 else r.choice(["tool", None, "user", ""])
            rows.append((conv * 3, turn * r.choice([1, 1, 1, 2]) if r.random() < .95 else None, role, r.choice(["Yes.", "Oui ! ", "cut off", "a.b", None, "", f"Text {conv} {turn}.", "É?\n"])))
    rows = list({(c, t): (c, t, role, text) for c, t, role, text in rows}.values())
    rows += [(None, 1, "user", "null id."), (None, 2, "assistant", "null id!"), (50_000, None, None, None)]
    rows += [(60_000, t, ("user", "assistant")[t % 2], f"Row {t}." if t % 7 else "cut") for t in range(3000)]
    return rows + [(70_000, 1, "user", "x." * 200_000), (70_000, 2, "assistant", "Same.")]


@pytest.mark.parametrize("rules", [0, 7, repair.RULES])
def test_conversations(spark, rules):
    rows = sample()
    df = spark.createDataFrame([(*x, n, "y") for n, x in enumerate(rows)], "conv_id long, turn long, role string, text string, cost long, audit string").repartition(7)
    got = repair.repaired(df, rules).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == brute(rows)
    assert len(got) == len({x[0] for x in rows})


def test_rows_of_one_turn_follow_roles(spark):
    df = spark.createDataFrame([(1, 4, "user", "A."), (1, 4, "assistant", "B."), (1, 4, "user", "A.")], "conv_id long, turn long, role string, text string")
    got, = repair.repaired(df).collect()
    assert (got.duplicate, got.gaps, got.cost) == brute([(1, 4, "user", "A."), (1, 4, "assistant", "B."), (1, 4, "user", "A.")])[1][2:3] + (0, got.cost)


def test_empty_table(spark):
    assert repair.repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_grammar_is_shared(spark):
    seqs = [("uauaua",)] * 50 + [("suaua",)] * 20 + [("uauauauauaua",)]
    pairs = repair.repair_pairs(spark.createDataFrame(seqs, "seq string"))
    left = repair.rewritten("seq", pairs)
    short = spark.createDataFrame(seqs, "seq string").select(left.alias("x")).collect()
    assert pairs[0] == "ua" and max(len(r.x) for r in short) <= 3
