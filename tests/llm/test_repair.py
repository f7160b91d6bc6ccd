"""Conversation repair against enumeration of all edits, and against a plain reading of the faults."""

import hashlib
import random
import re
import zlib
from itertools import groupby

import pytest

from formloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def enumerated(rows):
    """Cheapest (cost, audit, turns) over every sequence of edits with at most two inserts more than rows; rows: (role, text, forced, cut)."""
    best = None

    def go(i, cost, audit, out):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
            best = min(best or (cost, audit, out), (cost, audit, out), key=lambda x: x[:2])
        if audit.count("I") < len(rows) + 2:
            for r in ("user", "assistant"):
                go(i, cost + 2, audit + "I", [*out, (r, "")])
        if i < len(rows):
            role, text, forced, cut = rows[i]
            go(i + 1, cost + 3, audit + "D", out)
            if not forced:
                go(i + 1, cost + cut, audit + "K", [*out, (role, text)])
                for r in ("user", "assistant"):
                    go(i + 1, cost + 2 + cut, audit + "R", [*out, (r, text)])

    go(0, 0, "", [])
    return best


def shortest(rows):
    """The same by relaxing (cost, audit, turns) of every (row, roles' state) until nothing changes."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {(0, 0): (0, "", [])}
    for i in range(len(rows) + 1):
        changed = True
        while changed:
            changed = False
            for q in range(4):
                if (i, q) in best:
                    cost, audit, out = best[i, q]
                    for r in ("user", "assistant"):
                        t = step.get((q, r[0]))
                        new = (cost + 2, audit + "I", [*out, (r, "")])
                        if t is not None and ((i, t) not in best or new[:2] < best[i, t][:2]):
                            best[i, t], changed = new, True
        if i < len(rows):
            role, text, forced, cut = rows[i]
            for q in range(4):
                if (i, q) in best:
                    cost, audit, out = best[i, q]
                    moves = [(3, "D", q, out)]
                    if not forced:
                        moves += [(c + cut, a, step.get((q, r[:1])), [*out, (r, text)]) for c, a, r in ((0, "K", role), (2, "R", "user"), (2, "R", "assistant"))]
                    for c, a, t, o in moves:
                        new = (cost + c, audit + a, o)
                        if t is not None and ((i + 1, t) not in best or new[:2] < best[i + 1, t][:2]):
                            best[i + 1, t] = new
    return min((best[len(rows), q] for q in (0, 3) if (len(rows), q) in best), key=lambda x: x[:2])


def damage(conv, turn, role, text):
    role, text = (" " if x is None else x for x in (role, text))
    key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
    fault = zlib.crc32(key.encode()) % 20
    if fault == 1:
        text = ""
    if fault == 2:
        text = re.sub("[.!?]", "", text)
    if fault == 4:
        role = "user"
    return [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)


def expected(given):
    """{conv_id: row} of the report for undamaged rows."""
    out = {}
    rank = lambda r: (r[0] is not None, r[0] or 0)
    for conv, rows in groupby(sorted(given, key=lambda r: rank(r)), key=lambda r: r[0]):
        rows = sorted((x for r in rows for x in damage(*r)), key=lambda r: (rank(r[1:]), r[2][:32], r[3][:64], r[2], r[3]))
        seen, marked, counts = set(), [], [0, 0, 0]
        for _, _, role, text in rows:
            bare = text.strip(WHITE)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                counts[fault] += 1
            marked.append((role, text, fault < 2, fault == 2))
        initials = [r[2][:1] for r in rows]
        turns = {r[1] for r in rows if r[1] is not None}
        cost, audit, left = shortest(marked)
        whole = "\n".join(f"{r}:{t}" for r, t in left)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest())
    return out


def test_agenda_against_enumeration():
    random.seed(11)
    kinds = [("user", False, False), ("assistant", False, False), ("system", False, False), ("tool", False, False), ("user", False, True), ("assistant", False, True), ("", False, True), ("user", True, False)]
    for n in (0, 1, 2, 3, 3, 3):
        for _ in range(1 if n == 0 else 12):
            rows = [(r, f"t{k}", forced, cut) for k, (r, forced, cut) in enumerate(random.choices(kinds, k=n))]
            codes = tuple(("" if forced else r[:1] if r[:1] and r[:1] in "sua" else "?", cut, 1) for r, _, forced, cut in rows)
            _, (cost, audit) = repair.repaired(codes)
            want = enumerated(rows)
            assert (cost, audit) == want[:2] == shortest(rows)[:2]
            assert repair.edited([(r, t, 1) for r, t, _, _ in rows], 0, audit) == want[2]


def test_spans_join_to_the_whole():
    random.seed(12)
    for _ in range(40):
        rows = tuple((random.choice("usa?"), random.random() < 0.3, 1) if random.random() < 0.8 else ("", False, random.randint(1, 3)) for _ in range(9))
        ways = {0: (0, "")}
        for lo in (0, 2, 3, 7):
            hi = {0: 2, 2: 3, 3: 7, 7: 9}[lo]
            ways = {r: min((ways[q][0] + c, ways[q][1] + a) for q, r2, c, a in repair.spans(rows[lo:hi]) if r2 == r and q in ways) for r in range(4) if any(r2 == r and q in ways for q, r2, _, _ in repair.spans(rows[lo:hi]))}
        assert min(ways[q] for q in (0, 3) if q in ways) == repair.repaired(rows)[1]


def rows_of(spark, given, extra=False):
    df = spark.createDataFrame(given, SCHEMA)
    if extra:
        df = df.selectExpr("*", "1 AS conv", "'x' AS n", "array(1) AS spans", "2 AS part", "'q' AS fault")
    got = repair.report(repair.damaged(df), df.select("conv_id").distinct()).collect()
    return {r[0]: tuple(r)[1:] for r in got}, len(got)


def made(n, seed):
    random.seed(seed)
    out = []
    for conv in range(n):
        for turn in range(random.randrange(1, 9)):
            role = random.choice(["user", "assistant", "assistant", "system", "tool", None, "", "User"]) if random.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = random.choice(["Yes.", "No?", "cut off", "", None, " \n", "é! ", "ok.\r\n", "a" * 70 + random.choice("xy.")])
            out.append((conv if conv % 17 else None, random.choice([turn, turn * 2, None, 1]), role, text))
    return out


@pytest.mark.parametrize("chunk", [256, 3])
def test_report(spark, chunk, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK_ROWS", chunk)
    given = made(120, 5) + [(900, t, ("user", "assistant")[t % 2], random.choice(["a.", "b.", f"c{t}.", "d"])) for t in range(150)]
    given += given[:20]  # repeated rows
    got, n = rows_of(spark, given, extra=True)
    want = expected(given)
    assert n == len(want) and got == want


def test_empty_and_dropped(spark):
    assert rows_of(spark, []) == ({}, 0)
    gone = next(c for c in range(999) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    assert rows_of(spark, [(gone, 1, "user", "hello.")])[0] == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_repaired_turns_as_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "a."), (1, 2, "user", "b."), (2, 0, "assistant", "c.")], SCHEMA)
    _, fixed = repair.repair(df)
    got = [(r.conv_id, r.role, r.text) for r in repair.turns_of(fixed).orderBy("conv_id", "part", "seq", "place").collect()]
    assert got == [(1, "user", "a."), (1, "assistant", "b."), (2, "user", ""), (2, "assistant", "c.")]


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got, _ = rows_of(spark, [tuple(r) for r in df.collect()])
    assert got == expected([tuple(r) for r in df.collect()])
