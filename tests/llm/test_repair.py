"""Operator 11 against a forward search in plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from silocast.llm import repair

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, chunk string, edit int"


def damage(rows):
    """Rows (conv_id, turn, role, text) after the damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    tie = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).digest())
    return sorted(out, key=tie)


def search(rows):
    """All columns but conv_id for the damaged rows of one conversation."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def put(to, state, value):
        if state not in to or value < to[state]:
            to[state] = value

    def insert(states):
        for _ in range(3):
            for s, (c, a, t) in list(states.items()):
                put(states, step[s], (c + 2, a + "I", (*t, ("user:" if step[s] == "u" else "assistant:"))))
        return states

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        after: dict = {}
        for s, (c, a, t) in insert(best).items():
            put(after, s, (c + 3, a + "D", t))
            if fault in ("blank", "duplicate"):
                continue
            more, i = fault == "truncated", role[:1]
            if (i == "s" and s == "") or (i == "u" and s != "u") or (i == "a" and s == "u"):
                put(after, i, (c + more, a + "K", (*t, f"{role}:{text}")))
            to = step[s]
            put(after, to, (c + 2 + more, a + "R", (*t, f"{'user' if to == 'u' else 'assistant'}:{text}")))
        best = after
    ends = insert(best)
    cost, audit, lines = min(ends[s] for s in ("", "a") if s in ends)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows):
    by = {r[0]: [] for r in rows}
    for r in damage(rows):
        by[r[0]].append(r)
    return {k: search(v) for k, v in by.items()}


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}


def test_query_equals_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(repair.op11(spark, SF)) == expected(rows)


@pytest.fixture(scope="module")
def odd():
    draw = random.Random(5)
    roles = ("user", "assistant", "system", "tool", "", None)
    texts = ("Yes.", "No!", "open end", "", " \n", None, "Ende.  ", "Was? ", "é!", "x" * 5000)
    rows = [(c, draw.choice((None, *range(-2, 30))), draw.choices(roles, (9, 9, 3, 1, 1, 1))[0], draw.choice(texts)) for c in (*range(60), None) for _ in range(draw.randrange(1, 14))]
    rows += [(100, t, ("user", "assistant")[t % 2], f"Turn {t}{'.' * (t % 3 > 0)}") for t in range(700)]  # many chunks
    rows += [(101, 3, "user", "The same.")] * 90 + [(102, t, "user", f"Text {t}.") for t in range(200)]  # copies; a long run of one symbol
    return rows


@pytest.mark.parametrize("chunk_rows", [1, 3, 4096])
def test_odd_conversations(spark, odd, chunk_rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in odd], SCHEMA)
    assert found(repair.repair_report(df, repair.damaged(df), chunk_rows)) == expected(odd)


def test_turns_come_out(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Who?"), (1, 2, "user", "Me."), (2, 0, "assistant", "Hi.")]
    edits, counts = repair.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = [tuple(r) for r in edits.where("conv_id = 1").orderBy("chunk", "n").select("edit", "role", "text").collect()]
    assert out == [("K", "system", "Be brief."), ("K", "user", "Who?"), ("R", "assistant", "Me.")]
    assert counts.count() == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repair.repair_report(df, repair.damaged(df)).count() == 0
    gone = spark.createDataFrame([(c, 0, "user", "Hi.", "", 0) for c in range(60)], SCHEMA)
    out = found(repair.repair_report(gone, repair.damaged(gone)))
    assert any(v == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for v in out.values())


def test_powers_equal_steps():
    for symbol in (0, 1, 2, 3, 4, 5, 6, 7, repair.GONE):
        slow = np.where(np.eye(4, dtype=bool), 0, repair.FAR)
        for n in range(1, 20):
            slow = repair.times(slow, repair.power(symbol, 0))
            assert (repair.through([(symbol, n)]) == slow).all()
