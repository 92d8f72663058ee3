"""Conversation repair against exhaustive search, and on edge tables."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from panelcast.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, gone2 boolean, at int, edit string, cost long, seen int"
SPACE = " \t\n\x0b\x0c\r"


def search(rows):
    """(cost, edits, repaired rows) of the cheapest legal repair of (initial, role, text, must go, cut)
    rows, smallest edits first, by trying all scripts that cost no more than deleting everything."""
    best = None
    limit = 4 * len(rows)

    def go(i, made, cost, edits):
        nonlocal best
        if cost > limit or best is not None and cost > best[0]:
            return
        if i == len(rows):
            shape = "".join(r[0][:1] or "?" for r in made)
            body = shape[1:] if shape[:1] == "s" else shape
            if shape == "" or body and body == "ua" * (len(body) // 2):
                if best is None or (cost, edits) < best[:2]:
                    best = (cost, edits, made)
        if i < len(rows):
            _, role, text, must, cut = rows[i]
            go(i + 1, made, cost + 4, edits + "D")
            if not must:
                go(i + 1, made + [(role, text)], cost + 3 * cut, edits + "K")
                for new in ("user", "assistant"):
                    go(i + 1, made + [(new, text)], cost + 3 + 3 * cut, edits + "R")
        for new in ("user", "assistant"):
            go(i, made + [(new, "")], cost + 3, edits + "I")

    go(0, [], 0, "")
    return best


def faults(rows):
    """Rows (turn, role, text) in order, with what the operator should find."""
    seen, out = set(), []
    for _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        body = text.rstrip(SPACE)
        blank = not body
        double = (role, text) in seen and not blank
        cut = not blank and not double and body[-1] not in ".!?"
        seen.add((role, text))
        out.append((role[:1], role, text, blank or double, cut, blank, double))
    return out


def test_viterbi_finds_the_cheapest_smallest_script():
    rng = random.Random(3)
    for case in range(400):
        rows = [
            (role[:1], role, f"t{i}", rng.random() < 0.15, rng.random() < 0.3)
            for i, role in enumerate(rng.choices(["user", "assistant", "system", "tool"], k=rng.randint(0, 4)))
        ]
        run = turns.Viterbi()
        edits = "".join(run.step(initial, must, cut) for initial, _, _, must, cut in rows)
        cost, rest = run.finish()
        assert (cost, edits + rest) == search(rows)[:2], (case, rows)


def test_survivors_coalesce():
    run, nodes = turns.Viterbi(), 0
    for i in range(2000):
        run.step("ua"[i % 2], False, False)
        stack, nodes = [run.root], 0
        while stack:
            node = stack.pop()
            nodes += 1
            stack += node.kids
    assert nodes < 40


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(9)
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 4)):
            role = rng.choice(["user", "assistant", "assistant", "system", "User", ""])
            text = rng.choice(["Hi.", "Hi", "Why?", " ", "", "ok \n", None, "go! "])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), rng.choice([role, role, role, None]), text))
    rows += [(None, 1, "user", "no id."), (None, 2, "assistant", "none."), (900, None, None, None)]
    rows += [(901, 0, "user", "x" * 300_000 + "."), (901, 1, "assistant", "same."), (901, 1, "assistant", "same.")]
    return rows


def test_audits_equal_search(spark, talks):
    # ``gone2`` and others are columns of the input with names that the operator uses itself.
    df = spark.createDataFrame([(*r, True, 1, "x", 5, 2) for r in talks], SCHEMA).repartition(5)
    got = {r["conv_id"]: r for r in turns.audits(turns.damaged(df)).collect()}
    kept: dict = {}
    for r in turns.repaired(turns.damaged(df)).orderBy("conv_id", "at").collect():
        kept.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    by_conv: dict = {}
    for conv, turn, role, text in talks:
        rows = by_conv.setdefault(conv, [])
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fault == 4:
            role = "user"
        if fault != 0:
            rows += [(turn, role, text)] * (2 if fault == 3 else 1)
    assert set(got) == set(by_conv)
    for conv, rows in by_conv.items():
        told, r = faults(rows), got[conv]
        cost, edits, made = search([t[:5] for t in told])
        lines = [f"{a}:{b}" for a, b in made]
        at = sorted({t for t, *_ in rows if t is not None})
        assert r["gaps"] == (at[-1] - at[0] + 1 - len(at) if at else 0)
        assert (r["blank"], r["duplicate"], r["truncated"]) == tuple(sum(t[i] for t in told) for i in (5, 6, 4))
        pairs = [a[0] + b[0] for a, b in zip(told, told[1:])]
        assert r["illegal"] == sum(p not in ("su", "ua", "au") for p in pairs)
        assert (r["cost"], r["audit"]) == (cost, edits), (conv, told)
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        assert kept.get(conv, []) == lines


def test_empty_and_dropped(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.audits(turns.damaged(none)).count() == 0 and turns.repaired(none).count() == 0
    gone = spark.createDataFrame([(5, 1, "user", "x.")], none.schema).withColumn("gone", F.lit(True))
    row = turns.audits(gone).first()
    assert tuple(row)[:-1] == (5, 0, 0, 0, 0, 0, 0, "") and row["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_long_conversation_streams(spark):
    rows = spark.range(30_000).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("line "), F.col("id"), F.lit(".")).alias("text"),
    )
    row = turns.audits(rows).first()
    assert row["audit"] == "K" * 30_000 and row["cost"] == 0 and row["gaps"] == 0
    want = "\n".join(f"{('user', 'assistant')[i % 2]}:line {i}." for i in range(30_000))
    assert row["repaired_sha256"] == hashlib.sha256(want.encode()).hexdigest()
