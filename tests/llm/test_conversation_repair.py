"""Repairs against a search that carries whole audits, over short and long conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from llm_helpers import SF
from pyspark.sql import functions as F

from timberline.llm import conversation_repair as repair
from timberline.llm import queries

WHITE = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    """(conv, turn, role, text) rows after damage, with every conversation."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn, "user" if kind == 4 else role, text)
        out[conv] += [] if kind == 0 else [row, row] if kind == 3 else [row]
    return out


def expected(rows):
    """The contract, by dynamic programming over (cost, audit) pairs."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    faults, seen = [], set()
    for _, role, text in rows:
        solid = WHITE.findall(text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    states = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, state, inserted=0):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ""))
        if i < len(rows):
            role, text = rows[i][1:]
            cost, audit, turns = best(i + 1, state)
            found.append((3 + cost, "D" + audit, turns))
            if faults[i] not in ("blank", "duplicate"):
                broken = faults[i] == "truncated"
                new = role[:1]
                if new == states[state] or (new == "s" and state == ""):
                    cost, audit, turns = best(i + 1, new)
                    found.append((broken + cost, "K" + audit, f"{role}:{text}\n{turns}"))
                new = states[state]
                cost, audit, turns = best(i + 1, new)
                found.append((2 + broken + cost, "R" + audit, f"{'user' if new == 'u' else 'assistant'}:{text}\n{turns}"))
        if inserted < 2:
            new = states[state]
            cost, audit, turns = best(i, new, inserted + 1)
            found.append((2 + cost, "I" + audit, f"{'user' if new == 'u' else 'assistant'}:\n{turns}"))
        return min(found, default=(1 << 30, "", ""))

    for i in range(len(rows), -1, -50):
        best(i, "")
    cost, audit, turns = best(0, "")
    known = {t for t, _, _ in rows if t is not None}
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (
        max(known) - min(known) + 1 - len(known) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal,
        cost, audit, hashlib.sha256(turns[:-1].encode()).hexdigest(),
    )


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def same(out, want):
    got = {r["conv_id"]: tuple(r[c] for c in NAMES) for r in out}
    assert len(out) == len(got) and set(got) == set(want)
    for conv, rows in want.items():
        assert got[conv] == expected(rows), conv


def made(seed, conversations, length):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Maybe", " \t\n", "", "What?", "a. ", "Ünd so weiter .\n", None]
    rows = []
    for c in range(conversations):
        n = r.randrange(1, length)
        for t in range(n):
            text = r.choice(texts) if r.random() < 0.6 else f"Answer {r.randrange(9 * n)}."
            rows.append((c, t + r.randrange(2) * 3 * n if r.random() < 0.1 else t, r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), text))
    return [row for row in {(c, t): (c, t, role, text) for c, t, role, text in rows}.values()]


SCHEMA = "conv_id long, turn long, role string, text string"


def run(df, **options):
    return repair.repair(queries.damaged(df), present=F.col("here"), **options)


def test_short_conversations(spark):
    rows = made(1, 150, 9) + [(None, 3, "user", "Hi."), (None, None, "assistant", "Ho"), (900, None, None, None), (901, None, "user", "x.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("clash")).withColumn("audit", F.lit("clash"))
    same(run(df.repartition(3)).summary().collect(), damage(rows))


def test_long_conversations_are_cut(spark):
    rows = made(2, 12, 60) + [(77, t, ("user", "assistant")[t % 2], f"Turn {t % 90}.") for t in range(250)]
    df = spark.createDataFrame(rows, SCHEMA)
    for chunk in (3, 17):
        same(run(df.repartition(4), chunk_rows=chunk).summary().collect(), damage(rows))
    same(run(df, chunk_bytes=40).summary().collect(), damage(rows))


def test_turns_and_ties(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "Well?"), (1, 2, "user", "Well?"), (1, 3, "assistant", "x" * 3_000_000 + ".")]
    found = repair.repair(spark.createDataFrame(rows, SCHEMA))
    got = [(r["role"], len(r["text"])) for r in found.turns().orderBy("part", "no", "at").collect()]
    assert got[-1] == ("assistant", 3_000_001) and [g[0] for g in got] == ["user", "assistant"] * (len(got) // 2)
    row = found.summary().collect()[0]
    assert tuple(row[c] for c in NAMES) == expected([r[1:] for r in rows])


def test_empty_and_all_dropped(spark):
    assert run(spark.createDataFrame([], SCHEMA)).summary().count() == 0
    rows = [(c, 0, "user", "Hi.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    same(run(spark.createDataFrame(rows, SCHEMA)).summary().collect(), damage(rows))


def test_ranks_order_audits():
    r = np.random.default_rng(4)
    problems = [repair.Problem(r.integers(0, 4, n), r.choice([0, 0, 1, 2, 4], n), repair.END, True) for n in r.integers(0, 40, 60)]
    found = repair.least_audits(problems)
    by_size = defaultdict(list)
    for p, f in zip(problems, found, strict=True):
        by_size[len(p.kinds).bit_length()].append(f[0])
    for group in by_size.values():
        audits = [a for a, _, _ in sorted(group, key=lambda f: f[2])]
        assert audits == sorted(audits)


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.01"])
def test_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(queries.queries()["op13_conversation_repair"](spark, folder).collect(), damage(rows))
