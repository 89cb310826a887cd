"""Conversation repair against all edits of short conversations and a plain search of longer ones."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanledger.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string"
FULL = re.compile("(s?(ua)+)?")


def by_turn(turns):
    """Turns in the operator's order are needed only where numbers repeat with different contents, which these inputs do not have."""
    return sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0))


def faults(turns):
    seen, out = set(), []
    for _, _, role, text in turns:
        role, text = " " if role is None else role, " " if text is None else text
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def search(turns):
    """Cost, audit and lines of the least of the cheapest edits, by whole strings from the last turn to the first."""
    shown, never = {"": "", "s": "s", "u": "u", "a": "ua"}, (10 ** 9, "", ())

    def then(state, initial):
        own = shown[state] + initial
        return own[-1] if initial and re.fullmatch("s?(ua)*u?", own) else None

    def add(cost, way, line, rest):
        return rest[0] + cost, way + rest[1], (*line, *rest[2])

    def inserted(own):
        for _ in range(3):
            own = {q: min(best, *(add(5, "I", ((new, ""),), own[z]) for new in ("user", "assistant") if (z := then(q, new[0])))) for q, best in own.items()}
        return own

    after = inserted({q: (0, "", ()) if FULL.fullmatch(shown[q]) else never for q in shown})
    for role, text, fault in faults(turns)[::-1]:
        own = {q: [add(2, "D", (), after[q])] for q in shown}
        for q in shown if fault in ("", "truncated") else ():
            for new, cost, way in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                if z := then(q, new[:1]):
                    own[q].append(add(cost + 5 * (fault == "truncated"), way, ((new, text),), after[z]))
        after = inserted({q: min(ways) for q, ways in own.items()})
    return after[""]


def report(turns):
    rows = faults(turns)
    cost, audit, lines = search(turns)
    numbers = [t for _, t, _, _ in turns if t is not None]
    initials = [r[:1] for r, _, _ in rows]
    kinds = [f for _, _, f in rows]
    return {"gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, "blank": kinds.count("blank"), "duplicate": kinds.count("duplicate"),
            "truncated": kinds.count("truncated"), "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()}


def broken(rng, n_conv, longest):
    out = []
    for c in range(n_conv):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "agent", "User"])
            text = rng.choice([f"t{rng.randint(0, 9)}.", f"long {t}!", f"cut {t}", f"cut {t}", " \n", "", None, f"{t}? \t", "x.\x85"])
            out.append((c, None if t == 0 and rng.random() < 0.2 else t + (t > 3), role, text))
            if rng.random() < 0.15:
                out.append(out[-1])
    return out


def check(spark, turns, **conf):
    got = {r["conversation"]: r.asDict() for r in C.repair_report(spark.createDataFrame(turns, SCHEMA)).collect()}
    by = {}
    for r in turns:
        by.setdefault(r[0], []).append(r)
    assert len(got) == len(by)
    for c, own in by.items():
        want = report(by_turn(own))
        assert {k: got[None if c is None else str(c)][k] for k in want} == want, own


def test_equal_to_a_search(sp):
    check(sp, broken(random.Random(5), 400, 7))


def test_long_conversations_over_many_parts(sp):
    old = sp.conf.get("spark.sql.shuffle.partitions"), sp.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    sp.conf.set("spark.sql.shuffle.partitions", "9")
    sp.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(6)
        turns = broken(rng, 3, 500) + [(7, t, rng.choice(["user", "assistant"]), f"n{t}.") for t in range(900)]
        assert C.repair_edits(sp.createDataFrame(turns, SCHEMA)).rdd.getNumPartitions() > 4
        check(sp, turns)
    finally:
        sp.conf.set("spark.sql.shuffle.partitions", old[0])
        sp.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])


def test_tables_are_closed_and_hold_what_steps_give():
    T, rng = C.tables(), random.Random(1)
    assert len(T.vectors) < 100
    for _ in range(200):
        s = np.array([rng.randrange(C.SYMBOLS) for _ in range(rng.randint(0, 30))])
        own, led = T.summary(s)
        for v in range(len(T.vectors)):
            for q in range(4):
                assert T.trace(s, v, q)[1] == led[v, q]


def test_unusual_rows(sp):
    # A hot turn: one row thousands of times; a null conversation; columns with names of the operator's own.
    turns = [(1, 0, "user", "a.")] * 3000 + [(1, 1, "assistant", "b.")] + [(None, 0, "user", "q."), (None, None, "system", "s." * 200_000), (None, 1, "assistant", "z.")]
    check(sp, turns)
    df = sp.createDataFrame(turns, SCHEMA).withColumn("h1", F.lit(1)).withColumn("Tag", F.lit("x")).withColumn("text_", F.lit("y"))
    lines = C.repaired(df).where("conversation IS NULL").orderBy("place").collect()
    assert [(r["role"], r["text"][:2], r["edit"]) for r in lines] == [("system", "s.", "K"), ("user", "q.", "K"), ("assistant", "z.", "K")]
    audit = C.repair_report(df).where("conversation = '1'").first()
    assert audit["audit"] == "K" + "D" * 2999 + "K" and audit["duplicate"] == 2999 and audit["illegal"] == 2999
    # Different turns of one number: by role.
    same = sp.createDataFrame([(1, 5, "user", "q."), (1, 5, "assistant", "a.")], SCHEMA)
    assert C.repair_report(same).first()["audit"] == C.repair_report(same.orderBy("role")).first()["audit"]


def test_empty_table(sp):
    none = sp.createDataFrame([], SCHEMA)
    assert C.repair_report(none).count() == C.repaired(none).count() == C.repair_edits(none).count() == 0


def test_damage(sp):
    rows = [(c, t, "assistant" if t % 2 else "user", f"Well. {t}?") for c in range(60) for t in range(6)] + [(None, None, None, None)]
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if k:
            row = (c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            want += [row] * (2 if k == 3 else 1)
    got = [tuple(r) for r in C.damaged(sp.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(sp, sf):
    from spanledger.llm.catalog import QUERIES

    folder = f"/root/testdata/{sf}"
    got = QUERIES["op11_conversation_repair"].run(sp, folder).collect()
    rows = [tuple(r) for r in sp.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    after = {}
    for r in C.damaged(sp.createDataFrame(rows, SCHEMA)).collect():
        after.setdefault(r[0], []).append(tuple(r))
    assert {r["conv_id"] for r in got} == {r[0] for r in rows} and len(got) == len({r[0] for r in rows})
    for r in got:
        own = by_turn(after.get(r["conv_id"], []))
        want = report(own)
        assert {k: r[k] for k in want} == want
