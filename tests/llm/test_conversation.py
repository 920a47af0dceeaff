"""Audits against an exhaustive search over edits and against a plain version of whole conversations."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from daybook.llm import conversation as C

SCHEMA = "conv_id long, turn long, role string, text string, part string, seq int"


def cheapest(rows):
    """(cost, audit, repaired) by a search from the front over whole strings of initials, least cost then least audit."""
    n = len(rows)

    @lru_cache(None)
    def best(i, state):
        found = []
        if i == n and state in "0a":
            found.append((0, "", ()))
        nxt = {"0": "u", "s": "u", "u": "a", "a": "u"}[state]
        name = {"u": "user", "a": "assistant"}[nxt]
        if i < n:
            role, text, fault = rows[i]
            found += [(3 + c, "D" + a, r) for c, a, r in [best(i + 1, state)]]
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                c, a, r = best(i + 1, nxt)
                found.append((2 + extra + c, "R" + a, ((name, text), *r)))
                if role[:1] == nxt or (state == "0" and role[:1] == "s"):
                    c, a, r = best(i + 1, role[:1])
                    found.append((extra + c, "K" + a, ((role, text), *r)))
        return min(found + inserted(i, state, nxt, name), key=lambda x: (x[0], x[1]))

    def inserted(i, state, nxt, name):
        # Two inserts in a row reach every state, so nothing is lost by stopping there.
        out, chain, cost, lines = [], state, 0, []
        for _ in range(2):
            chain = {"0": "u", "s": "u", "u": "a", "a": "u"}[chain]
            lines.append(({"u": "user", "a": "assistant"}[chain], ""))
            cost += 2
            for c, a, r in no_insert(i, chain):
                out.append((cost + c, "I" * len(lines) + a, (*lines, *r)))
        return out

    def no_insert(i, state):
        out = [(0, "", ())] if i == n and state in "0a" else []
        if i == n:
            return out
        nxt = {"0": "u", "s": "u", "u": "a", "a": "u"}[state]
        role, text, fault = rows[i]
        c, a, r = best(i + 1, state)
        out.append((3 + c, "D" + a, r))
        if fault not in ("blank", "duplicate"):
            extra = int(fault == "truncated")
            c, a, r = best(i + 1, nxt)
            out.append((2 + extra + c, "R" + a, (({"u": "user", "a": "assistant"}[nxt], text), *r)))
            if role[:1] == nxt or (state == "0" and role[:1] == "s"):
                c, a, r = best(i + 1, role[:1])
                out.append((extra + c, "K" + a, ((role, text), *r)))
        return out

    return best(0, "0")


def faulted(rows):
    out, seen = [], set()
    for role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        if not body:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "sound" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def expected(given):
    """Reports of rows (conv_id, turn, role, text) after the damage, one conversation at a time."""
    convs = {}
    for conv, turn, role, text in given:
        role, text = (" " if x is None else x for x in (role, text))
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        rows = convs.setdefault(conv, [])
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        role = "user" if d == 4 else role
        rows += [(turn, role, text)] * {0: 0, 3: 2}.get(d, 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        turns = {t for t, _, _ in rows if t is not None}
        marked = faulted([(r, t) for _, r, t in rows])
        cost, audit, repaired = cheapest(tuple(marked))
        pairs = [a[:1] + b[:1] for (a, _, _), (b, _, _) in zip(marked, marked[1:])]
        n = lambda f: sum(x == f for _, _, x in marked)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, n("blank"), n("duplicate"), n("truncated"), sum(p not in ("su", "ua", "au") for p in pairs),
                    cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(11)
    out = []
    for conv in [*range(400), None]:
        for turn in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"])
            out.append((conv, None if rng.random() < 0.03 and turn == 0 else turn * rng.choice([1, 1, 2]) if turn else 0, role, rng.choice(["Yes.", "no", "So?  ", "", " \t", None, "Fine!\n", "é…", "a.b"])))
    return [r for i, r in enumerate(out) if r[:2] not in {x[:2] for x in out[:i]}]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def test_reports_match_a_plain_version(spark, conversations):
    got = [tuple(r) for r in C.report(C.damaged(frame(spark, conversations))).collect()]
    assert sorted(got, key=key) == sorted(expected(conversations), key=key)


def test_walk_is_least_of_all_edits():
    rng = random.Random(3)
    names = {"sound": C.SOUND, "blank": C.BLANK, "duplicate": C.DUPLICATE, "truncated": C.TRUNCATED}
    for _ in range(3000):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), f"t{i}", rng.choice(["sound", "sound", "blank", "duplicate", "truncated"])) for i in range(rng.randint(0, 7))]
        a = C.Audit()
        a.add([None] * len(rows), [r for r, _, _ in rows], [t for _, t, _ in rows], [names[f] for _, _, f in rows], C.AT_END)
        told = a.report()
        cost, audit, repaired = cheapest(tuple(rows))
        assert (told["cost"], told["audit"]) == (cost, audit)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in repaired))
        assert told["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()


def test_a_conversation_over_many_blocks(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice([f"line {rng.randint(0, 300)}.", "cut off", f"{t}?"])) for t in range(700)]
    rows += [(c, t, "user", "Hi.") for c in (1, 9, None) for t in range(3)]
    want = sorted(expected(rows), key=key)
    given = C.damaged(frame(spark, rows).repartition(5))
    for size in ({}, {"block_rows": 20}, {"block_bytes": 1}):
        assert sorted((tuple(r) for r in C.report(given, **size).collect()), key=key) == want


def test_repeated_rows_and_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.report(C.damaged(none)).collect() == []
    same = [(3, 1, "user", "Hi.")] * 50 + [(3, 2, "assistant", "Well." * 50_000)]
    got = C.report(frame(spark, same)).collect()
    assert [(r.duplicate, r.cost, r.audit) for r in got] == [(49, 49 * 3, "K" + "D" * 49 + "K")]
