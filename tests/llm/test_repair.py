"""Conversation repair against a plain recursion, and the recursion's rule against all audits of short conversations."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from functools import cache

import pytest

from packetlens.llm import queries, repair

TURNS = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
NOTHING = hashlib.sha256().hexdigest()


def faults(rows: list[tuple]) -> list[str]:
    """blank, duplicate, truncated or nothing for each (turn, role, text) in order."""
    out, seen = [], set()
    for _, role, text in rows:
        inked = text.strip(WHITE)
        out.append("blank" if not inked else "duplicate" if (role, text) in seen else "" if inked[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def follow(letters: str, rows: list[tuple], wrong: list[str]) -> tuple[int, list[str]] | None:
    """Cost and repaired turns of an audit, or None where it isn't allowed."""
    cost, said, i = 0, [], 0
    for x in letters:
        before = said[-1][0] if said else ""
        if x == "I":
            cost += 5
            said.append("assistant:" if before == "u" else "user:")
            continue
        if i == len(rows):
            return None
        (_, role, text), fault = rows[i], wrong[i]
        i += 1
        if x == "D":
            cost += 2
            continue
        if fault in ("blank", "duplicate") or x == "K" and role[:1] not in ("s", "u", "a"):
            return None
        cost += 5 * (fault == "truncated") + (x == "R")
        said.append(f"{role if x == 'K' else 'assistant' if before == 'u' else 'user'}:{text}")
    return (cost, said) if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in said)) else None


def best(rows: list[tuple]) -> tuple[int, str]:
    wrong = faults(rows)

    @cache
    def go(i: int, state: str, inserted: int) -> tuple[int, str]:
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if inserted < 3:
            cost, rest = go(i, "a" if state == "u" else "u", inserted + 1)
            found.append((cost + 5, "I" + rest))
        if i < len(rows):
            cost, rest = go(i + 1, state, 0)
            found.append((cost + 2, "D" + rest))
            if wrong[i] not in ("blank", "duplicate"):
                more = 5 * (wrong[i] == "truncated")
                cost, rest = go(i + 1, "a" if state == "u" else "u", 0)
                found.append((cost + more + 1, "R" + rest))
                role = rows[i][1][:1]
                if role and role in {"": "su", "s": "u", "u": "a", "a": "u"}[state]:
                    cost, rest = go(i + 1, role, 0)
                    found.append((cost + more, "K" + rest))
        return min(found, default=(10**9, ""))

    return go(0, "", 0)


def plain(turns: list[tuple]) -> dict:
    """The report's rows of (conv_id, turn, role, text)."""
    out = {}
    order = lambda r: (r[1] is not None, r[1] or 0, (r[2] if r[2] is not None else " ").encode(), (r[3] if r[3] is not None else " ").encode())
    for conv in {r[0] for r in turns}:
        rows = [(t, " " if role is None else role, " " if text is None else text) for _, t, role, text in sorted((r for r in turns if r[0] == conv), key=order)]
        numbers = {t for t, _, _ in rows if t is not None}
        wrong = faults(rows)
        cost, audit = best(rows)
        told = follow(audit, rows, wrong)
        assert told and told[0] == cost
        pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out[conv] = (gaps, *(wrong.count(x) for x in ("blank", "duplicate", "truncated")), pairs, cost, audit, hashlib.sha256("\n".join(told[1]).encode()).hexdigest())
    return out


def report(frame, ids=None) -> dict:
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[c] for c in columns) for r in repair.report(frame, ids).collect()}


def some(seed: int, n: int, most: int) -> list[tuple]:
    r = random.Random(seed)
    role = lambda: r.choice(["user", "user", "assistant", "assistant", "system", "tool", None, "", "umpire"])
    text = lambda: r.choice(["Yes.", "No!", "Why?", "half", "half a", "", " \n", None, "so. \t", "Yes.", f"word {r.randrange(9)}."])
    return [(conv, r.choice([t, t, t, t + 1, None]), role(), text()) for conv in [*range(n), None] for t in range(r.randrange(1, most))]


def test_plain_version_takes_the_least_of_all_audits() -> None:
    r = random.Random(3)
    for _ in range(60):
        rows = [(i, r.choice(["user", "assistant", "system", "tool"]), r.choice(["a.", "b.", "c", "", "a."])) for i in range(r.randrange(4))]
        wrong, found = faults(rows), []
        for n in range(len(rows) + 5):
            for letters in itertools.product("DIKR", repeat=n):
                told = follow("".join(letters), rows, wrong)
                if told:
                    found.append((told[0], "".join(letters)))
        assert best(rows) == min(found)


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_report(spark, monkeypatch, block) -> None:
    """Conversations in one block and in many give the same repairs; rows come in any order, with columns of the operator's own names."""
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = some(block, 25, 14)
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", f"turn {t}." if t % 7 else "cut") for t in range(90)]  # one long conversation
    rows += [(101, 5, "user", "again.")] * 40 + [(101, 6, "assistant", "again.")] * 3  # many equal rows
    shuffled = random.Random(1).sample(rows, len(rows))
    frame = spark.createDataFrame([(*x, 1, "z", 2, 3, "d") for x in shuffled], TURNS + ", block int, pos string, code int, n int, digest string")
    assert report(frame.repartition(5)) == plain(rows)


def test_repaired_turns(spark) -> None:
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hm."), (1, 2, "user", "Hello."), (1, 3, "assistant", "Hi."), (2, 0, "assistant", ""), (3, 1, "user", "x.")]
    done = repair.plan(spark.createDataFrame(rows, TURNS))
    found = sorted((r["conv_id"], r["seq"], r["role"], r["text"], r["edit"]) for r in repair.repaired(done).collect())
    # Deleting one of the two user turns costs 2, inserting an answer 5; to delete the first is least in ASCII.
    assert found == [(1, 0, "system", "Be kind.", "K"), (1, 1, "user", "Hello.", "K"), (1, 2, "assistant", "Hi.", "K")]


def test_edges(spark) -> None:
    empty = spark.createDataFrame([], TURNS)
    assert report(empty) == {}
    ids = spark.createDataFrame([(7, "a"), (7, "b"), (None, "c")], "conv_id long, text string")
    assert report(empty, ids) == {7: (0, 0, 0, 0, 0, 0, "", NOTHING), None: (0, 0, 0, 0, 0, 0, "", NOTHING)}
    long = "word " * 400_000
    rows = [(1, None, None, None), (1, None, "user", long + "end."), (1, None, "assistant", long), (2, 3, "user", "a."), (2, 9, "assistant", "b.")]
    assert report(spark.createDataFrame(rows, TURNS)) == plain(rows)


def test_damage(spark) -> None:
    """Each kind of damage is there, and null places count as a space."""
    rows = [(c, t, "assistant", "One. Two!") for c in range(20) for t in range(4)] + [(None, None, None, None)]
    hurt = queries.damaged(spark.createDataFrame(rows, TURNS)).collect()
    texts = {r["text"] for r in hurt}
    assert {"", "One Two", "One. Two!"} <= texts and {"user", "assistant"} <= {r["role"] for r in hurt}
    assert sum(r["conv_id"] is None for r in hurt) <= 2 and len(hurt) != len(rows)
