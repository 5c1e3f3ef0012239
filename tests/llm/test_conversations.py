"""Conversation repair against a shortest-path search over whole conversations."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from retail_insight.llm import conversations
from retail_insight.llm.conversations import repair, summarise

SCHEMA = "conv_id long, turn long, role string, text string, conv string, segment int, ROW long"
NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]


def fault_list(rows):
    seen, out = set(), []
    for _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Uniform-cost search over (cost, edits, place, repaired turns); the first end reached is the answer."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, turns = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            return cost, audit, turns
        if (at, state) in done:
            continue
        done.add((at, state))
        target = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
        heapq.heappush(heap, (cost + 3, audit + "I", at, target[0], (*turns, f"{target}:")))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, turns))
            if faults[at] in ("", "truncated"):
                more = 3 if faults[at] else 0
                if role and state + role[0] in ("s", "u", "su", "ua", "au"):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[:1], (*turns, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, target[0], (*turns, f"{target}:{text}")))
    raise AssertionError


def expected(rows):
    """Of sorted (turn, role, text)."""
    faults = fault_list(rows)
    times = {t for t, _, _ in rows if t is not None}
    gaps = max(times) - min(times) + 1 - len(times) if times else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    cost, audit, turns = cheapest(rows, faults)
    counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, "\n".join(turns))


def conversation(rng, size, times=True):
    rows = []
    for k in range(size):
        role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "u", "", " "])
        text = rng.choice(["yes.", "no!", f"t{k}.", f"t{k}?", f"t{k}", "", " \t", f"t{k}. \n", "é"])
        rows.append((k + k // 5 if times else None, role, text))
        if rng.random() < 0.1:
            rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("segment", [1, 3, 128])
def test_repair_against_a_search_over_whole_conversations(spark, monkeypatch, segment):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    rng = random.Random(segment)
    talks = {i: conversation(rng, rng.choice([1, 2, 3, 5, 8, 12])) for i in range(60)}
    talks |= {None: conversation(rng, 4), 99: conversation(rng, 150), 98: [(k // 2 + 5, "user", f"{k}.") for k in range(0, 60, 2)]}
    talks[97] = [(None, "user", "dated later.")] + [(3, "user", "dated later."), (9, "assistant", "x" * 2_000_000 + ".")]
    talks[96] = [(4, "user", "")] * 7
    rows = [(i, *r, "c", 1, 2) for i, rs in talks.items() for r in rs]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = {r.conv_id: tuple(r[n] for n in NAMES) for r in summarise(repair(turns)).collect()}
    assert found == {i: expected(rs) for i, rs in talks.items()}


def test_null_roles_and_texts_are_a_space_and_no_rows_give_none(spark):
    rows = [(1, 1, None, "a."), (1, 2, "user", None), (1, 3, "assistant", "b.")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (row,) = summarise(repair(turns)).collect()
    assert tuple(row[n] for n in NAMES) == expected([(t, r or " ", x or " ") for _, t, r, x in rows])
    assert summarise(repair(turns.limit(0))).count() == 0


def test_ties_go_by_letter():
    assert conversations.search("uu", [0, 0], 0, conversations.END_COST)[0] + "" == "KR"
    assert expected([(1, "user", "a."), (2, "user", "b.")])[6] == "KR"


def test_query_against_the_search(spark):
    from retail_insight.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    talks = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        fate, held = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20, talks.setdefault(r.conv_id, [])
        text = "" if fate == 1 else re.sub("[.!?]", "", r.text) if fate == 2 else r.text
        held += [(r.turn, "user" if fate == 4 else r.role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    want = {}
    for i, rows in talks.items():
        *counts, repaired = expected(rows)
        want[i] = (*counts, hashlib.sha256(repaired.encode()).hexdigest())
    found = QUERIES["op13_conversation_repair"](spark, sf).collect()
    assert {r.conv_id: tuple(r[n] for n in [*NAMES[:-1], "repaired_sha256"]) for r in found} == want
