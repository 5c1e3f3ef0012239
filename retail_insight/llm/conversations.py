"""Repair of conversation structure: the cheapest edits that make the turns alternate.

Every conversation is cut into segments of at most ``SEGMENT`` turns, in which
iterative-deepening A* looks for the edits: depth first, in the order of the
edits' initials, under a growing bound on the cost, with a table of the states
that failed and what they need at least. A conversation of one segment is
searched in one go. Of a longer one, each segment is searched for every state
in which it may be entered, given exactly what the segments behind it cost;
the states then chain up. So no task holds more than a segment's texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_insight.sources.workspace import stage

SEGMENT = 128
SEGMENT_CHARS = 1 << 20
SPACE = " \t\n\x0b\x0c\r"

DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3  # what the edits cost, and a cut text that stays
# A state is the initial of the last role kept; what may follow it, and the role that an edit puts there.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = " sua"
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
PUTS = ((USER, "user"), (USER, "user"), (ASSISTANT, "assistant"), (USER, "user"))
ENDING = ("", "II", "I", "")  # the inserts that a conversation still needs, by its last state
END_COST = [INSERT * len(x) for x in ENDING]
GOOD, BLANK, REPEAT, TRUNCATED = range(4)


def faults(text: Column, repeats: Column) -> Column:
    """The first fault of a turn, as a number."""
    trimmed = F.rtrim(text, F.lit(SPACE))
    ended = F.right(trimmed, F.lit(1)).isin(".", "!", "?")
    found = F.when(trimmed == "", BLANK).when(repeats, REPEAT).when(~ended, TRUNCATED)
    return found.otherwise(GOOD).cast("byte")


def _edits(initial: str, fault: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """Edits at a turn, by initial: letter, cost, turns used up, next state."""
    target = PUTS[state][0]
    yield "D", DELETE, 1, state
    yield "I", INSERT, 0, target
    if fault not in (BLANK, REPEAT):
        extra = CUT if fault == TRUNCATED else 0
        if (kept := FOLLOWS[state].get(initial)) is not None:
            yield "K", extra, 1, kept
        yield "R", REROLE + extra, 1, target


def search(initials: str, fault: list[int], entry: int, behind: list[int]) -> tuple[str, int, int]:
    """The edits of a segment, the state it is left in, and the cost to the conversation's end.

    ``behind`` is what the rest costs from each state. Of the cheapest edits
    the first in the order of their letters are returned: the first accepting
    path of the last, just sufficient bound. ``needs`` holds for every state
    that failed what is proved of its cost; it starts from what the faults
    ahead cost whatever the roles.
    """
    size, least = len(initials), min(behind)
    ahead = [least] * (size + 1)
    for k in range(size - 1, -1, -1):
        ahead[k] = ahead[k + 1] + (0 if fault[k] == GOOD else CUT if fault[k] == TRUNCATED else DELETE)
    needs: dict[tuple[int, int], int] = {(size, s): c for s, c in enumerate(behind)}
    letters: list[str] = []

    def descend(at: int, state: int, left: int) -> int:
        """0 if the end is reached with ``left``, else by how much it falls short at least."""
        need = needs.get((at, state), ahead[at])
        if need > left:
            return need - left
        if at == size:
            letters.append(str(state))
            return 0
        short = None
        for letter, cost, used, after in _edits(initials[at], fault[at], state):
            letters.append(letter)
            over = descend(at + used, after, left - cost)
            if not over:
                return 0
            letters.pop()
            short = over if short is None else min(short, over)
        needs[at, state] = left + short
        return short

    bound = needs.get((0, entry), ahead[0])
    while over := descend(0, entry, bound):
        bound += over
    return "".join(letters[:-1]), int(letters[-1]), bound


def crossing(initials: str, fault: list[int]) -> list[int | None]:
    """What it costs to go through a segment from each state to each state, 16 numbers; null if impossible."""
    out = []
    for entry in range(4):
        costs = {entry: 0}
        for initial, kind in zip(initials, fault, strict=True):
            waiting, after = sorted(costs.items(), key=lambda x: x[1]), {}
            reached = dict(costs)
            while waiting:  # inserts before the turn
                state, cost = waiting.pop(0)
                target = PUTS[state][0]
                if cost + INSERT < reached.get(target, 1 << 60):
                    reached[target] = cost + INSERT
                    waiting.append((target, cost + INSERT))
            for state, cost in reached.items():
                for letter, price, _, target in _edits(initial, kind, state):
                    if letter != "I":
                        after[target] = min(after.get(target, 1 << 60), cost + price)
            costs = after
        out += [costs.get(s) for s in range(4)]
    return out


def _segments(turns: DataFrame, kind: str) -> DataFrame:
    """Sorted turns cut into one row a segment, numbered in order, with what its turns say of the structure."""
    turn_type = "turns array<struct<role: string, text: string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out() -> dict:
            initials = "".join(r["role"][:1] or " " for r in held)
            times = [r["turn"] for r in held if r["turn"] is not None]
            pairs = sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(held) - 1))
            kinds = [r["fault"] for r in held]
            return {
                "conv": held[0]["conv"], "id": held[0]["id"], "segment": number, "initials": initials,
                "faults": bytes(kinds), "pairs": pairs, "times": len(set(times)),
                "first_turn": min(times, default=None), "last_turn": max(times, default=None),
                "turns": [{"role": r["role"], "text": r["text"]} for r in held],
            }

        schema = None
        for batch in batches:
            schema = schema or pa.schema(
                [
                    ("conv", pa.string()), batch.schema.field("id"), ("segment", pa.int64()), ("initials", pa.string()),
                    ("faults", pa.binary()), ("pairs", pa.int64()), ("times", pa.int64()),
                    ("first_turn", pa.int64()), ("last_turn", pa.int64()),
                    ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
                ]
            )
            rows = []
            for row in batch.to_pylist():
                if held and (row["conv"] != held[0]["conv"] or len(held) >= SEGMENT or size > SEGMENT_CHARS):
                    rows.append(out())
                    number, held, size = number + 1, [], 0
                held.append(row)
                size += len(row["text"])
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        if held:
            yield pa.RecordBatch.from_pylist([out()], schema)

    return turns.mapInArrow(
        run,
        f"conv string, id {kind}, segment long, initials string, faults binary, pairs long, times long, "
        f"first_turn long, last_turn long, {turn_type}",
    )


def _behind(longer: DataFrame) -> DataFrame:
    """What the segments behind each one cost, from every state; one small row a segment."""

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [crossing(i, list(f)) for i, f in zip(batch["initials"].to_pylist(), batch["faults"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["conv"], batch["segment"], pa.array(found, pa.list_(pa.int64()))], names=["conv", "segment", "crossing"]
            )

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by([("segment", "descending")])
        rest, found = END_COST, []
        for crossing_ in table["crossing"].to_pylist():
            found.append(rest)
            rest = [min(c + r for c, r in zip(crossing_[4 * s : 4 * s + 4], rest, strict=True) if c is not None) for s in range(4)]
        return pa.table({"conv": table["conv"], "segment": table["segment"], "behind": pa.array(found, pa.list_(pa.int64()))})

    crossed = longer.select("conv", "segment", "initials", "faults").mapInArrow(
        costs, "conv string, segment long, crossing array<long>"
    )
    return crossed.groupBy("conv").applyInArrow(chain, "conv string, segment long, behind array<long>")


def _searched(segments: DataFrame) -> DataFrame:
    """The edits of every segment from every state in which it may be entered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                entries = [START] if row["segment"] == row["first"] else range(4)
                found = [search(row["initials"], list(row["faults"]), s, row["behind"] or END_COST) for s in entries]
                out.append(
                    {
                        "conv": row["conv"], "segment": row["segment"], "audits": [x[0] for x in found],
                        "exits": [x[1] for x in found], "cost": found[0][2],
                    }
                )
            yield pa.RecordBatch.from_pylist(
                out,
                pa.schema(
                    [("conv", pa.string()), ("segment", pa.int64()), ("audits", pa.list_(pa.string())), ("exits", pa.list_(pa.int64())), ("cost", pa.int64())]
                ),
            )

    return segments.mapInArrow(run, "conv string, segment long, audits array<string>, exits array<long>, cost long")


def _chosen(searched: DataFrame) -> DataFrame:
    """Of a longer conversation's segments, the edits from the state in which each is really entered."""

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("segment")
        state, entries, audits = START, [], []
        for found, exits in zip(table["audits"].to_pylist(), table["exits"].to_pylist(), strict=True):
            entries.append(state)
            audits.append(found[state])
            state = exits[state]
        audits[-1] += ENDING[state]
        return pa.table({"conv": table["conv"], "segment": table["segment"], "entry": pa.array(entries, pa.int64()), "audit": pa.array(audits, pa.string())})

    return searched.select("conv", "segment", "audits", "exits").groupBy("conv").applyInArrow(
        chain, "conv string, segment long, entry long, audit string"
    )


def apply_edits(turns: list[dict], audit: str, entry: int) -> list[str]:
    """The repaired turns of a segment as ``role:text``."""
    state, at, out = entry, 0, []
    for letter in audit:
        target, role = PUTS[state]
        if letter == "I":
            out.append(f"{role}:")
            state = target
            continue
        turn = turns[at]
        at += 1
        if letter == "K":
            out.append(f"{turn['role']}:{turn['text']}")
            state = FOLLOWS[state][turn["role"][:1]]
        elif letter == "R":
            out.append(f"{role}:{turn['text']}")
            state = target
    return out


def repair(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row a segment: ``conv_id``, ``segment`` (ascending), its edits as ``audit``, and ``repaired``.

    ``repaired`` lists the turns after the edits as ``role:text``; ``initials``,
    ``faults`` and the counts describe the segment before them; ``cost`` is
    that of the whole conversation, in its first segment.

    Turns go by number, null numbers first, equal numbers by role and a hash of
    the text; a null role or text is one space, and a null id is an id. A role
    that is empty or starts with another letter fits nowhere and cannot be
    kept. Repeated rows are repeats of the first one. A very long text makes
    its segment end early and is never cut. Other columns are not read,
    whatever their names. No rows give no rows.

    Conversations of any length are spread over many tasks: repeats are found
    by a grouping that combines in the map tasks, turns are sorted by range,
    and what meets in one task for a whole conversation is one row of some
    hundred bytes for each ``SEGMENT`` turns.
    """
    kind = turns.schema[conv_id].dataType.simpleString()
    said = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit("")).alias("conv"),
        F.col(conv_id).alias("id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    said = stage(
        said.withColumns({"digest": F.unhex(F.sha2("text", 256)), "row": F.monotonically_increasing_id()}), "turns"
    )
    rank = F.struct(F.col("turn").isNotNull().alias("dated"), "turn", "row")
    firsts = said.groupBy("conv", "role", "digest").agg(F.min(rank)["row"].alias("first"), F.count(F.lit(1)).alias("times"))
    marked = said.join(firsts.where("times > 1").drop("times"), ["conv", "role", "digest"], "left")
    repeats = F.coalesce(F.col("first") != F.col("row"), F.lit(False))
    order = ["conv", "turn", "role", "digest", "row"]
    ordered = marked.withColumn("fault", faults(F.col("text"), repeats)).repartitionByRange(*order).sortWithinPartitions(*order)
    cut = _segments(ordered.select("conv", "id", "turn", "role", "text", "fault"), kind)
    segments = stage(cut, "segments")
    counts = segments.groupBy("conv").agg(F.min("segment").alias("first"), F.count(F.lit(1)).alias("parts"))
    slim = segments.select("conv", "segment", "initials", "faults").join(counts, "conv")
    slim = stage(slim, "searching")
    longer = slim.where("parts > 1")
    searched = stage(_searched(slim.join(_behind(longer), ["conv", "segment"], "left")), "searched")
    several = searched.join(counts.where("parts > 1").select("conv"), "conv", "left_semi")
    single = searched.join(counts.where("parts = 1").select("conv"), "conv", "left_semi").select(
        "conv",
        "segment",
        F.lit(START).cast("long").alias("entry"),
        F.concat(F.col("audits")[0], F.element_at(F.array(*map(F.lit, ENDING)), F.col("exits")[0].cast("int") + 1)).alias("audit"),
    )
    chosen = single.unionByName(_chosen(several)).join(searched.select("conv", "segment", "cost"), ["conv", "segment"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch[c].to_pylist() for c in ("turns", "audit", "entry")), strict=True)
            repaired = pa.array([apply_edits(*row) for row in rows], pa.list_(pa.string()))
            kept = batch.drop_columns(["turns", "entry"])
            yield pa.RecordBatch.from_arrays([*kept.columns, repaired], names=[*kept.schema.names, "repaired"])

    edited = segments.join(chosen, ["conv", "segment"])
    names = [c for c in edited.columns if c not in ("turns", "entry")]
    types = ", ".join(f"{c} {edited.schema[c].dataType.simpleString()}" for c in names)
    found = edited.mapInArrow(run, f"{types}, repaired array<string>")
    return found.withColumnRenamed("id", "conv_id")


def summarise(segments: DataFrame) -> DataFrame:
    """One row a conversation from ``repair``: gaps, faults, illegal pairs, cost, ``audit`` and ``repaired``.

    ``repaired`` is the whole conversation, its turns joined by line ends; the
    one place where a conversation meets, as whoever asks for its digest wants.
    Turn numbers that are null have no part in ``gaps``.
    """
    order = Window.partitionBy("conv").orderBy("segment")
    counted = lambda fault: F.length("faults") - F.length(F.replace(F.hex("faults"), F.lit(f"0{fault}"))) / 2
    before = F.max("last_turn").over(order.rowsBetween(Window.unboundedPreceding, -1))
    joint = F.concat(F.right(F.lag("initials").over(order), F.lit(1)), F.left("initials", F.lit(1)))
    seen = segments.select(
        "conv", "conv_id", "segment", "audit", "cost", "repaired", "first_turn", "last_turn",
        (F.col("times") - F.coalesce((before == F.col("first_turn")).cast("long"), F.lit(0))).alias("times"),
        (F.col("pairs") + F.coalesce((~joint.isin("su", "ua", "au")).cast("long"), F.lit(0))).alias("pairs"),
        *[counted(f).cast("long").alias(n) for f, n in ((BLANK, "blank"), (REPEAT, "duplicate"), (TRUNCATED, "truncated"))],
    )
    parts = F.sort_array(F.collect_list(F.struct("segment", "cost", "audit", "repaired")))
    whole = seen.groupBy("conv").agg(
        F.first("conv_id").alias("conv_id"),
        F.coalesce(F.max("last_turn") - F.min("first_turn") + 1 - F.sum("times"), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        F.sum("pairs").alias("illegal"),
        parts.alias("parts"),
    )
    return whole.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal",
        F.col("parts")[0]["cost"].alias("cost"),
        F.array_join(F.col("parts")["audit"], "").alias("audit"),
        F.array_join(F.flatten(F.col("parts")["repaired"]), "\n").alias("repaired"),
    )
