"""Repair of the turn structure of conversations by the cheapest edits.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``: perhaps a system turn, then user and
assistant in turns. The search runs over an edit lattice that is never built: a node is (rows consumed, state of the grammar), an edge
keeps (K, 0), reroles to user or assistant (R, 1) or deletes (D, 2) the next row, or inserts an empty turn (I, 5). Blank
and repeated rows must be deleted; a truncated row that stays costs 5 more. Dijkstra's algorithm pops nodes by (cost, audit), the
audit being the letters so far, and stops at the first accepting node behind the last row: that is the cheapest repair and, of
those, the one whose audit is least. At one node no audit of equal cost is the beginning of another (what follows would be inserts
alone, which cost), so the order of two audits is not changed by what is appended to both, and pieces of a conversation may be searched apart.

Rows are sorted over the cluster by conversation and turn. A conversation that lies inside one range of that order is searched whole;
of one that is cut by ranges, blocks of ``BLOCK`` rows are searched from every state to every state, and then the lattice of blocks in
the same way, so a conversation with a third of all rows is worked on by all tasks, and what meets in one task is a small multiple
of its audit, which is one cell of the result.

Rows of a conversation are ordered by turn (nulls first), then role, then text. Null roles and texts are empty. A row's
first fault counts: blank (no character but space, tab, line feed, vertical tab, form feed and carriage return), duplicate
(role and text seen earlier in the conversation), truncated (the last other character is none of ``.!?``). Rows without a conversation id
make up one conversation. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, parts_for

BLOCK = 256
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
#: States: nothing yet, behind system, behind user, behind assistant; and the role that may come next where it is chosen freely.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, ENDS = range(4), (START, ASSISTANT)
FREE = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
INITIAL = {USER: "u", ASSISTANT: "a"}
WHITE = " \t\n\x0b\x0c\r"

Found = dict[int, tuple[int, str]]
Edges = Callable[[int, int], Iterator[tuple[int, str, int, int]]]


def kept_state(state: int, initial: str) -> int | None:
    """The state behind a kept row, None where the grammar forbids it."""
    if initial == "s":
        return SYSTEM if state == START else None
    return FREE[state] if initial == INITIAL[FREE[state]] else None


def search(edges: Edges, last: int, start: int, ends: tuple[int, ...], every: bool = False) -> Found:
    """``{state: (cost, audit)}`` of the cheapest ways from ``(0, start)`` to ``last``: the first that is popped, or one for every end."""
    heap, done, found = [(0, "", 0, start)], set(), {}
    while heap:
        cost, audit, at, state = heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == last and state in ends:
            found[state] = (cost, audit)
            if not every or len(found) == len(ends):
                break
        for price, letters, to, behind in edges(at, state):
            if (to, behind) not in done:
                heappush(heap, (cost + price, audit + letters, to, behind))
    return found


def row_edges(initials: list[str], faults: list[int]) -> Edges:
    """The lattice of rows."""

    def edges(at: int, state: int) -> Iterator[tuple[int, str, int, int]]:
        free = FREE[state]
        yield INSERT, "I", at, free
        if at == len(faults):
            return
        yield DELETE, "D", at + 1, state
        if faults[at] in (BLANK, DUPLICATE):
            return
        more = CUT_OFF if faults[at] == TRUNCATED else 0
        behind = kept_state(state, initials[at])
        if behind is not None:
            yield KEEP + more, "K", at + 1, behind
        if behind != free:
            yield REROLE + more, "R", at + 1, free

    return edges


def piece_edges(pieces: list[dict[int, Found]]) -> Edges:
    """The lattice of pieces that have been searched from every state."""

    def edges(at: int, state: int) -> Iterator[tuple[int, str, int, int]]:
        if at < len(pieces):
            for behind, (cost, audit) in pieces[at][state].items():
                yield cost, audit, at + 1, behind

    return edges


def piece(edges: Edges, last: int) -> dict[int, Found]:
    return {s: search(edges, last, s, tuple(STATES), every=True) for s in STATES}


def cheapest(initials: list[str], faults: list[int], block: int = BLOCK) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    if len(faults) > block:
        cuts = range(0, len(faults), block)
        return joined([piece(row_edges(initials[a : a + block], faults[a : a + block]), len(faults[a : a + block])) for a in cuts], block)
    return next(iter(search(row_edges(initials, faults), len(faults), START, ENDS).values()))


def joined(pieces: list[dict[int, Found]], block: int = BLOCK) -> tuple[int, str]:
    """Cost and audit of the conversation that consecutive pieces make up."""
    while len(pieces) > block:
        pieces = [piece(piece_edges(own), len(own)) for own in (pieces[a : a + block] for a in range(0, len(pieces), block))]
    return next(iter(search(piece_edges(pieces), len(pieces), START, ENDS).values()))


def apply(state: int, audit: str, roles: list[str], texts: list[str]) -> tuple[int, list[dict[str, str]]]:
    """The state behind an audit and the turns that it leaves."""
    at, out = 0, []
    for letter in audit:
        if letter == "I":
            state = FREE[state]
            out.append({"role": ROLE[state], "text": ""})
            continue
        if letter == "K":
            state = kept_state(state, roles[at][:1])
            out.append({"role": roles[at], "text": texts[at]})
        elif letter == "R":
            state = FREE[state]
            out.append({"role": ROLE[state], "text": texts[at]})
        at += 1
    return state, out


class Tally(NamedTuple):
    """What is counted over consecutive rows; ``first`` and ``last`` are (turn, initial)."""

    blank: int
    duplicate: int
    truncated: int
    illegal: int
    lo: int | None
    hi: int | None
    turns: int
    first: tuple[int | None, str]
    last: tuple[int | None, str]

    @staticmethod
    def of(turns: list[int | None], initials: list[str], faults: list[int]) -> Tally:
        pairs = zip(initials, initials[1:], strict=False)
        own = [t for t in turns if t is not None]
        counts = [faults.count(k) for k in (BLANK, DUPLICATE, TRUNCATED)]
        bad = sum(a + b not in ("su", "ua", "au") for a, b in pairs)
        return Tally(*counts, bad, own[0] if own else None, own[-1] if own else None, len(set(own)), (turns[0], initials[0]), (turns[-1], initials[-1]))

    def then(self, more: Tally) -> Tally:
        meet = self.last[0] is not None and self.last[0] == more.first[0]
        bad = self.last[1] + more.first[1] not in ("su", "ua", "au")
        counts = (self.blank + more.blank, self.duplicate + more.duplicate, self.truncated + more.truncated, self.illegal + more.illegal + bad)
        return Tally(*counts, more.lo if self.lo is None else self.lo, self.hi if more.hi is None else more.hi, self.turns + more.turns - meet, self.first, more.last)

    @property
    def gaps(self) -> int:
        return 0 if self.lo is None else self.hi - self.lo + 1 - self.turns


_TALLY = "blank long, duplicate long, truncated long, illegal long, lo long, hi long, turns long, first_turn long, first_initial string, last_turn long, last_initial string"
_TURNS = "array<struct<role:string,text:string>>"
_PARTS = f"conv_id long, part int, block int, rows int, {_TALLY}, cost long, audit string, pieces array<struct<before:int,behind:int,cost:long,audit:string>>, kept {_TURNS}, own {_TURNS}"
_NAMES = [c.strip().split(" ")[0] for c in _TALLY.split(",")]


def _tally_row(t: Tally) -> dict:
    return dict(zip(_NAMES, [*t[:7], *t.first, *t.last], strict=True))


def _tally(row: dict) -> Tally:
    v = [row[c] for c in _NAMES]
    return Tally(*v[:7], (v[7], v[8]), (v[9], v[10]))


_ARROW_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_ARROW_PARTS = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("rows", pa.int32()), *[(c, pa.string() if "initial" in c else pa.int64()) for c in _NAMES], ("cost", pa.int64()), ("audit", pa.string()),
    ("pieces", pa.list_(pa.struct([("before", pa.int32()), ("behind", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))), ("kept", _ARROW_TURNS), ("own", _ARROW_TURNS),
])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations of one range, searched, and the blocks of its first and last one, which other ranges may share.

    Rows ``conv_id, turn, role, text, fault`` come sorted; of rows equal in turn, role and text all but the first are duplicates.
    """
    part, block = TaskContext.get().partitionId(), 0
    out: list[dict] = []

    def give(rows: list[tuple], whole: bool) -> None:
        nonlocal block
        _, turns, roles, texts, faults = map(list, zip(*rows, strict=True))
        initials = [r[:1] for r in roles]
        row = {"conv_id": rows[0][0], "part": part, "block": block, "rows": len(rows), **_tally_row(Tally.of(turns, initials, faults))}
        if whole:
            row["cost"], row["audit"] = cheapest(initials, faults)
            row["kept"] = apply(START, row["audit"], roles, texts)[1]
        else:
            found = piece(row_edges(initials, faults), len(rows))
            row["pieces"] = [{"before": s, "behind": e, "cost": c, "audit": a} for s, own in found.items() for e, (c, a) in own.items()]
            row["own"] = [{"role": r, "text": "" if f in (BLANK, DUPLICATE) else t} for r, t, f in zip(roles, texts, faults, strict=True)]
        block += 1
        out.append(row)

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_pylist(out, _ARROW_PARTS)
        out.clear()
        return made

    held: list[tuple] = []
    first = True  # of the range, which an earlier range may have begun
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and row[0] != held[-1][0]:
                for at in range(0, len(held), BLOCK) if first else [0]:
                    give(held[at : at + BLOCK] if first else held, not first)
                held, first = [], False
            elif held and row[4] != BLANK and row[1:4] == held[-1][1:4]:
                row = (*row[:4], DUPLICATE)
            held.append(row)
            if first and len(held) > BLOCK:
                give(held[:BLOCK], False)
                held = held[BLOCK:]
        if len(out) >= 64:
            yield flush()
    for at in range(0, len(held), BLOCK):
        give(held[at : at + BLOCK], False)
    yield flush()


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reports of conversations from their blocks in order, and for each block its part of the audit (``report`` is null there)."""
    schema = pa.schema([f for f in _ARROW_PARTS if f.name not in ("pieces", "kept", "own")] + [pa.field("run", pa.int32()), pa.field("runs", pa.int32()), pa.field("report", pa.bool_())])

    def give(rows: list[dict]) -> pa.RecordBatch:
        tally, pieces = _tally(rows[0]), []
        for r in rows[1:]:
            tally = tally.then(_tally(r))
        for r in rows:
            own: dict[int, Found] = {s: {} for s in STATES}
            for p in r["pieces"]:
                own[p["before"]][p["behind"]] = (p["cost"], p["audit"])
            pieces.append(own)
        cost, audit = joined(pieces)
        consumed = np.flatnonzero(np.frombuffer(audit.encode(), np.uint8) != ord("I"))
        cuts = [0, *consumed[np.cumsum([r["rows"] for r in rows])[:-1]].tolist(), len(audit)]  # inserts go with the block before
        out = [{"conv_id": rows[0]["conv_id"], "rows": sum(r["rows"] for r in rows), **_tally_row(tally), "cost": cost, "audit": audit, "report": True}]
        for k, r in enumerate(rows):
            out.append({"conv_id": r["conv_id"], "part": r["part"], "block": r["block"], "audit": audit[cuts[k] : cuts[k + 1]], "run": k, "runs": len(rows), "report": False})
        return pa.RecordBatch.from_pylist(out, schema)

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["conv_id"] != held[-1]["conv_id"]:
                yield give(held)
                held = []
            held.append(row)
    if held:
        yield give(held)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns that each block keeps; blocks come in the order of their conversation, whose state is carried on."""
    schema = pa.schema([("conv_id", pa.int64()), ("run", pa.int32()), ("runs", pa.int32()), ("kept", _ARROW_TURNS)])
    state = START
    for batch in batches:
        for at in range(batch.num_rows):
            conv, run, runs, audit, own = (c[at].as_py() for c in batch.columns)
            state, kept = apply(START if run == 0 else state, audit, [o["role"] for o in own], [o["text"] for o in own])
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "run": run, "runs": runs, "kept": kept}], schema)


class Repaired(NamedTuple):
    #: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of each conversation that has rows.
    reports: DataFrame
    #: ``conv_id, run, runs, kept``: the repaired turns (``role, text``) in ``runs`` consecutive runs; most conversations have one.
    turns: DataFrame


def with_faults(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, turn, role, text, fault``; repetitions within one turn are told where the rows are sorted."""
    bare = F.rtrim("text", F.lit(WHITE))
    key = F.unhex(F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    rows = rows.withColumn("bare", bare).withColumn("key", F.when(F.col("bare") != "", key))
    # Written before it is joined: a small table is broadcast by its size, and a crowded key of a large one can be split over tasks.
    again = rows.where("key IS NOT NULL").groupBy("key").agg(F.min(place).alias("earliest"), F.max(place).alias("latest")).where("earliest < latest").select("key", "earliest")
    again = scratch.put(again, "repeated")
    fault = (
        F.when(F.col("bare") == "", BLANK).when(F.col("earliest").isNotNull() & (F.col("earliest") < place), DUPLICATE)
        .when(~F.right("bare", F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    )
    return rows.join(again, "key", "left").select("conv_id", "turn", "role", "text", fault.cast("int").alias("fault"))


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts: int | None = None) -> Repaired:
    """The repaired conversations of a table of turns, and what was found and done in each."""
    scratch = Scratch(rows.sparkSession, "structure")
    n = parts or parts_for(rows)
    text: Callable[[str], Column] = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    faulty = scratch.put(with_faults(rows, scratch), "faults")
    order = ["conv_id", "turn", "role"]
    ranges = faulty.repartitionByRange(n, *order, F.left("text", F.lit(64))).sortWithinPartitions(*order, "text")
    found = scratch.put(ranges.mapInArrow(_searched, _PARTS), "searched")
    scratch.drop("faults")
    whole, blocks = found.where("cost IS NOT NULL"), found.where("cost IS NULL")
    ordered = lambda df, *by: df.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", *by)
    schema = _PARTS[: _PARTS.index("pieces")] + "run int, runs int, report boolean"
    stitched = scratch.put(ordered(blocks.drop("cost", "audit", "kept", "own"), "part", "block").mapInArrow(_stitched, schema), "stitched")
    report = ["conv_id", F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    reports = whole.select(*report).unionByName(stitched.where("report").select(*report))
    cut = blocks.select("part", "block", "own").join(stitched.where("NOT report").select("conv_id", "part", "block", "run", "runs", "audit"), ["part", "block"])
    cut = ordered(cut.select("conv_id", "run", "runs", "audit", "own"), "run").mapInArrow(_applied, f"conv_id long, run int, runs int, kept {_TURNS}")
    one = F.lit(1).alias("runs")
    return Repaired(reports, whole.select("conv_id", F.lit(0).alias("run"), one, "kept").unionByName(cut))
