"""Repair of the structure of conversations at the least cost.

The edit lattice of a conversation has a node for each row boundary and each
state of the grammar of role initials, ``(s?(ua)+)?``.  Edges keep a row (free,
or the price of a truncated text), change its role, delete it, or insert an
empty turn.  A bidirectional Dijkstra search looks for the cheapest way: a
forward and a reverse heap meet, all crossings of equal cost are finished, and
of these the least concatenated audit (the edits' initials) is picked.  An
audit tells the state it leads to, so equal costs at one node never have one
audit as the beginning of another, and the least of parts makes the least whole.

Rows are sorted by conversation over range partitions and searched in segments
of bounded rows and characters, so a conversation of any length is spread over
tasks.  A segment that may be one of several is searched from each state to
each state; a conversation's segments then stream through one task that keeps,
for each of four states, a cost, an audit and the running digest of the text,
and never a segment before the last one.

Rows are ordered by turn (nulls first), role and text.  Null role or text: one
space. Equal rows are counted before they are sorted, so any number of them is
one row here.  A null conv_id is a conversation.  A conversation named in
``every`` without rows has zeros, an empty audit and the digest of the empty
string.  No rows: no rows.  Other columns are not looked at.  An audit is one
string, which bounds a conversation to the length of a string.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.frames import settle

#: States of the grammar: nothing yet, after s, after u, after a; and the state that an added or changed turn leads to.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES, FINAL = (EMPTY, SYSTEM, USER, ASSISTANT), (EMPTY, ASSISTANT)
_NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEPT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {"su", "ua", "au"}
_BLANK = " \t\n\v\f\r"


@dataclass(frozen=True)
class Costs:
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1


@dataclass(frozen=True)
class Row:
    """``times`` equal rows, one after another: all but the first are duplicates."""

    role: str
    text: str
    times: int = 1
    duplicate: bool = False

    @property
    def fault(self) -> str:
        last = self.text.rstrip(_BLANK)[-1:]
        return "blank" if not last else "duplicate" if self.duplicate else "" if last in ".!?" else "truncated"


class Lattice:
    """Edges between (row boundary, state) nodes, in both directions, with costs and letters."""

    def __init__(self, rows: list[Row], costs: Costs):
        self.n, self.costs = len(rows), costs
        self.rows = []
        for r in rows:
            fault = r.fault
            more = (costs.delete * (r.times - 1), "D" * (r.times - 1))
            self.rows.append((r.role[:1], fault in ("blank", "duplicate"), costs.truncated if fault == "truncated" else 0, more))

    def _over(self, i: int, q: int) -> Iterator[tuple[int, int, str]]:
        """(state, cost, letters) of the edges that use up row ``i`` from state ``q``."""
        initial, must_go, price, (cost, letters) = self.rows[i]
        yield q, self.costs.delete + cost, "D" + letters
        if not must_go:
            if (q, initial) in _KEPT:
                yield _KEPT[q, initial], price + cost, "K" + letters
            yield _NEXT[q], self.costs.rerole + price + cost, "R" + letters

    def forward(self, i: int, q: int) -> Iterator[tuple[tuple[int, int], int, str]]:
        yield (i, _NEXT[q]), self.costs.insert, "I"
        if i < self.n:
            for to, cost, letters in self._over(i, q):
                yield (i + 1, to), cost, letters

    def reverse(self, i: int, q: int) -> Iterator[tuple[tuple[int, int], int, str]]:
        for before in STATES:
            if _NEXT[before] == q:
                yield (i, before), self.costs.insert, "I"
            if i:
                for to, cost, letters in self._over(i - 1, before):
                    if to == q:
                        yield (i - 1, before), cost, letters


class _Search:
    """One side: labels (cost, audit), and a heap by cost and then by boundary, so that free edges lead on in it."""

    def __init__(self, starts: list[tuple[int, int]], edges, sign: int):
        self.edges, self.sign = edges, sign
        self.label: dict[tuple[int, int], tuple[int, str]] = {v: (0, "") for v in starts}
        self.heap = [(0, sign * i, q) for i, q in starts]
        heapq.heapify(self.heap)
        self.done: set[tuple[int, int]] = set()

    def top(self) -> float:
        while self.heap and (self.sign * self.heap[0][1], self.heap[0][2]) in self.done:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def step(self) -> Iterator[tuple[int, int]]:
        """Settles the nearest node; yields the nodes whose labels it made better."""
        _, i, q = heapq.heappop(self.heap)
        v = self.sign * i, q
        self.done.add(v)
        cost, audit = self.label[v]
        for to, more, letters in self.edges(*v):
            new = cost + more, audit + letters if self.sign > 0 else letters + audit
            if to not in self.label or new < self.label[to]:
                if to not in self.label or new[0] < self.label[to][0]:
                    heapq.heappush(self.heap, (new[0], self.sign * to[0], to[1]))
                self.label[to] = new
                yield to


def cheapest(lattice: Lattice, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest way over all rows from a state to one of ``ends``; None if there is none."""
    ahead = _Search([(0, start)], lattice.forward, 1)
    back = _Search([(lattice.n, q) for q in ends], lattice.reverse, -1)
    best = 0 if lattice.n == 0 and start in ends else float("inf")
    while (a := ahead.top()) + (b := back.top()) <= best and a + b < float("inf"):
        one, other = (ahead, back) if a <= b else (back, ahead)
        for v in one.step():
            if v in other.label:
                best = min(best, one.label[v][0] + other.label[v][0])
    found = [(c + back.label[v][0], s + back.label[v][1]) for v, (c, s) in ahead.label.items() if v in back.label]
    return min(found, default=None)


def repaired(rows: list[Row], start: int, audit: str) -> list[str]:
    """``role:text`` of what the edits leave or add, from a state."""
    out, state, letters = [], start, iter(audit)
    for row in [*rows, None]:
        for letter in letters:
            if letter == "I":
                state = _NEXT[state]
                out.append(f"{_ROLE[state]}:")
                continue
            if letter == "K":
                state = _KEPT[state, row.role[:1]]
                out.append(f"{row.role}:{row.text}")
            elif letter == "R":
                state = _NEXT[state]
                out.append(f"{_ROLE[state]}:{row.text}")
            for _ in range(row.times - 1):
                next(letters)  # the repeats go
            break
    return out


def _counts(rows: list[Row], turns: list[int | None]) -> dict:
    faults = {"blank": 0, "duplicate": 0, "truncated": 0}
    illegal = 0
    for k, r in enumerate(rows):
        fault = r.fault
        if fault:
            faults[fault] += r.times if fault in ("blank", "duplicate") else 1
        if fault not in ("blank", "duplicate"):
            faults["duplicate"] += r.times - 1
        illegal += r.times - 1 + (k > 0 and rows[k - 1].role[:1] + r.role[:1] not in _LEGAL)
    own = [t for t in turns if t is not None]
    return faults | {
        "illegal": illegal, "first": rows[0].role[:1] if rows else None, "last": rows[-1].role[:1] if rows else None, "n_turns": len(set(own)),
        "least": min(own, default=None), "most": max(own, default=None),
    }


def placed_rows(rows: DataFrame) -> DataFrame:
    """Distinct rows of each conversation with their number and whether an earlier one has the same role and text."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    key = lambda c, no, value: (F.col(c).isNull().alias(no), F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(value))
    plain = rows.select(*key("conv_id", "no_id", "conv"), *key("turn", "no_turn", "at"), blank("role"), blank("text"))
    by = ["no_id", "conv", "no_turn", "at", "role", "text"]
    placed = plain.groupBy(*by).agg(F.count("*").alias("times"))
    # The earliest row of a role and text is one row, so neither grouping nor join has a key that many rows share.
    first = placed.groupBy("no_id", "conv", "role", "text").agg(F.max("no_turn").alias("no_turn"), F.min(F.when(~F.col("no_turn"), F.col("at"))).alias("at"))
    first = first.select("no_id", "conv", "no_turn", F.when(F.col("no_turn"), F.lit(0).cast("long")).otherwise(F.col("at")).alias("at"), "role", "text", F.lit(True).alias("is_first"))
    return placed.join(first, by, "left").withColumn("duplicate", F.col("is_first").isNull()).drop("is_first")


_SEGMENT = (
    "no_id boolean, conv long, part int, seq long, starts boolean, ends boolean, blank long, duplicate long, truncated long, illegal long, first string, last string, n_turns long, "
    "least long, most long, costs array<long>, audits array<string>, roles array<string>, texts array<string>, times array<int>, again array<boolean>"
)
_KINDS = [
    pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3, pa.list_(pa.int64()), pa.list_(pa.string()),
    pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.bool_()),
]
_NAMES = [c.split()[0] for c in _SEGMENT.split(", ")]


def _segments(rows: DataFrame, costs: Costs, most_rows: int, most_chars: int) -> DataFrame:
    """The sorted rows in segments, each with the cheapest audits between states: one row of ``_SEGMENT``."""

    def made(held: list[tuple], key: tuple, part: int, seq: int, starts: bool, ends: bool) -> list:
        own = [Row(r[4], r[5], r[6], r[7]) for r in held]
        lattice = Lattice(own, costs)
        found: list[tuple | None] = [None] * 16
        for a, z in [(EMPTY, ASSISTANT)] if starts and ends else product([EMPTY] if starts else STATES, STATES):
            found[4 * a + z] = cheapest(lattice, a, FINAL if starts and ends else (z,))
        c = _counts(own, [None if r[2] else r[3] for r in held])
        fields = [c[k] for k in ("blank", "duplicate", "truncated", "illegal", "first", "last", "n_turns", "least", "most")]
        return [*key, part, seq, starts, ends, *fields, [f and f[0] for f in found], [f and f[1] for f in found], [r.role for r in own], [r.text for r in own], [r.times for r in own], [r.duplicate for r in own]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def segments() -> Iterator[list]:
            part, seq, key, held, chars, starts = TaskContext.get().partitionId(), 0, None, [], 0, False
            for b in batches:
                for no_id, conv, no_row, no_turn, at, role, text, times, duplicate in zip(*(c.to_pylist() for c in b.columns)):
                    new = (no_id, conv) != key
                    if key is not None and (new or len(held) >= most_rows or chars >= most_chars):
                        yield made(held, key, part, seq, starts, new)
                        seq, held, chars, starts = seq + 1, [], 0, False
                    if new:
                        key, starts = (no_id, conv), False
                    if no_row:
                        starts = True  # a conversation's mark comes before all its rows
                    else:
                        held.append((no_id, conv, no_turn, at, role, text, times, duplicate))
                        chars += len(text)
            if key is not None:
                yield made(held, key, part, seq, starts, False)  # it may go on in the next range

        done, size = [], 0
        for s in segments():
            done.append(s)
            size += sum(map(len, s[18])) + 200
            if size > 2 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), _KINDS)], _NAMES)
                done, size = [], 0
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), _KINDS)], _NAMES)

    order = ["no_id", "conv", F.desc("no_row"), F.desc("no_turn"), "at", "role"]
    # Ranges look at the beginning of a text only, as their borders meet in the driver.
    dealt = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    return dealt.select("no_id", "conv", "no_row", "no_turn", "at", "role", "text", "times", "duplicate").mapInArrow(run, _SEGMENT)


def _joined(segments: DataFrame) -> DataFrame:
    """A row for each conversation, from its segments in order."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2

    class Whole:
        def __init__(self, key: tuple):
            self.id = None if key[0] else key[1]
            self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
            self.first_turn = self.last_turn = self.last = None
            self.ways = {EMPTY: (0, "", hashlib.sha256())}

        def add(self, s: dict) -> None:
            for k in ("blank", "duplicate", "truncated", "illegal"):
                setattr(self, k, getattr(self, k) + s[k])
            if self.last is not None and s["first"] is not None:
                self.illegal += self.last + s["first"] not in _LEGAL
            self.last = s["last"] if s["last"] is not None else self.last
            if s["least"] is not None:
                self.n_turns += s["n_turns"] - (self.last_turn == s["least"])
                self.first_turn = s["least"] if self.first_turn is None else self.first_turn
                self.last_turn = s["most"]
            rows = [Row(*r) for r in zip(s["roles"], s["texts"], s["times"], s["again"])]
            ways = {}
            for z in STATES:
                tried = [(cost + s["costs"][4 * a + z], audit + s["audits"][4 * a + z], a) for a, (cost, audit, _) in self.ways.items() if s["costs"][4 * a + z] is not None]
                if tried:
                    cost, audit, a = min(tried)
                    digest = self.ways[a][2].copy()
                    lines = repaired(rows, a, s["audits"][4 * a + z])
                    if lines:
                        digest.update(("\n" * (a != EMPTY) + "\n".join(lines)).encode())
                    ways[z] = cost, audit, digest
            self.ways = ways

        def row(self) -> tuple:
            cost, audit, end = min((self.ways[z][0], self.ways[z][1], z) for z in FINAL if z in self.ways)
            gaps = self.last_turn - self.first_turn + 1 - self.n_turns if self.n_turns else 0
            return self.id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, self.ways[end][2].hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, whole, done = None, None, []
        for b in batches:
            for s in b.to_pylist():
                if (s["no_id"], s["conv"]) != key:
                    if whole:
                        done.append(whole.row())
                    key = s["no_id"], s["conv"]
                    whole = Whole(key)
                whole.add(s)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
                done = []
        if whole:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*[whole.row()]), kinds)], names)

    dealt = segments.repartition("no_id", "conv").sortWithinPartitions("no_id", "conv", "part", "seq")
    schema = ", ".join(f"{c} {'string' if k == pa.string() else 'long'}" for c, k in zip(names, kinds))
    return dealt.mapInArrow(run, schema)


def repair(rows: DataFrame, every: DataFrame | None = None, costs: Costs = Costs(), most_rows: int = 512, most_chars: int = 1 << 20) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text), and of ``every`` (conv_id) if given: conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    ids = (every if every is not None else rows).select(F.col("conv_id").isNull().alias("no_id"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0).cast("long")).alias("conv")).distinct()
    placed = placed_rows(rows).withColumn("no_row", F.lit(False))
    both = placed.unionByName(ids.withColumn("no_row", F.lit(True)).withColumn("duplicate", F.lit(False)), allowMissingColumns=True)
    both = both.fillna({"no_turn": True, "at": 0, "role": "", "text": "", "times": 0})
    return _joined(settle(_segments(both, costs, most_rows, most_chars), "segments"))


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` of conversations with faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2
    takes its ends of sentences, 3 repeats it, 4 makes it the user's. Nulls are one space, but stay nulls as ids and turns."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), name("role").alias("role"), name("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")
