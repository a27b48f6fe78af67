"""Conversation repair against a plain dynamic program over single rows."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldmark.llm import queries, repair
from fieldmark.llm.repair import ASSISTANT, EMPTY, FINAL, STATES, SYSTEM, USER, Costs, Lattice, Row, cheapest

WHITE = " \t\n\v\f\r"


def brute(rows):
    """(counts, cost, audit, digest) of rows (turn, role, text) by trying every edit at every row."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        last = text.strip(WHITE)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
        seen.add((role, text))
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(4):  # a way has no more insertions in a row than there are states
            for q, (cost, audit, out) in list(best.items()):
                to = follow[q]
                new = cost + 2, audit + "I", out + [name[to] + ":"]
                best[to] = min(best.get(to, new), new)
        return best

    best = inserted({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults):
        after = {}

        def offer(q, new):
            after[q] = min(after.get(q, new), new)

        for q, (cost, audit, out) in best.items():
            offer(q, (cost + 3, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] in ("s", "u", "a") and (q + role[:1]) in ("s", "u", "su", "ua", "au"):
                    offer(role[:1], (cost + more, audit + "K", out + [role + ":" + text]))
                offer(follow[q], (cost + 2 + more, audit + "R", out + [name[follow[q]] + ":" + text]))
        best = inserted(after)
    cost, audit, out = min(v for q, v in best.items() if q in ("", "a"))
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    counts = [max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs)]
    return (*counts, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_small_lattices():
    rows = lambda s, text="x.": [Row(r, f"{i}{text}") for i, r in enumerate(s)]
    whole = lambda r: cheapest(Lattice(r, Costs()), EMPTY, FINAL)
    assert whole([]) == (0, "")
    assert whole(rows("suaua")) == (0, "KKKKK")
    assert whole(rows("s")) == (3, "D")
    assert whole(rows("a")) == (2, "IK")
    assert whole(rows("uua")) == (2, "KIKK")
    assert whole([Row("u", " "), Row("a", "y.")]) == (5, "DIK")
    assert whole([Row("u", "x."), Row("u", "x.", 3, True), Row("a", "y.")]) == (9, "KDDDK")
    assert cheapest(Lattice(rows("u"), Costs()), USER, (EMPTY,)) is None


@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "x", ""]), st.sampled_from(["p.", "q", " "]), st.integers(1, 3), st.booleans()), max_size=6), st.sampled_from(STATES), st.sampled_from(STATES))
@settings(max_examples=300, deadline=None)
def test_both_directions_agree(rows, start, end):
    """The meeting heaps give what one heap alone gives."""
    lattice = Lattice([Row(*r) for r in rows], Costs())
    best = {(0, start): (0, "")}
    for i in range(lattice.n + 1):
        for _ in range(4):
            for q in STATES:
                if (i, q) in best:
                    for to, cost, letters in lattice.forward(i, q):
                        new = best[i, q][0] + cost, best[i, q][1] + letters
                        best[to] = min(best.get(to, new), new)
    assert cheapest(lattice, start, (end,)) == best.get((lattice.n, end))
    assert (EMPTY, SYSTEM, USER, ASSISTANT) == STATES


ROLES, TEXTS = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No", "Why? ", "\t\n", "", None, "é!", " "]


def odd_rows():
    rows = []
    for c in [*range(1, 60), None]:
        for k in range(zlib.crc32(str(c).encode()) % 9):
            h = zlib.crc32(f"{c}/{k}".encode())
            rows.append((c, None if h % 11 == 0 else h // 7 % 6, ROLES[h // 3 % 6], TEXTS[h // 5 % 8]))
    rows += [(100, 1, "user", "Same.")] * 7 + [(100, 2, "assistant", "Fine.")] * 2 + [(100, 3, "user", "Same.")]
    return rows + [(200, i, ("user", "assistant")[i % 2], f"{i}.") for i in range(50)] + [(300, 0, "user", "long " * 60000 + ".")]


@pytest.mark.parametrize("most_rows", [2, 512])
def test_whole_conversations(spark, most_rows):
    rows = odd_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"part": F.lit(1), "times": F.lit("x"), "conv": F.lit(0)})
    every = df.select("conv_id").unionByName(spark.createDataFrame([(999,)], "conv_id long"))
    got = {r[0]: tuple(r)[1:] for r in repair.repair(df.repartition(3), every, most_rows=most_rows).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, " " if role is None else role, " " if text is None else text))
    assert got == {c: brute(r) for c, r in by.items()} | {999: brute([])}


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(df).collect() == [] and repair.damage(df).collect() == []


def test_damage_and_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    by, ids = defaultdict(list), {r.conv_id for r in rows}
    for r in rows:
        kind = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else r.text.translate({ord(c): None for c in ".!?"}) if kind == 2 else r.text
            by[r.conv_id] += [(r.turn, "user" if kind == 4 else r.role, text)] * (2 if kind == 3 else 1)
    got = {r[0]: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, sf).collect()}
    assert got == {c: brute(by[c]) for c in ids}
    odd = spark.createDataFrame([(None, None, None, None)] * 2, "conv_id long, turn long, role string, text string")
    kind = zlib.crc32(b" : ") % 20
    assert repair.damage(odd).count() == (0 if kind == 0 else 4 if kind == 3 else 2)
