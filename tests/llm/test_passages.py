"""Repeated passages against brute force over all windows."""

import random
import re
from collections import Counter

import pytest

from fieldmark.llm import passage_dedup, substring_dedup
from fieldmark.llm.frames import table


def brute(rows, width):
    """Spans to remove of each row, by looking at every window."""
    texts = sorted({(2**63 - 1 if i is None else i, passage_dedup.xxhash.xxh3_64_intdigest(t or ""), t or "") for i, t in rows})
    first, words = {}, {}
    for place, (rank, _, text) in enumerate(texts):
        words[(rank, text)] = place, list(re.finditer(r"[^\x20\x09-\x0D]+", text))
        low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[0]) for m in words[(rank, text)][1]]
        for i in range(len(low) - width + 1):
            first.setdefault(tuple(low[i : i + width]), (place, i))
    out = []
    for doc_id, text in rows:
        place, found = words[(2**63 - 1 if doc_id is None else doc_id, text or "")]
        low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[0]) for m in found]
        gone = sorted({j for i in range(len(low) - width + 1) if first[tuple(low[i : i + width])] != (place, i) for j in range(i, i + width)})
        spans = []
        for j in gone:
            if spans and spans[-1][2] == j - 1:
                spans[-1][1:] = [found[j].end(), j]
            else:
                spans.append([found[j].start(), found[j].end(), j])
        out.append((doc_id, len(low), len(spans), len(gone), tuple((a, b) for a, b, _ in spans)))
    return Counter(out)


def told(rows):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.n_removed_words, tuple(map(tuple, r.removed))) for r in rows.collect())


def test_passage_in_mid_line(spark):
    """54 words that start and end inside lines, broken differently; no line repeats."""
    p = [f"é{i}" for i in range(54)]
    one, two = "one " + " ".join(p) + " end one", "Two\nbefore " + " ".join(p[:20]).upper().replace("É", "é") + "\n" + "  ".join(p[20:]) + " after two"
    rows = [(1, one), (2, two), (3, " ".join(p[:49])), (4, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(r.n_removed for r in substring_dedup.repeated_units(d, "line", run_words=0).collect()) == 0
    got = passage_dedup.repeated_passages(d)
    assert told(got) == brute(rows, 50)
    assert {r.doc_id: r.n_removed_words for r in got.collect()} == {1: 0, 2: 54, 3: 0, 4: 0}
    assert {r.doc_id: r.text for r in substring_dedup.without(d, got).collect()} == {1: one, 2: "Two\nbefore  after two", 3: rows[2][1], 4: None}
    assert passage_dedup.repeated_passages(d.limit(0)).count() == 0


@pytest.mark.parametrize("width", [2, 5, 8])
@pytest.mark.parametrize("how", [{}, {"chunk_chars": 40, "bits": 1 << 15}])
def test_brute(spark, width, how):
    rnd = random.Random(width)
    rows = [(rnd.choice([None, *range(30)]), rnd.choice(" \n").join(rnd.choice(["a", "B", "b", "ü", "cc"]) for _ in range(rnd.randrange(40)))) for _ in range(60)]
    rows += rows[:3] + [(100, "a b " * 20), (7, "a b " * 20), (8, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert told(passage_dedup.repeated_passages(d, width, **how)) == brute(rows, width)


def brute_runs(rows, run_words):
    """Spans of clauses to remove of each row, by looking at every run."""
    texts = sorted({(2**63 - 1 if i is None else i, substring_dedup.xxhash.xxh3_64_intdigest(t or ""), t or "") for i, t in rows})
    first, held = {}, {}
    for place, (rank, _, text) in enumerate(texts):
        units = [(m.start(), m.end(), m[0].lower().split()) for m in re.finditer(r"[^\n.!?,;:]+[.!?,;:]*", text)]
        units, runs = [u for u in units if u[2]], []
        for i in range(len(units)):
            j, words = i, []
            while len(words) < run_words and j < len(units):
                words += units[j][2]
                j += 1
            if len(words) >= run_words:
                runs.append((i, j, tuple(words)))
                first.setdefault(tuple(words), (place, i))
        held[rank, text] = place, units, runs
    out = []
    for doc_id, text in rows:
        place, units, runs = held[2**63 - 1 if doc_id is None else doc_id, text or ""]
        gone = sorted({k for i, j, words in runs if first[words] != (place, i) for k in range(i, j)})
        spans = []
        for k in gone:
            if spans and spans[-1][2] == k - 1:
                spans[-1][1:] = [units[k][1], k]
            else:
                spans.append([*units[k][:2], k])
        out.append((doc_id, len(units), len(gone), sum(len(units[k][2]) for k in gone), tuple((a, b) for a, b, _ in spans)))
    return Counter(out)


def told_runs(rows):
    return Counter((r.doc_id, r.n_units, r.n_removed, r.n_removed_words, tuple(map(tuple, r.removed))) for r in rows.collect())


@pytest.mark.parametrize("width", [1, 3, 6])
@pytest.mark.parametrize("how", [{}, {"chunk_chars": 40}])
def test_clause_runs_brute(spark, width, how):
    rnd = random.Random(width)
    rows = [(rnd.choice([None, *range(30)]), "".join(rnd.choice(["a", "B", "b", "ü", "cc"]) + rnd.choice([" ", " ", "\n", ". ", ",", "!? "]) for _ in range(rnd.randrange(40)))) for _ in range(60)]
    rows += [(rnd.randrange(200, 900), rnd.choice(["x", "y", "z. "]) * 3 + " q,") for _ in range(300)]
    rows += rows[:3] + [(100, "a b, " * 20), (7, "a b, " * 20), (8, None), (9, " ,.\n"), (10, "long, text. " * 20_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert told_runs(substring_dedup.repeated_units(d, run_words=width, **how)) == brute_runs(rows, width)


def test_clauses_of_a_passage_in_mid_line(spark):
    """A passage of 54 words within lines, of which no whole line repeats, is removed but for its broken ends."""
    p = " ".join(f"w{i}" + ("," if i % 6 == 2 else "." if i % 11 == 5 else "") for i in range(54))
    rows = [(2, f"one {p} end. Other words. Then"), (1, f"Two before {p} after two."), (3, " ".join(p.split()[:29])), (None, None), (4, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS mark", "3 AS own", "4 AS removed", "5 AS bit_map")
    got = substring_dedup.repeated_units(d)
    assert told_runs(got) == brute_runs(rows, 30)
    removed = {r.doc_id: r.n_removed_words for r in got.collect()}
    assert removed[2] > 40 and not any(n for i, n in removed.items() if i != 2)
    out = {r.doc_id: r for r in substring_dedup.without(d, got).collect()}
    assert out[2].asDict() | {"text": 0} == {"doc_id": 2, "text": 0, "id": 1, "mark": 2, "own": 3, "removed": 4, "bit_map": 5}
    assert {i: r.text for i, r in out.items() if i != 2} == {i: t for i, t in rows if i != 2} and out[2].text.startswith("one w0 w1 w2,")
    assert substring_dedup.repeated_units(d.limit(0)).count() == 0 and substring_dedup.without(d.limit(0), got).count() == 0


def test_clauses_find_passages(spark):
    """Documents that repeat 50 words of an earlier one are found, and few others that have no 50 words twice."""
    d = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    first, across, any_ = {}, set(), set()
    for doc_id, text in sorted((tuple(r) for r in d.collect()), key=lambda r: r[0]):
        words = (text or "").lower().split()
        for i in range(len(words) - 49):
            other = first.setdefault(tuple(words[i : i + 50]), (doc_id, i))
            if other != (doc_id, i):
                any_.add(doc_id)
                if other[0] != doc_id:
                    across.add(doc_id)
    found = {r.doc_id for r in substring_dedup.repeated_units(d).collect() if r.n_removed}
    assert len(across) > 20 and len(across & found) >= 0.98 * len(across) and len(found - any_) <= 0.03 * d.count()


def test_whole_table(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    want = brute([tuple(r) for r in d.collect()], 50)
    assert sum(c for k, c in want.items() if k[2]) > 5
    assert told(passage_dedup.repeated_passages(d)) == want
