"""SimHash near-dedup against fingerprints and links by definition."""

import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldmark.llm import queries, simhash_dedup
from fieldmark.llm.frames import table
from fieldmark.llm.simhash_dedup import Near
from fieldmark.llm.words import lower_words


def plain_print(text, width=4):
    words = [w.decode() for w in lower_words(text)]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(rows, distance=4):
    """Sorted (doc_id, fingerprint, component) by comparing all fingerprints."""
    prints = [plain_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    return sorted(((d, f"{p:016x}", least.get(g)) for (d, _), p, g in zip(rows, prints, group)), key=repr)


@given(st.text(alphabet="Ab é\n ", max_size=40))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash_dedup.fingerprint(text) % 2**64 == plain_print(text)


def test_long_text():
    text = " ".join(random.Random(3).choices(["a", "b", "cc", "d"], k=20000))
    assert simhash_dedup.fingerprint(text) % 2**64 == plain_print(text)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = sorted(map(tuple, queries.op13_simhash_dedup(spark, sf).collect()), key=repr)
    assert got == plain_groups(rows)


ODD = [(None, "a b c d e"), (5, "a b c d e"), (None, "only null ids here or so"), (9, None), (8, " \n"), (7, "A B"), (6, "a b"), (6, "a b"), (4, "x y z w v")]


def test_odd_rows(spark):
    text = "the quick brown fox jumps over a lazy dog and goes home again to sleep for one more night in its den " * 8
    rows = ODD + [(100 + i, text + " tail" * (i % 3)) for i in range(6)] + [(200, text.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"print": F.lit("x"), "G": F.lit(0), "n": F.lit(1), "root": F.lit(2)})
    assert sorted(map(tuple, simhash_dedup.near_groups(df).collect()), key=repr) == plain_groups(rows)


def test_empty(spark):
    assert simhash_dedup.near_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def near_prints(seed, n=900):
    """Fingerprints in chains of small steps, many of which share a segment's value."""
    rng = random.Random(seed)
    found = [rng.getrandbits(64) for _ in range(6)]
    while len(found) < n:
        found.append(rng.choice(found[-200:]) ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5, 6, 7]))))
    return sorted({p - 2**64 if p >= 2**63 else p for p in found})


def roots(prints, distance):
    of = {p: p for p in prints}

    def find(p):
        while of[p] != p:
            p = of[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if ((p ^ q) % 2**64).bit_count() <= distance:
                a, b = sorted((find(p), find(q)))
                of[b] = a
    return {p: find(p) for p in prints if any(p != q and find(p) == find(q) for q in prints)}


@pytest.mark.parametrize("how", [Near(), Near(few=1, block=5), Near(segments=2, few=2), Near(segments=5, few=4, block=40), Near(distance=2)])
def test_no_link_is_lost(spark, how):
    """Small blocks send entries through the second cut, leaders and visits."""
    prints = near_prints(11, 400)
    got = simhash_dedup.print_components(spark.createDataFrame([(p,) for p in prints], "print long"), how)
    assert {r.node: r.root for r in got.collect()} == roots(prints, how.distance)
