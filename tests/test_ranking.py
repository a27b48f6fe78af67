"""Ranks over range partitions against sorting."""

import random

from pyspark.sql import functions as F

from fieldmark.functions.ranking import ordinals, tie_ranks


def test_ranks(spark):
    """One huge group with many ties over several partitions, a small one, null groups and values, clashing names."""
    rnd = random.Random(2)
    rows = [("a", i, None if i % 50 == 0 else float(rnd.randrange(40) if i % 2 else rnd.random() * 40), 7) for i in range(900)] + [(None, 1000 + i, 1.0, 7) for i in range(3)] + [("b", 2000, 3.0, 7)]
    df = spark.createDataFrame(rows, "g string, id long, v double, range_part int").repartition(5)
    for down in (True, False):
        got = {r.id: (r.rank, r.rank_ties, r.range_part) for r in tie_ranks(df, ["g"], "v", "rank", down).collect()}
        last = lambda v: (v is None, (-v if down else v) if v is not None else 0)
        assert got == {i: (1 + sum(h == g and last(w) < last(v) for h, _, w, _ in rows), sum(h == g and w == v for h, _, w, _ in rows), 7) for g, i, v, _ in rows}
    order = {r.id: r.n for r in ordinals(df, ["g"], [F.desc_nulls_last("v"), F.asc("id")], "n").collect()}
    for g in ("a", "b", None):
        own = sorted((v is None, -(v or 0), i) for h, i, v, _ in rows if h == g)
        assert [order[i] for *_, i in own] == list(range(1, len(own) + 1))


def test_no_rows(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert tie_ranks(none, ["g"], "v", "r").count() == ordinals(none, ["g"], [F.asc("v")], "n").count() == 0
