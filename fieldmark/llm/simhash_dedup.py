"""SimHash near-dedup by multi-index hashing.

A document's fingerprint has 64 bits: a bit is one if it is set in over half of
the XXH64 values (seed 42) of the document's word shingles, repeats included.
Documents link where their fingerprints differ in few bits.

Equal fingerprints are one from here on.  A fingerprint is cut into segments,
and each segment has a table from its value to the fingerprints at home there.
Of two fingerprints within ``distance`` bits one segment at least differs in no
more than ``distance // segments`` of its bits, so each fingerprint enumerates
that small Hamming ball around its own value, fetches what the table holds
there, and complete distances are verified.  Of two values of a ball the lower
one looks the higher one up, so no pair is fetched from both sides; look-ups
where nobody is at home are left out before they are shuffled.

A table has at most 2^22 entries whatever the input.  An entry with ``few`` at
home is one row that its visitors are joined with.  In others members are
connected in blocks, each of them compared with the entry's leader first
(:func:`fieldmark.llm.near_dedup.linked`); one that outgrows a block is cut
again by pieces of the bits outside its segment, of which one is equal in both
of a pair.  A task holds a block and its visitors, pairs are not written out
where many could be, and none is lost.

Null text, or text without words: the zero fingerprint, which is linked like
any other. Fewer words than a shingle has: the whole sequence is one. Null ids:
rows count as documents and carry links, but never name a component; one with
null ids alone has a null component. Repeated rows give repeated rows. An empty
table gives no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.components import components
from fieldmark.llm.frames import LEAST_HOT, doc_text, join_groups, maybe_in, pieces, settle
from fieldmark.llm.near_dedup import Read, Similarity, _Labels, linked
from fieldmark.llm.words import lower_words

_SLICE = 1 << 13


@dataclass(frozen=True)
class Near:
    """Links are between fingerprints that differ in ``distance`` bits or fewer."""

    width: int = 4
    seed: int = 42
    distance: int = 4
    segments: int = 3
    few: int = 32
    block: int = 20_000

    def __post_init__(self):
        if not 2 <= self.segments <= 16 or not 0 <= self.distance < 64:
            raise ValueError("from 2 to 16 segments and a distance below 64 bits")

    def cuts(self) -> list[tuple[int, int]]:
        """(lowest bit, bits) of each segment."""
        at = [64 * k // self.segments for k in range(self.segments + 1)]
        return [(a, z - a) for a, z in zip(at, at[1:])]

    def ball(self, bits: int) -> list[int]:
        """The masks of a segment's Hamming ball; the first one is zero."""
        return [sum(1 << i for i in flips) for r in range(self.distance // self.segments + 1) for flips in combinations(range(bits), r)]


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Of one text, as a signed 64-bit number."""
    words = lower_words(text)
    if not words:
        return 0
    k = min(width, len(words))
    joined = b" ".join(words)
    to = np.cumsum([len(w) + 1 for w in words])
    starts, stops = [0, *to[: len(words) - k].tolist()], (to[k - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for s in range(0, len(starts), _SLICE):
        h = np.array([xxhash.xxh64_intdigest(joined[a:z], seed) for a, z in zip(starts[s : s + _SLICE], stops[s : s + _SLICE])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """(doc_id, print) of every row; the print is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = [fingerprint(t.as_py(), how.width, how.seed) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], ["doc_id", "print"])

    return doc_text(docs).mapInArrow(run, "doc_id long, print long")


def _part(print_: Column, low: int, bits: int) -> Column:
    return F.shiftrightunsigned(print_, low).bitwiseAND(F.lit((1 << bits) - 1))


def look_ups(prints: DataFrame, how: Near) -> DataFrame:
    """(g, segment, print, own): each print where it is at home in each table (own), and the entries that it looks up."""

    def of(segment: int, low: int, bits: int) -> Column:
        value = _part(F.col("print"), low, bits)
        masks = F.array(*(F.lit(m).cast("long") for m in how.ball(bits)))
        keys = F.filter(F.transform(masks, lambda m: value.bitwiseXOR(m)), lambda k: k >= value)
        return F.transform(keys, lambda k: F.struct(F.lit(segment).alias("segment"), (k + F.lit(segment << 58)).alias("g"), (k == value).alias("own")))

    entries = [of(s, low, bits) for s, (low, bits) in enumerate(how.cuts())]
    return prints.select("print", F.explode(F.concat(*entries)).alias("e")).select("e.g", "e.segment", "print", "e.own")


def _counted(members: DataFrame) -> DataFrame:
    """(g, n, hub) of the entries with somebody at home and two members or more; the hub is the least one at home."""
    found = members.groupBy("g").agg(F.count("*").alias("n"), F.min(F.when(F.col("own"), F.col("print"))).alias("hub"))
    return found.filter("n > 1 and hub is not null")


def _near(how: Near) -> tuple[Read, Similarity]:
    def read(group: dict[str, list]) -> tuple:
        return np.array(group["print"], np.int64).view(np.uint64), np.array(group["own"], bool)

    def similar(held: tuple, i: int, others: np.ndarray, labels: _Labels) -> Iterator[int]:
        prints, own = held
        if not own[i]:  # pairs of visitors are found elsewhere
            others = others[own[others]]
        yield from others[np.bitwise_count(prints[others] ^ prints[i]) <= how.distance].tolist()

    return read, similar


def _connected(members: DataFrame, counted: DataFrame, how: Near) -> DataFrame:
    """Edges (u, v) that connect the prints of each entry as their links do."""
    sized = counted.select("g", "n", "hub", F.ceil(F.col("n") / how.block).cast("int").alias("blocks"))
    near = join_groups(members.select("g", "print", "own"), sized, ["g"])
    of, links = linked(near.select("g", "print", "own", "blocks", (F.col("print") == F.col("hub")).alias("lead")), "print", ["own"], *_near(how))
    edges = of.filter("print <> label").select(F.col("print").alias("u"), F.col("label").alias("v"))
    return edges if links is None else edges.unionByName(links)


def _cut_again(members: DataFrame, how: Near) -> DataFrame:
    """Members of large entries, dealt by each of ``distance + 1`` pieces of the bits outside the entry's segment."""
    piece = lambda low, bits: _part(F.col("print"), low, bits)
    by_segment = []
    for a, n in how.cuts():
        outside = [i for i in range(64) if not a <= i < a + n]
        each = [outside[len(outside) * k // (how.distance + 1) : len(outside) * (k + 1) // (how.distance + 1)] for k in range(how.distance + 1)]
        # A piece that lies on both sides of the segment is read as two parts.
        runs = [[(r[0], len(r)) for r in ([i for i in p if i < a], [i for i in p if i >= a + n]) if r] for p in each]
        by_segment.append(F.array(*(F.xxhash64("g", F.lit(k), *(piece(low, bits) for low, bits in r)) for k, r in enumerate(runs))))
    return members.withColumn("g", F.explode(F.element_at(F.array(*by_segment), F.col("segment") + 1)))


def _verified(members: DataFrame, small: DataFrame, how: Near) -> DataFrame:
    """Edges (u, v) of the members of entries with few at home; distances are verified within the join, so that chance
    meetings make no rows. Entries that many look up are broadcast, which there are fewer of than ``members`` has rows over
    ``LEAST_HOT``."""
    near = lambda h: (F.bit_count(F.col("print").bitwiseXOR(h)) <= how.distance) & (~F.col("own") | (h < F.col("print")))
    busy = settle(members.groupBy("g").count().filter(F.col("count") > LEAST_HOT).select(F.col("g").alias("at")), "busy")
    some, rest = small.join(F.broadcast(busy), F.col("entry") == F.col("at"), "left_semi"), small.join(F.broadcast(busy), F.col("entry") == F.col("at"), "left_anti")
    meets = (F.col("g") == F.col("entry")) & F.exists("homes", near)
    met = members.join(F.broadcast(some), meets).unionByName(members.join(F.broadcast(busy), F.col("g") == F.col("at"), "left_anti").join(rest, meets))
    return met.select(F.col("print").alias("u"), F.explode(F.filter("homes", near)).alias("v"))


def print_components(prints: DataFrame, how: Near = Near()) -> DataFrame:
    """(node, root) of every print that is linked with another; ``prints`` has one column of distinct prints."""
    every = look_ups(prints, how)
    at_home = every.filter("own")
    entries = settle(at_home.groupBy("g").agg(F.count("*").alias("n_homes")), "entries")
    few = F.col("n_homes") <= how.few
    small = at_home.join(entries.filter(few).select("g"), "g", "left_semi").groupBy(F.col("g").alias("entry")).agg(F.collect_list("print").alias("homes"))
    every = maybe_in(every, "g", entries.select("g"), "maybe").filter("maybe").drop("maybe")
    edges = _verified(every, small, how)
    large = settle(entries.filter(~few).select("g"), "large_entries")
    if not large.isEmpty():
        members = settle(every.join(large, "g", "left_semi"), "members")
        counted = settle(_counted(members), "entries")
        edges = edges.unionByName(_connected(members, counted.filter(F.col("n") <= how.block), how))
        again = counted.filter(F.col("n") > how.block).select("g")
        if not again.isEmpty():
            again = settle(_cut_again(members.join(again, "g", "left_semi"), how), "cut_again")
            edges = edges.unionByName(_connected(again, settle(_counted(again), "entries"), how))
    return components(edges)


def near_groups(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (the least id that links reach)."""
    rows = settle(fingerprints(docs, how), "prints")
    distinct = settle(rows.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct_prints")
    of = distinct.join(print_components(distinct.select("print"), how).withColumnRenamed("node", "print"), "print", "left")
    of = of.select("print", "n", "least", F.coalesce("root", "print").alias("root"))
    roots = of.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    of = settle(join_groups(of.withColumnRenamed("n", "copies"), roots, ["root"]).select("print", "component_id", F.col("copies").alias("n")), "components")
    out = join_groups(rows, of, ["print"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
