"""Benchmark decontamination.

Every benchmark item is looked for in every window of a document that has the
item's number of words.  A window's SimHash fingerprint is looked up in a
multi-index of the items' fingerprints: 64 bits in 8 blocks of 8, each block a
table from its 256 values to items.  Two fingerprints within ``radius`` bits
differ by ``radius // blocks`` bits at most in some block, so looking up each
block's value and its neighbours, 37 entries of a table at radius 20, gives
all items within the radius; what is beyond it is dropped by the full
distance.  The rest is verified by the exact weighted similarity of word
shingles (weights are counts: sum of least over sum of greatest).

A window at the threshold shares most of its shingles with one item of its
size.  Windows that share too few with every such item are not fingerprinted;
none of them could be verified, so that changes no result.

Items are taken in blocks of ``block_items`` items and ``block_chars``
characters, one after another: a block is broadcast, its results are settled,
and the broadcast is destroyed, so that what the driver and a worker hold has
a bound whatever the size of the benchmark.  Documents are read once a block
and are not shuffled.  At similarity 0.8 two fingerprints differ by 9.7 of 64
bits on average with deviation 2.9; the default radius is 3.6 deviations
beyond.

Words are lower-cased, and ASCII punctuation counts as white space. Null or
empty texts and items have no windows; empty tables give no rows. A document
shorter than an item is one window. Items with fewer words than a shingle are
one shingle. Repeated rows give repeated results; of equally similar windows
the first is reported. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.frames import doc_text, pieces, settle
from fieldmark.llm.words import WordHashes, mixed, shingle_hashes

_SPACED = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))
_BITS = np.arange(64, dtype=np.uint64)


@dataclass(frozen=True)
class Match:
    width: int = 5
    percent: int = 80
    radius: int = 20
    blocks: int = 8
    block_items: int = 20_000
    block_chars: int = 32 << 20


def plain_words(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_SPACED).split() if text else []


def simhash(shingles: np.ndarray) -> np.uint64:
    """Bit i is set where more shingles, with their repetitions, have it than not."""
    ones = (shingles[:, None] >> _BITS & np.uint64(1)).sum(0)
    return np.bitwise_or.reduce((2 * ones > len(shingles)).astype(np.uint64) << _BITS)


def weighted_similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


class Fingerprints:
    """Multi-index of fingerprints: for each block of their bits, where each value stands."""

    def __init__(self, prints: np.ndarray, radius: int, blocks: int):
        self.prints, self.radius, bits = prints, radius, 64 // blocks
        self.shift, self.low, size = np.arange(blocks, dtype=np.uint64) * np.uint64(bits), np.uint64(2**bits - 1), 2**bits
        self.first = np.arange(blocks)[:, None] * size  # of each block's table
        self.flips = np.array([sum(1 << i for i in f) for n in range(radius // blocks + 1) for f in combinations(range(bits), n)])
        values = (prints[:, None] >> self.shift & self.low).astype(np.int64) + self.first.T
        order = np.argsort(values.T.reshape(-1), kind="stable")
        self.item = order % max(1, len(prints))
        self.starts = np.searchsorted(values.T.reshape(-1)[order], np.arange(blocks * size + 1))

    def within(self, x: np.uint64) -> np.ndarray:
        """Numbers of all fingerprints within the radius of ``x``."""
        entries = (((x >> self.shift & self.low).astype(np.int64)[:, None] ^ self.flips) + self.first).reshape(-1)
        start = self.starts[entries]
        n = self.starts[entries + 1] - start
        start, n = start[n > 0], n[n > 0]
        rows = np.unique(self.item[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        return rows[np.bitwise_count(self.prints[rows] ^ x) <= self.radius]


class Items:
    """A block of benchmark items, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]], how: Match):
        self.how, self.vocabulary = how, {}
        hashes, grams = WordHashes(), defaultdict(list)
        by_size: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        self.length: list[int] = []
        for item_id, text in items:
            if words := plain_words(text):
                ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64)
                k = min(how.width, len(words))
                key = np.unique(_gram_keys(ids, k))
                grams[k].append((key, np.full(len(key), len(self.length))))
                self.length.append(len(words))
                by_size[len(words)].append((item_id, shingle_hashes(hashes.of(words), how.width)))
        self.grams = {}  # shingles of each width in order, and the item that each is of
        for k, v in grams.items():
            key, item = np.concatenate([x for x, _ in v]), np.concatenate([x for _, x in v])
            order = np.argsort(key, kind="stable")
            self.grams[k] = key[order], item[order]
        self.sizes = {
            n: ([i for i, _ in v], [Counter(s.tolist()) for _, s in v], Fingerprints(np.array([simhash(s) for _, s in v]), how.radius, how.blocks))
            for n, v in sorted(by_size.items())
        }

    def found_in(self, text: str | None, hashes: WordHashes) -> list[tuple[int, float, int, int]]:
        """(item_id, similarity, first word, words) of the best window of each item found in ``text``."""
        words = plain_words(text)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        windows: dict[int, set[int]] = defaultdict(set)
        for k, (known, item) in self.grams.items():
            if len(ids) >= k:
                inside = np.ones(len(ids) - k + 1, bool)
                for j in range(k):
                    inside &= ids[j : len(ids) - k + 1 + j] >= 0
                at = np.flatnonzero(inside)
                key = _gram_keys(ids, k, at)
                low = np.searchsorted(known, key)
                hit = known[np.minimum(low, len(known) - 1)] == key
                at, low = at[hit], low[hit]
                n = np.searchsorted(known, key[hit], "right") - low
                place = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                self._windows(len(words), k, np.repeat(at, n), item[place], windows)
        best: dict[int, tuple[float, int, int]] = {}
        for n, starts in sorted(windows.items()):
            names, counts, prints = self.sizes[n]
            size = min(n, len(words))
            for p in sorted(starts):
                shingles = shingle_hashes(hashes.of(words[p : p + size]), self.how.width)
                own = None
                for i in prints.within(simhash(shingles)).tolist():
                    own = own or Counter(shingles.tolist())
                    t = weighted_similarity(own, counts[i])
                    if 100 * t >= self.how.percent - 1e-9 and t > best.get(names[i], (0.0,))[0]:
                        best[names[i]] = (t, p, size)
        return [(i, *b) for i, b in sorted(best.items(), key=lambda x: (x[0] is None, x[0] or 0))]

    def _windows(self, n_words: int, k: int, at: np.ndarray, item: np.ndarray, out: dict[int, set[int]]) -> None:
        """Adds the starts of windows that share enough shingles of width ``k`` with an item of their size; ``at`` and
        ``item`` say where the shingles of which items are."""
        if not len(at):
            return
        order = np.lexsort((at, item))
        at, item = at[order], item[order]
        for group in np.split(np.arange(len(at)), np.flatnonzero(np.diff(item)) + 1):
            n = self.length[item[group[0]]]
            size = min(n, n_words)
            # similarity t needs t / (1 + t) of the shingles of both together
            least = self.how.percent * (size + n - 2 * k + 2) / (100 + self.how.percent) - 1e-9
            if len(group) >= least:
                first, last = max(0, int(at[group[0]]) - (size - k)), min(n_words - size, int(at[group[-1]]))
                starts = np.arange(first, last + 1)
                place = at[group]
                shared = np.searchsorted(place, starts + size - k, "right") - np.searchsorted(place, starts)
                out[n].update(starts[shared >= least].tolist())


def _gram_keys(ids: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    at = np.arange(len(ids) - k + 1) if at is None else at
    key = np.zeros(len(at), np.uint64)
    for j in range(k):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + ids[at + j].astype(np.uint64) + np.uint64(1))
    return key


def item_blocks(benchmark: DataFrame, how: Match) -> Iterator[Items]:
    """The benchmark in blocks that are each small enough to broadcast, one at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // how.block_items), -(-chars // how.block_chars))
    deal = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        yield Items([tuple(r) for r in rows.filter(deal == k).collect()], how)  # a block is bounded


def _by_block(benchmark: DataFrame, how: Match, found: Callable[[Broadcast], DataFrame]) -> Iterator[DataFrame]:
    """What ``found`` makes of each block. All but the last are settled, and their broadcasts destroyed."""
    shared = part = None
    for items in item_blocks(benchmark, how):
        if shared is not None:
            yield settle(part, "block")
            shared.destroy()
        shared = benchmark.sparkSession.sparkContext.broadcast(items)
        part = found(shared)
    yield part


def contaminations(docs: DataFrame, benchmark: DataFrame, how: Match = Match()) -> DataFrame:
    """doc_id, item_id, similarity, first_word and n_words of the best window, for each item in each row of ``docs``."""

    def found(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            names, kinds = ["doc_id", "item_id", "similarity", "first_word", "n_words"], [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            for b in pieces(batches):
                rows = [(d, *hit) for d, t in zip(b.column(0).to_pylist(), b.column(1)) for hit in shared.value.found_in(t.as_py(), hashes)]
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        return doc_text(docs).mapInArrow(run, "doc_id long, item_id long, similarity double, first_word long, n_words long")

    return reduce(DataFrame.unionByName, _by_block(benchmark, how, found))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, how: Match = Match()) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found."""
    left = docs

    def found(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for b in pieces(batches):
                yield b.filter(pa.array([not shared.value.found_in(t.as_py(), hashes) for t in b.column("text")], pa.bool_()))

        return left.mapInArrow(run, docs.schema)

    for part in _by_block(benchmark, how, found):
        left = part  # what the block leaves is looked through for the next one
    return left
