"""Alignment of two tokenizers' ids by bytes, with white-space anchors.

Texts are tokenised whole by both tokenizers.  Where a token of each begins
with a space at the same byte, what is before it ends together; these verified
shared ends are anchors, which split a document into windows of token ids, a
word or so each.  A window's alignment (groups between shared byte ends, and
the pair of ids that ends each group) depends on its ids alone and is memoised
by both id tuples; windows that are new in a batch are aligned together, by
looking up the byte ends of each side among those of the other.

A chunk is a run of documents of one task up to ``chunk_chars`` characters.  It
writes its documents with packed numbers of their pairs, and its distinct pairs
with counts.  The counts are summed over the corpus in a table of one row a
pair of ids, and return to the chunks by a join on the pair; a pair is in a
chunk once, so even the commonest pair has a row a chunk and no more.  A chunk
and what returns to it are put together in one bounded task.

Tokenising whole texts is exact and yet done once for each distinct word that a
worker remembers, and so is finding its windows: a word ends before a space that
follows something other than white space.  There the byte-level tokenizer always
ends a pre-token, and the piece model never joins, which is verified when it is
read.  New words go to the libraries many at once.  A text with a word whose
tokens differ from its bytes is tokenised and aligned as a whole.

Null or empty texts, and texts whose joined token bytes differ from a space and
the text (those with U+2581, which the model takes for a space): no tokens,
zeros, and an empty ``groups_sha256``. Repeated rows give repeated rows; null ids stay. No rows: no rows. Other columns are not looked at.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm import pretokens
from fieldmark.llm import vocabularies as V
from fieldmark.llm.distinct_words import packed, unpacked
from fieldmark.llm.frames import doc_text, give_back, settle

CHUNK_CHARS = 8 << 20
_MOST_WORDS, _MOST_KEPT = 500_000, 8 << 20  # that a worker keeps from task to task: words, and characters of them
_TOGETHER = 4096  # characters of words that go to a library as one text
_B_BITS = 24  # an id of B takes the low bits of a pair
_CUT = re.compile(r"(?<=\S)(?= )")
_WHITE = [chr(i) for i in range(0x3001) if chr(i).isspace()]
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))


def byte_level_bytes(entry: str) -> bytes:
    """The bytes of an entry of a byte-level vocabulary, in which printable bytes stand for themselves and the others, in
    order, for the characters from U+0100."""
    return bytes(map(_byte_of().__getitem__, entry))


@lru_cache(1)
def _byte_of() -> dict[str, int]:
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def piece_bytes(piece: str) -> bytes:
    """The bytes of an entry of a piece vocabulary with byte fallback."""
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def cut(text: str) -> list[str]:
    """The words of a text that begins with a space, each without the space before it.

    A word ends before a space that follows something other than white space; neither tokenizer joins what is before
    such a space with what is after it, or looks beyond it."""
    if any(f"{c} " in text for c in _WHITE):
        return [w[1:] for w in _CUT.split(text)]
    return text[1:].split(" ")


class _Slots(dict):
    """Numbers things in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        found = self[word] = len(self)
        return found


class _Ids:
    """Ids of texts by one tokenizer."""

    def __init__(self, table: list[bytes]):
        self.table = table
        self.length = np.array([len(t) for t in table], np.int64)
        self.marked = np.array([t.startswith(b" ") for t in table], bool)
        # Digits, zeros, and in the last of eight bytes what follows.
        self.digits = np.array([str(i).encode() for i in range(len(table))], "S8").view("<u8")

    def flat_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids in order, whether the bytes of a text's ids are the text's).

        Texts begin with a space; those that end like a word go to the library together and are told apart by bytes."""
        ends_word = [not t[-1].isspace() for t in texts]
        words = [k for k, e in enumerate(ends_word) if e]
        groups = [[words[i] for i in rows] for rows in pretokens.batches_of([texts[k] for k in words], _TOGETHER)]
        groups += [[k] for k, e in enumerate(ends_word) if not e]
        size, exact = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        order, parts = [], []
        while groups:
            apart = []
            for group, ids in zip(groups, self.encode(["".join([texts[k] for k in g]) for g in groups])):
                raw = [texts[k].encode() for k in group]
                found, through = np.array(ids, np.int64), np.cumsum([len(r) for r in raw])
                same = b"".join(map(self.table.__getitem__, ids)) == b"".join(raw)
                if len(group) > 1:
                    ends = np.cumsum(self.length[found])
                    last = np.searchsorted(ends, through)
                    if not same or not np.array_equal(ends[last], through):
                        apart += [[k] for k in group]
                        continue
                    size[group] = np.diff(last, prepend=-1)
                else:
                    size[group] = len(ids)
                exact[group] = same
                order += group
                parts.append(found)
            groups = apart
        flat, own = np.concatenate([*parts, np.zeros(0, np.int64)]), np.array(order, np.int64)
        start = np.zeros(len(texts), np.int64)
        start[own] = np.cumsum(size[own]) - size[own]
        return size, V.gathered(np.arange(len(texts)), start, size, flat), exact

    def of(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, and whether their bytes are the text's."""
        size, flat, exact = self.flat_of(texts)
        return np.split(flat, np.cumsum(size)[:-1]), exact.tolist()


class _ByteLevel(_Ids):
    def __init__(self, path: str):
        self.path = path
        names = V.library_tokenizer(path).get_vocab()
        special = V.special_string(path)
        table = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            table[i] = name.encode() if name == special else byte_level_bytes(name)
        super().__init__(table)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in V.library_tokenizer(self.path, True).encode_batch_fast(texts, add_special_tokens=False)]


class _Pieces(_Ids):
    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in names):
            raise ValueError(f"{path} has pieces with a space inside; its texts cannot be encoded word by word")
        self.space = self.model.piece_to_id("▁")
        super().__init__([piece_bytes(p) for p in names])

    def encode(self, texts: list[str]) -> list[list[int]]:
        # The model adds the first space itself, but not to an empty text.
        return [i if t != " " else [self.space] for t, i in zip(texts, self.model.encode([t[1:] for t in texts], num_threads=1))] if texts else []


@lru_cache(2)
def byte_level(path: str) -> _ByteLevel:
    return _ByteLevel(path)


@lru_cache(2)
def piece_model(path: str) -> _Pieces:
    return _Pieces(path)


class _Memo:
    """Alignments of windows by their id tuples: group texts and pairs of each slot; and windows of words."""

    def __init__(self, one: _Ids, two: _Ids):
        self.one, self.two = one, two
        self.random = np.random.default_rng(12).integers(1, 2**63, len(one.table) + len(two.table), np.uint64)
        self.forget()

    def forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.slot: dict[bytes, int] = {}
        self.text: list[bytes] = []
        self.n = self.pairs = none  # groups of each slot, and pairs of all slots, one after another
        self.words, self.chars = _Slots(), 0
        self.n_a = self.n_b = self.n_windows = self.windows = none  # of each word; windows of all words, one after another
        self.exact = np.zeros(0, bool)

    def trim(self) -> None:
        if len(self.words) > _MOST_WORDS or self.chars > _MOST_KEPT:
            self.forget()

    def add(self, keys: list[bytes], a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> None:
        """Windows that are not known yet, all at once; a group ends where tokens of both end."""
        ends_a, ends_b = np.cumsum(self.one.length[a]), np.cumsum(self.two.length[b])
        at_a, at_b = np.zeros((2, int(ends_a[-1]) + 1), bool)
        at_a[ends_a] = at_b[ends_b] = True
        last_a, last_b = at_b[ends_a], at_a[ends_b]
        to_a, to_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        in_a, in_b = np.diff(to_a, prepend=-1), np.diff(to_b, prepend=-1)
        # A group's ids of A, its ids of B, the next group: each as digits, zeros and what follows.
        written = np.empty(len(a) + len(b), "<u8")
        place_a, place_b = np.arange(len(a)) + np.repeat(np.cumsum(in_b) - in_b, in_a), np.arange(len(b)) + np.repeat(np.cumsum(in_a), in_b)
        for place, ids, last, own, sign in ((place_a, a, last_a, self.one, "|"), (place_b, b, last_b, self.two, ";")):
            written[place] = own.digits[ids] | np.where(last, np.uint64(ord(sign)), np.uint64(ord(","))) << np.uint64(56)
        through_a, through_b = np.cumsum(size_a), np.cumsum(size_b)
        ends = np.cumsum(np.count_nonzero(written.view(np.uint8).reshape(-1, 8), axis=1))[through_a + through_b - 1].tolist()
        text = written.tobytes().translate(None, b"\0")
        self.slot.update(zip(keys, range(len(self.text), len(self.text) + len(keys))))
        self.text += [text[p : q - 1] for p, q in zip([0, *ends], ends)]
        self.n = np.concatenate([self.n, np.diff(np.cumsum(last_a)[through_a - 1], prepend=0)])
        self.pairs = np.concatenate([self.pairs, a[to_a] << _B_BITS | b[to_b]])

    def slots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of words of each text, slots of all words in order); texts begin with a space."""
        before, get, n, found = len(self.words), self.words.__getitem__, [], []
        for t in texts:
            words = cut(t)
            n.append(len(words))
            found.extend(map(get, words))
        new = [" " + w for w in islice(self.words, before, None)]
        if new:
            self.chars += sum(map(len, new))
            (n_a, a, same_a), (n_b, b, same_b) = self.one.flat_of(new), self.two.flat_of(new)
            good = same_a & same_b
            n_windows = np.zeros(len(new), np.int64)
            n_windows[good], windows = flat_windows(a[np.repeat(good, n_a)], n_a[good], b[np.repeat(good, n_b)], n_b[good], self)
            for name, more in (("n_a", n_a), ("n_b", n_b), ("n_windows", n_windows), ("windows", windows), ("exact", good)):
                setattr(self, name, np.concatenate([getattr(self, name), more]))
        return np.array(n, np.int64), np.array(found, np.int64)

    def aligned(self, texts: list[str]) -> list[tuple[int, int, np.ndarray] | None]:
        """(n_a, n_b, windows) of each text, which begins with a space; None where ids do not give the text's bytes."""
        n, words = self.slots(texts)
        start = np.cumsum(self.n_windows) - self.n_windows
        windows = V.gathered(words, start, self.n_windows, self.windows)
        sums = [np.concatenate([[0], np.cumsum(x[words])]) for x in (self.n_a, self.n_b, self.n_windows, ~self.exact)]
        to = np.cumsum(n)
        n_a, n_b, _, odd = (s[to] - s[to - n] for s in sums)
        own = np.split(windows, sums[2][to][:-1])
        out: list[tuple[int, int, np.ndarray] | None] = list(zip(n_a.tolist(), n_b.tolist(), own))
        for k in np.flatnonzero(odd).tolist():  # words differ from their bytes; does the text as a whole?
            self.chars += len(texts[k])
            (a, same_a), (b, same_b) = self.one.of([texts[k]]), self.two.of([texts[k]])
            out[k] = (len(a[0]), len(b[0]), window_slots(a, b, self)[0]) if same_a[0] and same_b[0] else None
        return out


@lru_cache(2)
def _memo(path_a: str, path_b: str) -> _Memo:
    return _Memo(byte_level(path_a), piece_model(path_b))


def flat_windows(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, memo: _Memo) -> tuple[np.ndarray, np.ndarray]:
    """(number of windows of each text, the memo's slots of all windows in order) of texts with so many ids each."""
    if not len(n_a):
        return n_a, n_a
    begin_a, begin_b = (np.cumsum(t.length[x]) - t.length[x] for t, x in ((memo.one, a), (memo.two, b)))
    # A text is written with a space before it, so each begins with an anchor.
    space_a, space_b = np.flatnonzero(memo.one.marked[a]), np.flatnonzero(memo.two.marked[b])
    at_a, at_b = np.zeros((2, max(int(begin_a[-1]), int(begin_b[-1])) + 1), bool)
    at_a[begin_a[space_a]] = at_b[begin_b[space_b]] = True
    start_a, start_b = space_a[at_b[begin_a[space_a]]], space_b[at_a[begin_b[space_b]]]
    size_a, size_b = np.diff(start_a, append=len(a)), np.diff(start_b, append=len(b))
    # Each window's ids of A and then of B, told apart by their numbers.
    both, size = np.empty(len(a) + len(b), np.int32), size_a + size_b
    start = start_a + start_b
    both[np.arange(len(a)) + np.repeat(start_b, size_a)] = a
    both[np.arange(len(b)) + np.repeat(start_a + size_a, size_b)] = b + len(memo.one.table)
    inside = np.arange(len(both)) - np.repeat(start, size)
    hashed = np.add.reduceat(memo.random[both] * _POWERS[inside & 4095], start) ^ (size.astype(np.uint64) << np.uint64(40))
    _, chosen, inverse = np.unique(hashed, return_index=True, return_inverse=True)
    same = chosen[inverse]
    if not np.array_equal(size[same], size) or not np.array_equal(both[np.repeat(start[same], size) + inside], both):  # two windows share a hash
        chosen = inverse = np.arange(len(start))
    raw, wide = both.tobytes(), both.itemsize
    keys = [raw[p:q] for p, q in zip((start[chosen] * wide).tolist(), ((start + size)[chosen] * wide).tolist())]
    first = {key: k for key, k in zip(keys, chosen.tolist()) if key not in memo.slot}
    if first:
        new = np.fromiter(first.values(), np.int64, len(first))
        memo.add(list(first), V.gathered(new, start_a, size_a, a), size_a[new], V.gathered(new, start_b, size_b, b), size_b[new])
    slots = np.fromiter(map(memo.slot.__getitem__, keys), np.int64, len(keys))[inverse]
    return np.diff(np.searchsorted(start_a, np.cumsum(n_a)), prepend=0), slots


def window_slots(ids_a: list[np.ndarray], ids_b: list[np.ndarray], memo: _Memo) -> list[np.ndarray]:
    """For each text the memo's slots of its windows, in order; all texts have tokens."""
    n, slots = flat_windows(*(x for ids in (ids_a, ids_b) for x in (np.concatenate(ids), np.array([len(i) for i in ids], np.int64))), memo)
    return np.split(slots, np.cumsum(n)[:-1])


_ALIGNED = (
    "chunk long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "sizes binary, pair_slots binary, pair_times binary, pairs array<long>, totals array<long>"
)


def aligned(docs: DataFrame, path_a: str = V.BYTE_BPE_JSON, path_b: str = V.PIECE_BPE, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """A row for each chunk: its documents, the pairs of each packed as (place in ``pairs``, times), and its distinct pairs
    with how often they are linked in it."""
    longs = pa.list_(pa.int64())
    names = [c.split()[0] for c in _ALIGNED.split(", ")]
    kinds = [pa.int64(), *[longs] * 5, pa.list_(pa.string()), *[pa.binary()] * 3, longs, longs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # what is kept holds no cycles, and looking for them takes a tenth of the time
        memo, number, chars, parts = _memo(path_a, path_b), 0, 0, []

        def finished() -> pa.RecordBatch:
            held = np.zeros(len(memo.n), bool)
            for *_, windows in parts:
                held[windows] = True
            used, place_of = np.flatnonzero(held), np.cumsum(held) - 1
            size = memo.n[used]
            pairs, place = np.unique(V.gathered(used, np.cumsum(memo.n) - memo.n, memo.n, memo.pairs), return_inverse=True)
            start, total = np.cumsum(size) - size, np.zeros(len(pairs), np.int64)
            sizes, slots, times = [], [pairs[:0]], [pairs[:0]]
            for _, _, _, links, _, windows in parts:
                found = V.gathered(place_of[windows], start, size, place)
                total += np.bincount(found, minlength=len(pairs))
                found, n = np.unique(np.repeat(np.arange(len(links)) * len(pairs), links) + found, return_counts=True)
                doc, found = np.divmod(found, max(1, len(pairs)))
                sizes.append(np.bincount(doc, minlength=len(links)))
                slots.append(found)
                times.append(n)
            ids, n_a, n_b, links, texts = ([v for p in parts for v in p[c]] for c in range(5))
            chunk = TaskContext.get().partitionId() << 32 | number
            row = [chunk, ids, n_a, n_b, links, links, texts, *(packed(np.concatenate(x)) for x in (sizes, slots, times)), pairs.tolist(), total.tolist()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [" " + t if t else "" for t in batch.column(1).to_pylist()]
            for rows in pretokens.batches_of(texts, 2 << 20):
                full = [i for i in rows if texts[i]]
                found = dict(zip(full, memo.aligned([texts[i] for i in full]))) if full else {}
                n_a, n_b, links, digests, windows = [], [], [], [], [np.zeros(0, np.int64)]
                for i in rows:
                    of_a, of_b, own = found.get(i) or (0, 0, windows[0])
                    n_a.append(of_a)
                    n_b.append(of_b)
                    links.append(int(memo.n[own].sum()))
                    digests.append(hashlib.sha256(b";".join(map(memo.text.__getitem__, own.tolist()))).hexdigest() if len(own) else "")
                    windows.append(own)
                parts.append(([ids[i] for i in rows], n_a, n_b, links, digests, np.concatenate(windows).astype(np.int32)))
                chars += sum(len(texts[i]) for i in rows)
                if chars >= chunk_chars:
                    yield finished()
                    number, chars, parts = number + 1, 0, []
                    memo.trim()
        if parts:
            yield finished()
        parts = []
        memo.trim()
        gc.enable()
        give_back()

    return doc_text(docs).mapInArrow(run, _ALIGNED)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, n, best): how many links hold a pair of ids, and whether no pair with the same id of B is held by more."""
    each = chunks.select(F.explode(F.arrays_zip("pairs", "totals")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.totals").alias("n"))
    counts = each.groupBy("pair").agg(F.sum("n").alias("n"))
    of_b = F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1)).alias("b")
    counts = settle(counts.select("pair", "n", of_b), "pair_counts")
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))
    return counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def with_counts(chunks: DataFrame, counts: DataFrame) -> DataFrame:
    """A row for each document of the chunks, with the counts of its links."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch.column(i)[k] for i, c in enumerate(batch.schema.names)}
                n_pairs = row["n_pairs"].as_py()
                count, best = np.zeros(n_pairs, np.int64), np.zeros(n_pairs, np.int64)
                if row["returned"].is_valid:
                    back = row["returned"].values
                    place = back.field("place").to_numpy(zero_copy_only=False)
                    count[place] = back.field("n").to_numpy(zero_copy_only=False)
                    best[place] = back.field("best").to_numpy(zero_copy_only=False)
                size, slots, times = (unpacked(row[c].as_py()) for c in ("sizes", "pair_slots", "pair_times"))
                doc = np.repeat(np.arange(len(size)), size)
                sums = [np.zeros(len(size), np.int64) for _ in range(2)]
                for to, value in zip(sums, (best, count)):
                    np.add.at(to, doc, times * value[slots])
                own = [row[c].values for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, sums), row["groups_sha256"].values], names)
        give_back()

    # A pair is in a chunk once, so no key has more rows than there are chunks.
    asked = chunks.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    back = asked.join(counts, "pair").groupBy("chunk").agg(F.collect_list(F.struct("place", "n", "best")).alias("returned"))
    rows = chunks.select("chunk", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "sizes", "pair_slots", "pair_times", F.size("pairs").alias("n_pairs")).join(back, "chunk", "left")
    return rows.mapInArrow(run, ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in names))


def alignments(docs: DataFrame, path_a: str = V.BYTE_BPE_JSON, path_b: str = V.PIECE_BPE, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    chunks = settle(aligned(docs, path_a, path_b, chunk_chars), "aligned")
    return with_counts(chunks, pair_counts(chunks))
