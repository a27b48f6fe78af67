"""Language identification by prediction by partial matching (PPM).

Every language has a tree of byte contexts of up to ``order`` bytes, counted
on a bounded sample of labelled documents.  A byte costs what its longest
known context says; a byte unseen there costs that context's escape and what
the next shorter context gives it among the bytes not seen so far (escape
method C with exclusion).  The statistics are frozen, so a text has one exact
code length per language and the shortest one wins.

Frozen trees are compiled to tables over the union of all contexts.  One walks
from the latest byte to older ones; one says where a byte's costs stand, one
column a language, if any language saw it in that context; and one holds each
context's cost of an escape to the next shorter one.  Costs are kept only for
what was seen, so the tables, which are broadcast, grow with the sample
(``sample_docs`` documents a language) and not with contexts times languages
times bytes.  A text is scored with array look-ups, a bounded piece at a time,
whatever its length.  Prediction is one pass without a shuffle.

Null text, or text without letters: ``und`` with score 0, as for every text
when no labelled rows exist.  An empty table gives no rows.  Rows that are
repeated are one row of the sample, and are each predicted.  Ties go to the
first language by name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmark.llm.frames import give_back, pieces

UNKNOWN = "und"
_PIECE = 1 << 18
_ASCII_LETTER = re.compile("[A-Za-z]")


def fold(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, mod 4; rows with 2 are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


@dataclass(frozen=True)
class Trees:
    """``klass``: class of each byte, bytes that the sample lacks in the last one. ``child``: node and class of the next
    older byte to node. ``entry``: node and class of the byte to a row of ``cost``. Both are -1 for none. ``cost``: bits,
    one column a language. ``escape``: bits by node and language of going to ``parent``.
    ``usual``: bits a byte of each language's sample."""

    langs: tuple[str, ...]
    order: int
    klass: np.ndarray
    child: np.ndarray
    entry: np.ndarray
    cost: np.ndarray
    escape: np.ndarray
    parent: np.ndarray
    usual: np.ndarray


MAX_LANGUAGES = 1000


def sample(docs: DataFrame, sample_docs: int) -> DataFrame:
    """(lang, text) of at most ``sample_docs`` different rows a language, the first by a hash of the id among rows not held
    out. More than ``MAX_LANGUAGES`` values of ``lang`` are no language labels: a ValueError."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.filter("lang is not null and text is not null and length(text) > 0").filter(F.coalesce(fold("id") != 2, F.lit(False)))
    counts = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of lang")
    # Rows with a hash below a bound are some 2 * sample_docs + 100 a language, so that no task ranks many.
    bound = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (2 * sample_docs + 100) / r["count"])) for r in counts], "lang2 string, share double")
    rows = rows.withColumn("key", F.xxhash64("id", F.lit("langid")))
    rows = rows.join(F.broadcast(bound), (F.col("lang") == F.col("lang2")) & (F.shiftrightunsigned("key", 11) <= F.col("share") * float(2**53)))
    rows = rows.select("lang", "key", "id", "text").dropDuplicates()
    n = F.row_number().over(Window.partitionBy("lang").orderBy("key", "id", "text"))
    return rows.withColumn("n", n).filter(F.col("n") <= sample_docs).select("lang", "text")


def gram_counts(texts: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n): how often each byte follows each ``order`` bytes; a text begins after zero bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            for lang, text in zip(b.column(0), b.column(1)):
                u = np.frombuffer(b"\0" * order + text.as_py().encode(), np.uint8).astype(np.int64)
                gram = np.zeros(len(u) - order, np.int64)
                for j in range(order + 1):
                    gram = gram << 8 | u[j : len(u) - order + j]
                grams, n = np.unique(gram, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(n)), pa.array(grams), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return texts.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, order: int = 3, sample_docs: int = 300) -> Trees | None:
    """Trees from a bounded sample; None without labelled rows."""
    rows = gram_counts(sample(docs, sample_docs), order).toArrow()  # bounded by the sample
    if not len(rows):
        return None
    langs, lang = np.unique(rows.column("lang").to_numpy(), return_inverse=True)
    trees = compile_trees(tuple(langs.tolist()), lang, rows.column("gram").to_numpy(), rows.column("n").to_numpy(), order)
    del rows, lang
    give_back()  # the driver lives on, too
    return trees


def compile_trees(langs: tuple[str, ...], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int) -> Trees:
    """Trees of counted grams: row i says that ``gram[i]`` stands ``n[i]`` times in texts of language number ``lang[i]``."""
    parts = [gram >> 8 * j & 255 for j in range(order + 1)]  # the byte itself, then older ones
    used = np.unique(np.concatenate(parts))
    klass = np.full(256, len(used), np.int32)
    klass[used] = np.arange(len(used))
    size = len(used) + 1  # the last class stands for each byte that the sample lacks
    symbol, parts = klass[parts[0]].astype(np.int64), [klass[p].astype(np.int64) for p in parts]
    child, entry, escape, cost = [], [], [], []
    nodes, first_node, first_cost, parent = 1, 0, 0, [np.zeros(1, np.int32)]
    node = np.zeros(len(gram), np.int64)  # of each row's context at this length, counted from the first of that length
    above = np.full((len(gram), len(langs)), 1 / 256)  # probability of each row's byte, one byte of context shorter
    for depth in range(order + 1):
        keys, place = np.unique(node * size + symbol, return_inverse=True)
        count = np.zeros((len(keys), len(langs)))
        np.add.at(count, (place, lang), n)
        below = np.empty_like(count)
        below[place] = above  # equal for all rows of a key
        of = keys // size
        total, kinds, taken = (np.zeros((nodes, len(langs))) for _ in range(3))
        for to, what in ((total, count), (kinds, count > 0), (taken, np.where(count > 0, below, 0))):
            np.add.at(to, of, what)
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = np.where(total > 0, kinds / (total + kinds) / np.maximum(1 - taken, 1e-300), 1.0)
            p = np.where(count > 0, count / (total + kinds)[of], leave[of] * below)
        table = np.full((nodes, size), -1, np.int32)
        table.reshape(-1)[keys] = first_cost + np.arange(len(keys))
        entry.append(table)
        cost.append(-np.log2(p).astype(np.float32))
        escape.append(-np.log2(leave).astype(np.float32))
        first_cost += len(keys)
        walk = np.full((nodes, size), -1, np.int32)
        if depth < order:
            deeper, node = np.unique(node * size + parts[depth + 1], return_inverse=True)
            walk.reshape(-1)[deeper] = first_node + nodes + np.arange(len(deeper))
            parent.append((first_node + deeper // size).astype(np.int32))
            first_node, nodes = first_node + nodes, len(deeper)
        child.append(walk)
        above = p[place]
    bits = -np.log2(above[np.arange(len(lang)), lang])
    usual = np.bincount(lang, n * bits) / np.bincount(lang, n)
    return Trees(langs, order, klass, np.concatenate(child), np.concatenate(entry), np.concatenate(cost), np.concatenate(escape), np.concatenate(parent), usual)


def code_lengths(texts: list[bytes], trees: Trees) -> np.ndarray:
    """Bits of each text in each language."""
    out = np.zeros((len(texts), len(trees.langs)))
    size, order = trees.child.shape[1], trees.order
    child, entry = trees.child.reshape(-1), trees.entry.reshape(-1)
    gap = b"\0" * order
    group: list[int] = []
    held = 0

    def score(buf: bytes, starts: np.ndarray, lengths: np.ndarray, rows: list[int]) -> None:
        c = trees.klass[np.frombuffer(buf, np.uint8)]
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        node = np.zeros(len(at), np.int32)
        dead = np.zeros(len(at), bool)
        for j in range(1, order + 1):
            older = child[node * size + c[at - j]]
            dead |= older < 0
            node = np.where(dead, node, older)
        byte = c[at]
        row = entry[node * size + byte]
        bits = trees.cost[row]
        lost = np.flatnonzero(row < 0)  # no language saw the byte there
        bits[lost] = 0
        while len(lost):
            bits[lost] += trees.escape[node[lost]]
            end = lost[node[lost] == 0]
            bits[end] += 8  # below all contexts, bytes are equally likely
            lost = lost[node[lost] != 0]
            node[lost] = trees.parent[node[lost]]
            row = entry[node[lost] * size + byte[lost]]
            bits[lost[row >= 0]] += trees.cost[row[row >= 0]]
            lost = lost[row < 0]
        ends = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        np.add.at(out, rows, np.add.reduceat(bits, ends, axis=0, dtype=np.float64))

    def flush() -> None:
        nonlocal group, held
        if group:
            lengths = np.array([len(texts[i]) for i in group])
            starts = order + np.concatenate([[0], np.cumsum(lengths + order)[:-1]])
            score(gap + gap.join(texts[i] for i in group), starts, lengths, group)
        group, held = [], 0

    for i, t in enumerate(texts):
        if len(t) > _PIECE:  # a long text goes through in pieces, each with the bytes before it
            for a in range(0, len(t), _PIECE):
                piece = (gap + t[:_PIECE]) if a == 0 else t[a - order : a + _PIECE]
                score(piece, np.array([order]), np.array([len(piece) - order]), [i])
        elif t:
            group.append(i)
            held += len(t)
            if held > _PIECE:
                flush()
    flush()
    return out


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def predicted(texts: list[str | None], trees: Trees | None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, posterior under equal priors, bits a byte, and bits beyond twice the usual of that language, of each text."""
    score, per_byte, beyond = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
    langs = [UNKNOWN] * len(texts)
    rows = [i for i, t in enumerate(texts) if t and trees and has_letter(t)]
    if rows:
        raw = [texts[i].encode() for i in rows]
        bits, size = code_lengths(raw, trees), np.array([len(t) for t in raw])
        best = bits.argmin(1)
        least = bits[np.arange(len(rows)), best]
        score[rows] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
        per_byte[rows] = least / size
        beyond[rows] = least - 2 * trees.usual[best] * size
        for i, k in zip(rows, best):
            langs[i] = trees.langs[k]
    return langs, score, per_byte, beyond


def identify(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score, bits_per_byte. Only the text is scored."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            langs, score, bits, _ = predicted(b.column(2).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(score), pa.array(bits)], ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


def keep_identified(docs: DataFrame, trees: Trees | None, least_score: float = 0.3, slack_bits: float = 512) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language with at least ``least_score`` and is written in it: it
    takes at most twice the bits a byte that the language's sample took, and ``slack_bits`` more, enough for a key and an
    address within a short text. Long random letters and languages that were not learned take more. Without labelled rows
    there is nothing to judge by, and all rows stay."""
    if trees is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            langs, score, _, beyond = predicted(b.column("text").to_pylist(), shared.value)
            yield b.filter(pa.array([k != UNKNOWN and s >= least_score and x <= slack_bits for k, s, x in zip(langs, score, beyond)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fit_and_identify(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    return identify(docs, fit(docs, **how))
