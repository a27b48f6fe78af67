"""Byte-level BPE encoding and decoding.

Encoding explodes texts to pre-tokens with positions, encodes each distinct
one once, joins the ids back and reassembles by position; positions travel as
packed lists of a chunk (:mod:`fieldmark.llm.distinct_words`).  Decoding joins
ids with the token-byte table, whose size is the vocabulary's.

Null or empty text: no ids, which decode to no bytes. Repeated rows give
repeated rows. A text's ids are little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldmark.llm import vocabularies as V
from fieldmark.llm.distinct_words import CHUNK_CHARS, over_distinct_words
from fieldmark.llm.frames import pieces


def _ids(ids, slots, counts, start, size, flat) -> pa.RecordBatch:
    got = [V.gathered(s, start, size, flat).astype("<u4") for s in slots]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(g) for g in got], pa.int64()), pa.array([g.tobytes() for g in got], pa.binary())], ["doc_id", "n_tokens", "ids"])


def encode(docs: DataFrame, path: str = V.BYTE_BPE_RANKS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids."""
    return over_distinct_words(docs, partial(V.rank_ids, path), _ids, "doc_id long, n_tokens long, ids binary", chunk_chars=chunk_chars)


def decode(rows: DataFrame, path: str = V.BYTE_BPE_RANKS) -> DataFrame:
    """``rows`` with ``decoded``: the bytes of their ids."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = V.token_bytes(path)
        for b in pieces(batches):
            ids = b.column(names.index("ids"))
            texts = [b"".join(map(table.__getitem__, np.frombuffer(i.as_py(), "<u4").tolist())) if i.is_valid else None for i in ids]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], [*names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, decoded binary")
