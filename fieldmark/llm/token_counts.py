"""Token counts without token ids.

Pieces are counted once for each distinct pre-token of the corpus, brought to
the per-document pre-token frequencies, and summed.  See
:mod:`fieldmark.llm.distinct_words` for how the join stays free of hot keys.

Null or empty text: 0 bytes and 0 tokens. Repeated rows give repeated rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm import vocabularies as V
from fieldmark.llm.distinct_words import CHUNK_CHARS, over_distinct_words


def _pieces(path: str, special: str | None, words: list[str]) -> list[list[int]]:
    """[number of pieces, UTF-8 bytes] of each word."""
    return [[len(i), len(w.encode())] for w, i in zip(words, V.library_ids(path, words))]


def _sums(ids, slots, counts, start, size, flat) -> pa.RecordBatch:
    tokens = [int((flat[start[s]] * c).sum()) for s, c in zip(slots, counts)]
    size_b = [int((flat[start[s] + 1] * c).sum()) for s, c in zip(slots, counts)]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size_b, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, path: str = V.BYTE_BPE_JSON, limit: int = 512, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, and whether that is over ``limit``."""
    special = V.special_string(path)
    out = over_distinct_words(
        docs, partial(_pieces, path, special), _sums, "doc_id long, n_bytes long, n_tokens long",
        special=special, counted=True, chunk_chars=chunk_chars,
    )
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
