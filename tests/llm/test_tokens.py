"""Token files, counts and BPE against the libraries themselves."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F

from fieldmark.llm import byte_bpe, pretokens, token_counts, token_files
from fieldmark.llm import vocabularies as V
from fieldmark.llm.frames import new_path, table

ODD = [
    (None, "x y"), (900001, None), (900002, ""), (900003, "a<|endoftext|>b  \n c"), (900003, "a<|endoftext|>b  \n c"), (900003, "other"),
    (900004, "œ中 ½ don't  we'll 's '' \x1c\x85"), (900005, "long " * 30_000), (900006, "w" * 4000),
]


@pytest.fixture(scope="module")
def docs(spark, sf, tmp_path_factory):
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    path = str(tmp_path_factory.mktemp("docs") / "d")
    table(spark, sf, "documents").select("doc_id", "text").unionByName(odd).selectExpr("*", "1 AS n_tokens", "2 AS chunk", "'s' AS slots").write.parquet(path)
    return spark.read.parquet(path)


def whole_encoder():
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=V.ranks(V.BYTE_BPE_RANKS), special_tokens={})


def library_ids(text):
    return V.library_tokenizer(V.BYTE_BPE_JSON).encode(text or "", add_special_tokens=False).ids


def test_splitter_agrees_with_the_library():
    rnd, whole = random.Random(1), whole_encoder()
    plain, more = "ab'sstrevemlld  \n\t\r _-!.,12é²ªµ\xa0\x85\x1c\x00Z", "œ中а\u3000Ⅷ½\u0308٣\U0001f600"
    for _ in range(150):
        texts = ["".join(rnd.choice(plain if rnd.random() < 0.8 else plain + more) for _ in range(rnd.choice([0, 1, 2, 5, 30]))) for _ in range(20)]
        words: dict[str, int] = {}
        slots = pretokens.slots_of(texts, words)
        names = list(words)
        for t, s in zip(texts, slots):
            assert [names[i] for i in s] == pretokens.split(t)
            assert [i for k in s for i in V.rank_ids(V.BYTE_BPE_RANKS, [names[k]])[0]] == whole.encode_ordinary(t)


def test_splitter_survives_equal_hashes(monkeypatch):
    monkeypatch.setattr(pretokens, "_RANDOM", np.ones(256, np.uint64))
    words: dict[str, int] = {}
    slots = pretokens.slots_of(["ab cd ef", "gh ij"], words)
    names = list(words)
    assert [[names[i] for i in s] for s in slots] == [["ab", " cd", " ef"], ["gh", " ij"]]


def test_token_counts(docs):
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, chunk_chars=100_000).collect())
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(library_ids(r.text)), n > 512) for r in docs.collect())
    assert got == want


def test_bpe_round_trip(docs):
    whole = whole_encoder()
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in byte_bpe.decode(byte_bpe.encode(docs, chunk_chars=100_000)).collect())
    want = Counter((r.doc_id, len(i := whole.encode_ordinary(r.text or "")), np.array(i, "<u4").tobytes(), (r.text or "").encode()) for r in docs.collect())
    assert got == want


def test_token_files(spark, docs, monkeypatch):
    monkeypatch.setattr(token_files, "_MOST_WORDS", 500)
    path = new_path(spark, "tokens")
    token_files.write_tokens(docs, path)
    got = Counter(map(tuple, token_files.with_crc32(token_files.read_tokens(spark, path)).collect()))
    at, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "")):
        ids = [*library_ids(r.text), 0]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == Counter(want)
    files = [f for f in spark.read.parquet(path).inputFiles()]
    chunks = [pq.ParquetFile(f.removeprefix("file://")).metadata.row_group(0) for f in files]
    ids = [c.column(i) for c in chunks for i in range(c.num_columns) if c.column(i).path_in_schema.startswith("ids")]
    assert ids and all(c.has_column_index and {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(c.encodings) for c in ids)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(none).count() == 0
    assert byte_bpe.decode(byte_bpe.encode(none)).count() == 0
    path = new_path(spark, "tokens")
    token_files.write_tokens(none, path)
    assert token_files.read_tokens(spark, path).count() == 0


def test_digests_are_of_little_endian_ids():
    assert hashlib.sha256(np.array([1, 256], "<u4").tobytes()).hexdigest() == hashlib.sha256(b"\1\0\0\0\0\1\0\0").hexdigest()


def test_rows_in_no_fixed_order(spark):
    """Rows that come otherwise at each reading are settled first."""
    rows = [(k, None if k % 7 == 0 else f"word{k % 13} and  {k} é\n" * (k % 5)) for k in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).orderBy(F.rand())
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(d).collect()}
    back = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(byte_bpe.encode(d)).collect()}
    assert got.keys() == back.keys() == set(range(200)) and back == {k: (t or "").encode() for k, t in rows}
