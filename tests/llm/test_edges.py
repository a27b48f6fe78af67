"""Empty tables, very long texts, repeated rows and clashing columns where the other tests have none; registered queries."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from fieldmark.llm import byte_bpe, chat, quality_rules, queries, secrets, token_counts
from fieldmark.llm import vocabularies as V
from fieldmark.llm.frames import table

EMPTY = "doc_id long, text string"


def test_empty_tables(spark):
    none = spark.createDataFrame([], EMPTY)
    assert quality_rules.clean_lines(none).count() == 0
    assert secrets.scan_secrets(none).count() == 0 and secrets.redact_secrets(none).count() == 0
    assert chat.read_back(chat.examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_very_long_texts(spark):
    long = "word, " * 200_000
    docs = spark.createDataFrame([(1, long + "password = abcdefgh12345678"), (2, "x" * 1_000_000)], EMPTY)
    r = {x.doc_id: x for x in quality_rules.clean_lines(docs, with_text=False).collect()}
    assert (r[1].n_words, r[1].base_failed, r[2].n_words, r[2].word_chars) == (200_003, True, 1, 1_000_000)
    s = {x.doc_id: x for x in secrets.scan_secrets(docs).collect()}
    start = len(long)
    assert (s[1].n_assign, s[2].n_assign, s[2].n_hex) == (1, 0, 0) and s[1].spans.startswith(f"assign:{start}:")
    conv = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "### " + long)], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.examples(conv)).first()
    assert (back.n_turns, back.loss_chars) == (2, len(long) + 4)
    assert back.turns_sha256 == hashlib.sha256(f"user\n{long}\nassistant\n### {long}\n".encode()).hexdigest()


def test_repeated_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "token: abcdefgh1"), (1, "token: abcdefgh1"), (None, None)], EMPTY).withColumns({c: F.lit("x") for c in ("spans", "n_hex", "n_tokens", "chunk", "bucket", "kept", "n_words")})
    assert sorted((str(r.doc_id), r.n_assign) for r in secrets.scan_secrets(docs).collect()) == [("1", 1), ("1", 1), ("None", 0)]
    assert sorted((str(r.doc_id), r.n_tokens > 0) for r in token_counts.count_tokens(docs).collect()) == [("1", True), ("1", True), ("None", False)]
    assert sorted((str(r.doc_id), r.n_tokens > 0) for r in byte_bpe.encode(docs).collect()) == [("1", True), ("1", True), ("None", False)]
    assert quality_rules.clean_lines(docs, with_text=False).count() == 3


def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}


def test_registered_token_ids(spark, sf):
    known, start = texts(spark, sf), 0
    lib = V.library_tokenizer(V.BYTE_BPE_JSON)
    for r in queries.op1_token_id_output(spark, sf).orderBy("doc_id").collect():
        ids = [*lib.encode(known[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    assert start


def test_registered_counts_and_bpe(spark, sf):
    known, lib = texts(spark, sf), V.library_tokenizer(V.BYTE_BPE_JSON)
    n = {d: len(lib.encode(t, add_special_tokens=False).ids) for d, t in known.items()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op6_token_counts(spark, sf).collect()}
    assert got == {d: (len(t.encode()), n[d], n[d] > 512) for d, t in known.items()}
    bpe = {r.doc_id: r.decoded_sha256 for r in queries.op7_byte_bpe(spark, sf).collect()}
    assert bpe == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in known.items()}


def test_registered_secrets(spark, sf):
    known = texts(spark, sf)
    for r in queries.op9_secret_scans(spark, sf).collect():
        spans = [s.split(":") for s in r.spans.split(",")] if r.spans else []
        base = [s for s in spans if s[0] in ("assign", "access", "hex")]
        assert [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")] == [r.n_assign, r.n_access, r.n_hex]
        assert r.base_sha256 == hashlib.sha256(",".join(":".join(s) for s in base).encode()).hexdigest()
        assert all(0 <= int(a) < int(z) <= len(known[r.doc_id]) for _, a, z in spans)


def test_clean_documents_stay_untouched(spark):
    docs = spark.createDataFrame([(1, "Plain words about nothing in particular."), (2, None)], EMPTY)
    assert {r.doc_id: r.text for r in secrets.redact_secrets(docs).collect()} == {1: "Plain words about nothing in particular.", 2: None}


@pytest.mark.parametrize("name", ["op4_language_id"])
def test_registered_language_id(spark, sf, name):
    rows = queries.QUERIES[name](spark, sf).collect()
    langs = {r.doc_id: r.lang for r in table(spark, sf, "documents").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(langs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len([r for r in held if langs[r.doc_id]])
