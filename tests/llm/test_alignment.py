"""Alignment of tokenizers against the libraries and byte offsets, document by document."""

import hashlib
from collections import Counter
from functools import lru_cache

import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldmark.llm import alignment, queries
from fieldmark.llm import vocabularies as V
from fieldmark.llm.frames import table

ODD = [
    (None, "no id"), (1, None), (2, ""), (3, " "), (4, "   two  spaces \n\n end "), (5, "<|endoftext|> and <s> </s> <unk> <0x41>"), (6, "low ▁ line"), (7, "naïve 漢字 🙂 \u0000\u0001\r\n\ttab"),
    (8, "same text"), (8, "same text"), (9, "x" * 30000), (10, "word " * 30000), (11, "a"), (12, " 　 wide"), (13, "it's I'LL we've 12345 !!!??"),
]


class Plain:
    """Tokens of whole texts by the libraries, and alignment by sets of ends."""

    def __init__(self):
        self.a = tokenizers.Tokenizer.from_file(V.BYTE_BPE_JSON)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=V.PIECE_BPE)
        self.text_a = {i: s for s, i in self.a.get_vocab().items()}

    def tokens(self, text):
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        piece = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
        return [(i, alignment.byte_level_bytes(self.text_a[i])) for i in a], [(i, piece(self.b.id_to_piece(i))) for i in b]

    def document(self, text):
        """(n_a, n_b, links, groups text)."""
        if not text:
            return 0, 0, [], None
        a, b = self.tokens(text)
        if b"".join(t for _, t in a) != (" " + text).encode() or b"".join(t for _, t in b) != (" " + text).encode():
            return 0, 0, [], None
        ends = []
        for tokens in (a, b):
            at, own = 0, {}
            for i, t in tokens:
                at += len(t)
                own[at] = i
            ends.append(own)
        shared = sorted(ends[0].keys() & ends[1].keys())
        parts = []
        for own in ends:
            parts.append([[]])
            for e, i in own.items():
                parts[-1][-1].append(str(i))
                if e in ends[0] and e in ends[1]:
                    parts[-1].append([])
        groups = ["|".join(map(",".join, g)) for g in zip(*(p[:-1] for p in parts))]
        return len(a), len(b), [(ends[0][z], ends[1][z]) for z in shared], ";".join(groups)


plain_tokenizers = lru_cache(1)(Plain)


def brute(rows):
    plain = plain_tokenizers()
    docs = [(d, *plain.document(t)) for d, t in rows]
    count = Counter(x for d in docs for x in d[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(
        ((d, n_a, n_b, len(links), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text is not None else "") for d, n_a, n_b, links, text in docs),
        key=repr,
    )


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert sorted(map(tuple, queries.op12_token_alignment(spark, sf).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("chunk_chars", [1, 8 << 20])
def test_odd_rows(spark, chunk_chars):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"chunk": F.lit("x"), "pair": F.lit(0), "n_a": F.lit(1), "Returned": F.lit(2)})
    got = sorted(map(tuple, alignment.alignments(df.coalesce(2), chunk_chars=chunk_chars).collect()), key=repr)
    assert got == brute(ODD)


def test_empty(spark):
    assert alignment.alignments(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@given(st.lists(st.text(alphabet="ab \n'sé漢▁<|>1.", min_size=1, max_size=30), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_windows(texts):
    """Words encoded once each give the libraries' ids of whole texts, and windows their groups."""
    plain, one, two = plain_tokenizers(), alignment.byte_level(V.BYTE_BPE_JSON), alignment.piece_model(V.PIECE_BPE)
    a, same_a = one.of([" " + t for t in texts])
    b, same_b = two.of([" " + t for t in texts])
    for t, x, y in zip(texts, a, b):
        own_a, own_b = plain.tokens(t)
        if "▁" in t:  # the model takes it for a space, so such a text has no tokens
            assert plain.document(t)[3] is None
            continue
        assert x.tolist() == [i for i, _ in own_a] and y.tolist() == [i for i, _ in own_b]
    good = [k for k in range(len(texts)) if same_a[k] and same_b[k]]
    assert all("▁" not in texts[k] for k in good)
    if good:
        memo = alignment._Memo(one, two)
        slots = alignment.window_slots([a[k] for k in good], [b[k] for k in good], memo)
        for k, s in zip(good, slots):
            assert b";".join(memo.text[i] for i in s.tolist()).decode() == plain.document(texts[k])[3]


@given(st.lists(st.text(alphabet="ab \n\t\r\x1c\x85\xa0\u2003\u3000's1.é漢<|>", min_size=1, max_size=30), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_words(texts):
    """Words with white space of all kinds between them: ids of cut words are those of whole texts, groups too."""
    plain = plain_tokenizers()
    memo = alignment._Memo(alignment.byte_level(V.BYTE_BPE_JSON), alignment.piece_model(V.PIECE_BPE))
    for t in texts:
        words = alignment.cut(" " + t)
        assert "".join(" " + w for w in words) == " " + t
        for ids, own in zip(plain.tokens(t), (memo.one, memo.two)):
            assert [i for x in own.of([" " + w for w in words])[0] for i in x.tolist()] == [i for i, _ in ids]
    for t, got in zip(texts, memo.aligned([" " + t for t in texts])):
        n_a, n_b, links, groups = plain.document(t)
        assert groups is not None and got[:2] == (n_a, n_b) and b";".join(memo.text[i] for i in got[2].tolist()).decode() == groups
        assert int(memo.n[got[2]].sum()) == len(links)


def counted(monkeypatch, owner, name, size):
    """Sums of ``size`` of what a function of ``owner`` is called with."""
    seen, real = [], getattr(owner, name)
    monkeypatch.setattr(owner, name, lambda *a, **b: seen.append(size(*a)) or real(*a, **b))
    return seen


def test_known_words_are_not_aligned_again(monkeypatch):
    """The work of a text is that of its new words: no tokens of known ones go to a library or through windows."""
    one, two = alignment.byte_level(V.BYTE_BPE_JSON), alignment.piece_model(V.PIECE_BPE)
    memo = alignment._Memo(one, two)
    texts = [" some words, " * 50 + "and\nothers", " and\nothers some words," * 40, " low ▁ line"]
    encoded = [counted(monkeypatch, x, "encode", lambda t: sum(map(len, t))) for x in (one, two)]
    windows = counted(monkeypatch, alignment, "flat_windows", lambda a, *_: len(a))
    first = memo.aligned(texts[:2])
    assert all(0 < sum(e) < 100 for e in encoded) and 0 < sum(windows) < 30
    for seen in (*encoded, windows):
        seen.clear()
    again = memo.aligned(texts[:2])
    assert not any(map(sum, (*encoded, windows)))
    assert [(a, b, w.tolist()) for a, b, w in again] == [(a, b, w.tolist()) for a, b, w in first]
    assert memo.aligned(texts)[2] is None  # a text that B does not give back, beside others


def test_new_windows_are_aligned_together(monkeypatch):
    one, two = alignment.byte_level(V.BYTE_BPE_JSON), alignment.piece_model(V.PIECE_BPE)
    memo = alignment._Memo(one, two)
    calls = counted(monkeypatch, memo, "add", lambda *_: 1)
    text = "".join(f" w{i}" for i in range(500))
    slots = alignment.window_slots(one.of([text])[0], two.of([text])[0], memo)[0]
    assert sorted(set(slots.tolist())) == list(range(500)) and len(calls) == 1


def test_long_words_are_forgotten(monkeypatch):
    """What a worker keeps is bounded by characters as well, however few the words."""
    monkeypatch.setattr(alignment, "_MOST_KEPT", 5000)
    memo = alignment._Memo(alignment.byte_level(V.BYTE_BPE_JSON), alignment.piece_model(V.PIECE_BPE))
    kept = []
    for k in "abc":
        memo.aligned([" " + k * 2000])
        memo.trim()
        kept.append(len(memo.words))
    assert kept == [1, 2, 0] and not memo.text and not memo.slot
