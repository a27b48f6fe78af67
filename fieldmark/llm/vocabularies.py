"""Public vocabularies, loaded once in each worker. Paths are parameters; nothing is copied or trained."""

from __future__ import annotations

import base64
import json
import os
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
import tokenizers

BYTE_BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")
BYTE_BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(4)
def library_tokenizer(path: str, plain_text: bool = False) -> tokenizers.Tokenizer:
    """``plain_text``: strings of special tokens inside texts are text like any other."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    found = tokenizers.Tokenizer.from_file(path)
    found.encode_special_tokens = plain_text
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(4)
def special_string(path: str) -> str | None:
    """The special string that the tokenizer takes out of texts before splitting; at most one is supported."""
    with open(path, encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f)["added_tokens"]]
    if len(added) > 1:
        raise ValueError(f"{path} has {len(added)} special strings; one at most is supported")
    return added[0] if added else None


@lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(4)
def piece_encoder(path: str) -> tiktoken.Encoding:
    """Encodes its whole argument as one pre-token."""
    return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(4)
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table: bytes by id."""
    table = [b""] * (max(ranks(path).values()) + 1)
    for token, i in ranks(path).items():
        table[i] = token
    return table


def library_ids(path: str, words: list[str]) -> list[list[int]]:
    return [e.ids for e in library_tokenizer(path).encode_batch_fast(words, add_special_tokens=False)]


@lru_cache(4)
def space_first(path: str) -> np.ndarray:
    """By id, whether a byte-level token begins with a space, which such vocabularies write as U+0120."""
    names = library_tokenizer(path).get_vocab()
    out = np.zeros(max(names.values()) + 1, np.int64)
    out[[i for name, i in names.items() if name.startswith("\u0120")]] = 1
    return out


def library_flat(path: str, words: list[str], together: int = 256, plain_text: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each word, all ids in order), as ``library_ids``.

    Words of a space and letters are split off again wherever they stand, so many of them go to the library as one
    text; of the tokens of such a word just the first one begins with the space."""
    plain = [i for i, w in enumerate(words) if w[0] == " " and w[1:].isalpha()]
    rest = sorted(set(range(len(words))) - set(plain))
    encode = library_tokenizer(path, plain_text).encode_batch_fast
    size, parts = np.zeros(len(words), np.int64), []
    order = np.array([*plain, *rest], np.int64)
    groups = [plain[a : a + together] for a in range(0, len(plain), together)]
    for group, e in zip(groups, encode(["".join([words[i] for i in g]) for g in groups], add_special_tokens=False)):
        ids = np.array(e.ids, np.int64)
        of = np.cumsum(space_first(path)[ids]) - 1
        if int(of[-1]) + 1 != len(group):
            raise ValueError("the library joined or split words that it should not")
        size[group] = np.bincount(of, minlength=len(group))
        parts.append(ids)
    for i, e in zip(rest, encode([words[i] for i in rest], add_special_tokens=False)):
        size[i] = len(e.ids)
        parts.append(np.array(e.ids, np.int64))
    flat = np.concatenate([*parts, np.zeros(0, np.int64)])
    start = np.zeros(len(words), np.int64)
    start[order] = np.cumsum(size[order]) - size[order]
    return size, gathered(np.arange(len(words)), start, size, flat)


def rank_ids(path: str, words: list[str]) -> list[list[int]]:
    encode = piece_encoder(path).encode_ordinary
    return [encode(w) for w in words]


def gathered(slots: np.ndarray, start: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The pieces ``flat[start:start + size]`` of all ``slots``, one after another."""
    n = size[slots]
    total = int(n.sum())
    return flat[np.repeat(start[slots] - (np.cumsum(n) - n), n) + np.arange(total)]
