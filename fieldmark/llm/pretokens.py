"""Pre-tokens of the byte-level vocabularies, a batch of texts at a time.

The pattern is a parameter's default, ``public_tokenizers.PATTERN``.  Texts
within Latin-1 are split with array operations: a pre-token is a run of one
character class with at most one space before it, and the few exceptions
(white space runs, English contractions) move single boundaries.  Other texts
go through the pattern itself.  Equal pre-tokens of a batch are found by a
64-bit hash and then compared byte by byte, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import regex

PATTERN = public_tokenizers.PATTERN

_LETTER, _NUMBER, _OTHER, _SPACE, _END = range(5)


def _classes() -> np.ndarray:
    table = np.full(256, _OTHER, np.uint8)
    for i in range(256):
        if regex.match(r"\p{L}", chr(i)):
            table[i] = _LETTER
        elif regex.match(r"\p{N}", chr(i)):
            table[i] = _NUMBER
        elif regex.match(r"\p{White_Space}", chr(i)):
            table[i] = _SPACE
    return table


_CLASS = _classes()
_RANDOM = np.random.default_rng(20).integers(1, 2**63, 256, np.uint64)
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
#: White space as the libraries see it, which is the Unicode property.
_pattern = regex.compile(PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def split(text: str) -> list[str]:
    """The pre-tokens of one text by the pattern."""
    return _pattern.findall(text)


def _starts(u: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pre-tokens start and end in Latin-1 bytes ``u``; each text is followed by one byte, at ``ends``."""
    kind = _CLASS[u]
    kind[ends] = _END
    start = np.empty(len(u), bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[ends] = True
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] < _SPACE))  # the last of white space before something
    start[last] = True
    start[last[u[last] == 32] + 1] = False
    p = np.flatnonzero(u[:-3] == 39)
    p = p[start[p] & (kind[p + 1] == _LETTER)]
    a, b = u[p + 1], u[p + 2]
    one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
    two &= kind[p + 2] == _LETTER
    start[p[one | two] + 1] = False
    start[p[one] + 2] = True
    start[p[two] + 3] = True
    at = np.flatnonzero(start)
    to = np.append(at[1:], len(u))
    real = kind[at] != _END
    return at[real], to[real]


def _latin(raw: list[bytes], words: dict[str, int]) -> list[np.ndarray] | None:
    """Slots of each text's pre-tokens, new ones entered in ``words``; None if two pre-tokens share a hash."""
    # Three bytes more, so that a look at the two bytes after an apostrophe stays inside.
    u = np.frombuffer(b"\0".join([*raw, b"\0\0", b""]), np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw]) - 1
    at, to = _starts(u, np.concatenate([ends, np.arange(ends[-1] + 1, len(u))]))
    if not len(at):
        return [np.zeros(0, np.int64) for _ in raw]
    size = to - at
    gone = np.flatnonzero(at[1:] != to[:-1]) + 1  # separators between tokens belong to none
    value = _RANDOM[u]
    value[ends] = 0
    inside = np.arange(len(u)) - np.repeat(np.append(at, len(u)), np.diff(np.concatenate([[0], at[1:], [len(u)]]), append=len(u)))
    value *= _POWERS[inside & 4095]
    hashed = np.add.reduceat(value, at) ^ (size.astype(np.uint64) << np.uint64(48))
    _, first, inverse = np.unique(hashed, return_index=True, return_inverse=True)
    one = np.repeat(at[first][inverse], size)  # byte by byte: is each the same as its first one?
    step = np.arange(len(one)) - np.repeat(np.cumsum(size) - size, size)
    if not np.array_equal(size[first][inverse], size) or not np.array_equal(u[one + step], u[np.repeat(at, size) + step]):
        return None
    text = u.tobytes()
    slots = np.fromiter((words.setdefault(text[a:b].decode("latin-1"), len(words)) for a, b in zip(at[first].tolist(), to[first].tolist())), np.int64, len(first))
    del gone
    return np.split(slots[inverse], np.searchsorted(at, ends[:-1]))


def slots_of(texts: list[str], words: dict[str, int], special: str | None = None) -> list[np.ndarray]:
    """For each text the slots of its pre-tokens, in order; ``words`` gives each pre-token's slot and grows.

    ``special``: a string that is a pre-token of its own, wherever it stands."""
    out: list[np.ndarray | None] = [None] * len(texts)
    rows, raw = [], []
    for i, t in enumerate(texts):
        if not t:
            out[i] = np.zeros(0, np.int64)
            continue
        if special is None or special not in t:
            try:
                raw.append(t.encode("latin-1"))
                rows.append(i)
                continue
            except UnicodeEncodeError:
                pass
        found: list[str] = []
        for k, part in enumerate(t.split(special) if special else [t]):
            found += [special] * (k > 0)
            found += split(part)
        out[i] = np.fromiter((words.setdefault(w, len(words)) for w in found), np.int64, len(found))
    if raw:
        got = _latin(raw, words)
        if got is None:
            got = [np.array([words.setdefault(w, len(words)) for w in split(r.decode("latin-1"))], np.int64) for r in raw]
        for i, g in zip(rows, got):
            out[i] = g
    return out


def batches_of(texts: list[str | None], most: int = 4 << 20) -> Iterator[list[int]]:
    """Row numbers in order, in runs of about ``most`` characters; a longer text is a run of its own."""
    rows, held = [], 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if rows and held + n > most:
            yield rows
            rows, held = [], 0
        rows.append(i)
        held += n
    if rows:
        yield rows
