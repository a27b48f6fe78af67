"""Line-first cleaning.

Each line is judged alone by three kinds of rule - punctuation, navigation,
boilerplate - and failing lines are removed.  A document is rejected when its
lines lose too much of its text, or when it fails the base limits on length
and repetition.  One pass over the rows, no shuffle; a row's cost is linear in
its text, so a hot source or group of copies spreads with the input splits.

Null or empty text: no words, no lines, ``base_failed`` and not kept, cleaned
text is empty.  Repeated rows are judged each for itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from fieldmark.llm.frames import doc_text, pieces

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

#: Line endings that close a sentence, and what may follow them.
ENDS = ".!?:;…\"'”’»)]"
#: Separators between links.
SEPARATORS = "|»›>•·"
#: Words that a navigation line may consist of.
NAV_WORDS = (
    "home about contact login logout search menu next previous share tweet print email help faq news blog shop cart "
    "account register sitemap top back more"
).split()
#: Phrases of boilerplate lines.
BOILERPLATE = (
    "all rights reserved|cookie|privacy policy|terms of (?:use|service)|javascript|subscribe|newsletter|click here|"
    "sign up|log in|copyright|licensed under|released under|this work is licensed"
)

_BOILER = re.compile(BOILERPLATE)
_SENTENCE = re.compile(r"[.!?\u2026] ")
_NAV = frozenset(w.encode() for w in NAV_WORDS)
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@dataclass(frozen=True)
class LineRules:
    """``long_line``: from so many words a line must end like a sentence or hold one. ``min_words`` and ``max_repeat`` (per cent of
    words in repeated three-word windows) are the base limits; ``max_lost`` is the share of words that lines may lose."""

    long_line: int = 4
    separators: int = 3
    symbol_share: float = 0.2
    min_words: int = 50
    max_repeat: int = 50
    max_lost: float = 0.5


def line_fault(line: str, n_words: int, rules: LineRules) -> str | None:
    """The first rule that a line with words fails: ``navigation``, ``boilerplate`` or ``punctuation``."""
    if sum(map(line.count, SEPARATORS)) >= rules.separators:
        return "navigation"
    low = line.translate(_LOWER)
    if n_words <= 8 and all(w in _NAV for w in low.encode().split()):
        return "navigation"
    if _BOILER.search(low):
        return "boilerplate"
    if sum(map(line.count, SYMBOLS)) > rules.symbol_share * len(line):
        return "punctuation"
    if n_words >= rules.long_line and line.rstrip(SPACES)[-1] not in ENDS and not _SENTENCE.search(line):
        return "punctuation"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more; a word in several such windows counts once."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    total = covered = 0
    for i, w in enumerate(windows):
        if w in often:
            total += i + 3 - max(covered, i)
            covered = i + 3
    return total


def judged(text: str | None, rules: LineRules) -> tuple:
    text = text or ""
    words = text.encode().split()
    n, seen, dup, kept_lines, lost = len(words), set(), 0, [], 0
    faults = {"navigation": 0, "boilerplate": 0, "punctuation": 0}
    n_lines = 0
    for line in text.split("\n"):
        k = len(line.encode().split())
        if not k:
            kept_lines.append(line)
            continue
        n_lines += 1
        dup += line in seen
        seen.add(line)
        if fault := line_fault(line, k, rules):
            faults[fault] += 1
            lost += k
        else:
            kept_lines.append(line)
    repeat = repeated_words(words)
    failed = n < rules.min_words or 100 * repeat > rules.max_repeat * n
    return (
        n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeat, failed,
        not failed and lost <= rules.max_lost * n, n_lines, *faults.values(), lost, "\n".join(kept_lines),
    )


_NAMES = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept n_lines n_navigation n_boilerplate "
    "n_punctuation n_lost_words"
).split()
_TYPES = [pa.bool_() if n in ("base_failed", "kept") else pa.int64() for n in _NAMES]


def clean_lines(docs: DataFrame, rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts and verdicts, and the ``cleaned`` text if asked for."""
    schema = "doc_id long, " + ", ".join(f"{n} {'boolean' if t == pa.bool_() else 'long'}" for n, t in zip(_NAMES, _TYPES))
    schema += ", cleaned string" if with_text else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *_NAMES] + ["cleaned"] * with_text
        for b in pieces(batches):
            cols = list(zip(*[judged(t.as_py(), rules) for t in b.column(1)])) or [()] * 13
            arrays = [pa.array(c, t) for c, t in zip(cols, [*_TYPES, pa.string()])]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays[: len(names) - 1]], names)

    return doc_text(docs).mapInArrow(run, schema)
