"""Line-first cleaning: rules judge single lines, failing lines go, then documents that lose
too much of their text are rejected.

Defined cases: a null text counts as empty; an empty text fails the base rules; repeated rows
get equal results; an empty table gives an empty table; input columns that bear the name of a
result column are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, types as T

from .common import WORD, field, map_text

# Characters counted as symbols, marks that end a sentence, menu separators.
SYMBOLS = "#*$%&|<>"
TERMINAL = ".!?:;\"')]…»”"
SEPARATORS = "|»›·>"
# Phrases of page furniture, compared in lower case.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "enable javascript",
    "privacy policy",
    "sign in to continue",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules; shares are whole percentages."""

    symbol_percent: int = 10  # symbols among the characters of a line's words
    shout_percent: int = 30  # words of a line that end with two exclamation marks
    short_words: int = 4  # lines with fewer words must end with a sentence mark
    menu_separators: int = 2
    menu_words: int = 4  # words between separators, at most, in a menu
    keep_percent: int = 50  # characters that must be left
    min_words: int = 50
    repeat_percent: int = 50


_word = re.compile(WORD)
_shout = re.compile(r"!!(?![^\x20\x09-\x0D])")


def line_passes(line: str, words: list[str], chars: int, rules: LineRules) -> bool:
    n = len(words)
    symbols = sum(map(line.count, SYMBOLS))
    if 100 * symbols > rules.symbol_percent * chars:
        return False
    if "!!" in line and 100 * len(_shout.findall(line)) > rules.shout_percent * n:
        return False
    if n < rules.short_words and words[-1][-1] not in TERMINAL:
        return False
    seps = sum(map(line.count, SEPARATORS))
    if seps >= rules.menu_separators and n <= rules.menu_words * (seps + 1):
        return False
    low = line.lower()
    return not any(p in low for p in BOILERPLATE)


def clean(text: str | None, rules: LineRules = LineRules()) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned text)."""
    text = text or ""
    words: list[str] = []
    kept_lines, kept_chars, total, dups = [], 0, 0, 0
    seen: set[str] = set()
    for line in text.split("\n"):
        own = _word.findall(line)
        if not own:
            kept_lines.append(line)
            continue
        words += own
        chars = sum(map(len, own))
        total += chars
        if line in seen:
            dups += 1
        else:
            seen.add(line)
        if line_passes(line, own, chars, rules):
            kept_chars += chars
            kept_lines.append(line)
    n = len(words)
    first: dict[tuple, int] = {}
    covered = bytearray(n)
    for i, window in enumerate(zip(words, words[1:], words[2:])):
        j = first.setdefault(window, i)
        if j != i:
            covered[i : i + 3] = covered[j : j + 3] = b"\1\1\1"
    repeats = sum(covered)
    failed = n < rules.min_words or 100 * repeats > rules.repeat_percent * n
    kept = not failed and 100 * kept_chars >= rules.keep_percent * total
    return n, total, sum(map(text.count, SYMBOLS)), dups, repeats, failed, kept, "\n".join(kept_lines)


FIELDS = [
    *(field(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    field("base_failed", T.BooleanType()),
    field("kept", T.BooleanType()),
    field("clean_text", T.StringType()),
]


def clean_lines(docs: DataFrame, rules: LineRules = LineRules(), text_col: str = "text") -> DataFrame:
    """``docs`` with the counts, the verdict and ``clean_text``, the text without failing lines."""
    return map_text(docs, lambda: lambda texts: list(zip(*(clean(t, rules) for t in texts))), FIELDS, text_col)
