"""Quality rules: lines first, then the document that is left of them."""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
# A line fails above this share of symbols among its word characters, in hundredths.
SYMBOL_SHARE = 10
# A menu has this many separators standing alone, and this share of its words.
MENU_SEPARATORS = 3
MENU_SHARE = 25
SEPARATORS = "[|/>•·»]"
# Phrases of page furniture, in lower case.
BOILERPLATE = (
    "all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept cookies"
    "|uses cookies|click here|read more|sign up|log in|subscribe|enable javascript|powered by"
    "|back to top|skip to content"
)
# A boilerplate line is short; a long one merely mentions the phrase.
BOILERPLATE_WORDS = 20
MIN_WORDS = 50
REPEAT_SHARE = 50
# A document that loses more of its word characters than this goes.
LOST_SHARE = 30

_SPACE_BYTES, _SYMBOL_BYTES = SPACES.encode(), SYMBOLS.encode()
_SEPARATOR = re.compile(SEPARATORS)
_BOILERPLATE = re.compile(BOILERPLATE)


class Judged(NamedTuple):
    clean_text: str
    n_lines: int
    n_failed_lines: int
    lost_chars: int
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool


_TYPES = {str: (pa.string(), T.StringType()), int: (pa.int64(), T.LongType()), bool: (pa.bool_(), T.BooleanType())}
_FIELDS = {"clean_text": str, "base_failed": bool, "kept": bool}
_ARROW = pa.struct([(f, _TYPES[_FIELDS.get(f, int)][0]) for f in Judged._fields])
_SPARK = T.StructType([T.StructField(f, _TYPES[_FIELDS.get(f, int)][1]) for f in Judged._fields])


def failed_rule(line: str, words: list[bytes], chars: int, symbols: int) -> str | None:
    """The first rule that the line breaks: punctuation, navigation or boilerplate."""
    if not any(map(str.isalnum, line)):
        return "punctuation"
    if _SEPARATOR.search(line):
        separators = sum(_SEPARATOR.sub("", w.decode()) == "" for w in words)
        if separators >= MENU_SEPARATORS and separators * 100 >= len(words) * MENU_SHARE:
            return "navigation"
    if symbols * 100 > chars * SYMBOL_SHARE:
        return "punctuation"
    if len(words) <= BOILERPLATE_WORDS and _BOILERPLATE.search(line.lower()):
        return "boilerplate"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    covered = bytearray(len(words))
    for place, window in enumerate(windows):
        if times[window] > 1:
            covered[place : place + 3] = b"\1\1\1"
    return sum(covered)


def judge(text: str | None) -> Judged:
    """Clean one text line by line and say whether enough of it is left."""
    lines = (text or "").split("\n")
    left, with_words, all_words = [], [], []
    lost = chars = symbols = 0
    for line in lines:
        # Splitting bytes knows the six ASCII spaces and no other.
        coded = line.encode()
        words = coded.split()
        if not words:  # layout
            left.append(line)
            continue
        line_chars = len(line) - (len(coded) - len(coded.translate(None, _SPACE_BYTES)))
        line_symbols = len(coded) - len(coded.translate(None, _SYMBOL_BYTES))
        with_words.append(line)
        all_words += words
        chars += line_chars
        symbols += line_symbols
        if failed_rule(line, words, line_chars, line_symbols):
            lost += line_chars
        else:
            left.append(line)
    repeated = repeated_words(all_words)
    base_failed = len(all_words) < MIN_WORDS or repeated * 100 > len(all_words) * REPEAT_SHARE
    return Judged(
        clean_text="\n".join(left),
        n_lines=len(lines),
        n_failed_lines=len(lines) - len(left),
        lost_chars=lost,
        n_words=len(all_words),
        word_chars=chars,
        n_symbols=symbols,
        n_dup_lines=len(with_words) - len(set(with_words)),
        n_repeat_words=repeated,
        base_failed=base_failed,
        kept=not base_failed and lost * 100 <= chars * LOST_SHARE,
    )


def clean_lines(text: Column, once: bool = False) -> Column:
    """A struct of the cleaned text, the counts it is judged by, and the verdict; its
    fields are those of ``Judged``.

    A null text counts as empty: no words, so it fails and is not kept. A text of any
    length is one row of work; nothing crosses rows, so repeated rows, ties and other
    columns do not matter, and an empty table gives an empty result. Lines without a
    word stay as layout, and the order of lines is kept.

    With ``once`` the planner may not copy the call into a filter on its result. A copy
    does all the work again, in a second Python worker for each task.
    """

    @F.arrow_udf(_SPARK)
    def judged(texts: pa.Array) -> pa.Array:
        columns = zip(*(judge(t.as_py()) for t in texts))
        arrays = [pa.array(c, f.type) for c, f in zip(columns, _ARROW)]
        return pa.StructArray.from_arrays(arrays, fields=list(_ARROW)) if arrays else pa.array([], _ARROW)

    return (judged.asNondeterministic() if once else judged)(text)
