"""Character classes and pre-token patterns for Python's ``re``.

Built from the Unicode database by rule, because ``\\s`` and ``\\w`` of ``re`` hold
other characters than the classes ``\\s``, ``\\p{L}`` and ``\\p{N}`` of the
tokenizer libraries.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache
from itertools import groupby

import public_tokenizers


def _ranges(initial: str) -> str:
    """The characters whose category starts with ``initial``, as ranges of a class."""
    runs = groupby(range(0x110000), lambda c: unicodedata.category(chr(c))[0] == initial)
    found = []
    for inside, run in runs:
        if inside:
            codes = list(run)
            found.append(f"\\U{codes[0]:08x}-\\U{codes[-1]:08x}")
    return "".join(found)


# The characters of the White_Space property.
_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _translated(pattern: str) -> re.Pattern:
    """A library's pattern with its classes spelled out for ``re``."""
    letters, numbers = _ranges("L"), _ranges("N")
    pattern = pattern.replace("(?!\\S)", f"(?![^{_SPACES}])")
    pattern = pattern.replace("[^\\s\\p{L}\\p{N}]", f"[^{_SPACES}{letters}{numbers}]")
    pattern = pattern.replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "\\p{N}")
    pattern = pattern.replace("\\p{L}", f"[{letters}]").replace("\\p{N}", f"[{numbers}]")
    return re.compile(pattern.replace("\\s", f"[{_SPACES}]"))


@cache
def byte_level() -> re.Pattern:
    """The split before the merges of the byte-level vocabularies."""
    return _translated(public_tokenizers.PATTERN)


@cache
def word_level(pattern: str) -> re.Pattern:
    return _translated(pattern)


@cache
def byte_letters() -> str:
    """The letter that a byte-level vocabulary file writes for each byte.

    Fixed rule of that file format: a visible Latin-1 character stands for itself,
    any other byte for the next character from U+0100 on.
    """
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return "".join(chr(b if b in visible else next(hidden)) for b in range(256))
