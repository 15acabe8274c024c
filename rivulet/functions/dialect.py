"""Patterns and replacements of the linear-time regex dialect, for Spark.

Pipelines written for that dialect differ from java.util.regex in a few places:
named groups ``(?P<n>...)``, ``$`` meaning only the very end, Unicode classes by
default, no look-around or backreferences, ``$name`` in replacements. The
translation is a single left-to-right rewrite on the driver; matching itself is
Spark's ``rlike`` / ``regexp_replace`` / ``regexp_extract``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

# ASCII members of the bracketed POSIX classes.
POSIX = {
    "alnum": "0-9A-Za-z",
    "alpha": "A-Za-z",
    "ascii": r"\x00-\x7F",
    "blank": r"\t ",
    "cntrl": r"\x00-\x1F\x7F",
    "digit": "0-9",
    "graph": "!-~",
    "lower": "a-z",
    "print": " -~",
    "punct": r"!-/:-@\[-`{-~",
    "space": r"\t\n\x0B\f\r ",
    "upper": "A-Z",
    "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}

# Escapes spelled differently in java.util.regex.
ESCAPES = {r"\v": r"\x0B", r"\<": r"(?:\b(?=\w))", r"\>": r"(?:\b(?<=\w))", r"\z": r"\z"}

_TOKEN = re.compile(
    r"""
    (?P<named>\(\?P?<(?P<name>[A-Za-z_][A-Za-z0-9_.\[\]]*)>)
  | (?P<flags>\(\?(?P<on>[a-zA-Z]*)(?P<off>-[a-zA-Z]+)?(?P<close>[:)]))
  | (?P<look>\(\?(?:[=!>]|<[=!]))
  | (?P<brace>\\[xuU]\{(?P<code>[0-9A-Fa-f]+)\})
  | (?P<wide>\\U(?P<wide_code>[0-9A-Fa-f]{8}))
  | (?P<prop>\\(?P<prop_kind>[pP])(?:\{(?P<prop_name>[^}]*)\}|(?P<prop_letter>[A-Za-z])))
  | (?P<boundary>\\[bB]\{)
  | (?P<escape>\\.)
  | (?P<posix>\[:(?P<posix_not>\^?)(?P<posix_name>[a-z]+):\])
  | (?P<repeat>(?:[*+?]|\{[0-9]+(?:,[0-9]*)?\})\??)
  | (?P<char>.)
    """,
    re.X | re.S,
)


@dataclass(frozen=True)
class Pattern:
    java: str
    groups: dict[str, int]
    count: int


def bad(source: str, reason: str) -> ValueError:
    return ValueError(f"bad regex `{source}`: {reason}")


@lru_cache(maxsize=1024)
def spark_pattern(source: str) -> Pattern:
    """Translate and check a pattern; ``ValueError`` names what is wrong."""
    out: list[str] = []
    names: dict[str, int] = {}
    count = 0
    class_depth = 0
    modes = [""]  # m and x as they hold in each open group
    after_repeat = False
    at = 0

    while at < len(source):
        if "x" in modes[-1] and (source[at].isspace() or source[at] == "#" and not class_depth):
            line_end = source.find("\n", at)
            at = at + 1 if source[at].isspace() else (line_end + 1 or len(source))
            continue
        token = _TOKEN.match(source, at)
        at, text = token.end(), token.group()
        kind = next(k for k in _KINDS if token.group(k) is not None)
        repeats = False
        if class_depth:
            if kind == "posix":
                members = POSIX.get(token["posix_name"])
                if members is None:
                    raise bad(source, f"unknown class `{text}`")
                out.append(f"[{token['posix_not']}{members}]")
            elif text in (r"\<", r"\>"):
                out.append(text[1])
            elif kind in ("escape", "brace", "wide", "prop"):
                out.append(_escape(source, token, kind))
            elif kind in ("boundary", "named", "flags", "look", "repeat"):
                out.append(text)
            else:
                if text in "-~" and out[-1] == text:
                    raise bad(source, f"class operator `{text}{text}` is not supported")
                class_depth += {"[": 1, "]": -1}.get(text, 0)
                if text == "]" and out[-1] in ("[", "[^"):
                    class_depth += 1  # a leading ] is a member
                    text = r"\]"
                elif text == "^" and out[-1] == "[":
                    out.pop()
                    text = "[^"
                out.append(text)
            after_repeat = False
            continue
        if kind == "named":
            if token["name"] in names:
                raise bad(source, f"duplicate group name `{token['name']}`")
            count += 1
            names[token["name"]] = count
            modes.append(modes[-1])
            out.append("(")
        elif kind == "flags":
            on, off = token["on"], token["off"] or ""
            if set(on + off[1:]) - set("imsxu") or "u" in off:
                raise bad(source, f"flags `{text}` are not supported")
            mode = "".join(
                flag for flag in "mx" if flag in modes[-1] + on and flag not in off
            )
            if token["close"] == ":":
                modes.append(mode)
            else:
                modes[-1] = mode
            # m is spelled out at ^ and $, x is resolved here, u is always on.
            on, off = re.sub("[mxu]", "", on), re.sub("[mxu]", "", off).rstrip("-")
            if on or off or token["close"] == ":":
                out.append(f"(?{on}{off}{token['close']}")
        elif kind == "look":
            raise bad(source, "look-around and atomic groups are not supported")
        elif kind == "boundary":
            raise bad(source, f"`{text}` is not supported")
        elif kind in ("escape", "brace", "wide", "prop"):
            out.append(_escape(source, token, kind))
        elif kind == "posix":
            raise bad(source, f"`{text}` outside a character class")
        elif kind == "repeat":
            if after_repeat:
                raise bad(source, "stacked repetition is not supported")
            repeats = True
            out.append(text)
        elif text == "(":
            count += 1
            modes.append(modes[-1])
            out.append(text)
        elif text == ")":
            if len(modes) == 1:
                raise bad(source, "unopened group")
            modes.pop()
            out.append(text)
        elif text == "[":
            class_depth = 1
            out.append(text)
        elif text == "$":
            out.append(r"(?![^\n])" if "m" in modes[-1] else r"\z")
        elif text == "^":
            out.append(r"(?<![^\n])" if "m" in modes[-1] else r"\A")
        else:
            out.append(text)
        after_repeat = repeats
    if class_depth:
        raise bad(source, "unclosed character class")
    # d: only \n ends a line. U: Unicode classes and case folding.
    java = "(?dU)" + "".join(out)
    _check(source, java)
    return Pattern(java, names, count)


_KINDS = (
    "named", "flags", "look", "brace", "wide", "prop", "boundary", "escape",
    "posix", "repeat", "char",
)


def _escape(source: str, token: re.Match, kind: str) -> str:
    if kind == "brace":
        return rf"\x{{{token['code']}}}"
    if kind == "wide":
        return rf"\x{{{token['wide_code'].lstrip('0') or '0'}}}"
    if kind == "prop":
        name = token["prop_name"] or token["prop_letter"]
        positive = (token["prop_kind"] == "p") != name.startswith("^")
        name = name.removeprefix("^")
        if len(name) > 2 and "=" not in name:
            name = "Is" + name
        return rf"\{'p' if positive else 'P'}{{{name}}}"
    text = token.group()
    if text in ESCAPES:
        return ESCAPES[text]
    if text[1].isalnum() and text[1] not in "afnrtxuUdDsSwWbBA":
        raise bad(source, f"unrecognized escape `{text}`")
    return text


def _check(source: str, java: str) -> None:
    """Let Spark compile the pattern on an empty one-row query."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        spark.sql("SELECT regexp_like('', :p)", args={"p": java}).collect()
    except PySparkException as problem:
        reason = str(problem).splitlines()[0]
        raise bad(source, reason) from None


_REFERENCE = re.compile(r"\$(?:\$|\{([^}]*)\}|([0-9A-Za-z_]+))")


def spark_replacement(pattern: Pattern, replacement: str) -> str:
    """Expand ``$1``, ``$name``, ``${name}`` and ``$$`` for regexp_replace. The
    longest run of word characters after ``$`` is the name; a group that does
    not exist stands for nothing."""
    out: list[str] = []
    last = 0
    after_reference = False

    def literal(text: str) -> None:
        nonlocal after_reference
        if not text:
            return
        escaped = re.sub(r"([\\$])", r"\\\1", text)
        if after_reference and escaped[0].isdigit():
            escaped = "\\" + escaped  # keep it out of the group number
        out.append(escaped)
        after_reference = False

    for found in _REFERENCE.finditer(replacement):
        literal(replacement[last : found.start()])
        last = found.end()
        name = found[1] if found[1] is not None else found[2]
        if name is None:
            literal("$")
            continue
        index = int(name) if name.isdecimal() else pattern.groups.get(name)
        if index is not None and index <= pattern.count:
            out.append(f"${index}")
            after_reference = True
    literal(replacement[last:])
    return "".join(out)
