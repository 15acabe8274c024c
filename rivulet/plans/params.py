"""Run-time parameters of a pipeline and ``${name}`` references to them."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from rivulet.operators.rules import parse_float

# Parameter kinds.
KINDS = ("text", "url", "number")


class ParamError(ValueError):
    """Every problem with the parameters of a run, together."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


@dataclass(frozen=True)
class Param:
    name: str
    kind: str = "text"
    default: Any = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"param `{self.name}`: no such kind as `{self.kind}`; there are text, url and number")

    def coerce(self, raw: Any) -> Any:
        text = raw if isinstance(raw, str) else as_text(raw)
        if self.kind == "url" and "://" not in text:
            raise ValueError(f"`{text}` has no scheme, so it is no URL")
        if self.kind == "number":
            number = parse_float(text.strip())
            if number is None:
                raise ValueError(f"`{text}` is no number")
            return number
        return text


def as_text(value: Any) -> str:
    if isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")).replace("e+", "e")


def resolve(declared: Iterable[Param], overrides: Mapping[str, Any] | None = None) -> dict:
    """Values for every declared parameter: the override, else the default."""
    by_name = {param.name: param for param in declared}
    bound, problems = {}, []
    for name, raw in (overrides or {}).items():
        if name not in by_name:
            problems.append(f"no param is called `{name}`")
            continue
        try:
            bound[name] = by_name[name].coerce(raw)
        except ValueError as problem:
            problems.append(f"param `{name}`: {problem}")
    for name, param in by_name.items():
        if name in (overrides or {}):
            continue
        if param.default is None:
            problems.append(f"param `{name}` has no value")
        else:
            bound[name] = param.default
    if problems:
        raise ParamError(problems)
    return bound


_REFERENCE = re.compile(r"\$\{([^}]*)(\}?)")


def references(value: Any) -> set[str]:
    """Names referenced anywhere inside strings, lists and objects."""
    if isinstance(value, str):
        found = _REFERENCE.findall(value)
        if any(not closed for _, closed in found):
            raise ValueError(f"`${{` without its `}}` in `{value}`")
        return {name for name, _ in found}
    if isinstance(value, Mapping):
        return set().union(*map(references, value.values()))
    if isinstance(value, list | tuple):
        return set().union(*map(references, value))
    return set()


def expand(value: Any, bound: Mapping[str, Any]) -> Any:
    """Replace references. A string that is exactly one reference takes the value
    with its type; anywhere else the value is spliced in as text."""
    if isinstance(value, Mapping):
        return {key: expand(inner, bound) for key, inner in value.items()}
    if isinstance(value, list | tuple):
        return [expand(inner, bound) for inner in value]
    if not isinstance(value, str):
        return value
    for name in references(value):
        if name not in bound:
            raise ValueError(f"no param is called `{name}`")
    exact = _REFERENCE.fullmatch(value)
    if exact:
        return bound[exact[1]]
    return _REFERENCE.sub(lambda found: as_text(bound[found[1]]), value)
