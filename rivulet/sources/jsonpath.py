"""Selecting the items of a JSON document by path, as array expressions.

Steps: ``.name``, ``.*``, ``..name``, ``..*``, ``[selectors]`` and ``..[selectors]``, where
selectors are names in quotes, indexes, slices ``a:b:c``, ``*`` and ``?test``, joined by
commas. Tests compare literals, queries from ``@`` (the node) or ``$`` (the document) that
name one place, and the functions ``length(value)``, ``count(query)`` and
``value(query)``; or they ask whether a query finds anything, or call
``match(value, 'pattern')`` and ``search(value, 'pattern')``. They combine with ``!``,
``&&``, ``||`` and parentheses. Each step maps an array of matches to an array of matches,
so a path costs no shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, functions as F

from rivulet.functions.dialect import spark_pattern
from rivulet.functions.views import let
from rivulet.items import variant_path
from rivulet.sources.jsonvalues import (
    COMPARISONS,
    Value,
    elements,
    has_text,
    length_of,
    literal_value,
    members,
    node_value,
    number_value,
)

_NAME = r"[A-Za-z_\u0080-\uffff][\w\u0080-\uffff]*"
_QUOTED = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
_INTEGER = r"-?(?:0|[1-9][0-9]*)"
_MEMBER = re.compile(rf"(?P<deep>\.\.|\.)(?:(?P<name>{_NAME})|(?P<every>\*))")
_OPENING = re.compile(r"(?P<deep>\.\.)?\[")
_SELECTOR = re.compile(
    rf"""\s*(?:(?P<quoted>{_QUOTED})
    | (?P<slice>(?P<start>{_INTEGER})?\s*:\s*(?P<stop>{_INTEGER})?\s*(?::\s*(?P<step>{_INTEGER})?)?)
    | (?P<index>{_INTEGER}) | (?P<every>\*) | (?P<test>\?))\s*""",
    re.X,
)
_TOKEN = re.compile(
    rf"""\s*(?:(?P<mark>&&|\|\||!(?!=)|\(|\)|,)
    | (?P<start>[@$])
    | (?P<op>==|!=|<=|>=|<|>)
    | (?P<call>[a-z][a-z0-9_]*)\(
    | (?P<value>-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|{_QUOTED}|true|false|null))""",
    re.X,
)
# Levels that ``..`` goes down before it looks whether there are more; then it goes on in
# spans that double, as far as Spark's JSON parser reads (what is deeper is no JSON to it).
DESCENT = 8
PARSED_DEPTH = 1000

Step = Callable[[Column], Column]
Test = Callable[[Column], Column]
# From a node and what is to be made of the value, which is computed once, to that.
WithValue = Callable[[Column, Callable[[Value], Column]], Column]


class _Operand(NamedTuple):
    """A part of a test by what it can serve as: a value to compare, a list of nodes, an
    answer. ``literal`` holds the value of a literal, in a tuple."""

    value: WithValue | None = None
    nodes: Step | None = None
    answer: Test | None = None
    literal: tuple | None = None


class _Reader:
    """A path and how far it has been read."""

    def __init__(self, path: str, root: Column | None):
        self.path, self.text, self.at, self.root = path, path.strip(), 1, root
        if not self.text.startswith("$"):
            raise self.problem("must start with `$`")

    def problem(self, what: str | None = None) -> ValueError:
        what = what or f"cannot read `{self.text[self.at:]}`"
        return ValueError(f"bad JSONPath `{self.path}`: {what}")

    def take(self, pattern: re.Pattern) -> re.Match | None:
        found = pattern.match(self.text, self.at)
        if found:
            self.at = found.end()
        return found

    def steps(self) -> list[Step]:
        found, _ = self.segments()
        if self.at < len(self.text):
            raise self.problem()
        return found

    def segments(self) -> tuple[list[Step], list[str | int] | None]:
        """The steps from here on, and the names and indexes that they consist of if
        they lead to one place at most."""
        found: list[Step] = []
        place: list[str | int] | None = []
        while True:
            member = self.take(_MEMBER)
            opening = None if member else self.take(_OPENING)
            if member:
                deep, step, part = member["deep"] == "..", _children, None
                if member["name"]:
                    step, part = _named(member["name"]), member["name"]
            elif opening:
                chosen = self.selectors()
                deep, step = bool(opening["deep"]), _joined([s for s, _ in chosen])
                part = chosen[0][1] if len(chosen) == 1 else None
            else:
                return found, place
            if deep:
                found.append(_descendants)
            found.append(step)
            place = None if place is None or deep or part is None else [*place, part]

    def selectors(self) -> list[tuple[Step, str | int | None]]:
        found = []
        while True:
            selector = self.take(_SELECTOR)
            if not selector:
                raise self.problem()
            found.append(self.selector(selector))
            mark = self.text[self.at : self.at + 1]
            self.at += 1
            if mark == "]":
                return found
            if mark != ",":
                self.at -= 1
                raise self.problem()

    def selector(self, found: re.Match) -> tuple[Step, str | int | None]:
        if found["quoted"]:
            name = self.unquoted(found["quoted"])
            return _named(name), name
        if found["slice"]:
            bounds = (int(found[part]) if found[part] else None for part in ("start", "stop", "step"))
            return _sliced(*bounds), None
        if found["index"]:
            return _indexed(int(found["index"])), int(found["index"])
        if found["every"]:
            return _children, None
        test = self.any_of()
        self.take(re.compile(r"\s*"))
        return (lambda nodes: F.filter(_children(nodes), lambda n: F.coalesce(test(n), F.lit(False)))), None

    def unquoted(self, text: str) -> str:
        """A quoted text with the escapes of JSON, and an escaped quote of its own kind."""
        inner = re.sub(r"""\\.|\"""", lambda m: {"\\'": "'", '"': '\\"'}.get(m.group(), m.group()), text[1:-1])
        try:
            return json.loads(f'"{inner}"', strict=False)
        except ValueError:
            raise self.problem(f"bad escape in {text}") from None

    # Tests, loosest first: a || b, a && b, !a, (a), comparison.

    def any_of(self) -> Test:
        tests = [self.all_of()]
        while self.mark("||"):
            tests.append(self.all_of())
        return lambda n: _folded(tests, n, lambda a, b: a | b)

    def all_of(self) -> Test:
        tests = [self.one()]
        while self.mark("&&"):
            tests.append(self.one())
        return lambda n: _folded(tests, n, lambda a, b: a & b)

    def one(self) -> Test:
        if self.mark("!"):
            test = self.one()
            return lambda n: ~test(n)
        if self.mark("("):
            test = self.any_of()
            if not self.mark(")"):
                raise self.problem()
            return test
        left = self.operand()
        op = self.token("op")
        if not op:
            if left.answer is None:
                raise self.problem("a test compares, or asks for a path")
            return left.answer
        first, second = self.value(left), self.value(self.operand())
        compare = COMPARISONS[op["op"]]
        return lambda n: first(n, lambda a: second(n, lambda b: compare(a, b)))

    def value(self, operand: _Operand) -> WithValue:
        if operand.value is None:
            raise self.problem("only a literal, a query for one place or a function with a value can be compared")
        return operand.value

    def operand(self) -> _Operand:
        start = self.token("start")
        if start:
            return self.query(start["start"] == "$")
        call = self.token("call")
        if call:
            return self.function(call["call"])
        found = self.token("value")
        if not found:
            raise self.problem()
        text = found["value"]
        held = self.unquoted(text) if text[0] in "'\"" else json.loads(text)
        return _Operand(value=lambda n, body: body(literal_value(held)), literal=(held,))

    def query(self, from_root: bool) -> _Operand:
        steps, place = self.segments()

        def start(node: Column) -> Column:
            return self.root if from_root else node

        def nodes(node: Column) -> Column:
            return _stepped(F.array(start(node)), steps)

        if place is None:
            return _Operand(nodes=nodes, answer=lambda n: F.size(nodes(n)) > 0)
        return _Operand(
            value=lambda n, body: let(_at(start(n), place), lambda found: body(node_value(found))),
            nodes=nodes,
            answer=lambda n: _at(start(n), place).isNotNull(),
        )

    def function(self, name: str) -> _Operand:
        given = [self.operand()]
        while self.mark(","):
            given.append(self.operand())
        if not self.mark(")"):
            raise self.problem()
        wanted = {"length": 1, "count": 1, "value": 1, "match": 2, "search": 2}.get(name)
        if wanted is None:
            raise self.problem(f"there is no function `{name}`")
        if len(given) != wanted:
            raise self.problem(f"`{name}` takes {wanted} argument{'s' * (wanted > 1)}")
        if name in ("count", "value"):
            nodes = given[0].nodes
            if nodes is None:
                raise self.problem(f"`{name}` takes a query")
            if name == "count":
                return _Operand(value=lambda n, body: body(number_value(F.size(nodes(n)))))
            only = lambda found: F.when(F.size(found) == 1, F.get(found, F.lit(0)))
            return _Operand(value=lambda n, body: let(let(nodes(n), only), lambda found: body(node_value(found))))
        value = self.value(given[0])
        if name == "length":
            return _Operand(
                value=lambda n, body: let(value(n, length_of), lambda size: body(number_value(size)))
            )
        if given[1].literal is None or not isinstance(given[1].literal[0], str):
            raise self.problem(f"the pattern of `{name}` is a text in quotes")
        pattern = given[1].literal[0]
        try:
            java = spark_pattern(f"^(?:{pattern})$" if name == "match" else pattern).java
        except ValueError as reason:
            raise self.problem(str(reason)) from None
        return _Operand(answer=lambda n: value(n, lambda v: has_text(v, java)))

    def token(self, kind: str) -> re.Match | None:
        found = _TOKEN.match(self.text, self.at)
        if found is None or found[kind] is None:
            return None
        self.at = found.end()
        return found

    def mark(self, text: str) -> bool:
        found = _TOKEN.match(self.text, self.at)
        if found is None or found["mark"] != text:
            return False
        self.at = found.end()
        return True


def _folded(tests: list[Test], node: Column, join: Callable[[Column, Column], Column]) -> Column:
    result = tests[0](node)
    for test in tests[1:]:
        result = join(result, test(node))
    return result


def parse_path(path: str, root: Column | None = None) -> list[Step]:
    """The steps of a path over the document ``root``; ``ValueError`` if it is malformed
    or unsupported, which can be asked without a document."""
    return _Reader(path, root).steps()


def _stepped(nodes: Column, steps: list[Step]) -> Column:
    for step in steps:
        nodes = step(nodes)
    return nodes


def _at(node: Column, place: list[str | int]) -> Column:
    """What names and indexes lead to, NULL if nothing is there."""
    names: list[str] = []
    for part in [*place, None]:
        if isinstance(part, str):
            names.append(part)
            continue
        if names:
            node, names = F.try_variant_get(node, variant_path(names), "variant"), []
        if part is not None:
            node = _element(node, part)
    return node


def _named(name: str) -> Step:
    where = variant_path([name])
    return lambda nodes: F.array_compact(
        F.transform(nodes, lambda n: F.try_variant_get(n, where, "variant"))
    )


def _element(node: Column, index: int) -> Column:
    place = lambda values: F.lit(index) if index >= 0 else F.size(values) + index
    return let(elements(node), lambda values: F.get(values, place(values)))


def _indexed(index: int) -> Step:
    return lambda nodes: F.array_compact(F.transform(nodes, lambda n: _element(n, index)))


def _children(nodes: Column) -> Column:
    return F.flatten(
        F.transform(nodes, lambda n: F.coalesce(elements(n), F.map_values(members(n)), _nothing()))
    )


def _joined(selectors: list[Step]) -> Step:
    """What each selector finds in a node, one selector after the other."""
    if len(selectors) == 1:
        return selectors[0]
    return lambda nodes: F.flatten(
        F.transform(nodes, lambda n: F.concat(*(select(F.array(n)) for select in selectors)))
    )


def _sliced(start: int | None, stop: int | None, step: int | None) -> Step:
    step = 1 if step is None else step

    def bound(value: int | None, size: Column, default: Column, low: int, above: int) -> Column:
        if value is None:
            return default
        place = F.lit(value) if value >= 0 else size + value
        return F.least(F.greatest(place, F.lit(low)), size + above)

    def pick(node: Column) -> Column:
        values = elements(node)
        size = F.size(values)
        if step > 0:
            first = bound(start, size, F.lit(0), 0, 0)
            last = bound(stop, size, size, 0, 0)
            places = F.filter(F.transform(values, lambda _, i: i), lambda i: (i >= first) & (i < last) & ((i - first) % step == 0))
        else:
            first = bound(start, size, size - 1, -1, -1)
            last = bound(stop, size, F.lit(-1), -1, -1)
            places = F.reverse(
                F.filter(F.transform(values, lambda _, i: i), lambda i: (i <= first) & (i > last) & ((first - i) % -step == 0))
            )
        return F.coalesce(F.transform(places, lambda i: F.get(values, i)), _nothing())

    return (lambda nodes: F.filter(nodes, lambda _: F.lit(False))) if step == 0 else (
        lambda nodes: F.flatten(F.transform(nodes, pick))
    )


def _nothing() -> Column:
    return F.array().cast("array<variant>")


def _descendants(nodes: Column) -> Column:
    """The nodes and everything below, each right before what it holds. Levels are
    gathered one by one with the way to each node, then put in the order of the ways."""

    def start(node: Column, i: Column) -> Column:
        return F.struct(F.array(i.cast("int")).alias("way"), node.alias("node"))

    def below(place: Column) -> Column:
        return F.transform(
            _children(F.array(place["node"])),
            lambda kid, i: F.struct(F.concat(place["way"], F.array(i.cast("int"))).alias("way"), kid.alias("node")),
        )

    def deeper(state: Column, _) -> Column:
        return let(
            F.flatten(F.transform(state["level"], below)),
            lambda kids: F.struct(F.concat(state["all"], kids).alias("all"), kids.alias("level")),
        )

    def further(state: Column, first: int, last: int) -> Column:
        gone = F.aggregate(F.sequence(F.lit(first), F.lit(last)), state, deeper)
        return F.when(F.size(state["level"]) == 0, state).otherwise(gone)

    def ordered(state: Column) -> Column:
        by_way = F.array_sort(
            state["all"], lambda a, b: F.when(a["way"] < b["way"], -1).when(a["way"] > b["way"], 1).otherwise(0)
        )
        return F.transform(by_way, lambda place: place["node"])

    first = F.transform(nodes, start)
    state, done = F.struct(first.alias("all"), first.alias("level")), 0
    while done <= PARSED_DEPTH:
        upto = max(2 * done, DESCENT)
        state = let(state, _spanning(further, done, upto - 1))
        done = upto
    return let(state, ordered)


def _spanning(further: Callable[[Column, int, int], Column], first: int, last: int) -> Step:
    return lambda state: further(state, first, last)


def select_elements(root: Column, path: str | None) -> Column:
    """The items of one document: an array root, or the one array a path lands
    on, gives its elements; otherwise every match is an item of its own."""
    steps = parse_path(path, root) if path and path.strip() else []
    return let(
        _stepped(F.array(root), steps),
        lambda found: F.coalesce(
            F.when(F.size(found) == 1, elements(F.get(found, F.lit(0)))), found
        ),
    )
