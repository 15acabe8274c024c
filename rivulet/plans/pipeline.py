"""A pipeline description composed into lazy DataFrames.

A pipeline is a list of nodes (kind and arguments) and of wires between them.
Composing it calls the step behind each node once, upstream first; Spark plans
and runs the result. Nothing is scheduled here.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from pathlib import Path
from time import perf_counter
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from rivulet import sources
from rivulet.functions.cards import cards
from rivulet.items import Items
from rivulet.operators import (
    filter_items,
    limit,
    regex,
    reverse,
    sort,
    tail,
    transform,
    union,
    unique,
)
from rivulet.plans.params import Param, expand, references, resolve
from rivulet.sinks import write_document, write_records
from rivulet.sinks.documents import CHANNEL_DESCRIPTION, check_format

FORMAT_VERSION = 1


class PipelineError(ValueError):
    """Every problem of a pipeline, together."""

    def __init__(self, problems: list[str]):
        super().__init__("\n".join(problems))
        self.problems = problems


@dataclass
class Context:
    """What a run reads: the clock and where each source url has landed.

    ``sources`` maps a url to items, to a ``(url, body)`` DataFrame or to a file
    path. ``landed`` is one ``(url, body)`` table that holds all other urls.
    """

    spark: SparkSession
    now: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    sources: Mapping[str, Items | DataFrame | str] = field(default_factory=dict)
    landed: DataFrame | None = None

    def source(self, url: str | None, parse: Callable[[DataFrame], Items]) -> Items:
        if url is None:
            raise ValueError("a source needs `url`")
        found = self.sources.get(url)
        if isinstance(found, Items):
            return found
        if isinstance(found, str):
            found = sources.landed_files(self.spark, found)
        if found is None and self.landed is not None:
            found = self.landed.where(F.col("url") == url)
        if found is None:
            raise ValueError(f"no body of {url} has landed")
        return parse(found)


@dataclass(frozen=True)
class Step:
    """A node kind: ``call(context, inputs, arguments)`` and how many wires it
    takes (``none``, ``one`` or ``many``). References are not expanded in the
    ``verbatim`` arguments."""

    call: Callable[[Context, list[Items], dict], Items]
    wires: str = "one"
    verbatim: frozenset[str] = frozenset()


def _feed(ctx: Context, _: list[Items], args: dict) -> Items:
    return ctx.source(args.get("url"), sources.feed_items)


def _json(ctx: Context, _: list[Items], args: dict) -> Items:
    path = args.get("path")
    return ctx.source(args.get("url"), lambda bodies: sources.json_items(bodies, path))


def _csv(ctx: Context, _: list[Items], args: dict) -> Items:
    return ctx.source(args.get("url"), sources.csv_items)


def _filter(ctx: Context, inputs: list[Items], args: dict) -> Items:
    rules = args.get("rules")
    if rules is not None and not isinstance(rules, list):
        raise ValueError("`rules` is a list of rule texts")
    mode, match = args.get("mode", "permit"), args.get("match", "all")
    return filter_items(inputs[0], rules, mode, match, ctx.now)


def _regex(_: Context, inputs: list[Items], args: dict) -> Items:
    return regex(
        inputs[0],
        args.get("field"),
        args.get("pattern"),
        args.get("mode", "replace"),
        args.get("replacement", ""),
    )


def _transform(_: Context, inputs: list[Items], args: dict) -> Items:
    ops = args.get("ops")
    if ops is not None and not isinstance(ops, list):
        raise ValueError("`ops` is a list of texts")
    return transform(inputs[0], ops)


def _sort(_: Context, inputs: list[Items], args: dict) -> Items:
    order, compare = args.get("order", "asc"), args.get("compare", "auto")
    return sort(inputs[0], args.get("by"), order, compare)


STEPS: dict[str, Step] = {
    "fetch_feed": Step(_feed, "none"),
    "fetch_json": Step(_json, "none"),
    "fetch_csv": Step(_csv, "none"),
    "filter": Step(_filter),
    "regex": Step(_regex, verbatim=frozenset({"replacement"})),
    "transform": Step(_transform),
    "sort": Step(_sort),
    "limit": Step(lambda _, inputs, args: limit(inputs[0], args.get("n"))),
    "tail": Step(lambda _, inputs, args: tail(inputs[0], args.get("n"))),
    "reverse": Step(lambda _, inputs, args: reverse(inputs[0])),
    "unique": Step(lambda _, inputs, args: unique(inputs[0], args.get("by"))),
    "union": Step(lambda _, inputs, args: union(inputs), "many"),
    "output": Step(lambda _, inputs, args: inputs[0]),
}


def register_step(kind: str, call: Callable[[Items], Items]) -> None:
    """Add a node kind that maps items to items."""
    STEPS[kind] = Step(lambda _, inputs, args: call(inputs[0], **args))


@dataclass(frozen=True)
class Node:
    id: int
    kind: str
    args: dict


@dataclass(frozen=True)
class Wire:
    source: int
    target: int


@dataclass
class NodeResult:
    node: Node
    status: str  # ok, failed or unready
    items: Items | None = None
    error: str | None = None
    observed: Observation | None = None


@dataclass(frozen=True)
class Pipeline:
    name: str
    nodes: tuple[Node, ...] = ()
    wires: tuple[Wire, ...] = ()
    params: tuple[Param, ...] = ()

    # --- building ----------------------------------------------------------

    @staticmethod
    def from_dict(spec: Mapping[str, Any]) -> Pipeline:
        """From the JSON form: name, params, nodes and edges between ports."""
        version = spec.get("version", FORMAT_VERSION)
        if version != FORMAT_VERSION:
            raise PipelineError([f"format version {version} is not supported"])
        problems, wires = [], []
        for edge in spec.get("edges", []):
            source, target = edge["from"], edge["to"]
            if source["port"] != "out":
                problems.append(f"node #{source['node']} has no output port `{source['port']}`")
            if target["port"] != "in":
                problems.append(f"node #{target['node']} has no input port `{target['port']}`")
            wires.append(Wire(source["node"], target["node"]))
        if problems:
            raise PipelineError(problems)
        return Pipeline(
            spec["name"],
            tuple(Node(n["id"], n["kind"], dict(n.get("params", {}))) for n in spec["nodes"]),
            tuple(wires),
            tuple(Param(p["name"], p["kind"], p.get("default")) for p in spec.get("params", [])),
        )

    @staticmethod
    def load(path: str) -> Pipeline:
        return Pipeline.from_dict(json.loads(Path(path).read_text(encoding="utf-8")))

    def add(self, kind: str, *inputs: int, **args) -> Pipeline:
        """A copy with one more node, wired to ``inputs`` in that order. Nodes
        are numbered from 1 as they are added."""
        node = Node(max((n.id for n in self.nodes), default=0) + 1, kind, args)
        wires = tuple(Wire(source, node.id) for source in inputs)
        return replace(self, nodes=self.nodes + (node,), wires=self.wires + wires)

    # --- checking ----------------------------------------------------------

    def inputs_of(self, node_id: int) -> list[int]:
        return [w.source for w in self.wires if w.target == node_id]

    def output_node(self) -> Node | None:
        return next((n for n in self.nodes if n.kind == "output"), None)

    def problems(self) -> list[str]:
        """What makes the pipeline unusable whatever its inputs. A wire that is
        still missing is not among them: only that node is unready then."""
        found = []
        by_id = {n.id: n for n in self.nodes}
        if len(by_id) < len(self.nodes):
            found.append("duplicate node ids")
        declared = {p.name for p in self.params}
        for node in self.nodes:
            step = STEPS.get(node.kind)
            if step is None:
                found.append(f"node #{node.id}: no step is called `{node.kind}`")
                continue
            args = {k: v for k, v in node.args.items() if k not in step.verbatim}
            try:
                undeclared = sorted(references(args) - declared)
            except ValueError as problem:
                found.append(f"node #{node.id}: {problem}")
                continue
            found += [
                f"node #{node.id}: names the param `${{{name}}}`, which is not declared"
                for name in undeclared
            ]
        for wire in self.wires:
            if wire.source not in by_id or wire.target not in by_id:
                found.append(f"wire #{wire.source} -> #{wire.target} ends at no node")
        for target, count in Counter(w.target for w in self.wires).items():
            step = STEPS.get(by_id[target].kind) if target in by_id else None
            if step and step.wires == "none":
                found.append(f"node #{target}: `{by_id[target].kind}` is a source, so no wire leads to it")
            elif step and step.wires == "one" and count > 1:
                found.append(f"node #{target} takes one wire, not {count}")
        cyclic = self._node_on_cycle()
        if cyclic is not None:
            found.append(f"the wires form a circle through node #{cyclic}")
        return found

    def _node_on_cycle(self) -> int | None:
        done: set[int] = set()

        def visit(node_id: int, path: frozenset[int]) -> int | None:
            if node_id in path:
                return node_id
            if node_id in done:
                return None
            for source in self.inputs_of(node_id):
                hit = visit(source, path | {node_id})
                if hit is not None:
                    return hit
            done.add(node_id)
            return None

        hits = (visit(n.id, frozenset()) for n in self.nodes)
        return next((hit for hit in hits if hit is not None), None)

    # --- composing ---------------------------------------------------------

    def compose(
        self,
        context: Context,
        params: Mapping[str, Any] | None = None,
        upto: int | None = None,
        observe: bool = False,
        persist_shared: bool = False,
    ) -> Composition:
        """Call every step (or only those that feed node ``upto``). No job runs.

        ``observe`` counts each node's items as they stream by in whatever job
        runs next. ``persist_shared`` keeps the output of nodes that feed several
        others, so that they are computed once.
        """
        problems = self.problems()
        if problems:
            raise PipelineError(problems)
        bound = resolve(self.params, params)
        composition = Composition(self, context)
        fan_out = Counter(w.source for w in self.wires)
        results = composition.results

        def visit(node: Node) -> NodeResult:
            if node.id not in results:
                upstream = [visit(self._node(i)) for i in self.inputs_of(node.id)]
                results[node.id] = self._run_step(node, upstream, context, bound, observe)
                result = results[node.id]
                if persist_shared and result.items and fan_out[node.id] > 1:
                    kept = result.items.df.persist(StorageLevel.MEMORY_AND_DISK)
                    composition.persisted.append(kept)
                    result.items = result.items.with_df(kept)
            return results[node.id]

        for node in self.nodes if upto is None else [self._node(upto)]:
            visit(node)
        return composition

    def _node(self, node_id: int) -> Node:
        for node in self.nodes:
            if node.id == node_id:
                return node
        raise ValueError(f"no node #{node_id}")

    def _run_step(
        self,
        node: Node,
        upstream: list[NodeResult],
        context: Context,
        bound: Mapping[str, Any],
        observe: bool,
    ) -> NodeResult:
        step = STEPS[node.kind]
        if step.wires != "none" and not upstream:
            return NodeResult(node, "unready", error="no wire leads to its input")
        for source in upstream:
            if source.status != "ok":
                why = f"node #{source.node.id} before it has no result"
                return NodeResult(node, "unready", error=why)
        try:
            args = {
                k: v if k in step.verbatim else expand(v, bound) for k, v in node.args.items()
            }
            items = step.call(context, [s.items for s in upstream], args)
            node = replace(node, args=args)
        except Exception as problem:  # whatever a step raises is that node's failure
            return NodeResult(node, "failed", error=str(problem) or type(problem).__name__)
        if not observe:
            return NodeResult(node, "ok", items)
        observed = Observation(f"node_{node.id}")
        counted = items.with_df(items.df.observe(observed, F.count(F.lit(1)).alias("items")))
        return NodeResult(node, "ok", counted, observed=observed)

    def run(
        self,
        context: Context,
        params: Mapping[str, Any] | None = None,
        format: str | None = None,
        destination: str | None = None,
        mode: str = "errorifexists",
    ) -> Composition:
        """Compose and write, or fail before anything is written.

        The caller's format and destination outrank the output node's, which
        outrank RSS and no destination; without one nothing is written and
        ``output`` holds the items. Nodes that feed no output are run too, since
        their failure fails the run. The output of nodes that feed several others
        is kept for the run, so that they are computed once.
        """
        composition = self.compose(context, params, persist_shared=True)
        try:
            return self._run(composition, format, destination, mode)
        finally:
            composition.close()

    def _run(
        self, composition: Composition, format: str | None, destination: str | None, mode: str
    ) -> Composition:
        composition.require_ok()
        settings = composition.output_settings(format, destination)
        loose = {n.id for n in self.nodes} - {w.source for w in self.wires}
        for node_id in sorted(loose - {self.output_node().id}):
            composition.items(node_id).df.write.format("noop").mode("overwrite").save()
        if settings["destination"]:
            composition.write(**settings, mode=mode)
        return composition


def _observed_items(result: NodeResult) -> int | None:
    """What a pass that has ended counted. Spark leaves plans that it knows to be empty
    out of a pass, and what feeds them with it: those are counted by themselves."""
    if result.observed is None:
        return None
    try:
        return result.observed.get["items"]
    except Py4JJavaError as problem:
        if "AssertionError" not in str(problem.java_exception):
            raise
        return result.items.df.count()


@dataclass
class Composition:
    """The items of every node of one pipeline."""

    pipeline: Pipeline
    context: Context
    results: dict[int, NodeResult] = field(default_factory=dict)
    persisted: list[DataFrame] = field(default_factory=list)

    def items(self, node_id: int) -> Items:
        result = self.results[node_id]
        if result.items is None:
            raise ValueError(f"node #{node_id} ({result.node.kind}): {result.error}")
        return result.items

    def require_ok(self) -> None:
        failed = [r for r in self.results.values() if r.status != "ok"]
        if failed:
            raise PipelineError(
                [f"node #{r.node.id} ({r.node.kind}): {r.error}" for r in failed]
            )
        if self.pipeline.output_node() is None:
            raise PipelineError(["no node of the pipeline is an output"])

    @property
    def output(self) -> Items:
        self.require_ok()
        return self.items(self.pipeline.output_node().id)

    def output_settings(self, format: str | None, destination: str | None) -> dict:
        args = self.results[self.pipeline.output_node().id].node.args
        return {
            "format": check_format(format or args.get("format") or "rss"),
            "destination": destination or args.get("destination") or None,
        }

    def write(self, format: str, destination: str, mode: str = "errorifexists") -> None:
        """One document as ordered part files under ``destination``."""
        title = self.pipeline.name
        write_document(self.output, destination, format, title, CHANNEL_DESCRIPTION, mode)

    def write_records(self, format: str, destination: str, mode: str = "errorifexists") -> None:
        write_records(self.output, destination, format, mode)

    def cards(self) -> Items:
        return cards(self.output, self.context.now)

    def report(self) -> list[dict]:
        """Status, error, item count and seconds per node. For an observed composition
        the counts come from one pass over each node that no other composed node reads;
        its seconds are those of the pass, which its upstream nodes share. A pass that
        fails marks its node ``failed``; nodes that only such a pass reaches have no
        count."""
        done, seconds = set(), {}
        for node_id in self._deepest():
            result = self.results[node_id]
            if result.observed is None:
                continue
            start = perf_counter()
            try:
                result.items.df.write.format("noop").mode("overwrite").save()
                done |= self._feeding(node_id)
            except Exception as problem:
                result.status, result.error = "failed", str(problem)
            seconds[node_id] = perf_counter() - start
        return [
            {
                "node": node_id,
                "kind": result.node.kind,
                "status": result.status,
                "error": result.error,
                "items": _observed_items(result) if node_id in done else None,
                "seconds": seconds.get(node_id),
            }
            for node_id, result in sorted(self.results.items())
        ]

    def _deepest(self) -> list[int]:
        """Composed nodes that feed no other composed node."""
        good = {i for i, r in self.results.items() if r.status == "ok"}
        return sorted(good - {w.source for w in self.pipeline.wires if w.target in good})

    def _feeding(self, node_id: int) -> set[int]:
        found, waiting = set(), [node_id]
        while waiting:
            here = waiting.pop()
            if here not in found:
                found.add(here)
                waiting += self.pipeline.inputs_of(here)
        return found

    def counts(self) -> DataFrame:
        """Item count per node as a lazy DataFrame."""
        merged = None
        for node_id, result in sorted(self.results.items()):
            if result.items is None:
                continue
            row = result.items.df.agg(F.count(F.lit(1)).alias("items")).select(
                F.lit(node_id).alias("node"), F.lit(result.node.kind).alias("kind"), "items"
            )
            merged = row if merged is None else merged.unionByName(row)
        return merged

    def close(self) -> None:
        for df in self.persisted:
            df.unpersist()
        self.persisted.clear()
