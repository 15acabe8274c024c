import json

import pytest
from pyspark.errors import PySparkException

from conftest import NOW, column, rows
from rivulet.plans import Context, Param, ParamError, Pipeline, PipelineError, register_step
from rivulet.plans.params import expand, references, resolve
from rivulet.plans.pipeline import STEPS
from rivulet.sinks import document_text

PARAMS = (Param("url", "url"), Param("count", "number", 10), Param("tag", "text", "news"))


# --- parameters --------------------------------------------------------------


def test_overrides_beat_defaults():
    assert resolve(PARAMS, {"url": "s3://b/f"}) == {"url": "s3://b/f", "count": 10, "tag": "news"}
    assert resolve(PARAMS, {"url": "a://b", "count": " 5 ", "tag": "1"})["count"] == 5.0


def test_all_problems_are_reported_together():
    with pytest.raises(ParamError) as error:
        resolve(PARAMS, {"count": "many", "bogus": "x"})
    assert error.value.problems == [
        "param `count`: `many` is no number",
        "no param is called `bogus`",
        "param `url` has no value",
    ]
    with pytest.raises(ParamError, match="scheme"):
        resolve(PARAMS, {"url": "nope"})
    with pytest.raises(ValueError, match="date"):
        Param("x", "date")


def test_references_expand():
    bound = {"n": 10, "tag": "news", "f": 5.0}
    assert expand("${n}", bound) == 10
    assert expand("x > ${n} ${tag} ${f}", bound) == "x > 10 news 5.0"
    assert expand({"a": ["${n}", "${n}${tag}"], "b": 1}, bound) == {"a": [10, "10news"], "b": 1}
    assert references({"a": ["${x} ${y}", "${x}"]}) == {"x", "y"}
    for bad, part in [("${nope}", "`nope`"), ("a ${n", "a \\${n")]:
        with pytest.raises(ValueError, match=part):
            expand(bad, bound)


# --- structure ---------------------------------------------------------------

FEED = "https://x.dev/feed"
# A stock list: what is on the shelf, with the count in a note.
POSTS = [
    {"title": "Nails", "link": "1", "pubDate": "2025-03-01", "description": "left: 500 kg"},
    {"title": "Rope", "link": "2", "pubDate": "2025-03-10", "description": "left: 5 m"},
    {"title": "Paint", "link": "3", "pubDate": "2025-03-09", "description": "left: 120 l"},
    {"title": "Gift card", "link": "4", "pubDate": "2025-03-10"},
]


def context(make, **more) -> Context:
    return Context(make.spark, NOW, {FEED: make.dynamic(POSTS), **more})


def stock() -> Pipeline:
    """Low stock first, then everything by name, each article once."""
    return (
        Pipeline("stock", params=(Param("enough", "number", 100),))
        .add("fetch_feed", url=FEED)
        .add("regex", 1, field="description", pattern="left: (?P<left>[0-9]+) ", mode="extract")
        .add("filter", 2, rules=["left < ${enough}"])
        .add("sort", 1, by="title", compare="lexical")
        .add("union", 3, 4)
        .add("unique", 5, by="link")
        .add("output", 6, format="json", destination="")
    )


def test_compose(make):
    run = stock().compose(context(make))
    assert column(run.output, "title") == ["Rope", "Gift card", "Nails", "Paint"]
    more = stock().compose(context(make), {"enough": "121"})
    assert column(more.items(3), "title") == ["Rope", "Paint"]
    assert column(more.items(3), "left") == ["5", "120"]


def test_structure_problems():
    broken = (
        Pipeline("broken")
        .add("fetch_feed", 9, url="${nope}")
        .add("shuffle", 1)
        .add("filter", 1, 1, rules=["a > ${b"])
        .add("sort", 5, by="x")
        .add("limit", 4, n=1)
        .add("regex", 1, field="x", pattern="y", replacement="${group}")
    )
    found = "\n".join(broken.problems())
    for part in (
        "`shuffle`", "`${nope}`", "without its", "#9 -> #1",
        "`fetch_feed` is a source", "node #3 takes one wire, not 2", "circle through node #",
    ):
        assert part in found, part
    assert "group" not in found
    with pytest.raises(PipelineError):
        broken.compose(None)


def test_one_bad_node_leaves_the_others(make):
    pipeline = (
        stock()
        .add("sort", 1, by="title", order="sideways")
        .add("limit", 8, n=1)
        .add("unique", by="link")
    )
    run = pipeline.compose(context(make))
    states = {i: r.status for i, r in run.results.items()}
    assert [states[i] for i in (7, 8, 9, 10)] == ["ok", "failed", "unready", "unready"]
    assert len(rows(run.items(7))) == 4
    with pytest.raises(PipelineError, match=r"node #8 \(sort\): .*order"):
        run.output  # noqa: B018
    assert "#8" in run.results[9].error
    assert "wire" in run.results[10].error
    with pytest.raises(ValueError, match="node #9"):
        run.items(9)


def test_run_to_a_node_composes_only_what_feeds_it(make):
    run = stock().compose(context(make), upto=3)
    assert sorted(run.results) == [1, 2, 3]
    assert column(run.items(3), "title") == ["Rope"]


def test_counts_per_node(make):
    run = stock().compose(context(make), observe=True)
    report = {r["node"]: r["items"] for r in run.report()}
    assert report == {1: 4, 2: 4, 3: 1, 4: 4, 5: 5, 6: 4, 7: 4}
    lazy = {r["node"]: r["items"] for r in stock().compose(context(make)).counts().collect()}
    assert lazy == report


def test_report_of_failed_and_empty_nodes(make):
    def odd(items):
        raise RuntimeError("no such shelf")

    register_step("odd", odd)
    try:
        pipeline = (
            stock()
            .add("odd", 1)
            .add("output", 8)
            .add("filter", 1, rules=["nothing == 1"])
            .add("fetch_json", url="https://x.dev/bad")
        )
        bad = make.spark.createDataFrame([("u", "{bad")], "url string, body string")
        run = pipeline.compose(context(make, **{"https://x.dev/bad": bad}), observe=True)
        report = {r["node"]: r for r in run.report()}
    finally:
        del STEPS["odd"]
    assert [report[i]["status"] for i in (7, 8, 9, 10, 11)] == ["ok", "failed", "unready", "ok", "failed"]
    assert report[8]["error"] == "no such shelf" and "cannot parse JSON" in report[11]["error"]
    assert [report[i]["items"] for i in (1, 7, 8, 9, 10, 11)] == [4, 4, None, None, 0, None]
    assert report[7]["seconds"] > 0 and report[9]["seconds"] is None


def test_shared_nodes_are_kept(make):
    pipeline = (
        Pipeline("shared")
        .add("fetch_feed", url=FEED)
        .add("limit", 1, n=1)
        .add("tail", 1, n=1)
        .add("union", 2, 3)
        .add("output", 4)
    )
    run = pipeline.compose(context(make), persist_shared=True)
    assert len(run.persisted) == 1 and run.persisted[0].is_cached
    assert column(run.output, "title") == ["Nails", "Gift card"]
    run.close()
    assert not run.persisted


def test_run_writes_and_fails_whole(make, tmp_path):
    target = tmp_path / "out"
    run = stock().run(context(make), destination=str(target), format="rss")
    text = "".join(p.read_text() for p in sorted(target.glob("part-*")))
    assert "<title>stock</title>" in text and text.index("Rope") < text.index("Nails")
    assert run.output_settings(None, None) == {"format": "json", "destination": None}
    assert stock().run(context(make)).output.columns  # no destination: nothing is written

    missing = tmp_path / "missing"
    with pytest.raises(PipelineError, match="has landed"):
        stock().run(Context(make.spark, NOW), destination=str(missing))
    loose = stock().add("fetch_json", url="https://x.dev/bad")
    bad = make.spark.createDataFrame([("u", "{bad")], "url string, body string")
    with pytest.raises(PySparkException, match="cannot parse JSON"):
        loose.run(context(make, **{"https://x.dev/bad": bad}), destination=str(missing))
    with pytest.raises(PipelineError, match="output"):
        Pipeline("none").add("fetch_feed", url=FEED).run(context(make), destination=str(missing))
    with pytest.raises(ValueError, match="`xml`"):
        stock().run(context(make), destination=str(missing), format="xml")
    assert not missing.exists()


def test_output_arguments_are_expanded(make, tmp_path):
    pipeline = (
        Pipeline("p", params=(Param("fmt", "text", "csv"), Param("to", "text")))
        .add("fetch_feed", url=FEED)
        .add("output", 1, format="${fmt}", destination="${to}")
    )
    pipeline.run(context(make), {"to": str(tmp_path / "o")})
    assert "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*"))).startswith(
        "description,link,pubDate,title\n"
    )


def test_json_description_and_every_kind(make, tmp_path):
    """All kinds of node, described in JSON, over landed bodies."""
    spark = make.spark
    landed = spark.createDataFrame(
        [
            ("https://x.dev/j", json.dumps({"hits": [
                {"url": "j1", "points": 70, "objectID": "7"}, {"url": "3", "points": 900}]})),
            ("https://x.dev/c", "Name,Code\nAsia,AS\nEurope,EU\nAfrica,AF\nOceania,OC\n"),
        ],
        "url string, body string",
    )
    edge = lambda a, b: {"from": {"node": a, "port": "out"}, "to": {"node": b, "port": "in"}}
    kinds = [
        ("fetch_feed", {"url": "${url}"}),
        ("filter", {"rules": ["pubDate > now - 7d"], "mode": "permit", "match": "all"}),
        ("regex", {"field": "description", "pattern": r"left: (?<score>\d+)", "mode": "extract"}),
        ("filter", {"rules": ["score > ${min_score}"]}),
        ("fetch_json", {"url": "https://x.dev/j", "path": "$.hits"}),
        ("transform", {"ops": ["rename url link", "rename points score", "rename objectID guid"]}),
        ("reverse", {}),
        ("fetch_csv", {"url": "https://x.dev/c"}),
        ("transform", {"ops": ["rename Name title", "rename Code guid"]}),
        ("tail", {"n": 3}),
        ("union", {}),
        ("unique", {"by": "link"}),
        ("sort", {"by": "score", "order": "desc"}),
        ("limit", {"n": 25}),
        ("output", {"format": "rss", "destination": ""}),
    ]
    spec = {
        "version": 1,
        "name": "everything",
        "params": [
            {"name": "url", "kind": "url", "default": FEED},
            {"name": "min_score", "kind": "number", "default": 50},
        ],
        "nodes": [{"id": i, "kind": k, "params": p} for i, (k, p) in enumerate(kinds, 1)],
        "edges": [edge(*e) for e in [(1, 2), (2, 3), (3, 4), (5, 6), (6, 7), (8, 9), (9, 10), (4, 11),
                                     (7, 11), (10, 11), (11, 12), (12, 13), (13, 14), (14, 15)]],
        "next_id": 16,
    }
    path = tmp_path / "everything.json"
    path.write_text(json.dumps(spec))
    ctx = context(make)
    ctx.landed = landed
    run = Pipeline.load(str(path)).compose(ctx)
    got = [(r.get("title"), r.get("link"), r.get("score")) for r in rows(run.output)]
    assert got == [
        ("Paint", "3", "120"), (None, "j1", 70), ("Europe", None, None), ("Africa", None, None),
        ("Oceania", None, None),
    ]
    assert document_text(run.output, "rss", run.pipeline.name).count("<item>") == 5
    assert column(run.cards(), "age") == ["1d ago", "", "", "", ""]

    spec["version"] = 2
    with pytest.raises(PipelineError, match="version 2"):
        Pipeline.from_dict(spec)
    spec["version"] = 1
    spec["edges"][0]["from"]["port"] = "side"
    with pytest.raises(PipelineError, match="no output port `side`"):
        Pipeline.from_dict(spec)


def test_a_step_of_ones_own(make):
    register_step("shout", lambda items, by: items.regex(by, "$", replacement="!"))
    try:
        run = stock().add("shout", 1, by="title").compose(context(make), upto=8)
        assert column(run.items(8), "title") == ["Nails!", "Rope!", "Paint!", "Gift card!"]
    finally:
        del STEPS["shout"]
