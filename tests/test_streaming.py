import json

import pytest

from rivulet.sources import json_items
from rivulet.streaming import append_records, stream_landed_files


def test_each_landed_file_is_written_once(spark, tmp_path):
    landed, out, state = tmp_path / "landed", tmp_path / "out", tmp_path / "state"
    landed.mkdir()

    def parse(bodies):
        items = json_items(bodies, "$.posts").filter(["score > 10"])
        return items.regex("title", "^", replacement="> ").transform(["drop junk"])

    def run():
        bodies = stream_landed_files(spark, str(landed))
        append_records(bodies, parse, str(out), str(state)).awaitTermination()
        lines = spark.read.text(str(out)).collect()
        return sorted((json.loads(r[0]) for r in lines), key=lambda r: r["score"])

    (landed / "1.json").write_text(
        json.dumps({"posts": [{"title": "a", "score": 11, "junk": 1}, {"title": "b", "score": 1}]})
    )
    assert run() == [{"title": "> a", "score": 11}]
    (landed / "2.json").write_text(json.dumps({"posts": [{"title": "c", "score": 12}]}))
    assert run() == [{"title": "> a", "score": 11}, {"title": "> c", "score": 12}]
    assert len(run()) == 2


def test_steps_over_the_whole_input_are_refused(spark, tmp_path):
    items = json_items(stream_landed_files(spark, str(tmp_path)))
    for step in (
        lambda: items.sort("a"),
        lambda: items.limit(1),
        lambda: items.tail(1),
        lambda: items.reverse(),
        lambda: items.unique("a"),
    ):
        with pytest.raises(ValueError, match="cannot run on a stream"):
            step()
