"""Prompts, frame helpers and what surrounds a run, on small hand-made input."""

import json

import pytest
from pyspark.sql import functions as F

from wavesift.functions import prompts
from wavesift.operators import media
from wavesift.plans import runs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_few_shot_never_shows_itself(spark):
    docs = spark.createDataFrame([(n, f"t{n}") for n in range(6)], "id long, text string")
    rows = prompts.few_shot(docs, docs, "id", "text", 5).collect()
    assert all(sorted(r.examples) == sorted(f"t{n}" for n in range(6) if n != r.id) for r in rows)
    assert prompts.few_shot(docs, docs.limit(0), "id", "text", 2).first().examples in ([], None)


def test_turns_and_hooks(spark):
    turns = one(spark, prompts.as_turns("Be brief.", F.array(F.lit("e")), F.lit("q")))
    assert [(t.role, t.content) for t in turns] == [("system", "Be brief."), ("user", "e"), ("user", "q")]
    hooks = prompts.Hooks()
    hooks.add("Plain", "alias ")(lambda: F.lit("p"))
    assert one(spark, hooks[" ALIAS"]()) == "p"
    with pytest.raises(KeyError, match="plain"):
        hooks["other"]


def test_empty_prompts(spark):
    assert prompts.NONE_LISTED in one(spark, prompts.subtitled(F.lit("q"), F.array(F.lit("A")), F.array().cast("array<string>")))
    assert one(spark, prompts.with_examples("", F.array().cast("array<string>"), F.lit("q"))) == "q"


def test_frames(spark):
    assert one(spark, media.timestamps(F.lit(0.5), 4)) == []
    assert one(spark, media.loader_steps(F.lit(0.5), F.lit(30.0), 4)) is None
    assert one(spark, media.padded(F.array(F.lit(1), F.lit(2), F.lit(3)))) == [1, 2, 3, 3]
    assert one(spark, media.padded(F.array().cast("array<int>"))) == []
    assert one(spark, media.exactly(F.array(F.lit(2), F.lit(1)), 2)) == [1, 2]
    with pytest.raises(Exception, match="3 places are wanted"):
        one(spark, media.exactly(F.array(F.lit(2), F.lit(1)), 3))
    assert tuple(one(spark, media.closest_grid(F.lit(400), F.lit(400)))) == (1, 1)
    assert tuple(one(spark, media.closest_grid(F.lit(2000), F.lit(2000)))) == (2, 2)


def test_names_and_seeds(spark):
    assert one(spark, runs.first_existing(F.lit("a"), F.array(F.lit("a.mkv"), F.lit("a.MP4")))) == "a.MP4"
    assert one(spark, runs.data_name(F.lit("/x/y"))) == "y"
    assert runs.seeds("7") == [7] * 4 and runs.seeds("0,None,8") == [0, None, 8, 1234]
    with pytest.raises(ValueError):
        runs.seeds("1,2")
    assert runs.matching(["a*", "b"], ["ab", "b", "c"]) == ["ab", "b"]
    assert runs.merged({"a": {"x": 1, "y": 2}}, {"a": {"y": 3}}) == {"a": {"x": 1, "y": 3}}


def test_files(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "one").mkdir()
    (tmp_path / "one/t.yaml").write_text("k: 1\nf: !function x.y\n")
    (tmp_path / "two").mkdir()
    (tmp_path / "two/t.yaml").write_text("k: 2\n")
    found = runs.task_files(str(tmp_path / "one"), str(tmp_path / "two"))
    assert runs.read_settings(found["t"]) == {"k": 1}


def test_cache_and_reports(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([(1, 0.5, "a|b")], "n int, x double, s string")

    for _ in range(2):
        rows = runs.cached(spark, str(tmp_path / "cache"), {"task": "t", "k": 3}, make)
        assert rows.count() == 1
    assert len(made) == 1
    assert runs.printed(rows).splitlines()[-1] == r"| 1 | 0.5000 | a\|b |"
    path = runs.write_report(rows, str(tmp_path), "run", "2025-01-01 10:00")
    assert path.endswith("run+2025_01_01_10_00.json")
    with open(path) as f:
        assert json.load(f) == [{"n": 1, "x": 0.5, "s": "a|b"}]
    log = runs.logged(spark.createDataFrame([(1, "d", 2, "r", "r")], "id int, doc string, target int, resps string, filtered_resps string"))
    assert log.first().asDict() == {"id": 1, "target": "2", "resps": None, "filtered_resps": "r"}
