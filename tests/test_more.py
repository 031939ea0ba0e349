"""Files, expansion, scorers and small operators that have no table of their own."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavesift.functions import prompts
from wavesift.functions.signal_kernels import Settings, select as chosen
from wavesift.operators import evaluation, frames, scorers
from wavesift.plans import selection
from wavesift.sources import files


def test_members_of_any_depth_and_cycles(spark):
    chain = [(f"t{i}", f"t{i + 1}") for i in range(20)] + [("t20", "t5"), ("t3", "t3"), ("r", "a"), ("r", "b"), ("a", "b"), (None, "x"), ("a", None)]
    edges = spark.createDataFrame(chain, "parent string, child string")
    roots = spark.createDataFrame([("t0",), ("r",), ("none",), (None,)], "root string")
    got = {(r.root, r.member): r.level for r in evaluation.expanded(spark, edges, roots).collect()}
    assert got == {("t0", f"t{i}"): i for i in range(1, 21)} | {("r", "a"): 1, ("r", "b"): 1}
    assert evaluation.expanded(spark, edges.where("false"), roots).count() == 0


def test_unknown_labels_are_errors(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0)], "k string, correct int")
    assert evaluation.known_only(df, "k", ["a", "b"]).count() == 2
    with pytest.raises(Exception, match="unknown label b"):
        evaluation.known_only(df, "k", ["a"]).collect()


def test_files_to_keyframes(spark, tmp_path):
    """Annotations, score files and features on disk, to one list of keyframes by the default name."""
    r = np.random.default_rng(6)
    scores = {str(i): r.random(60).tolist() for i in range(3)} | {"3": r.random(5).tolist()}
    vectors = {k: r.normal(size=(60, 4)) for k in ("0", "1")}
    notes = [{"question_id": i, "video_name": f"v{i}.mp4", "question": "?"} for i in range(5)]
    (tmp_path / "notes.json").write_text(json.dumps(notes))
    for k, v in scores.items():
        (tmp_path / "scores" / k).mkdir(parents=True)
        held = {"frame_indices": [7 * i for i in range(len(v))] if k != "1" else [], "clip_similarities": v}
        (tmp_path / "scores" / k / "similarity_scores.json").write_text(json.dumps(held))
    rows = [(k, i, x.tolist()) for k, own in vectors.items() for i, x in enumerate(own)]
    files.write_features(spark.createDataFrame(rows, "feature_id string, idx long, vector array<double>"), f"{tmp_path}/features", "clip")
    files.write_features(spark.createDataFrame([("9", 0, [1.0])], "feature_id string, idx long, vector array<double>"), f"{tmp_path}/features", "other")
    assert files.features(spark, f"{tmp_path}/features", "clip").count() == 120 and files.features(spark, f"{tmp_path}/features", "none").count() == 0

    records = selection.records(files.annotations(spark, f"{tmp_path}/notes.json", "question_id int, video_name string, question string"), "MLVU ", "/d")
    payloads = files.scores(spark, f"{tmp_path}/scores", "frame_indices array<long>, clip_similarities array<double>")
    lengths = spark.createDataFrame([("/d/video/v4.mp4", 100)], "video_path string, n_frames long")
    decided = selection.decided(records, payloads, "clip", 8)
    made = selection.keyframes(decided, Settings(budget=8), files.features(spark, f"{tmp_path}/features", "clip"), lengths)
    path = files.keyframe_path("mlvu", "clip", 8, f"{tmp_path}/out")
    assert path.endswith("out/mlvu/keyframes_mlvu_clip_8f.json") and files.export_list(selection.outputs(records, made), path, "ordinal") == 5
    with open(path) as f:
        got = {x["question_id"]: x for x in json.load(f)}
    assert got[0]["video_name"] == "v0.mp4" and got[0]["question"] == "?"
    for k in ("0", "1", "2"):
        own = np.array(vectors[k], np.float32).astype(float) if k in vectors else None
        picked = chosen(np.array(scores[k]), Settings(budget=8), own)
        assert got[int(k)]["keyframe_indices"] == [int(p) if k == "1" else 7 * int(p) for p in picked]
    assert got[3]["keyframe_indices"] == list(range(8)) and got[4]["keyframe_indices"] == [0, 14, 28, 42, 56, 70, 84, 99]
    assert tuple(selection.summary(made).first()) == (5, 3, 2, 1)
    files.export_map(records.select("feature_id", "video_path"), f"{tmp_path}/map.json", "feature_id", "video_path")
    assert json.loads((tmp_path / "map.json").read_text())["4"] == "/d/video/v4.mp4"


def test_grouped_questions_and_their_places(spark):
    rows = spark.createDataFrame([(0, "v1", "1-2", "x"), (1, "v2", "7", "y"), (2, "v1", "bad", "z"), (3, "v1", "1-x", "w")], "ordinal long, video_id string, question_id string, videoID2 string")
    placed = files.question_places(rows, "video_id")
    assert {r.ordinal: r.question_index for r in placed.collect()} == {0: 1, 1: 6, 2: 1, 3: 2}
    got = {r.video_id: r for r in files.grouped_questions(placed, "video_id", ["question_id", "question_index"], ("videoID2",)).collect()}
    assert got["v1"].videoID2 == "x" and [q.question_index for q in got["v1"].questions] == [1, 1, 2] and got["v2"].first_ordinal == 1


def test_subtitle_lists(spark, tmp_path):
    items = [{"timestamp": [1.5, 2.5], "text": "a"}, {"timestamp": [3.0, None], "text": "b"}, {"timestamp": [4, 5], "text": "c"}, {"start": "0:00:01.5", "end": "0:01:00", "line": "d"}]
    (tmp_path / "s.json").write_text(json.dumps(items))
    got = files.subtitle_list(spark, f"{tmp_path}/s.json", 90, 1.0).orderBy("ordinal").collect()
    assert [(r.start_s, r.end_s, r.text) for r in got] == [(0.5, 1.5, "a"), (2.0, 89.0, "b"), (3.0, 89.0, "c"), (0.5, 59.0, "d")]


def test_subtitles_of_frames_in_a_prompt(spark):
    mark = '<font color="white" size=".72c">{}</font>'
    held = [(0.0, 1.0, mark.format("a")), (1.0, 2.0, mark.format("b")), (5.0, 6.0, "plain"), (9.0, 10.0, mark.format("c"))]
    df = spark.createDataFrame([(held,)], "subs array<struct<start_s:double,end_s:double,text:string>>")
    at = lambda n: df.select(prompts.subtitles_at(F.col("subs"), F.lit(10.0), F.lit(100), F.lit(n)).alias("t")).first().t
    assert at(3) == ["a", "c"] and at(-1) == ["a", "b", "c"] and at(1) == ["a"]


def test_images_binaries_and_decoders(spark, tmp_path):
    for d in ("p", "q"):
        (tmp_path / d).mkdir()
        for i in range(25 if d == "p" else 3):
            (tmp_path / d / f"{i:03d}.png").write_bytes(bytes([i] * (i + 1)))
    got = files.image_frames(spark, str(tmp_path), 10).orderBy("directory", "rank").collect()
    assert [int(r.path[-7:-4]) for r in got] == [int(i * 24 / 9) for i in range(10)] + [0, 0, 0, 0, 0, 1, 1, 1, 1, 2]
    shown = files.decoded(files.binaries(spark, str(tmp_path), "00[12].png"), lambda _, b: [(n, float(x)) for n, x in enumerate(b)], "value double")
    assert sorted((r.path[-9:], r.frame, r.value) for r in shown.collect()) == sorted((f"/{d}/00{i}.png"[-9:], n, float(i)) for d in "pq" for i in (1, 2) for n in range(i + 1))


def test_datasets_by_settings(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1}, {"x": 2}]))
    (tmp_path / "b.jsonl").write_text('{"x": 3}\n{"x": 4}\n')
    spark.range(3).write.parquet(f"{tmp_path}/c.parquet")
    assert [files.dataset(spark, {"data_files": f"{tmp_path}/{n}"}).count() for n in ("a.json", "b.jsonl", "c.parquet")] == [2, 2, 3]
    assert files.dataset(spark, {"load_from_disk": f"{tmp_path}/c.parquet"}).count() == 3
    with pytest.raises(ValueError):
        files.dataset(spark, {})


def test_plugged_scorers(spark):
    r = np.random.default_rng(8)
    x = {s: r.normal(size=(n, 5)) for s, n in (("a", 30), ("b", 1))}
    q = {("a", 0): r.normal(size=5), ("a", 1): np.zeros(5), ("b", 0): r.normal(size=5), ("none", 0): r.normal(size=5)}
    held = spark.createDataFrame([(s, i, v.tolist()) for s, own in x.items() for i, v in enumerate(own)], "feature_id string, idx long, vector array<double>")
    asked = spark.createDataFrame([(s, n, v.tolist()) for (s, n), v in q.items()], "feature_id string, question int, query array<double>")
    for name in ("cosine", "sigmoid", "BLIP", lambda f, v: f @ v):
        got = {(r.feature_id, r.question, r.idx): r.score for r in scorers.score_frames(held, asked, name, 7).collect()}
        score = scorers.SCORERS[name] if isinstance(name, str) else name
        want = {(s, n, i): float(y) for (s, n), v in q.items() if s in x for i, y in enumerate(score(x[s], v))}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    with pytest.raises(KeyError):
        scorers.SCORERS["nothing"]


def test_accessors(spark):
    df = spark.createDataFrame([(3, "x", "12", "['p', \"q\"]")], "n int, s string, d string, l string")
    got = df.select(prompts.accessor(5, df.columns), prompts.accessor("s", df.columns), prompts.accessor("{{s}}-{{n}}", df.columns), prompts.accessor(lambda: F.upper("s"), df.columns), prompts.number_in(F.col("d")), prompts.number_in(F.col("s")), prompts.list_in(F.col("l")), prompts.list_in(F.col("s"))).first()
    assert tuple(got) == (5, "x", "x-3", "X", 12, None, ["p", "q"], None)


def test_batches_by_tokens_come_back_by_id(spark):
    df = spark.createDataFrame([(i, "en" if i % 3 else None, "t" * (i % 4), i % 4) for i in range(30)], "doc_id long, lang string, text string, n_tokens int")
    got = {r.doc_id: (r.lang, r.batch) for r in frames.length_batches(df, 4, "n_tokens").collect()}
    for lang in ("en", None):
        own = sorted((i for i in range(30) if ("en" if i % 3 else None) == lang), key=lambda i: (-(i % 4), "t" * (i % 4), i))
        assert [got[i] for i in own] == [(lang, n // 4) for n in range(len(own))]


def test_index_lists(spark):
    df = spark.createDataFrame([(" 3, 1,,2 ",), ("",), (" , ",), (None,)], "s string")
    assert [r[0] for r in df.select(frames.parse_indices(F.col("s"))).collect()] == [[3, 1, 2], None, None, None]


def test_media_and_documents(spark):
    df = spark.createDataFrame([(1, b"x", "i", "t")], "doc_id int, content binary, image string, text string")
    assert selection.without_media(df).columns == ["doc_id", "text"]
    docs = spark.createDataFrame([("a", "test", 1, "x"), ("a", "test", 2, "y"), ("b", "test", 1, "z")], "task string, split string, doc_id int, text string")
    held = spark.createDataFrame([("a", "test", 1, [1]), ("b", "test", 1, [2])], "task string, split string, doc_id int, keyframe_indices array<int>")
    assert sorted((r.task, r.doc_id, r.keyframe_indices) for r in selection.with_documents(held, docs).collect()) == [("a", 1, [1]), ("b", 1, [2])]


def test_fallback_letters_follow_from_ids(spark):
    from wavesift.functions import parsers

    df = spark.range(200).withColumn("s", F.when(F.col("id") % 2 == 0, "(B)").otherwise("e"))
    got = {r.id: r.pred for r in df.select("id", parsers.choice(F.col("s"), fallback=parsers.by_hash(F.col("id"))).alias("pred")).collect()}
    assert all(got[i] == "B" for i in range(0, 200, 2)) and {got[i] for i in range(1, 200, 2)} == set("ABCDE")
