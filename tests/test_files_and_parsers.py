"""Files and parsers on small hand-made input."""

import json

import pytest
from pyspark.sql import functions as F

from wavesift.functions import parsers
from wavesift.sources import files
from wavesift.streaming.sequences import windowed_scores


def values(spark, column, *strings):
    return [r[0] for r in spark.createDataFrame([(s,) for s in strings], "s string").select(column(F.col("s"))).collect()]


def test_letters(spark):
    assert values(spark, parsers.first_letter, "The best answer is B.", "Answer: C", "zz") == ["B", "A", ""]
    assert values(spark, parsers.choice, "(A) or (C)", "DNA test", "e", "B.") == ["C", "A", None, "B"]
    assert values(spark, parsers.bracket, "B) text", ")x", "C") == ["B", "", "C"]
    assert values(spark, parsers.question_index, "001-2", "5", "a-b") == [1, None, None]
    assert values(spark, parsers.clock_seconds, "01:02:03,500", "0:0:1.25") == [3723.5, 1.25]


def test_annotations(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "x"}, {"id": "y"}]))
    rows = files.annotations(spark, str(tmp_path / "a.json"), "id:string").orderBy("ordinal").collect()
    assert [(r.ordinal, r.id) for r in rows] == [(0, "x"), (1, "y")]
    (tmp_path / "b.json").write_text("{}")
    with pytest.raises(Exception, match="no list"):
        files.annotations(spark, str(tmp_path / "b.json"), "id:string").collect()


def test_scores_and_subtitles(spark, tmp_path):
    (tmp_path / "f1").mkdir()
    (tmp_path / "f1/similarity_scores.json").write_text(json.dumps({"video_id": "v", "score": [0.5]}))
    assert files.scores(spark, str(tmp_path), "video_id string, score array<double>").first().feature_id == "f1"
    (tmp_path / "s.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nold\n\n2\n00:00:01,000 --> 00:00:02,000\nnew\nlines\n")
    assert [tuple(r) for r in files.subtitles(spark, str(tmp_path / "s.srt")).collect()] == [(1.0, 2.0, "new lines")]


def test_stream(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = windowed_scores(stream).writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("windowed").agg(F.sum("n")).first()[0] == 1000
