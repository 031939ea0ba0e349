"""Scores of frames for queries by a scorer that is plugged in; those here work on vectors and are deterministic."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from wavesift.functions.prompts import Hooks
from wavesift.operators.walk import each_sequence

#: Scorers by name: a matrix of frames and a query's vector to a score for each frame.
SCORERS = Hooks()

Scorer = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return x / np.where(size > 0, size, 1.0)


@SCORERS.add("cosine", "clip")
def cosine(frames: np.ndarray, query: np.ndarray) -> np.ndarray:
    return _unit(frames) @ _unit(query)


@SCORERS.add("sigmoid", "siglip")
def sigmoid(frames: np.ndarray, query: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-cosine(frames, query)))


@SCORERS.add("matching", "blip")
def matching(frames: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The second class's share of a softmax over unlikeness and likeness."""
    like = cosine(frames, query)
    return 1 / (1 + np.exp(-2 * like))


def score_frames(frames: DataFrame, queries: DataFrame, scorer: str | Scorer = "cosine", batch: int = 256) -> DataFrame:
    """feature_id, question, idx and score of every frame (feature_id, idx, vector) for every question (feature_id,
    question, query) of its sample. Frames are scored batch by batch in order; a sample's frames go to one worker
    once for each of its questions, and one without frames gives no rows."""
    score = SCORERS[scorer] if isinstance(scorer, str) else scorer
    met = frames.join(queries, "feature_id").select(F.struct("feature_id", "question").alias("own"), "idx", "vector", "query")
    keyed = met.select(F.to_json("own").alias("seq_id"), "idx", "vector", "query", "own.feature_id", "own.question")

    def each(own):
        x, q = own["vector"].astype(float), own["query"][0].astype(float)
        parts = [score(x[at : at + batch], q) for at in range(0, len(x), batch)]
        return {"idx": own["idx"], "feature_id": own["feature_id"], "question": own["question"], "score": np.concatenate(parts)}

    kinds = f"idx long, feature_id {keyed.schema['feature_id'].dataType.simpleString()}, question {keyed.schema['question'].dataType.simpleString()}, score double"
    return each_sequence(keyed, ["vector", "query", "feature_id", "question"], each, kinds).drop("seq_id")


def answered(requests: DataFrame, model: Callable[[list[str]], list[str]], context: str = "context", batch: int = 64) -> DataFrame:
    """requests with the response that a model, which is plugged in, gives to each context, batch by batch where they
    lie; a null context is answered like an empty one. No model is built in."""
    made = to_arrow_schema(requests.withColumn("response", F.lit("")).schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = [x or "" for x in b.column(b.schema.get_field_index(context)).to_pylist()]
            told = [r for at in range(0, len(asked), batch) for r in model(asked[at : at + batch])]
            yield pa.record_batch([*b.columns, pa.array(told, made.field("response").type)], made.names)

    return requests.mapInArrow(each, requests.withColumn("response", F.lit("")).schema)
