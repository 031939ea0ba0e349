"""Many matches in one text, clashing columns, and thresholds with exact bounds."""

import math
import random

from pyspark.sql import functions as F

from wavesift.llm import boosting, pii


def test_many_matches_in_one_text(spark):
    r = random.Random(4)
    texts = ["".join(r.choice(["a{}@b.cc", "é\U0001f600 ", "{}.2.3.4", "+1 555 777 {}", " x ", "4111 1111 1111 1111", "\x01"]).format(r.randint(100, 999)) + r.choice(" ,;\x01") for _ in range(n)) for n in (0, 1, 63, 64, 65, 5_000)]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id int, text string").repartition(3)
    from tests.llm.test_documents import base_spans

    for row in pii.find(df).collect():
        assert [f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in row.pii_spans if s.kind < len(pii.BASE)] == base_spans(row.text)
        assert all(s.hit == row.text[s.start : s.end] for s in row.pii_spans)
    spans = {r.doc_id: sorted((s.start, s.end, s.kind) for s in r.pii_spans) for r in pii.find(df).collect()}
    for row in pii.redact(df).collect():
        if row.text is None:
            assert row.doc_id == len(texts)
            continue
        want, at, text = [], 0, texts[row.doc_id]
        for a, e, k in spans[row.doc_id]:
            if a >= at:
                want += [text[at:a], f"[{pii.KINDS[k]}]"]
            at = max(at, e)
        assert row.text == "".join(want) + text[at:]


def test_columns_of_the_same_names_stay(spark):
    df = spark.createDataFrame([(1, "mail a@b.cc now", "n", "s", "p", "r", "x")], "doc_id int, text string, pii_note string, spans string, pii_text string, row string, pieces string")
    found = pii.find(df).first()
    assert (found.pii_note, found.spans, found.pii_text, found.row, found.pieces) == ("n", "s", "p", "r", "x") and len(found.pii_spans) == 1
    assert tuple(pii.redact(df).first()) == (1, "mail [email] now", "n", "s", "p", "r", "x")
    assert pii.find(df.withColumn("pii_spans", F.lit("old"))).first().pii_spans[0].hit == "a@b.cc"


def test_errors_and_thresholds():
    assert abs(boosting.few_errors(3, 50, 0.1) - sum(math.comb(50, k) * 0.1**k * 0.9 ** (50 - k) for k in range(4))) < 1e-12
    model = boosting.fit([((n,), 60 - 10 * n, 10 * n) for n in range(7)])
    scores = [model.score((n,)) for n in range(7)]
    assert scores == sorted(scores)
    held = [((6,), 0, 200), ((5,), 1, 150), ((4,), 40, 60)]
    assert boosting.threshold(model, held, 0.98, 0.05) == scores[5]
    assert boosting.threshold(model, held, 0.98, 0.005) == math.inf  # 200 are too few for it, and of 351 one is wrong
    assert boosting.threshold(model, held[1:], 0.98, 0.05) == math.inf and boosting.threshold(model, [], 0.98, 0.05) == math.inf


def test_every_kind_that_adds_spans_is_certain_on_held_out_texts(spark):
    model, cuts = pii.trained(spark)
    assert sum(c < math.inf for c in cuts.values()) >= 3 and cuts[pii.KINDS.index("secret")] < math.inf
    rows = spark.createDataFrame(pii.labelled_texts(3_000, 55, held_out=True), "number int, text string, personal int")
    added = pii.find(rows).select("personal", F.explode("pii_spans").alias("s")).where(F.col("s.kind") >= len(pii.BASE)).groupBy("s.kind").agg(F.avg("personal").alias("right")).collect()
    assert added and all(r.right > 0.96 for r in added)
