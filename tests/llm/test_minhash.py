"""The pipeline's near-duplicate stage against brute force on sets of shingles."""

import random

import corpus_pipeline
from wavesift.llm import simhash


def test_near_copies_beyond_three_bits_leave_one(spark, docs, empty):
    r = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(40):
        own = [r.choice(words) for _ in range(r.randint(60, 200))]
        texts.append(" ".join(own))
        for changed in (1, 2, 5):
            near = list(own)
            for at in r.sample(range(len(near)), changed):
                near[at] = r.choice(words)
            texts.append(" ".join(near))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root, beyond = list(range(len(texts))), 0

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                beyond += (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > 3
                a, b = sorted((up(i), up(j)))
                root[b] = a
    assert beyond > 10
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.distinct(spark, rows, "")
    assert {x.doc_id for x in kept.collect()} == {up(i) for i in range(len(texts))}
    assert corpus_pipeline.distinct(spark, empty, "").count() == 0
    kept = corpus_pipeline.distinct(spark, docs, "")
    assert kept.columns == docs.columns and sorted(str(x.doc_id) for x in kept.collect()) == sorted(map(str, [0, 2, 5, 6, 7, 8, None, 9, 10]))
