"""Buckets of near copies that are too large for one task, against brute force: copies of one text, chains that drift
away from it, and two texts' copies between which one text stands."""

import random

import pytest

from wavesift.llm import minhash


@pytest.mark.parametrize("group", [2, 5, 1_000])
def test_links_of_large_buckets(spark, monkeypatch, group):
    monkeypatch.setattr(minhash, "GROUP", group)
    monkeypatch.setattr(minhash, "CANDIDATES", 10 if group == 5 else 2_000_000)
    r = random.Random(7)
    words = [f"w{i}" for i in range(900)]
    texts = []

    def changed(own, n):
        own = list(own)
        for at in r.sample(range(len(own)), n):
            own[at] = r.choice(words)
        return own

    for _ in range(4):
        base = [r.choice(words) for _ in range(150)]
        texts += [changed(base, r.choice([0, 1, 2])) for _ in range(15)]
        drift = base
        for _ in range(12):
            drift = changed(drift, 2)
            texts.append(drift)
    texts += [[r.choice(words) for _ in range(60)] for _ in range(20)]
    texts = [" ".join(t) for t in texts]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    direct = 0
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                direct += 1
                a, b = sorted((up(i), up(j)))
                root[b] = a
    assert direct > 300
    rows, classes = minhash.classified(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    got = {x.doc_id: x.component_id for x in rows.join(classes, "fp").collect()}
    assert got == {i: up(i) for i in range(len(texts))}
