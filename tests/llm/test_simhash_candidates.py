"""The near-duplicate stage's candidates from the SimHash operator, without any from MinHash bands."""

import random

from pyspark.sql import functions as F

from wavesift.llm import minhash, simhash


def test_near_fingerprints_are_candidates(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(700)]
    texts = []
    for _ in range(25):
        own = [r.choice(words) for _ in range(r.randint(150, 400))]
        other = list(own)
        other[r.randrange(len(own))] = "changed"
        texts += [" ".join(own), " ".join(other), " ".join([*other, "more"])]
    texts += ["one two three four five " * 60, "one two three four five " * 60 + "and then six other words"]  # alike as bags only
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    bits = [simhash.fingerprint(t, 5) for t in texts]

    def classes(linked):
        root = list(range(len(texts)))
        for i in range(len(texts)):
            for j in range(i):
                if linked(i, j):
                    a, b = sorted((root[i], root[j]))
                    root = [a if x == b else x for x in root]
        return root

    near = classes(lambda i, j: (bits[i] ^ bits[j]).bit_count() <= 3)
    assert near[-1] == near[-2]
    expected = classes(lambda i, j: near[i] == near[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert len(set(expected)) < 60 and expected[-1] != expected[-2]
    made = minhash.sketches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    made = made.withColumn("keys", F.array("fp"))  # bands that no two sets share
    name = {x.fp: x.doc_id for x in made.collect()}
    edges = {(name[x.a], name[x.b]) for x in minhash.links(made).collect()}
    assert classes(lambda i, j: (i, j) in edges or (j, i) in edges) == expected
