"""Scores of hosts against the solved equations."""

import numpy as np

from wavesift.llm import url_filter


def test_scores_of_long_paths_and_cycles_are_settled(spark):
    """A chain of 24 links to two blocked hosts, and a cycle with one trusted host."""
    chain, ring = [f"c{i}" for i in range(25)], [f"r{i}" for i in range(3)]
    names = [*chain, "b0", "b1", *ring]
    links = [(chain[i], chain[i + 1], 1) for i in range(24)] + [("c24", "b0", 1), ("c24", "b1", 1)] + [(ring[i], ring[(i + 1) % 3], 1) for i in range(3)]
    seeds = [(x, 1.0 * (x == "r0"), 1.0 * (x in ("b0", "b1"))) for x in names]
    n, at = len(names), {x: i for i, x in enumerate(names)}
    want = []
    for way in (0, 1):
        m = np.zeros((n, n))
        for link in links:
            m[at[link[1 - way]], at[link[way]]] += 1
        m /= np.maximum(m.sum(axis=0), 1)
        want.append(np.linalg.solve(np.eye(n) - 0.85 * m, [s[1 + way] for s in seeds]))
    found = url_filter.propagate(spark.createDataFrame(seeds, "host string, trusted double, blocked double"), spark.createDataFrame(links, "src string, dst string, links long"))
    got = {r.host: (r.trust, r.distrust) for r in found.collect()}
    assert all(abs(got[x][way] - want[way][at[x]]) < 2e-4 for x in names for way in (0, 1))
    assert 0 < got["c0"][1] < 0.1
