"""Sequences shorter than the filter, and reports of many rows."""

import json

import numpy as np
import pytest

from wavesift.functions import signal_kernels as k
from wavesift.operators import signal
from wavesift.plans import runs


@pytest.mark.parametrize("high", [False, True])
def test_first_level_of_short_sequences(spark, high):
    low, detail = k.filters("db4")
    r = np.random.default_rng(1)
    series = {n: r.random(n) for n in (1, 2, 3, 5, 7, 8, 9, 30)}
    rows = spark.createDataFrame([(n, i, float(v)) for n, x in series.items() for i, v in enumerate(x)], "seq_id long, idx long, score double")
    got = {(c.seq_id, c.pos): c.coef for c in signal.one_level(rows, high).collect()}
    want = {}
    for n, x in series.items():
        f, taps = (detail if high else low)[::-1], len(low)
        for pos in range((n + taps - 1) // 2):
            at = (2 * pos + 1 - np.arange(taps)) % (2 * n)
            want[n, pos] = float(f @ x[np.minimum(at, 2 * n - 1 - at)])
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-12 for p in want)


def test_report_has_all_rows(spark, tmp_path):
    path = runs.write_report(spark.range(10_001), str(tmp_path), "run", "2025-01-01")
    with open(path) as f:
        assert len(json.load(f)) == 10_001
