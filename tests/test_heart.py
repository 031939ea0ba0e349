"""The heart of the engine against naive loops written from its rules: every registered query that has no SQL."""

import math
from collections import defaultdict

import pytest

from wavesift.functions.signal_kernels import LOW_PASS
from wavesift.operators import frames, select, signal
from wavesift.plans import registry

SF = "/root/testdata/sf0.001"
LOW = LOW_PASS["db4"]
HIGH = [(-1) ** i * LOW[len(LOW) - 1 - i] for i in range(len(LOW))]


@pytest.fixture(scope="module")
def series(spark):
    out = defaultdict(list)
    for r in frames.frames(spark, SF).orderBy("seq_id", "idx").collect():
        out[r.seq_id].append((r.orig_idx, r.score))
    return out


def mirrored(x, i):
    n = len(x)
    while not 0 <= i < n:
        i = -1 - i if i < 0 else 2 * n - 1 - i
    return x[i]


def down(x, f):
    """Analysis: out[k] = sum over j of f[j] * x[2k + 1 - j], f the reversed synthesis filter."""
    r = f[::-1]
    return [sum(r[j] * mirrored(x, 2 * k + 1 - j) for j in range(len(r))) for k in range((len(x) + len(f) - 1) // 2)]


def up(c, f):
    """Synthesis of one band, without its borders."""
    out = []
    for i in range(2 * len(c) - len(f) + 2):
        out.append(sum(c[(i + len(f) - 2 - j) // 2] * f[j] for j in range(len(f)) if (i + len(f) - 2 - j) % 2 == 0 and 0 <= (i + len(f) - 2 - j) // 2 < len(c)))
    return out


def detail(x):
    n = len(x)
    level = 1 if n <= 1 else max(1, min(math.floor(math.log2(n)) - 3, math.floor(math.log2(n / 7))))
    sizes, a = [], x
    for _ in range(level):
        d = down(a, HIGH)
        a = down(a, LOW)
        sizes.append(len(d))
    y = up(d, HIGH)
    for size in sizes[-2::-1]:
        y = up(y[:size], LOW)
    return y[:n]


def mean(v):
    return sum(v) / len(v)


def spread(v):
    return math.sqrt(mean([(x - mean(v)) ** 2 for x in v]))


def peaks(band):
    v = [abs(x) for x in band]
    n, tops, i = len(v), [], 1
    while i < n - 1:
        j = i
        while j < n - 1 and v[j + 1] == v[i]:
            j += 1
        if v[i - 1] < v[i] and j < n - 1 and v[j + 1] < v[i]:
            tops.append((i + j) // 2)
        i = j + 1
    tops = [p for p in tops if v[p] >= mean(v) + 0.5 * spread(v)]
    distance, left, kept = max(5, int(n * 0.02)), set(tops), []
    while left:
        best = max(left, key=lambda p: (v[p], p))
        kept.append(best)
        left = {p for p in left if abs(p - best) >= distance}
    out = []
    for p in sorted(kept):
        sides = []
        for step in (-1, 1):
            low, q = v[p], p
            while 0 <= q < n and v[q] <= v[p]:
                low = min(low, v[q])
                q += step
            sides.append(low)
        if v[p] - max(sides) >= 0.05 * (max(v) - min(v)):
            out.append(p)
    return out


def spaced_out(n, k):
    return [0] if k == 1 else [n - 1 if i == k - 1 else math.floor(i * ((n - 1) / (k - 1))) for i in range(k)]


def near(x, vectors, i, j):
    if vectors is None:
        return math.exp(-abs(i - j) / 10)
    a, b = vectors[i], vectors[j]
    size = math.sqrt(sum(p * p for p in a)) * math.sqrt(sum(p * p for p in b))
    return sum(p * q for p, q in zip(a, b, strict=True)) / size if size else 0.0


def greedy(x, vectors, chosen, among, count):
    """count more of among; a candidate's likeness is to the most alike that is chosen, ties go to the lower place."""
    chosen = list(chosen)
    for _ in range(count):
        best = None
        for i in among:
            if i not in chosen:
                value = 0.5 * (2 * x[i] - 1) - 0.5 * max((near(x, vectors, i, j) for j in chosen), default=0.0)
                if best is None or value > best[0] + 1e-12:
                    best = (value, i)
        if best is None:
            break
        chosen.append(best[1])
    return chosen


def filled(x, vectors, chosen, k):
    return sorted(greedy(x, vectors, sorted(set(chosen)), range(len(x)), k - len(set(chosen))))


def selected(x, k, vectors=None):
    n = len(x)
    if n < k:
        return list(range(n))
    cuts = peaks(detail(x))
    if not cuts:
        even = set(spaced_out(n, k // 2))
        others = sorted((i for i in range(n) if i not in even), key=lambda i: (x[i], i), reverse=True)
        return sorted(even | set(others[: k - k // 2]))
    bounds = [0, *cuts, n]
    parts = [(a, b) for a, b in zip(bounds, bounds[1:])]
    worth = [0.4 * (b - a) / n + 0.2 * mean(x[a:b]) + 0.3 * max(x[a:b]) + 0.1 * spread(x[a:b]) ** 2 / (spread(x) ** 2 + 1e-8) for a, b in parts]
    keep = list(range(len(parts)))
    if len(parts) > 3:
        keep = [i for i in keep if worth[i] >= max(0.05, mean(worth) - 1.2 * spread(worth))] or keep
    e = [math.exp(worth[i] - max(worth[j] for j in keep)) for i in keep]
    share = [k * y / sum(e) for y in e]
    units = [math.floor(s) for s in share]
    for i in sorted(range(len(keep)), key=lambda i: (share[i] - units[i], i), reverse=True)[: k - sum(units)]:
        units[i] += 1
    chosen = []
    for i, count in zip(keep, units, strict=True):
        a, b = parts[i]
        if count:
            chosen += greedy(x, vectors, [max(range(a, b), key=lambda p: (x[p], -p))], range(a, b), count - 1)
    return filled(x, vectors, chosen, k)


def by_sequence(rows, column="idx"):
    out = defaultdict(list)
    for r in rows:
        out[r.seq_id].append(r[column])
    return {s: sorted(v) for s, v in out.items()}


def test_band(spark, series):
    got = {(r.seq_id, r.idx): r.detail for r in registry.queries()["dwt_band"](spark, SF).collect()}
    want = {(s, i): v for s, own in series.items() for i, v in enumerate(detail([x for _, x in own]))}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 2e-6 for p in want)


def test_chain_of_peaks_of_the_band(spark, series):
    got = by_sequence(signal.peaks(signal.band(frames.frames(spark, SF)), "detail").collect())
    assert got == {s: p for s, own in series.items() if (p := peaks(detail([x for _, x in own])))}


def test_keyframes(spark, series):
    rows = registry.queries()["keyframes_flagship"](spark, SF).collect()
    assert by_sequence(rows) == {s: selected([x for _, x in own], 16) for s, own in series.items()}
    assert all(series[r.seq_id][r.idx][0] == r.orig_idx for r in rows)


def test_keyframes_by_vectors(spark, series):
    held = {r.vec_id: [float(x) for x in r.embedding] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    rows = registry.queries()["keyframes_visual"](spark, SF).collect()
    assert by_sequence(rows) == {s: selected([x for _, x in own], 8, [held[o % len(held)] for o, _ in own]) for s, own in series.items()}


def test_filling_to_the_budget(spark, series):
    anchors = by_sequence(registry.queries()["segment_anchor"](spark, SF).collect())
    got = by_sequence(registry.queries()["budget_fill"](spark, SF).collect())
    assert got == {s: filled([x for _, x in own], None, anchors[s], 16) if len(anchors[s]) < 16 else sorted(sorted(anchors[s], key=lambda i: (-own[i][1], i))[:16]) for s, own in series.items()}


def test_records_to_keyframes(spark, series):
    got = {r.ordinal: r for r in registry.queries()["record_keyframes"](spark, SF).collect()}
    assert set(got) == set(series)
    for s, own in series.items():
        n = len(own)
        if s % 5 <= 2:
            want = spaced_out(n * 30, 16) if s % 3 else list(range(16))
        else:
            places = [o for o, _ in own] if s % 2 == 0 else list(range(n))
            want = sorted({places[i] for i in selected([x for _, x in own], 16)})
            if len(want) < 16:
                want = sorted(set(want) | {places[i] for i in spaced_out(n, 16)})[:16]
            want += want[-1:] * (16 - len(want))
        assert got[s].keyframe_indices == ",".join(map(str, want)) and got[s].video_name == f"v{s}"


def test_sequences_over_many_batches_and_odd_ones(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(s, i, 1000 * (s or 0) + i, float((i * 37 + (s or 0)) % 11) / 10) for s in (None, 1, 2, 3, 4) for i in range({None: 3, 1: 1, 2: 40, 3: 16, 4: 100}[s])]
        df = spark.createDataFrame(rows, "seq_id int, idx long, orig_idx long, score double").repartition(3)
        got = by_sequence(select.keyframes(df).collect())
        assert got == {s: selected([r[3] for r in rows if r[0] == s], 16) for s in (None, 1, 2, 3, 4)}
        assert select.keyframes(df.where("false")).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
