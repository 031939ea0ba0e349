"""Near-duplicate groups by the Jaccard similarity of word shingles: candidates from the groups of the SimHash operator
and, for pairs that its fingerprints hold farther apart, from MinHash bands; each is verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavesift.llm import simhash
from wavesift.llm.components import connect
from wavesift.llm.shared import forget, prepared, settle

#: Words in a shingle, least similarity of linked texts, and seed of the hashes.
SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: Bands and minima in each: a pair of similarity s shares no band with a chance of (1 - s**5)**24, 7.2e-5 at 0.8.
BANDS, MINIMA = 24, 5
#: Shingles that go through all permutations at once.
STEP = 4_096
#: Candidates up to which their names (8 bytes each) are sent to all workers, so that only their sets are shuffled.
CANDIDATES = 2_000_000
#: Members of a bucket that are verified in one task; larger buckets are verified by blocks of as many.
GROUP = 1_000

_random = np.random.default_rng(SEED)
_FACTORS = _random.integers(0, 1 << 31, BANDS * MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _random.integers(0, 1 << 32, BANDS * MINIMA, dtype=np.uint32)
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """Hashes of 64 bits that depend on the order of the parts."""
    x = parts[0].astype(np.uint64)
    for p in parts[1:]:
        x = x * _BASE + p
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """Distinct shingles of a text in order, as hashes of 32 bits; of a shorter text all its words, of none nothing."""
    w = (text or "").encode("utf-8").lower().split()
    if not w:
        return np.zeros(0, np.uint32)
    h = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in w), np.uint64, len(w))
    n = min(words, len(w))
    return np.unique((_joined([h[i : len(h) - n + 1 + i] for i in range(n)]) >> np.uint64(32)).astype(np.uint32))


def bands(own: np.ndarray) -> np.ndarray:
    """One key a band from the minima of a set of shingles."""
    least = np.full(BANDS * MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(own), STEP):
        np.minimum(least, (own[at : at + STEP, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    return _joined(list(least.reshape(BANDS, MINIMA).T)).view(np.int64)


def sketches(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, h (the hash of the text), fp (the hash of its set of shingles), bits (the SimHash fingerprint of its
    shingles, repeats included), keys of its bands and the set of every row; a null text counts as empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            sets = [shingles(t) for t in texts]
            bits = np.fromiter((simhash.fingerprint(t, SHINGLE) for t in texts), np.uint64, len(texts)).view(np.int64)
            fp = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets), np.uint64, len(sets)).view(np.int64)
            keys = pa.array([bands(s) for s in sets], pa.list_(pa.int64()))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fp), pa.array(bits), keys, pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "h", "fp", "bits", "keys", "own"])

    chosen = docs.select(F.col(id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(each, f"doc_id {kind}, h long, fp long, bits long, keys array<long>, own binary")


def _alike(own: np.ndarray, others: list[np.ndarray], least: float = SIMILARITY) -> list[int]:
    """Which of the others are similar to a set."""
    n = len(own)
    fits = [i for i, x in enumerate(others) if n and least * max(n, len(x)) <= min(n, len(x)) + 1e-9]
    if not fits:
        return []
    sizes = np.array([len(others[i]) for i in fits])
    values = np.concatenate([others[i] for i in fits])
    met = own[np.minimum(np.searchsorted(own, values), n - 1)] == values
    both = np.add.reduceat(met.astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
    return [i for i, ok in zip(fits, both + 1e-9 >= least * (n + sizes - both), strict=True) if ok]


def _similar(fps: list[int], sets: list[np.ndarray], least: float = SIMILARITY) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links within a group."""
    left = list(range(len(fps)))
    while left:
        queue, left = [left[0]], left[1:]
        while queue and left:
            u = queue.pop()
            found = [left[i] for i in _alike(sets[u], [sets[i] for i in left], least)]
            yield from ((fps[u], fps[i]) for i in found)
            queue.extend(found)
            gone = set(found)
            left = [i for i in left if i not in gone]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the runs of equal group in sorted rows (group, fp, own)."""
    group, fps, sets = None, [], []

    def told() -> Iterator[pa.RecordBatch]:
        found = np.array(list(_similar(fps, sets)), np.int64).reshape(-1, 2)
        if len(found):
            yield pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    for b in batches:
        for g, fp, own in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if g != group:
                yield from told()
                group, fps, sets = g, [], []
            fps.append(fp)
            sets.append(np.frombuffer(own, np.uint32))
    yield from told()


def _by_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, fp, pivot and whether these two are similar, of rows that have both sets."""
    for b in batches:
        own, other = (b.column(n).to_pylist() for n in (3, 4))
        like = [bool(_alike(np.frombuffer(x, np.uint32), [np.frombuffer(y, np.uint32)])) for x, y in zip(own, other, strict=True)]
        yield pa.record_batch([*b.columns[:3], pa.array(like, pa.bool_())], ["bucket", "fp", "pivot", "like"])


#: Sides of a block: members that the pivot links, members to be compared with all, and these as members.
LINKED, COMPARED, OTHER = 0, 1, 2


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links between the compared rows of each block and its members, which are together in
    sorted rows (block, side, fp, own). Members that the pivot links count as one."""
    block, sides = None, ([], [], [])

    def told() -> Iterator[pa.RecordBatch]:
        members = sides[LINKED] + sides[OTHER]
        sets, linked = [x for _, x in members], len(sides[LINKED])
        root: dict[int | None, int | None] = {}

        def up(x: int | None) -> int | None:
            while (y := root.get(x, x)) != x:
                root[x] = root.get(y, y)
                x = y
            return x

        found = []
        for f, own in sides[COMPARED]:
            for i in _alike(own, sets):
                z = members[i][0]
                a, b = up(f), up(None if i < linked else z)
                if z != f and a != b:
                    root[a] = b
                    found.append((f, z))
        if found:
            yield pa.record_batch([pa.array([a for a, _ in found], pa.int64()), pa.array([z for _, z in found], pa.int64())], ["a", "b"])

    for b in batches:
        for name, side, fp, own in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if name != block:
                yield from told()
                block, sides = name, ([], [], [])
            sides[side].append((fp, np.frombuffer(own, np.uint32)))
    yield from told()


def _of_large(held: DataFrame, sets: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Links within buckets too large for one task, from rows (bucket, fp), and the settled tables that they read.

    Members are compared with the bucket's smallest: those that are like it are linked by it. Each of the others is
    compared with all members, block by block of GROUP, so that no task holds more than two blocks; a block tells a
    spanning forest of its links.
    """
    pivots = held.groupBy("bucket").agg(F.min("fp").alias("pivot"), F.count("*").alias("n"))
    pivots = settle(pivots.join(sets.select(F.col("fp").alias("pivot"), F.col("own").alias("pivot_own")), "pivot"), "pivots")
    met = held.join(sets, "fp").join(pivots, "bucket").where("fp != pivot").select("bucket", "fp", "pivot", "own", "pivot_own")
    star = settle(met.mapInArrow(_by_pivot, "bucket long, fp long, pivot long, like boolean"), "stars")
    found = star.where("like").select(F.col("fp").alias("a"), F.col("pivot").alias("b"))
    if star.where("not like").isEmpty():
        return found, [pivots, star]
    others = star.where("not like").select("bucket", "fp")
    sizes = others.groupBy("bucket").agg(F.count("*").alias("l")).join(pivots.select("bucket", "n"), "bucket").select("bucket", F.ceil(F.col("l") / GROUP).alias("lefts"), F.ceil(F.col("n") / GROUP).alias("rights"))
    place = lambda parts: F.pmod(F.xxhash64("fp"), F.col(parts))
    each = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    members = star.select("bucket", "fp", F.when(F.col("like"), LINKED).otherwise(OTHER).alias("side")).union(pivots.select("bucket", "pivot", F.lit(LINKED)))
    left = others.join(sizes, "bucket").select("bucket", "fp", place("lefts").alias("x"), each("rights").alias("y"), F.lit(COMPARED).alias("side"))
    right = members.join(sizes, "bucket").select("bucket", "fp", each("lefts").alias("x"), place("rights").alias("y"), "side")
    blocks = left.union(right).select(F.xxhash64("bucket", "x", "y").alias("block"), "side", "fp").join(sets, "fp").select("block", "side", "fp", "own")
    return found.union(blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_by_block, "a long, b long")), [pivots, star]


def near(rows: DataFrame) -> DataFrame:
    """Rows (fp, band, key) that put the sets of one group of SimHash fingerprints in one bucket: fingerprints that the
    links of the SimHash operator connect, and sets of the same fingerprint. Settled; groups of one set are left out."""
    own = settle(rows.select("fp", "bits").distinct(), "bits")
    roots = connect(simhash.links(own.select(F.col("bits").alias("fp")).distinct()))
    rooted = own.join(roots, own["bits"] == roots["node"], "left").select("fp", F.coalesce("root", "bits").alias("key")).distinct()
    rooted = settle(rooted, "rooted")
    several = rooted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    found = settle(rooted.join(several, "key").select("fp", F.lit(BANDS).alias("band"), "key"), "near")
    forget(own)
    forget(rooted)
    return found


def links(rows: DataFrame) -> DataFrame:
    """Edges (a, b) between sets of shingles, enough to connect all that are similar and share a group of SimHash
    fingerprints or a band. Buckets of the same members are verified once; large ones in parts."""
    close = near(rows)
    keyed = rows.select("fp", "keys").dropDuplicates(["fp"]).select("fp", F.posexplode("keys").alias("band", "key")).union(close)
    large = settle(keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("band", "key"), "large")
    some = not large.isEmpty()
    small = keyed.join(large, ["band", "key"], "left_anti") if some else keyed
    members = small.groupBy("band", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    groups = settle(members.select("fps").distinct(), "buckets")
    placed = groups.select(F.xxhash64("fps").alias("group"), F.explode("fps").alias("fp"))
    held = settle(keyed.join(large, ["band", "key"]).select(F.xxhash64("band", "key").alias("bucket"), "fp"), "members") if some else None
    candidates = settle(placed.select("fp").union(held.select("fp") if some else placed.select("fp").where("false")).distinct(), "candidates")
    few = candidates.count() <= CANDIDATES
    sets = rows.select("fp", "own").join(F.broadcast(candidates) if few else candidates, "fp", "left_semi").dropDuplicates(["fp"])
    met = placed.join(sets, "fp").select("group", "fp", "own")
    found = met.repartition("group").sortWithinPartitions("group").mapInArrow(_verify, "a long, b long")
    done = [close, large, groups, candidates]
    if some:
        sets = settle(sets, "sets")
        more, read = _of_large(held, sets)
        found, done = found.union(more), [*done, held, sets, *read]
    edges = settle(found.distinct(), "links")
    for t in done:
        forget(t)
    return edges


def classified(docs: DataFrame, text: str = "text", id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, fp) of docs, and classes (fp, root, component_id) of the distinct sets; both settled."""
    prepared(docs.sparkSession)
    made = settle(sketches(docs, text, id), "sketches")
    linked = links(made)
    roots = connect(linked)
    forget(linked)
    rows = settle(made.select("doc_id", "h", "fp"), "fingerprints")
    forget(made)
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = settle(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = settle(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    return rows, settle(rooted.join(least, "root").select("fp", "root", "component_id"), "classes")
