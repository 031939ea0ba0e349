"""Near-duplicate groups by SimHash fingerprints and deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.llm.components import connect
from wavesift.llm.shared import documents, forget, prepared, settle

#: Words in a shingle, and seed of the shingle hash.
SHINGLE, SEED = 3, 42
#: Bits in which linked fingerprints differ at most. Two segments then leave one that differs in one bit at most.
DISTANCE, SEGMENTS, SEGMENT_BITS = 3, 2, 32
#: Fingerprints that a signature's group may hold before it is cut by finer signatures.
GROUP = 4_096
#: Shingles hashed and counted at once within a text.
STEP = 65_536


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text's shingles of so many words; zero for none. Long texts are counted in steps."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    total, counts = len(words) - shingle + 1, np.zeros(64, np.int64)
    for at in range(0, total, STEP):
        w = words[at : at + STEP + shingle - 1]
        shingles = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False))
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Columns doc_id, h (the hash of the text) and fp (the fingerprint as a signed long) of every row; a null text
    counts as empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter(map(fingerprint, b.column(2).to_pylist()), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(found.view(np.int64))], ["doc_id", "h", "fp"])

    chosen = docs.select(F.col(id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(each, f"doc_id {kind}, h long, fp long")


def _segment(n: int) -> F.Column:
    shifted = F.shiftrightunsigned(F.col("fp"), SEGMENT_BITS * n)
    return shifted.bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def variants(fps: DataFrame) -> DataFrame:
    """Rows (kind, key, fp): each segment whole, and with one bit taken out. kind: segment and place of that bit,
    which is the number of bits for the whole segment."""
    rows = []
    for n in range(SEGMENTS):
        for p in range(SEGMENT_BITS + 1):
            mask = (1 << SEGMENT_BITS) - 1 - (1 << p if p < SEGMENT_BITS else 0)
            rows.append(F.struct(F.lit(n * 64 + p).alias("kind"), _segment(n).bitwiseAND(F.lit(mask)).alias("key")))
    return fps.select("fp", F.explode(F.array(*rows)).alias("v")).select("v.kind", "v.key", "fp")


def finer(rest: DataFrame) -> DataFrame:
    """Large groups cut again: the other segment differs in three bits at most, so one of its halves in one at
    most. A finer group has 16 free bits and two wildcards and so 262,144 fingerprints at most."""
    half = SEGMENT_BITS // 2
    parts = []
    for n in range(2):
        for p in range(half + 1):
            mask = ((1 << half) - 1 - (1 << p if p < half else 0)) << (half * n)
            other = F.when(F.col("kind") < 64, _segment(1)).otherwise(_segment(0))
            parts.append(F.struct((F.col("kind") + 128 * (1 + n * 32 + p)).alias("kind"), other.bitwiseAND(F.lit(mask)).alias("sub")))
    cut = rest.select("kind", "key", "fp", F.explode(F.array(*parts)).alias("v"))
    return cut.select(F.col("v.kind").alias("kind"), F.shiftleft("key", 32).bitwiseOR(F.col("v.sub")).alias("key"), "fp")


def _near(fps: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links within a group, in time of its square at worst and memory of its size."""
    left = fps
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            close = np.bitwise_count(left ^ u) <= DISTANCE
            if close.any():
                found = left[close]
                yield from zip(repeat(int(u)), found.tolist(), strict=False)
                queue.extend(found)
                left = left[~close]


def _runs(cap: int | None):
    """Links within the runs of equal (kind, key) in sorted rows; the rows of a run over cap return as they are."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)
        over: tuple | None = None  # the run that is being returned

        def told(kind, a, b, rest):
            n = len(a)
            return pa.record_batch([pa.array(np.full(n, kind) if np.isscalar(kind) else kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(n, rest), pa.bool_())], ["kind", "a", "b", "rest"])

        def work(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            change = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
            at, to = np.r_[0, change], np.r_[change, rows.shape[1]]
            f = rows[2].view(np.uint64)
            two = at[to - at == 2]
            two = two[np.bitwise_count(f[two] ^ f[two + 1]) <= DISTANCE]
            if len(two):
                yield told(-1, f[two].view(np.int64), f[two + 1].view(np.int64), False)
            links: list[tuple[int, int]] = []
            for i, j in zip(at[to - at > 2].tolist(), to[to - at > 2].tolist(), strict=True):
                own = f[i:j]
                place = int(rows[0, i]) % 64
                if rows[0, i] < 128 and place < SEGMENT_BITS:
                    bit = (own >> np.uint64(place + SEGMENT_BITS * (int(rows[0, i]) // 64))) & np.uint64(1)
                    if bit.min() == bit.max():
                        continue  # one and the same segment: the whole segment's group has these
                if cap is not None and j - i > cap:
                    yield told(rows[0, i:j], rows[1, i:j], rows[2, i:j], True)
                else:
                    links.extend(_near(own))
            if links:
                x = np.array(links, np.uint64)
                yield told(-1, x[:, 0].view(np.int64), x[:, 1].view(np.int64), False)

        for b in batches:
            rows = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            held = np.concatenate([held, rows], axis=1)
            if over is not None:
                same = (held[0] == over[0]) & (held[1] == over[1])
                n = int(same.argmin()) if not same.all() else held.shape[1]
                if n:
                    yield told(held[0, :n], held[1, :n], held[2, :n], True)
                held = held[:, n:]
                if not held.shape[1]:
                    continue
                over = None
            last = np.flatnonzero((held[0] != held[0, -1]) | (held[1] != held[1, -1]))
            n = int(last[-1]) + 1 if len(last) else 0
            if n:
                yield from work(held[:, :n])
                held = held[:, n:]
            if cap is not None and held.shape[1] > cap:
                over = (held[0, 0], held[1, 0])
                yield told(held[0], held[1], held[2], True)
                held = held[:, :0]
        if held.shape[1]:
            yield from work(held)

    return link


def _linked(groups: DataFrame, cap: int | None) -> DataFrame:
    return groups.repartition("kind", "key").sortWithinPartitions("kind", "key").mapInArrow(_runs(cap), "kind int, a long, b long, rest boolean")


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, enough to connect all that are within DISTANCE of each other."""
    spread = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = settle(_linked(variants(fps.repartition(spread)), GROUP), "links")
    rest = first.where("rest").select("kind", F.col("a").alias("key"), F.col("b").alias("fp"))
    edges = first.where("not rest").select("a", "b")
    if not rest.isEmpty():
        edges = edges.union(_linked(finer(rest), None).where("not rest").select("a", "b"))
    return edges.distinct()


def classified(docs: DataFrame, text: str = "text", id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, fp) of docs, and classes (fp, root, component_id) of the distinct fingerprints; both settled."""
    prepared(docs.sparkSession)
    rows = settle(fingerprints(docs, text, id), "fingerprints")
    distinct = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connect(links(distinct.select("fp")))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = settle(rooted, "rooted")
    least = settle(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    classes = settle(rooted.join(least, "root").select("fp", "root", "component_id"), "classes")
    for done in (distinct, rooted, least):
        forget(done)
    return rows, classes


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, fp and component_id of every row of docs.

    Rows whose fingerprints differ in at most three bits are linked; component_id is the smallest doc_id that
    links reach. Null and empty texts have fingerprint zero and are linked like any other. Repeated rows each
    return; a null doc_id takes part and is the smallest of nothing. An empty table gives no rows. Other columns
    of docs are not read.
    """
    rows, classes = classified(docs, text, id)
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", id: str = "doc_id", classify=classified) -> DataFrame:
    """docs with one row of each near-duplicate group, as classify finds them: the smallest id (null last), of its
    texts the one with the smallest hash (a null text counts as empty), and of its repeated rows one. Columns are as
    before, whatever their names; an empty table stays empty. Only rows that are repeated in full are brought together
    as whole rows, to keep one of them."""
    rows, classes = classify(docs, text, id)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    least = rows.groupBy("fp", order.alias("o")).agg(F.count("*").alias("n")).groupBy("fp").agg(F.min(F.struct("o", "n")).alias("o"))
    kept = least.join(classes, "fp").groupBy("root").agg(F.min("o").alias("o"))
    kept = settle(kept.select(F.col("o.o.doc_id").alias("keep_id"), F.col("o.o.h").alias("keep_h"), (F.col("o.n") > 1).alias("several")), "kept")
    forget(rows)
    forget(classes)
    own = docs.select(F.struct("*").alias("keep_row"), F.col(id).alias("keep_own"), F.xxhash64(text).alias("keep_hash"))

    def met(which: str) -> DataFrame:
        these = kept.where(which)
        return own.join(these, (own["keep_hash"] == these["keep_h"]) & own["keep_own"].eqNullSafe(these["keep_id"]), "left_semi")

    found = met("not several").select("keep_row.*")
    if kept.where("several").isEmpty():
        return found
    return found.union(met("several").dropDuplicates(["keep_own", "keep_hash"]).select("keep_row.*"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
