"""Exact top-k inner products by MaxScore over shards of integer vectors.

A query's terms are its components. A shard has a posting list for each dimension: its rows in order of that component.
What a term adds to a row's score, above the least that it adds to any row, lies between zero and a bound. Terms whose
bounds together cannot lift a row to the threshold are non-essential. The rows that can reach it are in the heads of
the essential terms' lists, down to where all essential terms together fall short; these heads are traversed, and the
non-essential terms are probed, the strongest first, for rows that can still compete.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavesift.llm.shared import forget, prepared, settle, table

K, SCALE, QUERY_EVERY = 10, 1024, 100
#: Queries that are sent to the executors at once, as doubles: with 64 components 4 MB. More are taken in further
#: passes, each of which reads the rows once.
QUERIES = 8_192
#: Vectors of a shard: its rows, lists and sorted values take 1.3 KB for each of 64 components.
BLOCK = 32_768
#: Bound on the sums of products that are taken in double precision, so that rounding stays far below one half.
EXACT = float(1 << 40)
#: Non-essential terms that are probed at once, and rows of the strongest list that give a first threshold.
PROBED, FIRST = 8, 256
#: Scores are longs; one beyond is given as the nearest long, and ranked by its true value.
LEAST_LONG, MOST_LONG = -(1 << 63), (1 << 63) - 1


def doubles(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """vec_id and v, the components as doubles; vectors that are null or empty or that hold null or non-finite
    components are left out, and so are rows without an id."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    own = rows.where(F.size(vector) > 0).select(F.col(id).cast("long").alias("vec_id"), v.alias("v"))
    return own.where(F.forall("v", finite) & F.col("vec_id").isNotNull())


def whole(x: float, scale: int) -> int:
    """floor(scale * x), also where the product is beyond a double."""
    y = x * scale
    return math.floor(y) if math.isfinite(y) else int(x) * scale


class Shard:
    """Rows of one length with their posting lists."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.columns = ids, np.ascontiguousarray(rows.T)
        self.lists = np.argsort(self.columns, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.columns, self.lists, axis=1)
        self.low, self.high = self.sorted[:, 0], self.sorted[:, -1]
        self.most = float(np.abs(rows).max())

    def head(self, term: int, q: float, added: float) -> np.ndarray:
        """The rows of a term's list to which it adds at least so much above its least."""
        if q > 0:
            return self.lists[term, np.searchsorted(self.sorted[term], self.low[term] + added / q, "left") :]
        return self.lists[term, : np.searchsorted(self.sorted[term], self.high[term] + added / q, "right")]

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return q @ self.columns[:, rows]

    def best(self, query_id: int, q: np.ndarray, k: int, held: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The k best of held, (score, -vec_id) pairs, and this shard's rows; ties go to the smaller vec_id."""
        ends = np.stack([q * self.low, q * self.high])
        least = ends.min(axis=0)
        bound = ends.max(axis=0) - least
        order = np.argsort(-bound, kind="stable")
        rest = np.concatenate([bound[order][::-1].cumsum()[::-1], [0.0]])  # what the terms from each place on can add
        base = least.sum()
        theta = held[-1][0] if len(held) == k else None
        strong = order[0]
        first = self.lists[strong, -FIRST:] if q[strong] > 0 else self.lists[strong, :FIRST]
        found = self.scores(q, first)[self.ids[first] != query_id]
        if len(found) >= k:
            floor = np.partition(found, len(found) - k)[len(found) - k]
            theta = floor if theta is None else max(theta, floor)
        if theta is None:
            essential, rows = len(order), np.flatnonzero(self.ids != query_id)
        else:
            essential = int(np.count_nonzero(base + rest[:-1] >= theta))
            if not essential:
                return held  # all terms together cannot reach the threshold
            need, total = theta - base - rest[essential] - 0.5, rest[0] - rest[essential]
            if need <= 0:
                rows = np.flatnonzero(self.ids != query_id)
            else:
                met = np.zeros(len(self.ids), bool)
                for t in order[:essential].tolist():
                    if bound[t] > 0:
                        met[self.head(t, q[t], need * (bound[t] / total))] = True
                met[self.ids == query_id] = False
                rows = np.flatnonzero(met)
        own = order[:essential]
        part = q[own] @ (self.columns[own] if 2 * len(rows) > len(self.ids) else self.columns[np.ix_(own, rows)])
        part = (part[rows] if 2 * len(rows) > len(self.ids) else part) - least[own].sum() + base
        at = essential
        while True:
            if len(part) > k:
                floor = np.partition(part, len(part) - k)[len(part) - k]  # a row has at least what it has so far
                theta = floor if theta is None else max(theta, floor)
            if theta is not None:
                open_ = part + rest[at] >= theta - 0.5
                rows, part = rows[open_], part[open_]
            if at == len(order):
                break
            terms = order[at : at + PROBED]
            part = part + q[terms] @ self.columns[np.ix_(terms, rows)] - least[terms].sum()
            at += len(terms)
        return _merged(k, held, np.rint(part).astype(np.int64).tolist(), self.ids[rows].tolist())


def _merged(k: int, held: list[tuple[int, int]], scores: list[int], ids: list[int]) -> list[tuple[int, int]]:
    return sorted(held + [(s, -i) for s, i in zip(scores, ids, strict=True)], reverse=True)[:k]


def search(queries: DataFrame, rows: DataFrame, k: int = K, scale: int = SCALE, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: for each query the k rows of the highest integer inner product.

    A row's components are floor(scale * x). A query's own row (that of its vec_id) is no candidate. Ties go to
    the smaller vec_id. Rows whose vec_id is null, or whose vector is null, empty, of another length than the
    query's or not finite take no part; components may be of any size, and a score beyond a long is given as the
    nearest long. Repeated candidates each count, repeated queries once; no queries or no candidates give no rows;
    other columns are not read, so they may have any names. Queries are taken in blocks of QUERIES, each a pass over
    the rows whose partial results are written to the shared folder.
    """
    spark = prepared(rows.sparkSession)
    asked = settle(doubles(queries, id, vector).dropDuplicates(["vec_id"]), "queries")
    total = asked.count()
    passes = max(1, -(-total // QUERIES))
    merged = None
    for n in range(passes):
        block = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == n)
        found = settle(_pass(spark, block, doubles(rows, id, vector), k, scale), "topk")
        merged = found if merged is None else merged.union(found)
    forget(asked)
    # a long's ends stand for all scores beyond them, which the column beyond puts in order
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pass(spark: SparkSession, block: DataFrame, rows: DataFrame, k: int, scale: int) -> DataFrame:
    held = spark.sparkContext.broadcast([(r.vec_id, np.array(r.v, np.float64)) for r in block.toLocalIterator()])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {q: [] for q, _ in held.value}
        with np.errstate(over="ignore"):
            asked = [(q, v, np.floor(v * scale)) for q, v in held.value]
        waiting: list[pa.RecordBatch] = []

        def work() -> None:
            all_ = pa.Table.from_batches(waiting)
            ids = all_.column(0).to_numpy()
            sizes = np.array([len(v) for v in all_.column(1)])
            flat = all_.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            ends = sizes.cumsum()
            for n in np.unique(sizes):
                own = np.flatnonzero(sizes == n)
                raw = flat[(ends[own] - n)[:, None] + np.arange(n)]
                with np.errstate(over="ignore"):
                    made = np.floor(raw * scale)
                most = np.abs(made).max(axis=1)
                small = most * most * n < EXACT  # a row with a great component is scored by itself, in whole numbers
                shard = Shard(ids[own][small], made[small]) if small.any() else None
                for q, v, whole_ in asked:
                    if len(v) != n:
                        continue
                    wide = ~small
                    if shard is not None:
                        if float(np.abs(whole_).max()) * shard.most * n < EXACT:
                            best[q] = shard.best(q, whole_, k, best[q])
                        else:
                            wide = np.ones(len(own), bool)
                    if wide.any():
                        best[q] = _plain(ids[own][wide], raw[wide], q, v, k, scale, best[q])
            waiting.clear()

        gathered = 0
        for b in batches:
            waiting.append(b)
            gathered += b.num_rows
            if gathered >= BLOCK:
                work()
                gathered = 0
        if waiting:
            work()
        rows = [(q, -i, min(max(s, LEAST_LONG), MOST_LONG), str(s)) for q, own in best.items() for s, i in own]
        for at in range(0, len(rows), 65_536):
            q, i, s, true = zip(*rows[at : at + 65_536], strict=True)
            beyond = [x if abs(int(x)) > MOST_LONG else None for x in true]
            yield pa.record_batch([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.int64()), pa.array([None if x is None else _order(int(x)) for x in beyond], pa.string())], ["query_id", "vec_id", "score", "beyond"])

    return rows.mapInArrow(each, "query_id long, vec_id long, score long, beyond string")


def _order(x: int) -> str:
    """A string whose order is that of the numbers beyond a long."""
    size = f"{len(str(abs(x))):06d}{abs(x)}"
    return "1" + size if x > 0 else "0" + "".join(chr(ord("9") - int(c) + ord("0")) for c in size)


def _plain(ids: np.ndarray, rows: np.ndarray, query_id: int, q: np.ndarray, k: int, scale: int, held: list) -> list:
    """Scores in Python's whole numbers, for components of any size."""
    own = [whole(x, scale) for x in q.tolist()]
    for i, row in zip(ids.tolist(), rows.tolist(), strict=True):
        if i != query_id:
            held = _merged(k, held, [sum(a * whole(x, scale) for a, x in zip(own, row, strict=True))], [i])
    return held


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for every embedding whose vec_id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    return search(rows.where(F.col("vec_id") % QUERY_EVERY == 0), rows)


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_dot_product(q.v::double[], c.v::double[]) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select * from r where rank <= 10
"""
