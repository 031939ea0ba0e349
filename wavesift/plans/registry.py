"""All queries of the engine by name, and SQL that gives the same rows from the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavesift.functions import parsers, scores
from wavesift.functions.signal_kernels import Settings
from wavesift.operators import budget, evaluation, frames, select, signal, subtitles
from wavesift.session import table

BUDGET, SMALL = 16, 4

SEQ = """f as (select user_id as seq_id, row_number() over (partition by user_id order by ts, event_id) - 1 as idx, event_id as orig_idx,
  case when max(value) over (partition by user_id) = min(value) over (partition by user_id) then 0.5
  else (value - min(value) over (partition by user_id)) / (max(value) over (partition by user_id) - min(value) over (partition by user_id)) end as score from events)"""
LEN = SEQ + ", n as (select seq_id, count(*) as n from f group by 1)"
TOPS = SEQ + """, r0 as (select *, case when lag(score) over (partition by seq_id order by idx) is not distinct from score then 0 else 1 end as nw from f),
 r1 as (select *, sum(nw) over (partition by seq_id order by idx) as run from r0),
 r2 as (select seq_id, run, min(idx) as a, max(idx) as b, min(score) as v from r1 group by 1, 2),
 r3 as (select *, lag(v) over (partition by seq_id order by run) as bf, lead(v) over (partition by seq_id order by run) as af from r2),
 lm as (select seq_id, (a + b) // 2 as idx, v from r3 where v > bf and v > af),
 th as (select seq_id, avg(abs(score)) + 0.5 * stddev_pop(abs(score)) as height, 0.05 * (max(abs(score)) - min(abs(score))) as prominence from f group by 1),
 hm as (select lm.* from lm join th using (seq_id) where v >= height)"""
SEG = TOPS + """, sg as (select f.seq_id, f.idx, f.score, sum(case when hm.idx is null then 0 else 1 end) over (partition by f.seq_id order by f.idx)::bigint as seg
 from f left join hm on hm.seq_id = f.seq_id and hm.idx = f.idx),
 wh as (select seq_id, count(*) as n, var_pop(score) as sp from sg group by 1),
 im as (select g.seq_id, g.seg, 0.4 * g.len / wh.n + 0.2 * g.mean + 0.3 * g.most + 0.1 * g.v / (wh.sp + 1e-8) as importance
  from (select seq_id, seg, count(*) as len, avg(score) as mean, max(score) as most, var_pop(score) as v from sg group by 1, 2) g join wh using (seq_id)),
 k0 as (select *, count(*) over (partition by seq_id) <= 3 or importance >= greatest(0.05, avg(importance) over (partition by seq_id) - 1.2 * stddev_pop(importance) over (partition by seq_id)) as ok from im),
 kp as (select seq_id, seg, importance from (select *, max(ok::int) over (partition by seq_id) as any_ok from k0) where ok or any_ok = 0),
 sm as (select *, e / sum(e) over (partition by seq_id) as weight from (select *, exp(importance - max(importance) over (partition by seq_id)) as e from kp)),
 al as (select seq_id, seg, floor(weight * 16)::bigint + (case when row_number() over (partition by seq_id order by weight * 16 - floor(weight * 16) desc, seg desc)
  <= 16 - sum(floor(weight * 16)) over (partition by seq_id) then 1 else 0 end) as n_alloc from sm)"""
RESULTS = """x as (select d.doc_id, d.lang, d.source, coalesce(l.quality, -1) as quality,
  case when d.n_chars % 5 = d.doc_id % 5 then 1 else 0 end as correct from documents d left join labels l on l.doc_id = d.doc_id)"""
INTERVALS = """iv as (select user_id, event_id, epoch_us(ts) / 1e6 as start_s, epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) / 1e6 as end_s from events)"""
PT = INTERVALS + """, pt as (select user_id, event_id as id, epoch_us(ts) / 1e6 + 0.25 as t from events), sp as (select * from iv where end_s is not null)"""
KIND = "case event_id % 4 when 0 then 'A' when 1 then 'B' when 2 then 'C' else 'D' end"

Query = Callable[[SparkSession, str], DataFrame]
_all: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _all[f.__name__] = (f, sql)
        return f

    return add


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    return frames.frames(spark, d)


def _tops(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _sequences(spark, d)
    return rows, signal.high_maxima(rows, "score")


def _segmented(spark: SparkSession, d: str) -> DataFrame:
    return signal.segmented(*_tops(spark, d))


def _results(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", "quality")
    right = (F.col("n_chars") % 5 == F.col("doc_id") % 5).cast("int")
    return table(spark, d, "documents").join(labels, "doc_id", "left").select("doc_id", "lang", "source", F.coalesce("quality", F.lit(-1)).alias("quality"), right.alias("correct"))


def _seconds(c: str) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


def _intervals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, d, "events")
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    spans = events.select("user_id", "event_id", _seconds("ts").alias("start_s"), F.lead(F.unix_micros(F.col("ts").cast("timestamp"))).over(by).alias("e")).withColumn("end_s", F.col("e") / 1e6).drop("e").where("end_s is not null")
    points = events.select("user_id", F.col("event_id").alias("id"), (_seconds("ts") + 0.25).alias("t"))
    return points, spans


def _r(c: str, digits: int = 6) -> F.Column:
    return F.round(c, digits).alias(c)


@query(f"with {SEQ} select seq_id, idx, orig_idx, round(score, 6) as score from f")
def seq_frames(spark, d):
    return _sequences(spark, d).select("seq_id", "idx", "orig_idx", _r("score"))


@query(f"with {SEQ} select seq_id, idx, orig_idx from f where idx % 7 = 0")
def stride_sample(spark, d):
    return frames.stride_sample(_sequences(spark, d), F.lit(30.0), 4.0).select("seq_id", "idx", "orig_idx")


@query(f"with {LEN} select seq_id, i as rank, case when i = 15 then n - 1 else floor(i * ((n - 1) / 15.0::double))::bigint end as idx from n, unnest(range(16)) t(i)")
def uniform_sample(spark, d):
    return frames.lengths(_sequences(spark, d)).select("seq_id", F.posexplode(frames.linspace(F.col("n"), BUDGET)).alias("rank", "idx")).withColumn("rank", F.col("rank").cast("long"))


@query(f"with {LEN} select seq_id, i as rank, floor((n - 1) / 8.0::double / 2 + round_even((n - 1) / 8.0::double * i, 0))::bigint as idx from n, unnest(range(8)) t(i)")
def midpoint_sample(spark, d):
    return frames.lengths(_sequences(spark, d)).select("seq_id", F.posexplode(frames.midpoints(F.col("n"), 8)).alias("rank", "idx")).withColumn("rank", F.col("rank").cast("long"))


@query(f"with {LEN} select seq_id, case when n > 64 then (case when i = 15 then n - 1 else floor(i * ((n - 1) / 15.0::double))::bigint end) else i * 4 end as idx from n, unnest(range(20)) t(i) where (n > 64 and i < 16) or (n <= 64 and i * 4 < n)")
def fps_or_uniform_sample(spark, d):
    places = F.when(F.col("n") > 64, frames.linspace(F.col("n"), BUDGET)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(4).cast("long")))
    return frames.lengths(_sequences(spark, d)).select("seq_id", F.explode(places).alias("idx"))


@query(f"with {SEQ} select f.seq_id, t.rank::bigint as rank, f.idx, f.orig_idx from f join (select unnest([0, 1, 2, 3]) as rank, unnest([9, 2, 9, 40]) as idx) t on t.idx = f.idx")
def index_list_pick(spark, d):
    return frames.pick(_sequences(spark, d), [9, 2, 9, 40, 100_000])


@query(f"with {SEQ} select seq_id, idx, orig_idx from f where idx >= 10 and idx < 20")
def range_slice(spark, d):
    return frames.between(_sequences(spark, d), 10, 20).select("seq_id", "idx", "orig_idx")


@query("select doc_id, n_chars from documents where doc_id % 4 = 1 and doc_id < 500")
def rank_shard(spark, d):
    return frames.shard(table(spark, d, "documents"), "doc_id", 1, 4, 500).select("doc_id", "n_chars")


@query("select doc_id, lang, (row_number() over (partition by lang order by n_chars desc, text, doc_id) - 1) // 8 as batch from documents")
def length_batches(spark, d):
    return frames.length_batches(table(spark, d, "documents"), 8)


@query("select o_custkey as video_id, min(o_orderkey) as first_ordinal, count(*) as n_questions, string_agg(o_orderkey, ',' order by o_orderkey) as questions from orders group by 1")
def group_questions(spark, d):
    held = F.sort_array(F.collect_list("o_orderkey"))
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("video_id")).agg(F.min("o_orderkey").alias("first_ordinal"), F.count("*").alias("n_questions"), F.array_join(F.transform(held, lambda x: x.cast("string")), ",").alias("questions"))


@query("select o_orderkey, case when contains(o_orderpriority, '-') then try_cast(split_part(o_orderpriority, '-', -1) as integer) - 1 end as by_dash, o_orderkey % 3 as question_index from orders")
def question_index_parse(spark, d):
    made = F.concat(F.col("o_custkey").cast("string"), F.lit("-"), (F.col("o_orderkey") % 3 + 1).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", parsers.question_index(F.col("o_orderpriority")).alias("by_dash"), parsers.question_index(made).cast("long").alias("question_index"))


@query("select item_id, text || ' ' || concat_ws(' ', 'A', 'B') as query from benchmark")
def query_text(spark, d):
    return table(spark, d, "benchmark").select("item_id", parsers.query_text(F.col("text"), F.array(F.lit("A"), F.lit("B"))).alias("query"))


@query("select d.doc_id, l.quality, l.doc_id is null as missing from documents d left join labels l on l.doc_id = d.doc_id")
def record_score_left_join(spark, d):
    held = table(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("found"))
    return table(spark, d, "documents").join(held, "doc_id", "left").select("doc_id", "quality", F.col("found").isNull().alias("missing"))


@query("select d.doc_id, case when l.doc_id is null then 'missing_payload' when l.quality = 0 then 'missing_scores' when d.n_chars < 400 then 'too_short' else 'selected' end as status from documents d left join labels l on l.doc_id = d.doc_id")
def status_cascade(spark, d):
    held = table(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("found"))
    status = F.when(F.col("found").isNull(), "missing_payload").when(F.col("quality") == 0, "missing_scores").when(F.col("n_chars") < 400, "too_short").otherwise("selected")
    return table(spark, d, "documents").join(held, "doc_id", "left").select("doc_id", status.alias("status"))


@query("with s as (select case when l.doc_id is null then 'missing' when d.n_chars < 400 then 'fallback' else 'success' end as status from documents d left join labels l on l.doc_id = d.doc_id) select count(*) as num_records, count(*) filter (status = 'success') as success, count(*) filter (status <> 'success') as fallback, count(*) filter (status = 'missing') as missing_scores from s")
def run_summary(spark, d):
    held = table(spark, d, "labels").select("doc_id", F.lit(True).alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("n_chars") < 400, "fallback").otherwise("success")
    rows = table(spark, d, "documents").join(held, "doc_id", "left").select(status.alias("status"))
    return rows.agg(F.count("*").alias("num_records"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") != "success").alias("fallback"), F.count_if(F.col("status") == "missing").alias("missing_scores"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def skip_existing_anti(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("select doc_id from documents where doc_id in (select doc_id from labels where quality = 1)")
def available_semi(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id")


@query(f"with {LEN} select seq_id, n, greatest(1, least(floor(log2(n)) - 3, floor(log2(n / 7.0::double))))::bigint as dwt_level from n")
def dwt_level(spark, d):
    return frames.lengths(_sequences(spark, d)).select("seq_id", "n", signal.level().alias("dwt_level"))


@query(f"with {LEN} select seq_id, n, greatest(5, floor(n * 0.02::double))::bigint as min_distance from n")
def min_peak_distance(spark, d):
    return frames.lengths(_sequences(spark, d)).select("seq_id", "n", signal.min_distance().alias("min_distance"))


def _dwt_sql(high: bool) -> str:
    from wavesift.functions.signal_kernels import filters

    f = filters("db4")[1 if high else 0][::-1]
    taps = ", ".join(f"{x!r}::double" for x in map(float, f))
    return f"""with {LEN}, o as (select seq_id, n, i as pos, j, (2 * i + 1 - j + 2 * n) % (2 * n) as p, [{taps}][j + 1] as tap from n, unnest(range(200)) t(i), unnest(range(8)) u(j) where i < (n + 7) // 2)
      select o.seq_id, o.pos, round(sum(o.tap * f.score), 6) + 0.0 as coef from o join f on f.seq_id = o.seq_id and f.idx = case when o.p < o.n then o.p else 2 * o.n - 1 - o.p end group by 1, 2"""


@query(_dwt_sql(False))
def dwt_approx_l1(spark, d):
    return signal.one_level(_sequences(spark, d), False).select("seq_id", "pos", (F.round("coef", 6) + 0.0).alias("coef"))


@query(_dwt_sql(True))
def dwt_detail_l1(spark, d):
    return signal.one_level(_sequences(spark, d), True).select("seq_id", "pos", (F.round("coef", 6) + 0.0).alias("coef"))


@query()
def dwt_band(spark, d):
    return signal.band(_sequences(spark, d)).select("seq_id", "idx", (F.round("detail", 6) + 0.0).alias("detail"))


@query(f"with {TOPS} select seq_id, round(height, 6) as height, round(prominence, 6) as prominence from th")
def peak_thresholds(spark, d):
    return signal.thresholds(_sequences(spark, d), "score").select("seq_id", _r("height"), _r("prominence"))


@query(f"with {TOPS} select seq_id, idx, round(v, 6) as v from lm")
def local_maxima(spark, d):
    return signal.local_maxima(_sequences(spark, d), "score").select("seq_id", "idx", _r("v"))


@query(f"""with recursive {TOPS}, rk as (select *, row_number() over (partition by seq_id order by v desc, idx desc) as r from hm),
 g as (select seq_id, r, [idx] as kept from rk where r = 1 union all
  select rk.seq_id, rk.r, case when len(list_filter(g.kept, lambda q: abs(q - rk.idx) < 5)) = 0 then list_append(g.kept, rk.idx) else g.kept end
  from g join rk on rk.seq_id = g.seq_id and rk.r = g.r + 1),
 z as (select seq_id, max(r) as r from g group by 1)
 select g.seq_id, unnest(g.kept) as idx from g join z on z.seq_id = g.seq_id and z.r = g.r""")
def peaks_distance(spark, d):
    return signal.spaced(_tops(spark, d)[1], 5).select("seq_id", "idx")


@query(f"""with {TOPS}, w as (select hm.seq_id, hm.idx, hm.v, coalesce(max(case when f.idx < hm.idx and f.score > hm.v then f.idx end), -1) as l,
  coalesce(min(case when f.idx > hm.idx and f.score > hm.v then f.idx end), 1000000) as r from hm join f on f.seq_id = hm.seq_id group by 1, 2, 3)
 select w.seq_id, w.idx, round(w.v - greatest(min(case when f.idx <= w.idx then f.score end), min(case when f.idx >= w.idx then f.score end)), 6) as prominence
 from w join f on f.seq_id = w.seq_id and f.idx > w.l and f.idx < w.r group by w.seq_id, w.idx, w.v""")
def peaks_prominence(spark, d):
    rows, tops = _tops(spark, d)
    return signal.prominences(rows, tops, "score").select("seq_id", "idx", _r("prominence"))


@query(f"with {SEG} select seq_id, seg, min(idx) as start, max(idx) + 1 as end_ from sg group by 1, 2")
def segments(spark, d):
    return signal.segments(*_tops(spark, d)).withColumnRenamed("end", "end_")


@query(f"with {SEG} select seq_id, seg, round(importance, 6) as importance from im")
def segment_importance(spark, d):
    return budget.importance(_segmented(spark, d)).select("seq_id", "seg", _r("importance"))


@query(f"with {SEG} select seq_id, seg, round(importance, 6) as importance from kp")
def segment_filter(spark, d):
    return budget.strong(budget.importance(_segmented(spark, d))).select("seq_id", "seg", _r("importance"))


@query(f"with {SEG} select seq_id, seg, round(weight, 6) as weight from sm")
def softmax_weights(spark, d):
    return budget.softmax(budget.strong(budget.importance(_segmented(spark, d)))).select("seq_id", "seg", _r("weight"))


@query(f"with {SEG} select seq_id, seg, n_alloc from al")
def budget_allocation(spark, d):
    return budget.allocate(budget.strong(budget.importance(_segmented(spark, d))), BUDGET)


@query(f"with {SEG} select seq_id, seg, idx, round(score, 6) as score from (select *, row_number() over (partition by seq_id, seg order by score desc, idx) as r from sg) where r = 1")
def segment_anchor(spark, d):
    return select.anchors(_segmented(spark, d)).select("seq_id", "seg", "idx", _r("score"))


def _greedy_sql(like: str, source: str) -> str:
    """The greedy choice of SMALL items, a step at a time; like: SQL for the likeness of f and a chosen item g."""
    parts = [source, "s1 as (select seq_id, 0::bigint as rank, idx from (select *, row_number() over (partition by seq_id order by score desc, idx) as r from f) where r = 1)"]
    for n in range(2, SMALL + 1):
        held = " union all ".join(f"select * from s{i}" for i in range(1, n))
        parts.append(f"h{n} as ({held})")
        parts.append(f"""v{n} as (select f.seq_id, f.idx, 0.5 * (2 * f.score - 1) - 0.5 * max({like}) as value from f join h{n} c on c.seq_id = f.seq_id join f g on g.seq_id = c.seq_id and g.idx = c.idx
          where not exists (select 1 from h{n} o where o.seq_id = f.seq_id and o.idx = f.idx) group by f.seq_id, f.idx, f.score)""")
        parts.append(f"s{n} as (select seq_id, {n - 1}::bigint as rank, idx from (select *, row_number() over (partition by seq_id order by round(value, 12) desc, idx) as r from v{n}) where r = 1)")
    return f"with {', '.join(parts)} " + " union all ".join(f"select * from s{i}" for i in range(1, SMALL + 1))


@query(_greedy_sql("exp(-abs(f.idx - g.idx) / 10.0::double)", SEQ))
def mmr_temporal(spark, d):
    return select.greedy(_sequences(spark, d), SMALL)


_VECTORS = SEQ.replace("f as (", "f0 as (") + """, ct as (select count(*) as c from embeddings),
 f as (select f0.*, list_transform(e.embedding, lambda x: x::double) as v from f0, ct join embeddings e on e.vec_id = f0.orig_idx % ct.c)"""


def _with_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    rows = _sequences(spark, d).withColumn("vec_id", F.col("orig_idx") % e.agg(F.count("*")).scalar())
    return rows.join(e.select("vec_id", F.col("embedding").alias("vector")), "vec_id").select("seq_id", "idx", "orig_idx", "score", "vector")


@query(_greedy_sql("list_dot_product(f.v, g.v) / (sqrt(list_dot_product(f.v, f.v)) * sqrt(list_dot_product(g.v, g.v)))", _VECTORS))
def mmr_visual(spark, d):
    return select.greedy(_with_vectors(spark, d), SMALL, vectors=True)


@query()
def budget_fill(spark, d):
    rows = _segmented(spark, d)
    return select.filled(rows, select.anchors(rows), BUDGET)


@query(f"with {SEQ} select seq_id, idx from (select *, row_number() over (partition by seq_id order by score desc, idx) as r from f) where r <= 16")
def budget_trim(spark, d):
    return select.trimmed(_sequences(spark, d), BUDGET)


@query(f"""with {LEN}, u as (select distinct seq_id, case when i = 7 then n - 1 else floor(i * ((n - 1) / 7.0::double))::bigint end as idx from n, unnest(range(8)) t(i)),
 o as (select f.*, row_number() over (partition by f.seq_id order by f.score desc, f.idx desc) as r from f where not exists (select 1 from u where u.seq_id = f.seq_id and u.idx = f.idx))
 select f.seq_id, f.idx, f.orig_idx from f join u on u.seq_id = f.seq_id and u.idx = f.idx union all select seq_id, idx, orig_idx from o where r <= 8""")
def weak_boundary_hybrid(spark, d):
    return select.hybrid(_sequences(spark, d), BUDGET)


@query(f"""with {LEN}, c as (select distinct f.seq_id, f.orig_idx as o from f where idx in (3, 5, 8, 13, 21)),
 u as (select f.seq_id, f.orig_idx as o from n, unnest(range(8)) t(i), f where f.seq_id = n.seq_id and f.idx = case when i = 7 then n - 1 else floor(i * ((n - 1) / 7.0::double))::bigint end),
 m as (select seq_id, o, row_number() over (partition by seq_id order by o) as r from (select * from c union select * from u))
 select seq_id, string_agg(o, ',' order by o) as keyframe_indices from m where r <= 8 group by 1""")
def map_to_original(spark, d):
    held = _sequences(spark, d).groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("idx", "orig_idx"))).alias("held"))
    chosen = F.array(*[F.lit(i).cast("long") for i in (21, 3, 5, 8, 13, 8, 9_999)])
    mapped = select.to_original(chosen, F.col("held.orig_idx"), 8)
    return held.select("seq_id", F.array_join(F.transform(mapped, lambda x: x.cast("string")), ",").alias("keyframe_indices"))


@query()
def keyframes_flagship(spark, d):
    return select.keyframes(_sequences(spark, d))


@query()
def keyframes_visual(spark, d):
    return select.keyframes(_with_vectors(spark, d), Settings(budget=8), vectors=True)


@query("""select a.vec_id, round(list_dot_product(list_transform(a.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double))
  / (sqrt(list_dot_product(list_transform(a.embedding, lambda x: x::double), list_transform(a.embedding, lambda x: x::double))) * sqrt(list_dot_product(list_transform(b.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double)))), 6) + 0.0 as score
  from embeddings a join embeddings b on b.vec_id = 0""")
def cosine_scores(spark, d):
    e = table(spark, d, "embeddings")
    one = e.where("vec_id = 0").agg(F.min("embedding")).scalar()
    return e.withColumn("q", one).select("vec_id", (F.round(scores.cosine(F.col("embedding"), F.col("q")), 6) + 0.0).alias("score"))


@query("select event_id, round(1 / (1 + exp(value / 100 - (event_id % 7))), 6) as score from events")
def two_class_softmax(spark, d):
    return table(spark, d, "events").select("event_id", F.round(scores.second_of_two(F.col("value") / 100, F.col("event_id") % 7), 6).alias("score"))


@query("select event_id, round(1 / (1 + exp(-(value - 100) / 50)), 6) as score from events")
def sigmoid_scores(spark, d):
    return table(spark, d, "events").select("event_id", F.round(scores.sigmoid((F.col("value") - 100) / 50), 6).alias("score"))


_PHRASES = "trim(text)"
for _p in parsers.PREFIXES:
    _PHRASES = f"replace({_PHRASES}, '{_p}', '')"


@query(f"select doc_id, regexp_extract({_PHRASES}, '[ABCD]', 0) as pred from documents")
def parse_answer_first_letter(spark, d):
    return table(spark, d, "documents").select("doc_id", parsers.first_letter(F.col("text")).alias("pred"))


_SAID = f"""case event_id % 8 when 0 then '(' || {KIND} || ') or (B)' when 1 then 'It is ' || {KIND} || ' then C ' when 2 then {KIND} || '.x' when 3 then 'e' when 4 then '(' || {KIND} || ')'
 when 5 then 'DNA test, ' || {KIND} || ' it is' when 6 then '.,' || {KIND} || '!?' else 'x(' || {KIND} || '):' end"""
_STRIPPED = _SAID
for _c in (",", ".", "!", "?", ";", ":", "''"):
    _STRIPPED = f"trim({_STRIPPED}, '{_c}')"


def _last(needle: str) -> str:
    """SQL: where needle stands last in s, from 0 on, -1 if nowhere."""
    return f"case when contains(s, {needle}) then length(s) - instr(reverse(s), reverse({needle})) - length({needle}) + 1 else -1 end"


_PLACES = _last("'(' || x || ')'") + " as l1, " + _last("' ' || x || ' '") + " as l2"


@query(f"""with p as (select event_id, ' ' || {_STRIPPED} || ' ' as s from events),
 c as (select event_id, x, n, contains(s, '(' || x || ')') as b1, contains(s, x || ' ') as b2, contains(s, x || '.') as b3, {_PLACES} from p, (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest(range(5)) as n) l),
 m as (select *, max(b1::int) over (partition by event_id) as a1, max(b2::int) over (partition by event_id) as a2 from c),
 r as (select event_id, x, row_number() over (partition by event_id order by case when a1 = 1 then l1 else l2 end desc, n) as q from m where (a1 = 1 and b1) or (a1 = 0 and a2 = 1 and b2) or (a1 = 0 and a2 = 0 and b3))
 select p.event_id, r.x as pred from p left join r on r.event_id = p.event_id and q = 1""")
def parse_answer_choice(spark, d):
    text = F.expr(_SAID)
    return table(spark, d, "events").select("event_id", parsers.choice(text).alias("pred"))


@query("select part.p_partkey, case when instr(s, ')') > 1 then substr(s, instr(s, ')') - 1, 1) when instr(s, ')') = 1 then '' else s end as pred from part, (select p_partkey as pk, case p_partkey % 3 when 0 then p_brand || ') x' when 1 then ')' || p_brand else p_brand end as s from part) t where t.pk = part.p_partkey")
def parse_answer_bracket(spark, d):
    s = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_brand", F.lit(") x"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(")"), "p_brand")).otherwise(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", parsers.bracket(s).alias("pred"))


@query(f"with {RESULTS} select case when grouping(lang) = 0 then 'lang' when grouping(source) = 0 then 'source' when grouping(quality) = 0 then 'quality' else 'overall' end as dimension, coalesce(lang, source, quality::varchar, '') as label, count(*) as n, round(100.0 * sum(correct) / count(*), 6) as accuracy from x group by grouping sets ((lang), (source), (quality), ())")
def accuracy_grouping_sets(spark, d):
    return evaluation.by_each(_results(spark, d), ["lang", "source", "quality"]).select("dimension", "label", "n", _r("accuracy"))


DOMAIN = ["en", "de", "fr", "es", "xx"]


@query(f"with {RESULTS}, dm as (select unnest({DOMAIN}) as label) select label, count(x.doc_id) as n, round(coalesce(100.0 * sum(correct) / nullif(count(x.doc_id), 0), 0), 6) as accuracy from dm left join x on x.lang = label group by 1")
def accuracy_domain_zero_fill(spark, d):
    return evaluation.over_domain(_results(spark, d), "lang", DOMAIN).select("label", "n", _r("accuracy"))


@query(f"with {RESULTS}, g as (select lang as label, count(*) as n, round(sum(correct) / count(*), 5) as a from x group by 1 union all select source, count(*), round(sum(correct) / count(*), 5) from x group by 1) select sum(n)::bigint as n, round(sum(a * n) / sum(n), 5) as accuracy from g")
def accuracy_weighted(spark, d):
    return evaluation.weighted(_results(spark, d), ["lang", "source"])


@query(f"with {RESULTS}, dm as (select unnest({DOMAIN}) as label), g as (select label, coalesce(100.0 * sum(correct) / nullif(count(x.doc_id), 0), 0) as a from dm left join x on x.lang = label group by 1) select round(avg(a), 6) as accuracy from g")
def accuracy_macro(spark, d):
    return evaluation.macro(_results(spark, d), "lang", DOMAIN).select(_r("accuracy"))


@query("select user_id, event_type as pred from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def submission_last_wins(spark, d):
    return evaluation.last_of(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", F.col("event_type").alias("pred"))


@query("select event_type, user_id, event_id from (select *, max(date_trunc('day', ts)) over (partition by event_type) as m from events) where date_trunc('day', ts) = m")
def latest_run_per_key(spark, d):
    rows = table(spark, d, "events").withColumn("day", F.date_trunc("day", "ts"))
    return evaluation.latest_runs(rows, "event_type", "day").select("event_type", "user_id", "event_id")


@query("select event_type, sum(event_id % 100)::bigint as tokens, round(sum(value), 3) as latency, round(case when sum(value) > 0 then sum(event_id % 100) / sum(value) else 0 end, 6) as speed from events group by 1")
def throughput_summary(spark, d):
    tokens, latency = F.sum(F.col("event_id") % 100), F.sum("value")
    return table(spark, d, "events").groupBy("event_type").agg(tokens.alias("tokens"), F.round(latency, 3).alias("latency"), F.round(F.when(latency > 0, F.try_divide(tokens, latency)).otherwise(F.lit(0.0)), 6).alias("speed"))


_LOSSES = "[l_quantity, l_extendedprice / 1000, l_tax * 100 + 5]"


@query(f"select l_orderkey, l_linenumber, list_position({_LOSSES}, list_min({_LOSSES}))::bigint - 1 as best, list_position([l_quantity / 2, l_extendedprice / 1000 / 3, (l_tax * 100 + 5) / 5], list_min([l_quantity / 2, l_extendedprice / 1000 / 3, (l_tax * 100 + 5) / 5]))::bigint - 1 as best_normalised from lineitem")
def mc_argmin_norm(spark, d):
    losses = F.array(F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_tax") * 100 + 5)
    best, norm = evaluation.lowest_choice(losses, F.array(F.lit(2.0), F.lit(3.0), F.lit(5.0)))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", best.alias("best"), norm.alias("best_normalised"))


@query("select l_orderkey, l_linenumber, round(l_quantity - l_tax, 6) as first_gain, round(l_extendedprice - l_discount, 6) as second_gain from lineitem")
def mc_mutual_information(spark, d):
    gain = F.zip_with(F.array("l_quantity", "l_extendedprice"), F.array("l_tax", "l_discount"), lambda a, b: F.round(a - b, 6))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", gain[0].alias("first_gain"), gain[1].alias("second_gain"))


@query("select o_orderkey, case when o_orderstatus = 'F' or o_orderstatus = substr(o_orderpriority, 1, 1) then 1.0 else 0.0 end::double as score from orders")
def multi_target_match(spark, d):
    gold = F.array(F.lit("F"), F.substring("o_orderpriority", 1, 1))
    return table(spark, d, "orders").select("o_orderkey", F.when(F.exists(gold, lambda g: g == F.col("o_orderstatus")), 1.0).otherwise(0.0).alias("score"))


@query("select event_id, round(epoch_us(ts) % 86400000000 // 1000 / 1e3, 3) as seconds from (select event_id, ts from events)")
def srt_time_seconds(spark, d):
    return table(spark, d, "events").select("event_id", F.round(parsers.clock_seconds(F.date_format("ts", "HH:mm:ss,SSS")), 3).alias("seconds"))


@query(f"with {PT} select pt.user_id, pt.id, sp.event_id from pt join sp on sp.user_id = pt.user_id and pt.t >= sp.start_s and pt.t < sp.end_s")
def subtitle_interval_join(spark, d):
    points, spans = _intervals(spark, d)
    return subtitles.covered(points, spans, "user_id", "t", "start_s", "end_s", 36_000).select("user_id", "id", "event_id")


@query(f"""with {PT}, w as (select *, case when end_s - start_s < 1 then (start_s + end_s) / 2 - 0.5 else start_s end as lo, case when end_s - start_s < 1 then (start_s + end_s) / 2 + 0.5 else end_s end as hi from sp)
 select user_id, event_id from w where exists (select 1 from pt where pt.user_id = w.user_id and pt.t > w.lo and pt.t < w.hi)""")
def subtitle_cover_semi(spark, d):
    points, spans = _intervals(spark, d)
    return subtitles.touched(spans, points, "user_id", "t", "start_s", "end_s", 36_000).select("user_id", "event_id")


@query(f"""with {PT}, s as (select user_id, max((start_s + end_s) / 2) over (partition by user_id order by event_id) as t, 'span' as kind, event_id as id from sp),
 a as (select * from s union all select user_id, t, 'point', id from pt) select user_id, row_number() over (partition by user_id order by t, kind, id) - 1 as place, kind, id from a""")
def subtitle_interleave(spark, d):
    points, spans = _intervals(spark, d)
    return subtitles.interleaved(points, spans, "user_id", "event_id", "t", "start_s", "end_s")


@query("""with recursive e as (select r_name as parent, n_name as child from nation join region on r_regionkey = n_regionkey union all select n_name, c_name from customer join nation on n_nationkey = c_nationkey),
 t as (select r_name as root, r_name as member, 0 as level from region union all select t.root, e.child, t.level + 1 from t join e on e.parent = t.member)
 select root, member, level from t where level > 0""")
def task_expand_recursive(spark, d):
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    upper = nation.join(region, region["r_regionkey"] == nation["n_regionkey"]).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    lower = table(spark, d, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("parent"), F.col("c_name").alias("child"))
    return evaluation.expanded(spark, upper.union(lower), region.select(F.col("r_name").alias("root")))


@query("select text, count(*) as n from documents group by 1 having count(*) > 1")
def duplicate_members(spark, d):
    return table(spark, d, "documents").groupBy("text").agg(F.count("*").alias("n")).where("n > 1")


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _all.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all.items() if sql}


from wavesift.plans import more, prompts_and_media  # noqa: E402, F401  (add their queries to _all)
