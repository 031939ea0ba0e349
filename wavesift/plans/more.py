"""Queries of records, samplers, judgements, set operations and scorers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavesift.functions import prompts
from wavesift.functions.signal_kernels import Settings
from wavesift.operators import evaluation, frames, media, scorers, subtitles
from wavesift.plans import selection
from wavesift.plans.registry import BUDGET, LEN, RESULTS, SEQ, _results, query
from wavesift.session import table

_ANNOTATED = "select o_orderkey as ordinal, o_custkey as video_id, 'v' || o_custkey as \"videoID\", case when o_orderkey % 7 = 0 then 'x' else o_custkey || '-' || (o_orderkey % 3 + 1) end as question_id from orders"


def _annotated(spark, d):
    question = F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit("-"), (F.col("o_orderkey") % 3 + 1).cast("string")))
    video = F.concat(F.lit("v"), F.col("o_custkey").cast("string"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("ordinal"), F.col("o_custkey").alias("video_id"), video.alias("videoID"), question.alias("question_id"), video.alias("video_path"), video.alias("video_name"))


@query(f"""with a as ({_ANNOTATED})
 select 'videomme' as benchmark, ordinal, video_id::varchar as feature_id, '/d/data/' || "videoID" || '.mp4' as video_path, case when question_id <> 'x' then ordinal % 3 end::integer as question_index from a
 union all select 'lvb', ordinal, ordinal::varchar, '/d/videos/' || "videoID", null from a union all select 'mlvu', ordinal, question_id, '/d/video/' || "videoID", null from a""")
def adapter_records(spark, d):
    rows = _annotated(spark, d)
    made = [selection.records(rows, name, "/d").select(F.lit(name).alias("benchmark"), "ordinal", "feature_id", "video_path", "question_index") for name in ("videomme", "lvb", "mlvu")]
    return made[0].union(made[1]).union(made[2])


_KIND = "case when seq_id % 5 = 0 then 'missing_payload' when seq_id % 5 = 1 then 'missing_scores' when seq_id % 5 = 2 then 'too_short' else 'selected' end"


def _records(spark, d):
    """A record for each user; payloads are missing, empty or short for some of them, frames are given for others."""
    own = frames.frames(spark, d).groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("idx", "orig_idx", "score"))).alias("held"))
    kind = F.col("seq_id") % 5
    scores = F.when(kind == 2, F.slice("held.score", 1, BUDGET - 1)).when(kind != 1, F.col("held.score"))
    payloads = own.where(kind != 0).select(F.col("seq_id").cast("string").alias("feature_id"), F.when(F.col("seq_id") % 2 == 0, F.col("held.orig_idx")).alias("frame_indices"), scores.alias("clip_similarities"))
    annotations = own.select(F.col("seq_id").alias("ordinal"), F.concat(F.lit("v"), F.col("seq_id").cast("string")).alias("video_name"), F.col("seq_id").alias("question_id"))
    lengths = own.select(F.concat(F.lit("/d/video/v"), F.col("seq_id").cast("string")).alias("video_path"), F.when(F.col("seq_id") % 3 > 0, F.size("held") * 30).alias("n_frames"))
    return selection.records(annotations, "mlvu", "/d"), payloads, lengths


def _decided(spark, d):
    records, payloads, lengths = _records(spark, d)
    return records, selection.decided(records, payloads, "clip", BUDGET), lengths


@query(f"with {LEN} select seq_id as ordinal, {_KIND} as status, case when seq_id % 5 = 2 then {BUDGET - 1} when seq_id % 5 < 2 then -1 else n end::integer as n_scores from n")
def record_decisions(spark, d):
    rows = _decided(spark, d)[1]
    return rows.select("ordinal", "status", F.coalesce(F.size("scores"), F.lit(-1)).alias("n_scores"))


@query(f"""with {LEN} select seq_id as ordinal, {_KIND} as status, string_agg(case when seq_id % 3 = 0 then i when i = {BUDGET - 1} then n * 30 - 1 else floor(i * ((n * 30 - 1) / {BUDGET - 1}.0::double))::bigint end, ',' order by i) as keyframe_indices
 from n, unnest(range({BUDGET})) t(i) where seq_id % 5 <= 2 group by seq_id, n""")
def record_fallbacks(spark, d):
    _, rows, lengths = _decided(spark, d)
    found = selection.keyframes(rows.where(F.col("status") != selection.SELECTED), Settings(), lengths=lengths)
    return found.select("ordinal", "status", F.array_join(F.transform("keyframe_indices", lambda x: x.cast("string")), ",").alias("keyframe_indices"))


@query()
def record_keyframes(spark, d):
    """The whole way: records, payloads, decisions, choice, and the annotations with their keyframes."""
    records, rows, lengths = _decided(spark, d)
    made = selection.outputs(records, selection.keyframes(rows, Settings(), lengths=lengths))
    return made.select("ordinal", "video_name", F.array_join(F.transform("keyframe_indices", lambda x: x.cast("string")), ",").alias("keyframe_indices"))


@query(f"with {LEN} select count(*) as num_records, count(*) filter ({_KIND} = 'selected') as success, count(*) filter ({_KIND} <> 'selected') as fallback, count(*) filter ({_KIND} = 'missing_payload') as missing_scores from n")
def record_summary(spark, d):
    _, rows, lengths = _decided(spark, d)
    return selection.summary(selection.keyframes(rows, Settings(), lengths=lengths))


@query("with s as (select doc_id, case when n_chars % 5 = 0 then 'skipped' when n_chars % 5 = 1 then 'failed' else 'done' end as status from documents) select count(*) as total, count(*) filter (status = 'done') as success, string_agg(doc_id, ',' order by doc_id) filter (status = 'failed') as failed, round(sum(case when status = 'done' then 0.5 else 0 end), 3)::double as read_time, 0.0::double as model_time from s")
def prepare_summary(spark, d):
    kind = F.col("n_chars") % 5
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("feature_id"), F.when(kind == 0, "skipped").when(kind == 1, "failed").otherwise("done").alias("status"), F.when(kind > 1, 0.5).alias("read_time"), F.lit(None).cast("double").alias("model_time"))
    return selection.prepared(rows).withColumn("failed", F.array_join(F.transform("failed", lambda x: x.cast("string")), ",")).withColumn("read_time", F.round("read_time", 3))


@query("select doc_id, doc_id not in (select doc_id from labels where doc_id is not null) as missing from documents")
def missing_videos(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("video_path"))
    there, missing = selection.without_videos(rows, table(spark, d, "labels").select(F.col("doc_id").alias("video_path")))
    return there.select("doc_id", F.lit(False).alias("missing")).union(missing.select("doc_id", F.lit(True).alias("missing")))


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F'")
def duration_class(spark, d):
    return selection.of_class(table(spark, d, "orders"), "F", "o_orderstatus").select("o_orderkey", "o_orderstatus")


@query("select p_partkey, p_name from part")
def drop_media(spark, d):
    return selection.without_media(table(spark, d, "part").select("p_partkey", "p_name", F.col("p_name").cast("binary").alias("content"), F.lit("x").alias("image")))


@query("select o_orderkey, case when o_orderkey % 7 = 0 then (row_number() over (partition by o_custkey order by o_orderkey) - 1)::integer else (o_orderkey % 3)::integer end as question_index from orders")
def question_places(spark, d):
    from wavesift.sources.files import question_places as places

    return places(_annotated(spark, d), "video_id").select(F.col("ordinal").alias("o_orderkey"), "question_index")


@query(f"with {LEN}, s as (select seq_id, n, ceil(n / 3.0::double) > 25 as many from n) select seq_id, case when many then (case when i = 24 then n - 1 else floor(i * ((n - 1) / 24.0::double))::bigint end) else i * 3 end as idx from s, unnest(range(60)) t(i) where (many and i < 25) or (not many and i * 3 < n)")
def rate_sample(spark, d):
    return frames.lengths(frames.frames(spark, d)).select("seq_id", F.explode(frames.by_rate(F.col("n"), F.lit(29.97), 10.0, 25)).alias("idx"))


@query(f"with {SEQ} select seq_id, idx, orig_idx, idx // 16 as run from f")
def batches_and_back(spark, d):
    rows = frames.frames(spark, d).select("seq_id", "idx", F.array("orig_idx").alias("vector"))
    return frames.flat(frames.batched(rows, 16, "idx")).select("seq_id", "idx", F.col("vector")[0].alias("orig_idx"), "run")


@query("select c_custkey, (floor(c_acctbal * 2.5))::bigint as frame from customer where c_acctbal >= 0")
def seconds_to_frame(spark, d):
    return table(spark, d, "customer").where("c_acctbal >= 0").select("c_custkey", prompts.to_frame(F.col("c_acctbal"), F.lit(2.5)).alias("frame"))


@query(f"""with {LEN}, q as (select seq_id, n, i, case when i = 7 then n * 10 - 1 else floor(i * ((n * 10 - 1) / 7.0::double))::bigint end as p from n, unnest(range(8)) t(i)),
 h as (select distinct f.seq_id, f.idx, f.orig_idx from f join q on q.seq_id = f.seq_id and q.p >= f.idx * 10 and q.p < f.idx * 10 + 5)
 select n.seq_id, coalesce(string_agg('s' || orig_idx, chr(10) order by idx), '') as texts from n left join h on h.seq_id = n.seq_id group by 1""")
def subtitles_by_frame(spark, d):
    text = F.concat(F.lit('<font color="white" size=".72c">s'), F.col("orig_idx").cast("string"), F.lit("</font>"))
    own = F.struct("idx", F.col("idx").cast("double").alias("start_s"), (F.col("idx") + 0.5).alias("end_s"), text.alias("text"))
    held = frames.frames(spark, d).groupBy("seq_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(own)).alias("subtitles"))
    return held.select("seq_id", F.array_join(prompts.subtitles_at(F.col("subtitles"), F.lit(10.0), F.col("n") * 10, F.lit(8)), "\n").alias("texts"))


@query("""with e as (select vec_id // 50 as feature_id, vec_id % 50 as idx, list_transform(embedding, lambda x: x::double) as v from embeddings), q as (select feature_id, v as q from e where idx = 0)
 select feature_id, 1 as question, idx, round(list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))), 6) + 0.0 as score from e join q using (feature_id)""")
def plugged_scores(spark, d):
    rows = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("feature_id"), (F.col("vec_id") % 50).alias("idx"), F.col("embedding").alias("vector"))
    asked = rows.where("idx = 0").select("feature_id", F.lit(1).alias("question"), F.col("vector").alias("query"))
    return scorers.score_frames(rows, asked, "cosine", 16).withColumn("score", F.round("score", 6) + 0.0)


@query(f"with {RESULTS}, m as (select unnest(['en', 'src1', 'src2', 'zz']) as label) select m.label, count(x.doc_id) as n, round(coalesce(100.0 * sum(correct) / nullif(count(x.doc_id), 0), 0), 6) as accuracy from m left join x on contains(x.lang || '_' || x.source, m.label) group by 1")
def accuracy_by_substring(spark, d):
    found = evaluation.by_substring(_results(spark, d), ["lang", "source"], ["en", "src1", "src2", "zz"])
    return found.select("label", "n", F.round("accuracy", 6).alias("accuracy"))


_NINE = [f"src{n}" for n in range(9)]


@query(f"with {RESULTS}, dm as (select unnest({_NINE}) as label), g as (select label, coalesce(100.0 * sum(correct) / nullif(count(x.doc_id), 0), 0) as a from dm left join x on x.source = label group by 1) select round(avg(a), 6) as accuracy from g")
def accuracy_macro_nine(spark, d):
    return evaluation.macro(_results(spark, d), "source", _NINE).select(F.round("accuracy", 6).alias("accuracy"))


@query("select user_id as id, arg_max(case when event_type in ('click', 'view') then 'Correct' else 'Wrong' end, event_id) as judge from events group by 1")
def judge_map(spark, d):
    return evaluation.judged(table(spark, d, "events").withColumnRenamed("user_id", "id"), "id", F.array(F.lit("click"), F.lit("view")), F.col("event_type"), "event_id")


@query("select p_partkey, case when p_partkey % 4 < 3 then p_partkey % 4 when p_partkey % 8 = 3 then 1 else -100 end::integer as gold from part")
def gold_index(spark, d):
    gold = F.when(F.col("p_partkey") % 4 < 3, (F.col("p_partkey") % 4).cast("string")).when(F.col("p_partkey") % 8 == 3, F.col("p_type")).otherwise(F.lit("9"))
    return table(spark, d, "part").select("p_partkey", evaluation.gold_index(F.array(gold), F.array("p_brand", "p_type", "p_name"))[0].alias("gold"))


@query("select l_orderkey, l_linenumber, round(l_quantity - l_tax, 6) as first_gain, round(l_extendedprice - l_discount, 6) as second_gain from lineitem")
def mutual_information_sliced(spark, d):
    gain = evaluation.mutual_information(F.array("l_quantity", "l_tax", "l_extendedprice", "l_discount"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(gain[0], 6).alias("first_gain"), F.round(gain[1], 6).alias("second_gain"))


@query("with n as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as i from events) select user_id, sha256(string_agg('sample_' || i || md5(event_id::varchar), '' order by i)) as hash from n group by 1")
def run_hash(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.md5(F.col("event_id").cast("string")).alias("digest"))
    return evaluation.run_hash(rows, "user_id", "event_id", "digest")


@query("with g as (select o_orderpriority as grp, o_custkey as member from orders group by 1, 2), s as (select member from g group by 1 having count(*) > 1) select grp, member from g where member in (select member from s)")
def competing_groups(spark, d):
    groups = table(spark, d, "orders").select(F.col("o_orderpriority").alias("group"), F.col("o_custkey").alias("member")).distinct()
    return evaluation.competing(groups).withColumnRenamed("group", "grp")


@query("select r_name as root, n_name as member, 1 as level, n_name || '!' as value from nation join region on r_regionkey = n_regionkey")
def task_members_last_wins(spark, d):
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    met = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    edge = lambda n, mark: met.select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"), F.lit(n).alias("ordinal"), F.concat("n_name", F.lit(mark)).alias("value"))
    return evaluation.members(edge(1, "?").union(edge(2, "!")), region.select(F.col("r_name").alias("root")), spark)


@query("select doc_id, lang as task, n_chars as keyframe_indices from documents where doc_id in (select doc_id from labels where doc_id is not null)")
def keyframes_with_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("task"), F.lit("test").alias("split"), "n_chars")
    found = table(spark, d, "labels").select("doc_id").distinct().join(docs.withColumnRenamed("n_chars", "keyframe_indices"), "doc_id")
    return selection.with_documents(found, docs).select("doc_id", "task", "keyframe_indices")


@query("select conv_id, arg_min(text, turn) as response from conversations group by 1")
def filter_take_first(spark, d):
    held = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("responses"))
    return held.select("conv_id", prompts.ensemble(F.col("responses")).alias("response"))


@query("with c as (select user_id, event_type, count(*) as n, min(event_id) as f from events group by 1, 2) select user_id, event_type as response from (select *, row_number() over (partition by user_id order by n desc, f) as r from c) where r = 1")
def filter_majority(spark, d):
    held = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("responses"))
    return held.select("user_id", prompts.ensemble(F.col("responses"), ("majority",)).alias("response"))


@query("select o_custkey, count(*) * 2 as n_items from orders group by 1")
def flatten_lists(spark, d):
    held = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.array("o_orderkey", "o_orderkey")).alias("lists"))
    return held.select("o_custkey", F.size(F.flatten("lists")).cast("long").alias("n_items"))


@query("select n_regionkey as key from nation intersect select r_regionkey from region where r_regionkey > 1")
def keys_in_both(spark, d):
    return table(spark, d, "nation").select(F.col("n_regionkey").alias("key")).intersect(table(spark, d, "region").where("r_regionkey > 1").select("r_regionkey"))


@query("select n_nationkey, n_name as by_field, 'In ' || n_regionkey as by_template, n_nationkey::bigint as number, 2 as items from nation")
def document_accessors(spark, d):
    rows = table(spark, d, "nation")
    listed = prompts.list_in(F.concat(F.lit("['"), F.col("n_name"), F.lit("', 'b']")))
    return rows.select("n_nationkey", prompts.accessor("n_name", rows.columns).alias("by_field"), prompts.accessor("In {{n_regionkey}}", rows.columns).alias("by_template"), prompts.number_in(F.col("n_nationkey").cast("string")).alias("number"), F.size(listed).alias("items"))


@query(f"with {LEN} select seq_id, round(16 / greatest(n::double, 1e-6) * 29.97::double, 6) as rate from n")
def sampled_rate(spark, d):
    return frames.lengths(frames.frames(spark, d)).select("seq_id", F.round(media.sample_fps(F.lit(16), F.col("n"), F.lit(29.97)), 6).alias("rate"))


@query("select o_custkey, list_transform(string_split(string_agg(o_orderkey, ' , ' order by o_orderkey), ','), lambda x: trim(x)::integer)[1] as first_, count(*)::integer as n from orders group by 1")
def index_list_parse(spark, d):
    held = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string")), " , ").alias("text"))
    places = frames.parse_indices(F.col("text"))
    return held.select("o_custkey", places[0].alias("first_"), F.size(places).alias("n"))


@query("select event_id, round(epoch_us(ts) % 86400000000 // 1000 / 1e3, 3) as seconds from (select event_id, ts from events)")
def clock_time_seconds(spark, d):
    from wavesift.functions.parsers import clock_seconds

    return table(spark, d, "events").select("event_id", F.round(clock_seconds(F.date_format("ts", "H:m:s.SSS")), 3).alias("seconds"))


@query("select c_custkey, case c_custkey % 4 when 0 then c_name || '.mp4' when 1 then c_name || '.MP4' when 2 then c_name || '.mkv' end as path from customer")
def path_fallback(spark, d):
    from wavesift.plans.runs import first_existing

    others = F.expr("case c_custkey % 4 when 0 then array(concat(c_name, '.MP4'), concat(c_name, '.mp4')) when 1 then array(concat(c_name, '.mkv'), concat(c_name, '.MP4')) when 2 then array(concat(c_name, '.mkv')) else array(concat(c_name, '.avi')) end")
    return table(spark, d, "customer").select("c_custkey", first_existing(F.col("c_name"), others).alias("path"))


@query("""with iv as (select user_id, event_id, epoch_us(ts) / 1e6 as start_s, epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) / 1e6 as end_s from events)
 select a.user_id, a.event_id, count(b.event_id) as n_points from iv a join events b on b.user_id = a.user_id and epoch_us(b.ts) / 1e6 + 0.25 >= a.start_s and epoch_us(b.ts) / 1e6 + 0.25 < a.end_s group by 1, 2""")
def subtitle_point_counts(spark, d):
    from wavesift.plans.registry import _intervals

    points, spans = _intervals(spark, d)
    return subtitles.covered(points, spans, "user_id", "t", "start_s", "end_s", 36_000).groupBy("user_id", "event_id").agg(F.count("*").alias("n_points"))


@query("select event_type, round(avg(value), 6) as mean_, round(max(value), 6) as most, round(100.0 * sum(event_id % 2) / count(*), 6) as share from events group by 1")
def rolled_up_metrics(spark, d):
    rows = table(spark, d, "events").withColumn("odd", F.col("event_id") % 2)
    found = evaluation.rolled_up(rows, ["event_type"], {"mean_": ("value", "Mean"), "most": ("value", "max"), "share": ("odd", "percent")})
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean_", "most", "share")])


@query("select item_id, upper(substr(text, 1, 1)) as response from benchmark")
def plugged_answers(spark, d):
    asked = table(spark, d, "benchmark").select("item_id", F.col("text").alias("context"))
    return scorers.answered(asked, lambda texts: [t[:1].upper() for t in texts]).select("item_id", "response")


@query("select 'set' || (o_custkey % 50) as archive, string_agg('/d/set' || (o_custkey % 50) || '_' || o_orderkey || '.tar', ',' order by '/d/set' || (o_custkey % 50) || '_' || o_orderkey || '.tar') as parts from orders group by 1")
def archive_parts(spark, d):
    from wavesift.sources.files import archive_parts as parts

    paths = table(spark, d, "orders").select(F.concat(F.lit("/d/set"), (F.col("o_custkey") % 50).cast("string"), F.lit("_"), F.col("o_orderkey").cast("string"), F.lit(".tar")).alias("path"))
    return parts(paths).select("archive", F.array_join("parts", ",").alias("parts"))
