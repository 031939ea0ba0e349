"""Queries of prompts, requests, frame times, pixel budgets, tiles and names, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavesift.functions import prompts
from wavesift.operators import frames, media
from wavesift.plans import runs
from wavesift.plans.registry import LEN, query
from wavesift.session import table

MOST, LEAST_PIXELS, MOST_PIXELS, ALL_PIXELS, TILE = 16, 100_352, 602_112, 90_316_800, 448

_OPTIONS = "array(p_brand, p_type, concat('size ', p_size))"
_GRID = f"""w as (select p_partkey, 100 + p_partkey * 37 % 1900 as width, 100 + p_partkey * 91 % 1300 as height from part),
 g as (select i, j from unnest(range(1, 7)) a(i), unnest(range(1, 7)) b(j) where i * j <= 6),
 o as (select *, abs(width::double / height - i::double / j) as off from w, g),
 m as (select *, row_number() over (partition by p_partkey order by i * j, i, j) as r from (select *, min(off) over (partition by p_partkey) as least from o) where off = least),
 t as (select p_partkey, i::integer as i, j::integer as j from (select *, row_number() over (partition by p_partkey order by r desc) as z from m where r = 1 or width::double * height > 0.5 * {TILE * TILE} * i * j) where z = 1)"""


def _text(s: str) -> str:
    """An SQL literal."""
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(f"select p_partkey, {_text(prompts.CHOOSE)} || chr(10) || p_name || chr(10) || p_brand || chr(10) || p_type || chr(10) || 'size ' || p_size || chr(10) || {_text(prompts.BEST)} as prompt from part")
def prompt_choice(spark, d):
    return table(spark, d, "part").select("p_partkey", prompts.choose(F.col("p_name"), F.expr(_OPTIONS)).alias("prompt"))


@query("select p_partkey, 'Watch. ' || p_name || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'C. size ' || p_size || chr(10) || 'Answer:' as prompt from part")
def prompt_lettered(spark, d):
    return table(spark, d, "part").select("p_partkey", prompts.lettered(F.col("p_name"), F.expr(_OPTIONS), "Watch. ", "Answer:").alias("prompt"))


@query("select item_id, 'Q: ' || text || ' A:' as prompt from benchmark")
def prompt_around(spark, d):
    return table(spark, d, "benchmark").select("item_id", prompts.around(F.col("text"), "Q: ", " A:").alias("prompt"))


@query(f"select item_id, {_text(prompts.LISTED)} || case when item_id % 2 = 0 then replace(text, chr(10), ' ') else {_text(prompts.NONE_LISTED)} end || chr(10) || {_text(prompts.CHOOSE_SUBTITLED)} || chr(10) || 'Which?' || chr(10) || 'A' || chr(10) || {_text(prompts.BEST)} as prompt from benchmark")
def prompt_subtitled(spark, d):
    marked = F.concat(F.lit('<font color="white" size=".72c">'), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("</font>"))
    lines = F.array(F.lit("00:01 --> 00:02"), F.when(F.col("item_id") % 2 == 0, marked).otherwise(F.lit("plain")))
    return table(spark, d, "benchmark").select("item_id", prompts.subtitled(F.lit("Which?"), F.array(F.lit("A")), prompts.font_texts(lines)).alias("prompt"))


@query("""with o as (select item_id as i, text as t, md5('7:' || item_id) as o from benchmark order by 3, 1 limit 4),
 x as (select b.item_id, b.text, o.t, row_number() over (partition by b.item_id order by o.o, o.i) as r from benchmark b join o on o.i <> b.item_id)
 select item_id, 'Solve.' || chr(10) || string_agg(t, chr(10) || chr(10) order by r) || chr(10) || chr(10) || any_value(text) as prompt from x where r <= 3 group by 1""")
def prompt_few_shot(spark, d):
    rows = table(spark, d, "benchmark")
    shown = prompts.few_shot(rows, rows, "item_id", "text", 3, seed=7)
    return shown.select("item_id", prompts.with_examples("Solve.\n", F.col("examples"), F.col("text")).alias("prompt"))


@query("select n_nationkey, 'Country ' || n_name || ' (' || n_regionkey || ')' as prompt from nation")
def prompt_template(spark, d):
    return table(spark, d, "nation").select("n_nationkey", prompts.rendered("Country {{n_name}} ({{n_regionkey}})", "n_name", "n_regionkey").alias("prompt"))


@query("select p_partkey, p_name as context, c.n as choice, case c.n when 0 then p_brand when 1 then p_type else 'size ' || p_size end as target from part, (select unnest([0, 1, 2]) as n) c")
def requests_by_choice(spark, d):
    return prompts.requests(table(spark, d, "part"), "p_partkey", F.col("p_name"), F.expr(_OPTIONS))


@query("""with q as (select o_custkey, list({'k': o_orderkey % 3, 's': case when o_orderkey % 5 <> 0 then o_totalprice end} order by o_orderkey) as l from orders group by 1)
 select o_custkey, coalesce(struct_extract(list_filter(l, lambda x: x.k = o_custkey % 3 and x.s is not null)[1], 's'), struct_extract(l[o_custkey % 3 + 1], 's')) as score from q""")
def score_extraction(spark, d):
    one = F.struct("o_orderkey", (F.col("o_orderkey") % 3).alias("question_index"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("similarity"))
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(one)).alias("questions"))
    return rows.select("o_custkey", prompts.scores_of(F.col("questions"), (F.col("o_custkey") % 3).cast("int"), "similarity").alias("score"))


@query(f"with x as (select p_partkey, p_size * 1.5::double as d from part) select p_partkey, i::integer as place, case when d > {MOST} then d / {MOST}.0::double * i else i::double end as t from x, unnest(range({MOST})) u(i) where d > {MOST} or i < floor(d)")
def frame_timestamps(spark, d):
    return table(spark, d, "part").select("p_partkey", F.posexplode(media.timestamps(F.col("p_size") * 1.5, MOST)).alias("place", "t"))


@query(f"with x as (select p_partkey, p_size * 1.5::double as d, 25.0::double + p_partkey % 3 as fps from part) select p_partkey, i::integer as place, floor(floor(d * fps) / least({MOST}, floor(d)))::bigint * i as frame from x, unnest(range({MOST})) u(i) where i < least({MOST}, floor(d))")
def frame_loader_steps(spark, d):
    steps = media.loader_steps(F.col("p_size") * 1.5, F.lit(25.0) + F.col("p_partkey") % 3, MOST)
    return table(spark, d, "part").select("p_partkey", F.posexplode(steps).alias("place", "frame"))


@query(f"with {LEN} select seq_id, string_agg(printf('%.2fs', (case when i = 15 then n - 1 else floor(i * ((n - 1) / 15.0::double)) end) / 4.0::double), ',' order by i) as labels from n, unnest(range(16)) t(i) group by 1")
def frame_time_labels(spark, d):
    return frames.lengths(frames.frames(spark, d)).select("seq_id", media.time_labels(frames.linspace(F.col("n"), 16), F.lit(4.0)).alias("labels"))


@query(f"""with {LEN} select f.seq_id, string_agg(f.orig_idx, ',' order by f.idx) as kept from f join n using (seq_id) where f.idx in (0, 5, 9) or f.idx = n.n - 1 group by 1""")
def frame_thinning(spark, d):
    held = frames.frames(spark, d).groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("idx", "orig_idx"))).alias("held"))
    places = F.array(*[F.lit(i).cast("long") for i in (0, 5, 5, 9)])
    kept = media.thinned(F.col("held.orig_idx"), places, distinct=True, last=True)
    return held.select("seq_id", F.array_join(F.transform(kept, lambda x: x.cast("string")), ",").alias("kept"))


@query("with g as (select o_custkey, count(*) as n, string_agg(o_orderkey, ',' order by o_orderkey) as k, max(o_orderkey) as last from orders group by 1) select o_custkey, case when n % 2 = 1 then k || ',' || last else k end as padded from g")
def frame_padding(spark, d):
    held = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
    return held.select("o_custkey", F.array_join(F.transform(media.padded(F.col("keys")), lambda x: x.cast("string")), ",").alias("padded"))


@query(f"""with x as (select p_partkey, greatest(least({MOST_PIXELS}::double, {ALL_PIXELS} / (p_size * 10)::double * 2), floor({LEAST_PIXELS} * 1.05::double)) as bound, case when p_partkey % 3 = 0 then 200000 end as wanted from part)
 select p_partkey, round(least(coalesce(wanted::double, bound), bound), 3) as pixels from x""")
def pixel_budget(spark, d):
    wanted = F.when(F.col("p_partkey") % 3 == 0, F.lit(200_000))
    pixels = media.pixel_budget(F.col("p_size") * 10, F.lit(LEAST_PIXELS), F.lit(MOST_PIXELS), F.lit(ALL_PIXELS), wanted)
    return table(spark, d, "part").select("p_partkey", F.round(pixels, 3).alias("pixels"))


def _grids(spark, d):
    size = F.expr("100 + p_partkey * 37 % 1900"), F.expr("100 + p_partkey * 91 % 1300")
    return table(spark, d, "part").select("p_partkey", media.closest_grid(*size, TILE).alias("grid"))


@query(f"with {_GRID} select p_partkey, i, j from t")
def tile_grid(spark, d):
    return _grids(spark, d).select("p_partkey", "grid.i", "grid.j")


@query(f"with {_GRID} select p_partkey, (n % i * {TILE})::integer as left_, (n // i * {TILE})::integer as top, ((n % i + 1) * {TILE})::integer as right_, ((n // i + 1) * {TILE})::integer as bottom from t, unnest(range(6)) u(n) where n < i * j")
def tile_boxes(spark, d):
    boxes = _grids(spark, d).select("p_partkey", F.explode(media.crop_boxes(F.col("grid"), TILE)).alias("b"))
    return boxes.select("p_partkey", F.col("b.left").alias("left_"), "b.top", F.col("b.right").alias("right_"), "b.bottom")


@query("select c_custkey, case c_custkey % 3 when 0 then c_name when 1 then c_mktsegment else '' end as model from customer")
def model_name_parse(spark, d):
    arguments = F.expr("case c_custkey % 3 when 0 then concat('model=x,pretrained=', c_name, ',device=cuda') when 1 then concat('batch=1,engine=', c_mktsegment) else 'batch=1' end")
    return table(spark, d, "customer").select("c_custkey", runs.model_name(arguments).alias("model"))


@query("select o_orderkey, regexp_replace(o_orderpriority, '[^A-Za-z0-9_.]', '_', 'g') as safe, replace(o_orderpriority, ' ', '') || '.v1' as stem, o_orderkey || '_a' as plain from orders")
def name_parts(spark, d):
    path = F.concat(F.lit("/data.d/"), F.replace("o_orderpriority", F.lit(" "), F.lit("")), F.lit(".v1.json"))
    plain = runs.without_extension(F.concat(F.col("o_orderkey").cast("string"), F.lit(".mp4_a.mp4")))
    return table(spark, d, "orders").select("o_orderkey", runs.safe_name(F.col("o_orderpriority")).alias("safe"), runs.data_name(path).alias("stem"), plain.alias("plain"))


@query("select doc_id, coalesce(strlen(text), 0)::integer as n_bytes from documents")
def byte_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_bytes"))


@query("select doc_id, trim(split_part(split_part(text, '. ', 1), ', ', 1), ' ') as cleaned from documents")
def response_cleanup(spark, d):
    from wavesift.functions import parsers

    return table(spark, d, "documents").select("doc_id", parsers.cleaned(F.col("text"), [". ", ", "]).alias("cleaned"))
