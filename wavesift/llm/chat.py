"""Preference pairs of conversations as a shared prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.llm.shared import table

OPEN, CLOSE, TRAINED = "<|im_start|>", "<|im_end|>", "assistant"

_TURN = "struct<turn:bigint,role:string,text:string>"


def _safe(x: str) -> str:
    return f"replace(coalesce({x}, ''), '<|im_', '<| im_')"


def _rendered(x: str) -> str:
    """SQL: a turn; the template's own marks within a text are broken by a space."""
    return f"concat('{OPEN}', {_safe(x + '.role')}, '\\n', {_safe(x + '.text')}, '{CLOSE}\\n')"


def format_preferences(turns: DataFrame, pair: str = "pair_id", chosen: str = "is_chosen", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask, differs: one row for each pair.

    The prompt is the longest common prefix of both sides' turns (equal role and text, in order of turn), rendered
    once. A completion is the rest of its side; its mask lists start:end of what is trained, the assistant's texts
    with their closing marks, in code points from the prompt's start, end exclusive, comma-joined. Turns with equal
    numbers follow in order of role and text, null first; turns repeated in full count once. Null roles and texts
    are empty but equal only nulls. A pair with one side has that side as its completion, no prompt, and an empty
    other side; differs is false where both completions are empty. Rows with a null pair or side are left out: they
    belong to no pair. A pair is one output row, so its conversations must fit one; sets are gathered before the
    shuffle, and pairs are spread by hash however common their turns are.
    """
    rows = turns.where(F.col(pair).isNotNull() & F.col(chosen).isNotNull()).select(F.col(pair).alias("pair_id"), F.col(chosen).alias("side"), F.struct(F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).alias("t"))
    made = rows.groupBy("pair_id").agg(F.sort_array(F.collect_set(F.when(F.col("side"), F.col("t")))).alias("c"), F.sort_array(F.collect_set(F.when(~F.col("side"), F.col("t")))).alias("r"))
    made = made.withColumn("miss", F.expr("array_position(zip_with(c, r, (x, y) -> x.role <=> y.role and x.text <=> y.text), false)"))
    made = made.withColumn("n", F.expr("cast(least(size(c), size(r), case when miss = 0 then size(c) else miss - 1 end) as int)"))
    made = made.withColumn("prompt", F.expr(f"array_join(transform(slice(c, 1, n), x -> {_rendered('x')}), '')"))
    for side, name in (("c", "chosen"), ("r", "rejected")):
        own = f"slice({side}, n + 1, size({side}) - n)"
        made = made.withColumn(name, F.expr(f"array_join(transform({own}, x -> {_rendered('x')}), '')"))
        head = f"char_length(concat('{OPEN}', {_safe('x.role')}, '\\n'))"
        made = made.withColumn(
            f"{name}_mask",
            F.expr(f"""aggregate({own}, named_struct('at', char_length(prompt), 'out', ''), (a, x) -> named_struct(
              'at', a.at + char_length({_rendered("x")}),
              'out', case when x.role <=> '{TRAINED}' then concat(a.out, case when a.out = '' then '' else ',' end, a.at + {head}, ':', a.at + char_length({_rendered("x")}) - 1) else a.out end),
              a -> a.out)"""),
        )
    return made.select("pair_id", F.col("n").cast("long").alias("n_prompt_turns"), "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask", F.expr("chosen != '' or rejected != ''").alias("differs"))


def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2n (chosen) and 2n + 1 (rejected) as pair n."""
    rows = table(spark, sf_dir, "conversations")
    return format_preferences(rows.select(F.floor(F.col("conv_id") / 2).alias("pair_id"), (F.pmod(F.col("conv_id"), F.lit(2)) == 0).alias("is_chosen"), "turn", "role", "text"))


ORACLE = f"""
with d as (select distinct conv_id, turn, role, text from conversations where conv_id is not null),
t as (select conv_id // 2 as pair_id, conv_id % 2 as side, role, text,
    row_number() over (partition by conv_id order by turn, role nulls first, text nulls first) as n from d),
m as (select coalesce(a.pair_id, b.pair_id) as pair_id, min(coalesce(a.n, b.n)) as miss
    from (select * from t where side = 0) a full join (select * from t where side = 1) b on a.pair_id = b.pair_id and a.n = b.n
    where a.n is null or b.n is null or a.role is distinct from b.role or a.text is distinct from b.text group by 1),
z as (select t.*, coalesce(m.miss, 1000000000) - 1 as p,
    replace(coalesce(role, ''), '<|im_', '<| im_') as r, replace(coalesce(text, ''), '<|im_', '<| im_') as x
    from t left join m using (pair_id)),
y as (select *, '{OPEN}' || r || chr(10) || x || '{CLOSE}' || chr(10) as s,
    length('{OPEN}' || r || chr(10)) as head from z),
w as (select *, coalesce(sum(length(s)) over (partition by pair_id, side order by n rows between unbounded preceding and 1 preceding), 0) as place from y)
select pair_id, count(*) filter (side = 0 and n <= p) as n_prompt_turns,
  coalesce(string_agg(s, '' order by n) filter (side = 0 and n <= p), '') as prompt,
  coalesce(string_agg(s, '' order by n) filter (side = 0 and n > p), '') as chosen,
  coalesce(string_agg(s, '' order by n) filter (side = 1 and n > p), '') as rejected,
  coalesce(string_agg((place + head)::bigint || ':' || (place + length(s) - 1)::bigint, ',' order by n) filter (side = 0 and n > p and role = '{TRAINED}'), '') as chosen_mask,
  coalesce(string_agg((place + head)::bigint || ':' || (place + length(s) - 1)::bigint, ',' order by n) filter (side = 1 and n > p and role = '{TRAINED}'), '') as rejected_mask,
  count(*) filter (n > p) > 0 as differs
from w group by pair_id
"""
