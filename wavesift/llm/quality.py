"""Quality rules whose cutoffs are certified on labelled documents to reject few good ones in every stratum.

The verdict is the union of the rules, and it is the union that is certified. Stricter cutoffs reject more, so a chain
of ever stricter sets of cutoffs can be tested one after the other, each at the full level, until the first that
fails (fixed-sequence testing); whatever is laxer than a certified set is certified with it. A part of the labels
chooses the order in which the chain tightens the rules, the others test it.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.llm.boosting import few_errors
from wavesift.llm.shared import documents, forget, settle, table

WINDOW, LEAST_WORDS, REPEAT_PERCENT = 8, 20, 30
#: Share of a stratum's good documents that the rules together may reject, and the probability that they reject more
#: in any stratum.
LIMIT, RISK = 0.01, 0.05
#: One in so many labels chooses the order of the tests and takes no part in them.
TUNED = 4
#: Labels up to which they are sent to all workers, so that only labelled documents are measured for the cutoffs.
LABELS = 1_000_000
#: Rule: the measure, as a pair (left, right), of which left >= cutoff * right rejects, and the cutoffs that are tried,
#: from the strictest to the laxest.
RULES: dict[str, tuple[str, str, list[int]]] = {
    "symbols": ("100 * n_symbols", "word_chars", [8, 10, 12, 15, 20, 25, 30]),
    "long_words": ("word_chars", "n_words", [12, 15, 20, 30]),
    "dup_lines": ("100 * n_dup_lines", "n_lines", [30, 40, 50, 70]),
    "repeats": ("100 * n_repeat_words", "n_words", [10, 15, 20, 25]),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measures of a text as long columns, in place of columns of docs with their names.

    Repeated windows are found within the row: the windows' hashes are sorted with their places, and the words of
    those that have an equal neighbour are sorted and compared, so that no hash decides. Places closer than a window
    share words. Only texts with a repeat are sorted.
    """
    t = docs.select(F.struct("*").alias("q_row"), F.coalesce(F.col(text), F.lit("")).alias("q_text"))
    t = t.withColumn("q_words", F.expr(r"filter(split(q_text, '[\\x20\\x09-\\x0D]+'), w -> w != '')"))
    t = t.withColumn("q_lines", F.expr(r"filter(split(q_text, '\n', -1), l -> rlike(l, '[^\\x20\\x09-\\x0D]'))"))
    t = t.withColumns(
        {
            "n_words": F.size("q_words").cast("long"),
            "word_chars": F.expr("cast(char_length(array_join(q_words, '')) as bigint)"),
            "n_symbols": F.expr("cast(char_length(q_text) - char_length(regexp_replace(q_text, '[#*$%&|<>]+', '')) as bigint)"),
            "n_dup_lines": F.expr("cast(size(q_lines) - size(array_distinct(q_lines)) as bigint)"),
            "n_lines": F.size("q_lines").cast("long"),
            "q_hashes": F.expr("transform(q_words, w -> xxhash64(w))"),
        }
    )
    window = ", ".join(f"q_hashes[i + {n}]" for n in range(WINDOW))
    twice = lambda a, f: f"transform(filter(transform({a}, (x, n) -> named_struct('i', x.i, 'd', coalesce(x.{f} = get({a}, n - 1).{f}, false) or coalesce(x.{f} = get({a}, n + 1).{f}, false))), x -> x.d), x -> x.i)"
    t = t.withColumn("q_windows", F.expr(f"case when n_words < {WINDOW} then cast(array() as array<bigint>) else transform(sequence(0, cast(n_words as int) - {WINDOW}), i -> xxhash64({window})) end"))
    t = t.withColumn("q_sorted", F.expr("case when size(array_distinct(q_windows)) < size(q_windows) then sort_array(transform(q_windows, (h, i) -> named_struct('h', h, 'i', i))) end"))
    t = t.withColumn("q_like", F.expr(f"sort_array(transform({twice('q_sorted', 'h')}, i -> named_struct('w', slice(q_words, i + 1, {WINDOW}), 'i', i)))"))
    t = t.withColumn("q_places", F.expr(f"sort_array({twice('q_like', 'w')})"))
    t = t.withColumn("n_repeat_words", F.expr(f"case when size(q_places) > 0 then {WINDOW} + aggregate(transform(q_places, (p, n) -> case when n = 0 then 0 else least({WINDOW}, p - q_places[n - 1]) end), 0L, (a, v) -> a + v) else 0L end"))
    # as a generator's output, or else a later filter on a measure would be pushed below and the measure taken again
    return t.select(*[F.col(f"q_row.`{c}`").alias(c) for c in docs.columns if c not in MEASURES], F.inline(F.array(F.struct(*MEASURES))))


def base_failed() -> Column:
    return F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words")


def _rejects(rule: str, cut: int) -> Column:
    left, right, _ = RULES[rule]
    return F.expr(f"{right} > 0 and {left} >= {cut} * {right}")


def _strictness(rule: str) -> Column:
    """How far a rule must be tightened to reject: 1 for its laxest cutoff, 0 if no cutoff does."""
    cuts = RULES[rule][2]
    hits = sum((_rejects(rule, c).cast("int") for c in cuts), F.lit(0))
    return F.when(hits > 0, len(cuts) + 1 - hits).otherwise(0)


Cell = tuple[bool, bool, tuple[int, ...], int]  # whether it tunes, whether good, strictness of each rule, documents


def _path(cells: list[Cell]) -> list[tuple[int, ...]]:
    """Ever stricter settings of the rules, from none to all at their strictest. Each step tightens the rule that by
    the tuning cells rejects the fewest further good documents, of those the one with the most bad ones; without
    tuning cells the laxest rule, the first on a tie."""
    most = [len(cuts) for _, _, cuts in RULES.values()]
    at, path = [0] * len(most), []
    open_ = [c for c in cells if c[0]]
    while at != most:
        best = None
        for r in range(len(most)):
            if at[r] < most[r]:
                new = [c for c in open_ if c[2][r] == at[r] + 1]
                cost = (sum(c[3] for c in new if c[1]), -sum(c[3] for c in new if not c[1]), at[r] / most[r], r)
                best = min(best, cost) if best else cost
        at[best[-1]] += 1
        open_ = [c for c in open_ if not 0 < c[2][best[-1]] <= at[best[-1]]]
        path.append(tuple(at))
    return path


def _rejected(cells: list[Cell], at: tuple[int, ...], good: bool) -> int:
    return sum(n for _, g, levels, n in cells if g == good and any(0 < x <= most for x, most in zip(levels, at, strict=True)))


def _certified(cells: list[Cell], limit: float, level: float) -> tuple[int, ...]:
    """The strictest setting up to which all of the path pass, with each rule as lax as it can be without letting a
    bad document pass."""
    tests = [c for c in cells if not c[0]]
    n = sum(c[3] for c in tests if c[1])
    best = (0,) * len(RULES)
    for at in _path(cells):
        wrong = _rejected(tests, at, True)
        if not n or wrong >= n * limit or few_errors(wrong, n, limit) > level:
            break
        best = at
    bad = _rejected(cells, best, False)
    for r in range(len(best)):
        for lax in range(best[r]):
            at = (*best[:r], lax, *best[r + 1 :])
            if _rejected(cells, at, False) == bad:
                best = at
                break
    return best


def certify(scored: DataFrame, stratum: str = "stratum", limit: float = LIMIT, risk: float = RISK, tunes: Column | None = None) -> DataFrame:
    """A row for each stratum with a cutoff for each rule, null where a rule is not used.

    scored has a row for each labelled document: its stratum, whether it is good, and the measures. A setting of all
    rules is certified if so few of the stratum's good documents are rejected that the exact binomial probability of
    as few, at a true rate of limit, is at most risk divided by the number of strata; settings are tested along the
    path of the stratum's tuning rows (tunes), which are not tested. Cells of documents that no setting tells apart are
    counted by Spark; a stratum has at most 4,000, and the driver holds one stratum's at a time.
    """
    levels = [_strictness(r).alias(f"s_{r}") for r in RULES]
    cells = scored.groupBy(F.col(stratum).alias("stratum"), (F.lit(False) if tunes is None else tunes).alias("tunes"), "good", *levels).agg(F.count("*").alias("n"))
    cells = settle(cells, "strata")
    strata = max(1, cells.select("stratum").distinct().count())
    rows = []
    for name, own in groupby(cells.orderBy("stratum").toLocalIterator(), key=lambda r: r.stratum):
        best = _certified([(r.tunes, r.good, tuple(r[f"s_{x}"] for x in RULES), r.n) for r in own], limit, risk / strata)
        rows.append((name, *(cuts[len(cuts) - at] if at else None for at, (_, _, cuts) in zip(best, RULES.values(), strict=True))))
    forget(cells)
    return scored.sparkSession.createDataFrame(rows, "stratum string, " + ", ".join(f"cut_{r} int" for r in RULES))


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """measured with base_failed and kept. A stratum without certified cutoffs keeps all that the base rules keep."""
    few = cutoffs.count() <= 10_000
    table_ = cutoffs.withColumnRenamed("stratum", "q_stratum")
    joined = measured.withColumn("q_own", F.coalesce(F.col(stratum).cast("string"), F.lit(""))).join(F.broadcast(table_) if few else table_, F.col("q_own") == F.col("q_stratum"), "left")
    bad = F.lit(False)
    for r, (left, right, _) in RULES.items():
        bad = bad | F.coalesce(F.expr(f"{right} > 0 and {left} >= cut_{r} * {right}"), F.lit(False))
    judged = joined.withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & ~bad).drop("q_own", "q_stratum", *[f"cut_{r}" for r in RULES])


def _marks(labels: DataFrame, id: str) -> DataFrame:
    return labels.where(F.col("quality").isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("doc_id")).agg((F.min("quality") > 0).alias("good"))


def _fitted(rows: DataFrame, limit: float, risk: float) -> DataFrame:
    """Cutoffs from labelled rows (doc_id, good, q_group, measures). An id counts once, whatever rows it has."""
    one = rows.where(~base_failed()).groupBy("doc_id", "good").agg(F.min(F.struct(F.coalesce("q_group", F.lit("")).alias("stratum"), *MEASURES)).alias("m")).select("doc_id", "good", "m.*")
    return certify(one, "stratum", limit, risk, F.pmod(F.xxhash64("doc_id"), F.lit(TUNED)) == 0)


def _narrow(docs: DataFrame, text: str, id: str, stratum: str) -> DataFrame:
    return docs.select(F.col(id).alias("doc_id"), F.col(stratum).cast("string").alias("q_group"), F.col(text).alias("text"))


def keep(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", stratum: str = "lang", limit: float = LIMIT, risk: float = RISK) -> DataFrame:
    """The rows of docs, columns as before, that rate() keeps. Whole rows are not shuffled. Up to LABELS labels go to
    all workers, and the cutoffs come from a first pass that measures labelled documents alone; with more labels it
    measures all and joins the measures."""
    marks = settle(_marks(labels, id), "marks")
    narrow = _narrow(docs, text, id, stratum)
    if marks.count() <= LABELS:
        cutoffs = _fitted(measures(narrow.join(F.broadcast(marks), "doc_id")), limit, risk)
    else:
        cutoffs = _fitted(measures(narrow).select("doc_id", "q_group", *MEASURES).join(marks, "doc_id"), limit, risk)
    forget(marks)
    own = docs.select(F.struct("*").alias("q_kept"), F.col(stratum).cast("string").alias("q_group"), F.col(text).alias("text"))
    return judge(measures(own), cutoffs, "q_group").where("kept").select("q_kept.*")


def rate(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", stratum: str = "lang", limit: float = LIMIT, risk: float = RISK) -> DataFrame:
    """doc_id, the measures, base_failed and kept for every row of docs; labels (doc_id, quality) are the holdout.

    A null text has no words and fails. A null stratum is the stratum "". Labels are matched by doc_id; a document
    with labels that disagree counts as good only if none says 0; null ids and labels are left out. Repeated rows
    each return, and count once as labelled documents; an empty table gives no rows; without labels only the base
    rules reject. Other columns of docs are not read.
    """
    rows = settle(measures(_narrow(docs, text, id, stratum)).select("doc_id", "q_group", *MEASURES), "measures")
    return judge(rows, _fitted(rows.join(_marks(labels, id), "doc_id"), limit, risk), "q_group").drop("q_group")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document, by language."""
    rated = rate(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
