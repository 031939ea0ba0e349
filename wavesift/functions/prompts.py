"""Prompts, few-shot examples and requests as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sentences of the prompts.
CHOOSE = "Select the best answer to the following multiple-choice question based on the video. Respond with only the letter (A, B, C, or D) of the correct option."
CHOOSE_SUBTITLED = "Select the best answer to the following multiple-choice question based on the video and the subtitles. Respond with only the letter (A, B, C, or D) of the correct option."
BEST = "The best answer is:"
LISTED = "This video's subtitles are listed below: \n"
NONE_LISTED = "No subtitles available"
FONT_TEXT = r'<font color="white" size=".72c">(.*?)</font>'


def letter(place: Column) -> Column:
    """A for 0, B for 1 and so on."""
    return F.char(place + 65)


def choose(question: Column, options: Column, post: str = BEST, intro: str = CHOOSE) -> Column:
    """Introduction, question, options and closing words, a line each."""
    return F.concat(F.lit(intro + "\n"), question, F.lit("\n"), F.array_join(options, "\n"), F.lit("\n" + post))


def lettered(question: Column, candidates: Column, pre: str = "", post: str = "") -> Column:
    """The question above its candidates, each behind its letter."""
    lines = F.transform(candidates, lambda c, n: F.concat(letter(n), F.lit(". "), c))
    return F.concat(F.lit(pre), question, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n" + post))


def around(question: Column, pre: str = "", post: str = "") -> Column:
    return F.concat(F.lit(pre), question, F.lit(post))


def font_texts(lines: Column) -> Column:
    """The first marked text of each line that has one."""
    found = F.transform(lines, lambda s: F.struct(s.rlike(FONT_TEXT).alias("has"), F.regexp_extract(s, FONT_TEXT, 1).alias("text")))
    return F.transform(F.filter(found, lambda x: x["has"]), lambda x: x["text"])


def subtitled(question: Column, options: Column, texts: Column) -> Column:
    """choose() below the subtitles; a null or empty list has none."""
    told = F.when(F.size(texts) > 0, F.array_join(texts, "\n")).otherwise(F.lit(NONE_LISTED))
    return F.concat(F.lit(LISTED), told, F.lit("\n"), choose(question, options, intro=CHOOSE_SUBTITLED))


def rendered(template: str, *fields: str) -> Column:
    """template with each {{field}} replaced by the column of that name; a null leaves nothing."""
    made = F.lit(template)
    for f in fields:
        made = F.replace(made, F.lit("{{" + f + "}}"), F.coalesce(F.col(f).cast("string"), F.lit("")))
    return made


def few_shot(docs: DataFrame, pool: DataFrame, id: str, text: str, k: int, seed: int = 0) -> DataFrame:
    """docs with examples, an array of k texts of the pool: the same k for all, but never a document's own.

    The pool is ordered by the digest of seed and id, and k + 1 of its rows, which k bounds, go to every worker.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")))
    first = pool.select(F.col(id).alias("i"), F.col(text).alias("t"), order.alias("o")).orderBy("o", "i").limit(k + 1)
    held = first.agg(F.sort_array(F.collect_list(F.struct("o", "i", "t")))).scalar()
    others = F.filter("held", lambda x: x["i"] != F.col(id))
    return docs.withColumn("held", held).withColumn("examples", F.transform(F.slice(others, 1, k), lambda x: x["t"])).drop("held")


def with_examples(description: str, examples: Column, question: Column, between: str = "\n\n") -> Column:
    """Description, examples and question as one text."""
    shown = F.when(F.size(examples) > 0, F.concat(F.array_join(examples, between), F.lit(between))).otherwise(F.lit(""))
    return F.concat(F.lit(description), shown, question)


def as_turns(system: str, examples: Column, question: Column) -> Column:
    """An array of (role, content): the system's words if there are any, the examples, the question."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    start = F.array(turn("system", F.lit(system))) if system else F.array().cast("array<struct<role:string,content:string>>")
    return F.concat(start, F.transform(examples, lambda e: turn("user", e)), F.array(turn("user", question)))


def requests(docs: DataFrame, id: str, context: Column, choices: Column | None = None) -> DataFrame:
    """id, choice, context, target: a row for each document, or for each of its choices."""
    own = docs.select(F.col(id), context.alias("context"), (choices if choices is not None else F.array(F.lit(None).cast("string"))).alias("all"))
    return own.select(id, "context", F.posexplode("all").alias("choice", "target"))


def scores_of(questions: Column, index: Column, key: str, place: str = "question_index", position: Column | None = None) -> Column:
    """key of the first entry whose place is index and which has that key, else of the entry at the position, which
    is the index unless it is given."""
    own = F.filter(questions, lambda q: (q[place] == index) & q[key].isNotNull())
    position = index if position is None else position
    return F.coalesce(F.get(own, F.lit(0))[key], F.when(position >= 0, F.get(questions, position.cast("int")))[key])


def accessor(spec: int | str | Callable[[], Column], columns: list[str]) -> Column:
    """What a task's setting says of a document: a number, a field by its name, a template, or a function's column."""
    if callable(spec):
        return spec()
    if isinstance(spec, int):
        return F.lit(spec)
    return F.col(spec) if spec in columns else rendered(spec, *columns)


def number_in(text: Column) -> Column:
    """A text of digits as a number; null for another."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long"))


def list_in(text: Column) -> Column:
    """A text that is a list literal as an array of texts; null for another."""
    return F.when(text.rlike(r"(?s)^\[.*\]$"), F.from_json(text, "array<string>", {"allowSingleQuotes": "true"}))


def to_frame(seconds: Column, fps: Column) -> Column:
    return (seconds * fps).cast("long")


def subtitle_frames(subtitles: Column, fps: Column) -> Column:
    """Subtitles, an array of (start_s, end_s, text), as (start, end, text) by frames."""
    return F.transform(subtitles, lambda s: F.struct(to_frame(s["start_s"], fps).alias("start"), to_frame(s["end_s"], fps).alias("end"), s["text"].alias("text")))


def subtitles_at(subtitles: Column, fps: Column, total: Column, n: Column) -> Column:
    """Texts of the subtitles, an array of (start_s, end_s, text), in which one of n frames spread over a video of total
    frames lies (n of -1: all frames), in their order, without marks."""
    held = subtitle_frames(subtitles, fps)
    n = F.when(n == -1, total).otherwise(n)
    step = (total - 1) / F.greatest(n - 1, F.lit(1))
    places = F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.when((i == n - 1) & (n > 1), total - 1).otherwise(F.floor(i * step)).cast("long"))
    return font_texts(F.transform(F.filter(held, lambda s: F.exists(places, lambda p: (p >= s["start"]) & (p < s["end"]))), lambda s: s["text"]))


class Hooks:
    """Named functions that make a column of a document's fields, or an aggregate of results."""

    def __init__(self):
        self.known: dict[str, Callable[..., Column]] = {}

    def add(self, name: str, *others: str):
        def keep(f: Callable[..., Column]) -> Callable[..., Column]:
            for n in (name, *others):
                self.known[n.lower().strip()] = f
            return f

        return keep

    def __getitem__(self, name: str) -> Callable[..., Column]:
        found = self.known.get(name.lower().strip())
        if found is None:
            raise KeyError(f"{name}: known are {', '.join(sorted(self.known))}")
        return found


#: What is done with a document's responses; ensembles of them by name.
FILTERS = Hooks()


@FILTERS.add("take_first")
def take_first(responses: Column) -> Column:
    return F.get(responses, F.lit(0))


@FILTERS.add("majority")
def majority(responses: Column) -> Column:
    """The response that is there most often, the first of equals."""
    counted = F.transform(F.array_distinct(responses), lambda r: F.struct(F.size(F.filter(responses, lambda x: x == r)).alias("n"), (-F.array_position(responses, r)).alias("at"), r.alias("r")))
    return F.array_max(counted)["r"]


def ensemble(responses: Column, names: tuple[str, ...] = ("take_first",)) -> Column:
    """The filters named, one after the other."""
    for n in names:
        responses = FILTERS[n](responses)
    return responses
