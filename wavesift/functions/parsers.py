"""Answer letters, times and paths out of strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that are deleted, in this order, before the first letter is taken.
PREFIXES = ["The best answer is", "The correct answer is", "The answer is", "The answer", "The best option isThe correct option is", "Best answer:Best option:"]
LETTERS = "ABCDE"


def first_letter(s: Column, prefixes: list[str] = PREFIXES) -> Column:
    """The first of A to D once the phrases are deleted; empty if there is none."""
    s = F.trim(s)
    for p in prefixes:
        s = F.replace(s, F.lit(p), F.lit(""))
    return F.regexp_extract(s, "[ABCD]", 0)


def choice(s: Column, letters: str = LETTERS, fallback: Column | None = None) -> Column:
    """The letter that a response names: "(X)", else "X ", else "X."; of several the one that stands last, the
    first letter on a tie; fallback (null unless given) where there is none."""
    for mark in ",.!?;:'":
        s = F.btrim(s, F.lit(mark))
    s = F.concat(F.lit(" "), s, F.lit(" "))

    def last(needle: str) -> Column:
        turned = F.instr(F.reverse(s), needle[::-1])
        return F.when(turned > 0, F.length(s) - turned - len(needle) + 1).otherwise(-1)

    def best(pattern: str, place: str) -> Column:
        options = [F.when(F.contains(s, F.lit(pattern.format(x))), F.struct(last(place.format(x)).alias("at"), F.lit(-n).alias("n"), F.lit(x).alias("x"))) for n, x in enumerate(letters)]
        return F.array_max(F.array(*options))["x"]

    return F.coalesce(best("({})", "({})"), best("{} ", " {} "), best("{}.", " {} "), fallback if fallback is not None else F.lit(None).cast("string"))


def by_hash(id: Column, letters: str = LETTERS) -> Column:
    """A letter that follows from an id: a fallback for choice() that is the same in each run."""
    return F.array(*map(F.lit, letters))[F.pmod(F.xxhash64(id), F.lit(len(letters))).cast("int")]


def bracket(s: Column) -> Column:
    """The character before the first closing bracket; empty if that comes first, all of it without one."""
    at = F.instr(s, ")")
    return F.when(at > 1, s.substr(at - 1, F.lit(1))).when(at == 1, F.lit("")).otherwise(s)


def clock_seconds(s: Column) -> Column:
    """Hours, minutes and seconds, with a comma or a point before the fraction, as seconds."""
    p = F.split(F.replace(s, F.lit(","), F.lit(".")), ":")
    return p[0].cast("double") * 3600 + p[1].cast("double") * 60 + p[2].cast("double")


def question_index(q: Column) -> Column:
    """The last part of an id with dashes, less one; null where it is no number."""
    return F.when(F.contains(q, F.lit("-")), F.element_at(F.split(q, "-"), -1).try_cast("int") - 1)


def query_text(question: Column, options: Column) -> Column:
    return F.concat(question, F.lit(" "), F.array_join(options, " "))


def cleaned(response: Column, stops: list[str]) -> Column:
    """A response up to each stop word, without white space around it."""
    for stop in stops:
        response = F.substring_index(response, stop, 1)
    return F.trim(response)
