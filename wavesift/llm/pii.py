"""Personal data: candidate spans from generators, chosen by boosted trees on format and context.

All of it is DataFrame expressions. A pattern goes over a text once and puts a mark on either side of each match; the
text split at the marks gives gaps and matches in turn, whose lengths added up are positions in code points. Sums are
added up in groups, groups of groups and so on, so that time follows the number of matches.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.llm import boosting
from wavesift.llm.shared import documents, prepared

#: Base kinds in their order. The patterns match what the plain ones "leftmost, non-overlapping, then dropped if
#: they fail" match, but begin only where such a match can begin and never give back characters, so that a text
#: of one endless run takes linear time. Card numbers are looked for with 12 to 19 digits at once.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of further candidates, meant to miss little; the trees choose among what they propose. Words of mail
#: addresses and secrets have any length; local phone numbers (two to five groups of two to five digits) and IBANs (at
#: most 34 characters) have those of their formats.
MORE = {
    "email_words": r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{2,}+\s?(?:\(at\)|\[at\]|\sat\s)\s?[a-z0-9-]{2,}+\s?(?:\(dot\)|\[dot\]|\sdot\s|\.)\s?[a-z]{2,}+(?![a-z0-9])",
    "phone_local": r"(?<![0-9+.])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20./-][0-9]{2,5}){1,4}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+(?![A-Za-z0-9_-])",
}
KINDS = [*BASE, *MORE]
#: A cheap test that a text must pass before a pattern is tried.
HINTS = {"email": "[@]", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "email_words": r"(?i)(?:[(\[]at[)\]]|\sat\s)", "phone_local": "[0-9]{2}[ ./-][0-9]|[0-9][)]", "national_id": "[0-9]-[0-9]{2}-[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "secret": "[A-Za-z0-9_-]{20}"}
#: Code points of context on either side of a candidate.
CONTEXT = 40
#: Words near a candidate that speak for it or against it.
FOR = r"(?i)(?:token|secret|passw|api[ _-]?key|credential|bearer|phone|tel\b|tel\.|call|fax|mobile|ssn|social security|national id|passport|iban|account|bank|e-?mail|contact|reach|write)"
AGAINST = r"(?i)(?:version|release|isbn|issn|doi|order|invoice|section|chapter|page|pages|figure|table|row|score|year|model|part no|commit|checksum|sha|md5|hash|file|https?:|www\.)"
#: Texts, made by rule, of which the first third fits the trees and the rest, of other forms and words, sets the
#: thresholds; the precision asked of these, and the probability that any kind's threshold misses it.
SAMPLE, PRECISION, RISK = 12_000, 0.98, 0.05
#: Values that one step of a sum goes over, and levels of such steps.
GROUP, LEVELS = 64, 3

_SPAN = "array<struct<kind:int,start:int,end:int,hit:string>>"
_MARK, _NO_MARK = "\\u0001", "\\u0003"


def _let(value: str, name: str, body: str) -> str:
    """SQL: body with name standing for value, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _before(values: str, join: str, level: int = LEVELS) -> str:
    """SQL: for each of an array's numbers (at least one) what join, "+" or "max", makes of those before it, from 0 on."""
    step = (lambda a, b: f"{a} + {b}") if join == "+" else (lambda a, b: f"greatest({a}, {b})")
    if not level:
        return f"slice(aggregate({values}, array(0), (o, v) -> concat(o, array({step('element_at(o, -1)', 'v')}))), 1, size({values}))"
    n = f"{level}"
    parts = f"transform(sequence(0, (size({values}) - 1) div {GROUP}), i{n} -> slice({values}, i{n} * {GROUP} + 1, {GROUP}))"
    sums = f"transform(c{n}, x{n} -> aggregate(x{n}, 0, (p, v) -> {step('p', 'v')}))"
    inner = f"transform({_before(f'x{n}', join, 0)}, p{n} -> {step(f'p{n}', f'o{n}[j{n}]')})"
    return _let(parts, f"c{n}", _let(sums, f"s{n}", _let(_before(f"s{n}", join, level - 1), f"o{n}", f"flatten(transform(c{n}, (x{n}, j{n}) -> {inner}))")))


def _found(kind: str, text: str, more: bool = False) -> str:
    """SQL: matches of a kind in order as structs (kind, start, end, hit) or, for further candidates, with what stands
    near them: up to CONTEXT code points before, back to the match before the last at most, and the characters
    next to them."""
    pattern = (BASE | MORE)[kind].replace("\\", "\\\\").replace("'", "\\'")
    hint = HINTS[kind].replace("\\", "\\\\")
    span = f"named_struct('kind', {KINDS.index(kind)}, 'start', p[i] + l[2 * i], 'end', p[i] + l[2 * i] + l[2 * i + 1], 'hit', g[2 * i + 1])"
    near = f"right(concat(right(coalesce(get(g, 2 * i - 2), ''), {CONTEXT}), right(coalesce(get(g, 2 * i - 1), ''), {CONTEXT}), right(g[2 * i], {CONTEXT})), {CONTEXT})"
    edge = "concat(right(concat(coalesce(get(g, 2 * i - 1), ''), g[2 * i]), 1), left(concat(g[2 * i + 2], coalesce(get(g, 2 * i + 3), '')), 1))"
    one = f"named_struct('s', {span}, 'near', {near}, 'edge', {edge})" if more else span
    kind_ = f"array<struct<s:{_SPAN[6:-1]},near:string,edge:string>>" if more else _SPAN
    hits = f"transform(sequence(0, (size(g) - 3) div 2), i -> {one})"
    places = _let("transform(sequence(0, (size(g) - 3) div 2), i -> l[2 * i] + l[2 * i + 1])", "w", _before("w", "+"))
    found = _let("transform(g, x -> char_length(x))", "l", _let(places, "p", hits))
    parts = f"split(regexp_replace({text}, '{pattern}', '{_MARK}$0{_MARK}'), '{_MARK}', -1)"
    none = f"cast(array() as {kind_})"
    return f"case when not rlike({text}, '{hint}') then {none} else {_let(parts, 'g', f'case when size(g) < 3 then {none} else {found} end')} end"


def _digits(hit: str) -> str:
    return f"regexp_replace({hit}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """SQL: whether a string of digits passes the checksum, from the right doubling every second digit."""
    return f"""pmod(aggregate(transform(split(reverse({digits}), ''), (c, i) -> case when i % 2 = 0 then cast(c as int)
      else cast(substring('0246813579', cast(c as int) + 1, 1) as int) end), 0, (a, v) -> a + v), 10) = 0"""


def _valid(span: str) -> str:
    """SQL: whether a base match passes its check."""
    hit = f"{span}.hit"
    return f"""case {span}.kind
      when 1 then forall(split({hit}, '[.]'), p -> char_length(ltrim('0', p)) <= 3 and cast(concat('0', right(ltrim('0', p), 3)) as int) <= 255)
      when 2 then {_luhn(_digits(hit))}
      when 3 then char_length({_digits(hit)}) between 9 and 15
      else true end"""


FEATURES = ["kind", "digits", "letters", "length", "mixed", "distinct", "for", "against", "edges"]


def _features(c: str) -> str:
    """SQL: a candidate's small whole-number features."""
    hit = f"{c}.s.hit"
    return f"""named_struct(
      'kind', {c}.s.kind,
      'digits', least(char_length({_digits(hit)}), 24),
      'letters', least(char_length(regexp_replace({hit}, '[^A-Za-z]', '')), 40) div 4,
      'length', least(char_length({hit}), 64) div 4,
      'mixed', cast(rlike({hit}, '[0-9]') as int) + cast(rlike({hit}, '[a-z]') as int) + cast(rlike({hit}, '[A-Z]') as int),
      'distinct', least(size(array_distinct(split({hit}, ''))), 16) div 2,
      'for', cast(rlike({c}.near, '{FOR.replace(chr(92), chr(92) * 2)}') as int),
      'against', cast(rlike({c}.near, '{AGAINST.replace(chr(92), chr(92) * 2)}') as int),
      'edges', cast(rlike({c}.edge, '[/=#_A-Za-z0-9]') as int))"""


def candidates(df: DataFrame) -> DataFrame:
    """df, which has a column pii_text without nulls and no other such names, with pii_base, the checked base spans,
    and pii_found, the other candidates with their features."""
    base = "concat(" + ", ".join(_found(k, "pii_plain") for k in BASE) + ")"
    more = "concat(" + ", ".join(_found(k, "pii_plain", True) for k in MORE) + ")"
    made = df.withColumn("pii_plain", F.expr(f"translate(pii_text, '{_MARK}', '{_NO_MARK}')"))  # no pattern tells these two apart
    made = made.withColumn("pii_base", F.expr(f"filter({base}, s -> {_valid('s')})")).withColumn("pii_more", F.expr(more))
    return made.withColumn("pii_found", F.expr(f"transform(pii_more, c -> named_struct('s', c.s, 'f', {_features('c')}))")).drop("pii_more", "pii_plain")


def labelled_texts(n: int = SAMPLE, seed: int = 7, held_out: bool = False) -> list[tuple[int, str, int]]:
    """(number, text, whether its candidate is personal), made by rule: each text has one value of a known nature,
    with words around it that fit it, or none. Texts that are held out have other forms and other words."""
    r = random.Random(seed)
    some = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    digits = lambda k: some("0123456789", k)
    hexes = lambda k: some("0123456789abcdef", k)
    upper = lambda k: some("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k)
    mixed = lambda k: some("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k)
    word = lambda: some("bcdgkmpvwz" if held_out else "aeioulnrst", r.randint(2, 9))
    if not held_out:
        yes = [
            (lambda: f"{word()}.{word()} (at) {word()} (dot) com", ["write to", "contact", "e-mail"]),
            (lambda: f"{word()}[at]{word()}[dot]org", ["reach me at", "email", "contact"]),
            (lambda: f"{word()} at {word()} dot net", ["email", "e-mail me:"]),
            (lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", ["call", "phone:", "mobile", "tel."]),
            (lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", ["call", "phone:", "fax"]),
            (lambda: f"{digits(3)} {digits(4)} {digits(4)}", ["phone", "tel."]),
            (lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", ["ssn", "national id", "social security number", word()]),
            (lambda: f"DE{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}", ["iban", "account", "bank", word()]),
            (lambda: f"FR{digits(22)}", ["iban", "bank account"]),
            (lambda: hexes(r.choice([32, 40])), ['token = "', "secret: ", "api key ", "password="]),
            (lambda: mixed(r.randint(24, 40)), ["token ", "api_key = ", "bearer ", "credential "]),
        ]
        no = [
            (lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", ["year", "release of", word()]),
            (lambda: f"{digits(2)}.{digits(2)}.{digits(4)}", ["on", "year", word()]),
            (lambda: f"{digits(3)} {digits(3)}", ["order", "page", "row", word(), "score"]),
            (lambda: f"{digits(4)}/{digits(4)}", ["section", word(), "figure"]),
            (lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", ["part no", "isbn", "order"]),
            (lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", ["invoice", "model", "isbn"]),
            (lambda: hexes(r.choice([32, 40, 64])), ["commit ", "sha ", "md5 ", "checksum "]),
            (lambda: word() + word() + word() + word() + word(), ["", word()]),
            (lambda: "-".join(word() for _ in range(6)), ["https://", word(), "file "]),
            (lambda: "-" * 24, [word(), ""]),
            (lambda: "_" * 30, [word(), ""]),
            (lambda: f"{word()} at {word()} . {word()}", [word(), "was"]),
            (lambda: f"{digits(3)}.{digits(3)}.{digits(3)}.{digits(3)}", [word(), "call", "phone", "reach"]),
            (lambda: f"{digits(2)}.{digits(3)}.{digits(2)}.{digits(2)}.{digits(2)}", [word(), "version"]),
            (lambda: f"AB{digits(2)} {digits(4)} {digits(4)} {digits(4)}", ["model", "part no", "order"]),
        ]
    else:
        yes = [
            (lambda: f"{word()}_{digits(2)}(at){word()}(dot)info", ["mail address e-mail", "please contact", "write"]),
            (lambda: f"{word()}.{word()} [at] {word()} [dot] de", ["reach us", "our email is"]),
            (lambda: f"{word()} (at) {word()}.{word()[:3]}", ["contact", "send e-mail to"]),
            (lambda: f"({digits(4)}) {digits(5)}", ["fax", "telephone"]),
            (lambda: f"{digits(4)}/{digits(3)} {digits(3)}", ["call us", "mobile number", "tel."]),
            (lambda: f"{digits(2)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", ["phone number", "call"]),
            (lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", ["his social security no", "SSN:", "her national ID", "passport"]),
            (lambda: f"GB{digits(2)} {upper(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}", ["IBAN:", "pay to account", "her bank"]),
            (lambda: f"NL{digits(2)}{upper(4)}{digits(10)}", ["iban no", "Account:"]),
            (lambda: hexes(r.choice([24, 48, 56])), ["auth token: ", "client secret ", "passwd ", "x-api-key: "]),
            (lambda: f"{mixed(8)}_{mixed(20)}", ["Bearer ", "credentials: ", "API KEY="]),
        ]
        no = [
            (lambda: f"{digits(2)}/{digits(2)}/{digits(4)}", ["since", "in the year", word()]),
            (lambda: f"{digits(4)} {digits(2)}", ["figure", "lines of", word(), "table"]),
            (lambda: f"{digits(3)}.{digits(2)}", ["score", "chapter", word()]),
            (lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", ["ISSN", "order number", "model"]),
            (lambda: f"{digits(2)}-{digits(5)}-{digits(2)}", ["ISBN", "invoice", "part no"]),
            (lambda: hexes(r.choice([40, 48, 56])), ["revision hash ", "sha1: ", "in commit ", "file checksum "]),
            (lambda: word() + word() + word() + word() + word() + word(), ["", word()]),
            (lambda: "_".join(word() for _ in range(7)), ["www.", word(), "the file "]),
            (lambda: "-_" * 14, [word(), ""]),
            (lambda: f"{word()} at {word()}. {word()}", [word(), "then"]),
            (lambda: f"{digits(2)}.{digits(2)}.{digits(3)}.{digits(2)}", [word(), "version", "release"]),
            (lambda: f"XK{digits(2)}{digits(4)}{digits(4)}{digits(4)}", ["part no", "model"]),
        ]
    rows = []
    for n_ in range(n):
        personal = n_ % 2
        make, before = r.choice(yes if personal else no)
        rows.append((n_, f"{word()} {word()} {r.choice(before)} {make()} {word()} {word()}", personal))
    return rows


_models: dict[int, tuple[boosting.Boosted, dict[int, float]]] = {}


def trained(spark: SparkSession, sample: int = SAMPLE) -> tuple[boosting.Boosted, dict[int, float]]:
    """Trees, and each kind's threshold. They are fitted on the candidates of a third of the sample, counted by
    features, and calibrated on the rest, which is made by other rules; what comes to the driver is a row for each
    cell of features, at most a few for each text of the sample. A kind that cannot be shown to reach the precision
    adds nothing."""
    if sample not in _models:
        fits = labelled_texts(sample // 3)
        rows = spark.createDataFrame([(True, *t) for t in fits] + [(False, *t) for t in labelled_texts(sample - len(fits), 8, True)], "fits boolean, number int, pii_text string, personal int")
        each = candidates(rows).select("fits", "personal", F.explode("pii_found.f").alias("f")).select("fits", "personal", *[F.col(f"f.{x}").alias(x) for x in FEATURES])
        counted = each.groupBy("fits", *FEATURES).agg(F.sum(1 - F.col("personal")).alias("neg"), F.sum("personal").alias("pos")).collect()
        cells = {side: sorted((tuple(int(c[x]) for x in FEATURES), c.neg, c.pos) for c in counted if c.fits == side) for side in (True, False)}
        model = boosting.fit(cells[True])
        _models[sample] = model, {k: boosting.threshold(model, [c for c in cells[False] if c[0][0] == k], PRECISION, RISK / len(MORE)) for k in range(len(BASE), len(KINDS))}
    return _models[sample]


def _spans(docs: DataFrame, text: str, sample: int) -> DataFrame:
    """row (all columns of docs as a struct), pii_text and spans."""
    model, cuts = trained(docs.sparkSession, sample)
    made = candidates(docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("pii_text")))
    columns = lambda c: [c["f"][x] for x in FEATURES]

    def chosen(c: Column) -> Column:
        wanted = F.lit(False)
        for k, cut in cuts.items():
            if cut != float("inf"):
                wanted = wanted | ((c["s"]["kind"] == k) & (F.round(model.expression(columns(c)), 6) >= round(cut, 6)))
        return wanted

    added = F.transform(F.filter("pii_found", chosen), lambda c: c["s"])
    spans = F.expr("array_sort(pii_all, (a, b) -> case when a.start < b.start then -1 when a.start > b.start then 1 when a.kind < b.kind then -1 when a.kind > b.kind then 1 else 0 end)")
    return made.withColumn("pii_all", F.concat("pii_base", added)).select("row", "pii_text", spans.alias("spans"))


def find(docs: DataFrame, text: str = "text", out: str = "pii_spans", sample: int = SAMPLE) -> DataFrame:
    """docs with an array of spans (kind, start, end, hit) in order of start, then of kind.

    Base spans (email, ip, card, phone) are all there; others are there if the trees' score reaches the threshold
    of their kind, also where they overlap base spans. start and end are code points, end exclusive. A null or empty
    text has no spans. Texts are searched whole, in time that follows their length and their matches; rows are
    neither dropped nor repeated; an empty table gives no rows. Only a column of docs named like out is replaced.
    """
    return _spans(docs, text, sample).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != out], F.col("spans").alias(out))


#: Code points of a piece of text from which parts are taken.
PIECE = 4_096


def _part(start: str, end: str) -> str:
    """SQL: the text between two code points, out of its pieces."""
    a, b = f"(({start}) div {PIECE})", f"(({end}) div {PIECE})"
    whole = f"array_join(slice(pieces, {a} + 2, {b} - {a} - 1), '')"
    return f"""case when {a} = {b} then substring(coalesce(get(pieces, cast({a} as int)), ''), ({start}) % {PIECE} + 1, ({end}) - ({start}))
      else concat(substring(pieces[cast({a} as int)], ({start}) % {PIECE} + 1), {whole}, substring(coalesce(get(pieces, cast({b} as int)), ''), 1, ({end}) % {PIECE})) end"""


def redact(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """docs with each span of text replaced by its kind in square brackets; overlapping spans become one, named by
    the first. A null text stays null. Rows and columns are as before; time follows a text's length and spans."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    made = _spans(docs, text, sample)
    made = made.withColumn("pieces", F.expr(f"case when size(spans) > 0 then regexp_extract_all(pii_text, '(?s).{{1,{PIECE}}}', 0) end"))
    made = made.withColumn("ahead", F.expr(f"case when size(spans) > 0 then {_let('transform(spans, s -> s.end)', 'w', _before('w', 'max'))} end"))
    heads = "filter(transform(spans, (s, i) -> named_struct('kind', s.kind, 'start', s.start, 'from', ahead[i])), x -> x.start >= x.from)"
    shown = f"concat({_part('x.from', 'x.start')}, '[', element_at(array({names}), x.kind + 1), ']')"
    end = "greatest(element_at(ahead, -1), element_at(spans, -1).end)"
    cleaned = F.expr(f"case when size(spans) = 0 then row.`{text}` else concat(array_join(transform({heads}, x -> {shown}), ''), {_part(end, 'char_length(pii_text)')}) end")
    return made.select(*[(cleaned if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def _told(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.end)), ',')")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, a digest of the base spans, and all spans of every document."""
    found = find(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.expr(f"cast(size(filter(pii_spans, s -> s.kind = {k})) as bigint)")
    base = found.withColumn("base", F.expr(f"filter(pii_spans, s -> s.kind < {len(BASE)})"))
    return base.select("doc_id", *[count(n).alias(f"n_{k}") for n, k in enumerate(BASE)], F.sha2(_told("base"), 256).alias("base_sha256"), _told("pii_spans").alias("spans"))
