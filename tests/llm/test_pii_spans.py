"""Added spans beside base ones, and secrets of any length."""

import random

from wavesift.llm import pii


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_nothing_of_an_added_span_around_a_card_stays(spark):
    r = random.Random(4)
    card = next(d for d in iter(lambda: "".join(r.choice("0123456789") for _ in range(16)), "") if luhn(d))
    iban = f"GB82 WEST {card[:4]} {card[4:8]} {card[8:12]} {card[12:]}"
    long = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(300))
    rows = spark.createDataFrame([(0, f"pay to the bank account iban {iban} today"), (1, f"the api_key = {long} is new")], "doc_id long, text string")
    found = {x.doc_id: [(pii.KINDS[s.kind], s.hit) for s in x.pii_spans] for x in pii.find(rows).collect()}
    assert found[0][0] == ("iban", iban) and ("card", iban[10:]) in found[0] and found[1] == [("secret", long)]
    assert {x.doc_id: x.text for x in pii.redact(rows).collect()} == {0: "pay to the bank account iban [iban] today", 1: "the api_key = [secret] is new"}
