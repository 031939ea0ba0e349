"""Document operators against brute force on odd texts: null, empty, long, repeated, with clashing columns."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from tests.llm.conftest import TEXTS
from wavesift.llm import blocks, bpe, byte_bpe, packing, pii, quality, simhash, token_counts

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def spaced(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m[0])]
    return [x[2] for x in sorted(found)]


def test_pii(docs, empty):
    found = pii.find(docs)
    assert set(found.columns) == {*docs.columns, "pii_spans"} and found.count() == len(TEXTS)
    for r in found.collect():
        own = [f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in r.pii_spans if s.kind < len(pii.BASE)]
        assert own == base_spans(r.text)
        assert all(s.hit == r.text[s.start : s.end] for s in r.pii_spans)
    cleaned = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert cleaned[5].startswith("[email][email] [ip].[ip] 300.1.2.3 x [card] y [phone]") and cleaned[2] is None and cleaned[0] == TEXTS[0][1]
    assert pii.redact(docs).columns == docs.columns and pii.find(empty).count() == 0


def test_pii_trees_on_held_out_texts(spark):
    model, cuts = pii.trained(spark)
    assert any(c != float("inf") for c in cuts.values())
    rows = spark.createDataFrame(pii.labelled_texts(600, seed=99), "number int, text string, personal int")
    told = [(r.personal, any(s.kind >= len(pii.BASE) for s in r.pii_spans)) for r in pii.find(rows).collect()]
    hits = Counter(told)
    assert hits[1, True] / (hits[1, True] + hits[0, True]) > 0.9 and hits[1, True] / (hits[1, True] + hits[1, False]) > 0.5


def fingerprint(text):
    w = spaced(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    root = {f: f for f in prints}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 3:
                root[up(a)] = up(b)
    return {f: up(f) for f in prints}


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in got) == Counter((t[0], fingerprint(t[1])) for t in TEXTS)
    up = components({fingerprint(t[1]) for t in TEXTS})
    least = defaultdict(list)
    for t in TEXTS:
        if t[0] is not None:
            least[up[fingerprint(t[1])]].append(t[0])
    assert all(r.component_id == min(least[up[r.fp & (1 << 64) - 1]], default=None) for r in got)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter([0, 2, 5, 6, 7, 8, None, 9, 10])
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("group", [4, 4_096])
def test_links_of_a_dense_group(spark, monkeypatch, group):
    """A ball of close fingerprints, chains, and strangers; small groups are cut again by finer signatures."""
    monkeypatch.setattr(simhash, "GROUP", group)
    r = np.random.default_rng(3)
    prints = [0x1234567812345678 ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 4), replace=False)) for _ in range(150)]
    prints += [int(x) for x in r.integers(0, 1 << 62, 60)]
    for _ in range(60):
        prints.append(prints[-1] ^ sum(1 << int(b) for b in r.choice(64, 3, replace=False)))
    prints = list(set(prints))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    from wavesift.llm.components import connect

    got = {r.node & (1 << 64) - 1: r.root for r in connect(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    want, ours = defaultdict(set), defaultdict(set)
    for f, u in components(set(prints)).items():
        want[u].add(f)
        ours[got.get(f, ("alone", f))].add(f)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, ours.values()))


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (0, None), (None, 1), (7, 0)], "doc_id long, quality int")
    for r in quality.rate(docs, labels).collect():
        text = next(t[1] for t in TEXTS if t[0] == r.doc_id)
        w = spaced(text)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [line for line in (text or "").split("\n") if spaced(line)]
        want = (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and r.kept == (not r.base_failed)
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {0, 1} and kept.count() == 2
    assert quality.rate(empty, labels).count() == 0 and quality.rate(docs, labels.where("false")).count() == len(TEXTS)


def test_certified_cutoffs_against_the_binomial_sum(spark):
    """2,000 good documents of one language without symbols, bad ones with many; another language has too few."""
    rows = [("en", True, 100, 500, 0)] * 2_000 + [("en", True, 100, 500, 60)] * 3 + [("en", False, 100, 500, 80)] * 50 + [("fr", True, 100, 500, 0)] * 30 + [("fr", False, 100, 500, 80)] * 9
    scored = spark.createDataFrame(rows, "stratum string, good boolean, n_words long, word_chars long, n_symbols long").selectExpr("*", "0L n_dup_lines", "0L n_repeat_words", "5L n_lines")
    cuts = {r.stratum: r.cut_symbols for r in quality.certify(scored).collect()}
    assert cuts == {"en": 15, "fr": None}  # 12 would reject three good ones too, 15 catches as many bad ones


def test_token_counts(docs, empty):
    assert Counter(token_counts.count_tokens(docs).collect()) == Counter((t[0], len((t[1] or "").encode()), len(ids(t[1])), len(ids(t[1])) > 1024) for t in TEXTS)
    assert token_counts.count_tokens(empty).count() == 0


def test_blocks(docs, empty):
    got = blocks.read_ids(blocks.write_ids(docs)).orderBy("start").collect()
    order = sorted(TEXTS, key=lambda t: (t[0] is not None, t[0] or 0))
    assert [(r.doc_id, r.ids) for r in got] == [(t[0], ids(t[1]) + [0]) for t in order]
    assert [r.start for r in got] == np.cumsum([0] + [len(r.ids) for r in got])[:-1].tolist()
    assert blocks.read_ids(blocks.write_ids(empty)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 5_000, 70_000])
def test_block_round_trip_and_damage(n):
    r = np.random.default_rng(n)
    x = (r.zipf(1.2, n) % 50_257).astype("<u4")
    block = blocks.write_block(np.array([n]), x, 50_257)
    assert (blocks.read_block(block)[1] == x).all()
    with pytest.raises(ValueError):
        blocks.read_block(block[:-1] + bytes([block[-1] ^ 1]))


def test_packing(docs, empty):
    rows, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs).collect():
        rows[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for t in TEXTS:
        whole = ids(t[1]) + [1]
        copies = sum(x[0] == t[0] for x in TEXTS)
        assert sum(r.length for r in rows[t[0]]) == copies * len(whole) and {r.doc_tokens for r in rows[t[0]]} == {len(whole)}
        assert all(r.ids_crc32 == crc(whole[r.start : r.start + r.length]) for r in rows[t[0]])
        assert {i for r in rows[t[0]] for i in range(r.start, r.start + r.length)} == set(range(len(whole)))
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in own])
        assert [r.offset for r in own] == [0, *ends[:-1]] and ends[-1] & ends[-1] - 1 == 0 and ends[-1] <= 2048
    assert packing.pack(empty).count() == 0


def test_byte_bpe(docs, empty):
    with open(public_tokenizers.path(byte_bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = byte_bpe.encode(docs)
    assert Counter((r.doc_id, hashlib.md5(str(r.ids).encode()).digest()) for r in coded.collect()) == Counter((t[0], hashlib.md5(str(library.encode_ordinary(t[1] or "")).encode()).digest()) for t in TEXTS)
    assert Counter((r.doc_id, bytes(r.bytes)) for r in byte_bpe.decode(coded).collect()) == Counter((t[0], (t[1] or "").encode()) for t in TEXTS)
    assert byte_bpe.encode(empty).count() == 0


def test_short_pieces_are_cut_as_the_pattern_cuts_them():
    around = ["{}", " {}", "a{}", " a{}.", '{}a"', "'s{}", "{}\n{}", " a{}!)"]
    for c in [chr(n) for n in (*range(1, 0x400), 0x2028, 0x3042, 0x1F600, 0x1C89, 0x10FFFD)]:
        for shape in around:
            piece = shape.format(c, c)
            assert bpe.short_pre_tokens(piece) == bpe.pre_tokens(piece), repr(piece)


def test_order_0_values_find_their_ids():
    r = np.random.default_rng(3)
    model = blocks.Model(300, 8)
    model.seen[:] = r.integers(0, 50, 300)
    model.renew()
    v = r.integers(0, int(model.cum[-1]), 5_000)
    own = model.ids_at(v)
    assert (model.cum[own] <= v).all() and (v < model.cum[own] + model.freq[own]).all()
