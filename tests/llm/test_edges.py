"""Odd tables through every operator: nulls, repeated rows, empty tables, very long texts, clashing column names."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import TEXTS
from wavesift.llm import chat, minhash, packing, quality, shared, simhash, topk, url_filter
from wavesift.llm.components import connect

SF = "/root/testdata/sf0.001"
CLASHES = ["keep_h_", "keep_row", "keep_own", "keep_hash", "pii_spans", "pii_text", "q_row", "q_text", "q_kept", "n_words", "kept", "h", "fp", "root", "row", "spans", "start", "length"]


@pytest.fixture(scope="module")
def odd(docs):
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    return docs


@pytest.mark.parametrize("classify", [simhash.classified, minhash.classified])
def test_one_of_each(odd, empty, classify):
    kept = simhash.one_of_each(odd, classify=classify)
    rows = kept.collect()
    assert kept.columns == odd.columns and all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    ids = Counter(r.doc_id for r in rows)
    assert max(ids.values()) == 1 and {0, 2, 5, 6, 7, 8, None, 9, 10} == set(ids)  # null, empty and blank texts are one group
    assert simhash.one_of_each(empty, classify=classify).count() == 0


def test_every_stage_keeps_columns_and_odd_rows(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES[:3]:
        made = stage(spark, odd, SF)
        assert made.columns == odd.columns, name
        assert all(r[c] == f"own {c}" for r in made.collect() for c in CLASHES), name
        none = stage(spark, empty, SF)
        assert none.count() == 0 and none.columns == empty.columns, name
    assert packing.pack(odd).count() > 0 and corpus_pipeline.packed(spark, empty, SF).count() == 0
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = shared.settle(stage(spark, docs, SF), "stage")
    want = {t[0] for t in TEXTS if len((t[1] or "").split()) >= 20 and t[0] not in (1, 7, 8)}  # 1 repeats 0, 7 and 8 repeat themselves
    assert Counter(r.doc_id for r in docs.collect()) == Counter(want)
    assert {r.doc_id for r in corpus_pipeline.packed(spark, docs, SF).collect()} == want


def test_stages_stand_repeated_rows_and_null_ids(spark, docs):
    text = " ".join(f"word{i} of{i % 9}" for i in range(40))
    rows = spark.createDataFrame([(None, text, "en")] * 3 + [(4, text, None)] * 2 + [(5, text + " mail a@b.cc", "en")], "doc_id long, text string, lang string")
    assert quality.keep(rows, shared.table(spark, SF, "labels")).count() == 6
    kept = corpus_pipeline.distinct(spark, rows, SF).collect()
    assert [(r.doc_id, r.text) for r in kept] == [(4, text)]
    cleaned = corpus_pipeline.clean(spark, rows, SF).collect()
    assert len(cleaned) == 6 and [r.text for r in cleaned if r.doc_id == 5] == [text + " mail [email]"]


def test_measures_of_a_table_with_their_names(spark):
    df = spark.createDataFrame([("a b\nc", "x", 7)], "text string, n_words string, q_words int")
    got = quality.measures(df)
    assert sorted(got.columns) == sorted(["text", "q_words", *quality.MEASURES]) and got.first().n_words == 3 and got.first().q_words == 7


def test_repeated_windows_are_compared_by_their_words(spark):
    """With hashes that are all alike the words decide."""
    r = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 3, n)) for n in (8, 9, 30, 200)] + ["a b c d e f g h " * 3, "x"]
    from tests.llm.test_documents import spaced

    for row in quality.measures(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect():
        w = spaced(row.text)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        assert row.n_repeat_words == len({j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)})


def test_risk_of_certified_rules():
    """Strata whose good documents are rejected at a rate just over the limit by every cutoff: few are certified."""
    r = np.random.default_rng(11)
    rules, level, wrong = len(quality.RULES), 0.05, 0
    strict = tuple(1 for _ in range(rules))
    for _ in range(2_000):
        bad = int(r.binomial(900, 0.0101))
        cells = [(False, True, (0,) * rules, 900 - bad), (False, True, strict, bad), (True, True, (0,) * rules, 300), (False, False, strict, 50)]
        wrong += any(quality._certified(cells, 0.01, level))
    assert wrong / 2_000 < level + 3 * (level * (1 - level) / 2_000) ** 0.5
    sure = [(False, True, (0,) * rules, 900), (True, True, (0,) * rules, 300), (False, False, strict, 50)]
    assert quality._certified(sure, 0.01, level) == (1, 0, 0, 0) or sum(quality._certified(sure, 0.01, level)) == 1


def test_paths_tighten_every_rule(spark):
    cells = [(True, True, (1, 0, 0, 0), 5), (True, False, (0, 2, 0, 0), 9)]
    path = quality._path(cells)
    most = [len(cuts) for _, _, cuts in quality.RULES.values()]
    assert list(path[-1]) == most and len(path) == sum(most) and all(sum(b) - sum(a) == 1 and all(y >= x for x, y in zip(a, b)) for a, b in zip(path, path[1:]))
    assert path[0][0] == 0  # the first rule would reject good documents


def test_repeated_labelled_ids_count_once(spark):
    words = " ".join(f"u{i}" for i in range(50))
    docs = spark.createDataFrame([(i, words, "en") for i in range(40)] * 30 + [(99, words + " " + "#" * 60, "en")] * 30, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(99, 0)], "doc_id long, quality int")
    rated = quality.rate(docs, labels)
    assert rated.where("not kept").count() == 0  # 40 good documents certify nothing, though they have 1,200 rows


def test_components_with_null_ends_and_loops(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (None, 4), (5, None), (2, 7)], "a long, b long")
    assert {r.node: r.root for r in connect(edges).collect()} == {1: 1, 2: 1, 7: 1}
    assert connect(edges.where("false")).count() == 0


def test_topk_of_great_components_and_clashing_names(spark):
    rows = [(100, [0.001, 0.0]), (1, [1e13, 0.0]), (2, [2.0, 5.0]), (3, [-1e300, 0.0]), (4, [1.7e308, 1.0]), (200, [1e200, 1.0]), (5, [float("inf"), 1.0])]
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, score int, v string, query_id string")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search(df.where("vec_id % 100 = 0"), df).collect()}
    end = (1 << 63) - 1
    # for 100, whose components are 1 and 0: 4, 200, 1, 2, 3
    assert [got[100, n] for n in range(1, 6)] == [(4, end), (200, end), (1, 10_240_000_000_000_000), (2, 2_048), (3, -end - 1)]
    assert [got[200, n] for n in range(1, 6)] == [(4, end), (1, end), (2, end), (100, end), (3, -end - 1)]
    assert topk.search(df.where("false"), df).count() == 0 and topk.search(df.where("vec_id = 100"), df.where("false")).count() == 0


def test_topk_prunes_and_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 300)
    monkeypatch.setattr(topk, "FIRST", 20)
    r = np.random.default_rng(9)
    scale = np.array([30.0, 9.0, 3.0, 1.0, 0.3, 0.1, 0.0, 0.0])
    x = r.normal(size=(2_000, 8)) * scale
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    v = np.floor(x * 1024)
    want = []
    for q in range(0, 2_000, 100):
        s = v @ v[q]
        order = sorted((i for i in range(2_000) if i != q), key=lambda i: (-s[i], i))[:10]
        want += [(q, n + 1, i, int(s[i])) for n, i in enumerate(order)]
    assert sorted(map(tuple, topk.search(df.where("vec_id % 100 = 0"), df).collect())) == want


def test_pages_repeated_long_and_empty(spark):
    html = "".join(f'<a href="https://h{i % 50}.org/{i}">x</a>' for i in range(20_000))
    pages = [(1, "http://bad.net/es/", None, "x")] * 2 + [(2, "http://long.org/", html, "x"), (2, "http://long.org/", html, "x"), (3, None, html, "x"), (None, "http://h1.org/", '<a href="//bad.net/">', "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, verdict string")
    got = Counter(map(tuple, url_filter.judge(df).collect()))
    assert got[1, "bad.net", "/es/", "net/es/", "block"] == 2 and got[2, "long.org", "/", None, "block"] == 2  # it alone links to what alone links to bad.net
    assert got[3, "", "", None, "allow"] == 1 and got[None, "h1.org", "/", None, "block"] == 1
    assert url_filter.judge(df.where("false")).count() == 0


def test_mass_of_hosts_without_links_goes_back_to_the_seeds(spark):
    """Against the equations with that mass returned, in units of what a seed's own mass is then."""
    names = ["a", "b", "c", "d", "e"]
    links = [("a", "b", 1), ("a", "c", 3), ("b", "a", 1), ("c", "d", 2)]
    seeds = [("a", 1.0, 0.0), ("b", 0.0, 0.5), ("c", 0.25, 0.0), ("d", 0.0, 1.0), ("e", 0.5, 0.0)]
    at = {x: i for i, x in enumerate(names)}
    found = {r.host: (r.trust, r.distrust) for r in url_filter.propagate(spark.createDataFrame(seeds, "host string, trusted double, blocked double"), spark.createDataFrame(links, "src string, dst string, links long")).collect()}
    for way in (0, 1):
        seed = np.array([s[1 + way] for s in seeds])
        m = np.zeros((5, 5))
        for x in links:
            m[at[x[1 - way]], at[x[way]]] += x[2]
        out = m.sum(axis=0)
        m[:, out > 0] /= out[out > 0]
        m[:, out == 0] = (seed / seed.sum())[:, None]
        score = np.linalg.solve(np.eye(5) - 0.85 * m, 0.15 * seed)
        unit = 0.15 + 0.85 * score[out == 0].sum() / seed.sum()  # what one seed's own mass is
        assert abs(score.sum() - seed.sum()) < 1e-9 and all(abs(found[x][way] - score[at[x]] / unit) < 2e-4 for x in names)


def test_preferences_long_and_empty(spark):
    long = "word " * 200_000
    rows = [(1, side, t, "user" if t % 2 == 0 else "assistant", long if t == 1 else f"{side}{t}" if t == 3 else "same") for side in (True, False) for t in range(4)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "pair_id long, is_chosen boolean, turn int, role string, text string, prompt string")
    one = chat.format_preferences(df).first()
    assert one.n_prompt_turns == 3 and long in one.prompt and "True3" in one.chosen and "False3" in one.rejected
    assert chat.format_preferences(df.where("false")).count() == 0


def test_few_documents_are_cut_in_packing():
    r = np.random.default_rng(3)
    lengths = (r.zipf(1.3, 3_000) * 40 % 1_900 + 20).tolist()
    pieces = packing.harmonic(lengths)
    assert sum(n for _, _, n, _, _ in pieces) == sum(lengths)
    assert len(pieces) < 1.25 * len(lengths)
