"""Searches, URLs, conversations and the pipeline."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from wavesift.llm import chat, queries, topk, url_filter

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"select {','.join(columns)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, [tuple(r[c] for c in columns) for r in df.collect()])) == sorted(map(repr, want))


def test_topk_with_ties_gaps_and_two_lengths(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 50)
    r = np.random.default_rng(5)
    rows = [(i, r.integers(-3, 4, 6).astype(float).tolist()) for i in range(400)]
    rows += [(i, [0.5, -0.25]) for i in range(400, 412)] + [(500, None), (501, [1.0, None] * 3), (502, [float("nan")] * 6), (503, []), (None, [1.0] * 6), (7, rows[7][1]), (100, rows[100][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    ok = [(i, np.floor(1024 * np.array(v))) for i, v in rows if i is not None and v and not any(x is None or x != x for x in v)]
    want = []
    for q, v in {i: v for i, v in ok if i % 100 == 0}.items():
        scored = sorted((-int(v @ c), i) for i, c in ok if i != q and len(c) == len(v))[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    for most in (8_192, 3):
        monkeypatch.setattr(topk, "QUERIES", most)
        assert sorted(map(tuple, topk.search(df.where("vec_id % 100 = 0"), df).collect())) == sorted(want)
    assert topk.search(df.where("false"), df).count() == 0 and topk.search(df.where("vec_id % 100 = 0"), df.where("false")).count() == 0


def test_urls(spark):
    urls = [None, "nothing", "http://WWW.Example.com/en/x?y#z", "http://example.com/en/", "http://a.example.com/de", "https://b.net/es/1", "http://b.net/de/1", "http://xcom/", "http://c.org?q=/en/", "://com/"]
    df = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[3] == ("example.com", "/en/", "example.com/en/", "block")
    assert got[4][2:] == ("com/", "allow") and got[5][2:] == ("net/es/", "block") and got[6][2:] == (None, "block")  # half of b.net is blocked
    assert got[7] == ("xcom", "/", None, "allow") and got[8] == ("c.org", "", None, "allow") and got[9] == ("com", "/", "com/", "allow")
    assert url_filter.judge(df.where("false")).count() == 0


def test_distrust_goes_back_over_links(spark):
    """farm.org links to blocked pages only, good.org to trusted ones; scores against a plain iteration."""
    page = lambda i, url, *to: (i, url, "".join(f'<a href="{x}">' for x in to))
    pages = [page(0, "http://bad.net/es/1"), page(1, "http://farm.org/", "http://bad.net/es/1"), page(2, "http://good.org/", "//www.com/x"), page(3, "http://www.com/"), page(4, "http://far.org/", "http://farm.org/")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge(df).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "allow", 4: "block"}


def test_preferences(spark):
    rows = [
        (1, True, 0, "user", "hi"), (1, True, 1, "assistant", "yes <|im_end|>"), (1, False, 0, "user", "hi"), (1, False, 1, "assistant", "no"), (1, False, 1, "assistant", "no"),
        (2, True, 0, None, None), (2, False, 0, None, None), (3, True, 0, "user", "alone"), (None, True, 0, "user", "x"), (4, True, 0, "user", ""), (4, False, 5, "user", ""), (4, False, 6, "assistant", "more"),
    ]
    got = {r.pair_id: r for r in chat.format_preferences(spark.createDataFrame(rows, "pair_id long, is_chosen boolean, turn int, role string, text string")).collect()}
    one = got[1]
    assert one.n_prompt_turns == 1 and one.prompt == "<|im_start|>user\nhi<|im_end|>\n" and one.chosen == "<|im_start|>assistant\nyes <| im_end|><|im_end|>\n"
    for side, mask in ((one.chosen, one.chosen_mask), (one.rejected, one.rejected_mask)):
        a, b = map(int, mask.split(":"))
        assert (one.prompt + side)[a:b] == side.split("\n", 1)[1][:-1]
    assert set(got) == {1, 2, 3, 4} and not got[2].differs and got[3].rejected == "" and got[3].n_prompt_turns == 0
    assert got[4].n_prompt_turns == 1 and got[4].chosen == "" and got[4].rejected != ""


def test_pipeline_keeps_clean_documents(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "pii", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert len(ids) == kept.count() > 100
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == ids
