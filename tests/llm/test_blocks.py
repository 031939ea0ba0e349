"""Blocks of token ids: how small they are, where they are written, odd contents."""

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import zstandard

from wavesift.llm import blocks, bpe

VOCABULARY = 50_257


def test_fewer_bytes_than_a_general_compressor():
    """On the first two million ids of the middle table, against zstd at level 9 on 16-bit ids."""
    encode, held, n = bpe.encoder(public_tokenizers.path(blocks.TOKENIZER)), [], 0
    for text in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id")["text"].to_pylist():
        held.append(np.append(encode(text or ""), 0))
        n += len(held[-1])
        if n >= blocks.BLOCK_IDS:
            break
    ids = np.concatenate(held).astype("<u4")
    body = blocks.compress(ids, VOCABULARY)
    assert (blocks.decompress(body, len(ids), VOCABULARY) == ids).all()
    assert len(body) < 0.92 * len(zstandard.compress(ids.astype("<u2").tobytes(), 9))


@pytest.mark.parametrize("kind", ["one id", "two in turn", "all once", "copies", "random"])
def test_odd_contents(kind):
    r = np.random.default_rng(1)
    ids = {
        "one id": np.full(90_000, 7),
        "two in turn": np.arange(90_001) % 2 * 50_256,
        "all once": r.permutation(VOCABULARY),
        "copies": np.tile(r.integers(0, VOCABULARY, 777), 150),
        "random": r.integers(0, VOCABULARY, 100_000),
    }[kind].astype("<u4")
    body = blocks.compress(ids, VOCABULARY)
    assert (blocks.decompress(body, len(ids), VOCABULARY) == ids).all()
    assert len(body) < {"one id": 0.1, "two in turn": 0.2, "copies": 1.2, "all once": 3.2}.get(kind, 2.6) * len(ids)


def test_order_1_spans_do_not_meet():
    r = np.random.default_rng(2)
    model = blocks.Model(300, 50)
    model.steps = 64
    model.count(r.zipf(1.4, (64, 50)).astype(np.int64) % 300)
    head, unit = model.keys >> blocks.NEXT_BITS, 1 << blocks.NEXT_BITS
    for x in np.unique(head):
        own = head == x
        start, size = model.both[own] >> blocks._u(blocks.NEXT_BITS), model.both[own] & blocks._BELOW
        assert start[0] == 0 and (size > 0).all() and (start[1:] == (start + size)[:-1]).all() and model.known[x] == (start + size)[-1] < unit


def test_where_blocks_are_written(spark, docs, empty, tmp_path):
    folder = f"file://{tmp_path}/ids"
    written = blocks.write_ids(docs, folder=folder)
    again = blocks.read_ids(spark.read.parquet(folder))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, blocks.read_ids(written).collect()))
    assert blocks.read_ids(blocks.write_ids(empty, folder=f"file://{tmp_path}/none")).count() == 0


def test_ids_with_many_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ALIKE", 5)
    rows = [(None if i % 3 else 7, f"text {i % 17}") for i in range(60)] + [(i, "other") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = blocks.read_ids(blocks.write_ids(df)).orderBy("start").collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0) for r in got)) == [(r.doc_id is not None, r.doc_id or 0) for r in got] and len(got) == 70
    assert [r.start for r in got] == np.cumsum([0] + [len(r.ids) for r in got])[:-1].tolist()
