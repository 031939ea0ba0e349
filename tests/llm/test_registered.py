"""Registered queries without SQL against brute force on whole small tables, digests included."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__
from tests.llm.test_documents import base_spans, components, crc, fingerprint, ids
from wavesift.llm import byte_bpe, places

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def run(spark, name):
    rows = __spark_entry__.queries()[name](spark, SF).collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: r for r in rows}


def test_op1(spark, texts):
    got = run(spark, "op1_pii")
    assert set(got) == set(texts)
    for i, t in texts.items():
        base = base_spans(t)
        kinds = [s.split(":")[0] for s in base]
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(kinds.count(k) for k in ("email", "ip", "card", "phone"))
        assert got[i].base_sha256 == sha(",".join(base)) and set(base) <= set(got[i].spans.split(",")) | {""}


def test_op2(spark, texts):
    got = run(spark, "op2_simhash")
    up = components({fingerprint(t) for t in texts.values()})
    least = {}
    for i in sorted(texts):
        least.setdefault(up[fingerprint(texts[i])], i)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fingerprint(t):016x}", least[up[fingerprint(t)]]) for i, t in texts.items()}


def test_op6(spark, texts):
    got, at = run(spark, "op6_token_blocks"), 0
    for i in sorted(texts):
        own = [*ids(texts[i]), 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(own), crc(own))
        at += len(own)
    assert set(got) == set(texts)


def test_op9(spark, texts):
    with open(public_tokenizers.path(byte_bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in texts.items():
        own = library.encode_ordinary(t or "")
        want[i] = (len(own), sha(",".join(map(str, own))), sha(library.decode_bytes(own)))
    assert {i: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for i, r in run(spark, "op9_byte_bpe").items()} == want


def test_op9_in_small_chunks_and_buckets(spark, texts, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK", 20_000)
    monkeypatch.setattr(byte_bpe, "BUCKET", 10_000)
    monkeypatch.setattr(byte_bpe, "IDS", 5_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("lang", "chunk").withColumnRenamed("source", "word")
    back = byte_bpe.decode(byte_bpe.encode(docs), keep=("doc_id",))
    assert {r.doc_id: bytes(r.bytes).decode() for r in back.collect()} == {i: t or "" for i, t in texts.items()}


def test_decoding_of_no_ids_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (2, []), (3, [0, 1, 0])], "doc_id long, ids array<int>")
    table = byte_bpe.token_bytes(public_tokenizers.path(byte_bpe.RANKS))
    assert sorted((r.doc_id, None if r.bytes is None else bytes(r.bytes)) for r in byte_bpe.decode(rows).collect() if r.doc_id > 1) == [(2, b""), (3, table[0] + table[1] + table[0])]
    assert [r.bytes for r in byte_bpe.decode(rows).where("doc_id = 1").collect()] == [None, None]
    assert byte_bpe.decode(rows.where("false")).count() == 0
    with pytest.raises(Exception, match="lacks"):
        byte_bpe.decode(spark.createDataFrame([(1, [10**8])], "doc_id long, ids array<int>")).collect()


@pytest.mark.parametrize("n", [0, 1, 5, 1_000, 300_000])
def test_places(n):
    r = np.random.default_rng(n)
    _, codes = np.unique(r.zipf(1.3, n) % 5_000, return_inverse=True)
    packed, starts = places.gathered(codes, int(codes.max(initial=-1)) + 1)
    assert (places.scattered(packed, starts, n) == codes).all()
    if n > 1:
        with pytest.raises(ValueError):
            places.scattered(packed, starts, n + 1)
