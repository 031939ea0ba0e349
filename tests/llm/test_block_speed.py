"""Token blocks: what makes them fit their CPU seconds changes neither ids nor bytes."""

import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from wavesift.llm import blocks, bpe

VOCABULARY = 50_257
PATH = public_tokenizers.path(blocks.TOKENIZER)


def test_plain_pattern_gives_the_same_ids():
    whole, encode, r = Tokenizer.from_file(PATH), bpe.encoder(PATH), np.random.default_rng(4)
    parts = ["a", " ", "word", "ß", "日本", "'s", "'", "12", "\n", "\r", "\t", "\x85", "\xa0", "\u2003", "\u3000", "\x1c", "!?", "é", "<|endoftext|>", "zqxj"]
    texts = ["".join(r.choice(parts, n)) for n in r.integers(0, 12, 4_000)] + ["  ", " ", "a ", " a", "a\n b", "x <|endoftext|> y"]
    found = bpe.runs(pa.array([*texts, None]))
    assert found.pop() is None and 500 < sum(found) < 3_500
    for text, run in zip(texts, found, strict=True):
        assert run == bool(regex.search(r"[^\S\x1c-\x1f]{2}", text)), repr(text)
        assert encode(text, run).tolist() == whole.encode(text, add_special_tokens=False).ids == encode(text).tolist(), repr(text)


def test_every_white_space_counts_as_such():
    spaces = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and c.isspace() and c not in "\x1c\x1d\x1e\x1f"]
    assert len(spaces) == 25 and all(bpe.runs(pa.array([c + " " for c in spaces] + [f"\n{c}" for c in spaces])))


def test_plain_texts_take_less_time():
    encode, text = bpe.encoder(PATH), "the people of this town have been there for years and they like it, " * 20_000
    taken = {}
    for run in (True, False, True, False, True, False):
        began = time.process_time()
        encode(text, run)
        taken[run] = min(taken.get(run, 9), time.process_time() - began)
    assert taken[False] < 0.7 * taken[True]


def test_places_are_those_of_a_search():
    r = np.random.default_rng(5)
    model = blocks.Model(3_000, 500)
    model.steps = 64
    model.count(r.zipf(1.3, (64, 500)).astype(np.int64) % 3_000)
    model.guide()
    for _ in range(20):
        model.c1, v = r.zipf(1.3, 500) % 3_000, r.integers(0, 1 << blocks.NEXT_BITS, 500)
        v[:50], v[50:100] = 0, (1 << blocks.NEXT_BITS) - 1
        start, size = model.place(v)[1:]
        assert (start <= v).all() and (v < start + size).all()
        for x, value, got in zip(model.c1, v, model.place(v)[0] >> 2 * blocks.NEXT_BITS + 1, strict=True):
            own = model.keys >> blocks.NEXT_BITS == x
            k = np.searchsorted(model.both[own] >> blocks._u(blocks.NEXT_BITS), np.uint64(value), "right") - 1
            assert got == (model.keys[own][k] & (1 << blocks.NEXT_BITS) - 1 if value < model.known[x] else -1)


def test_fewer_keys_or_fewer_values():
    r = np.random.default_rng(6)
    for keys, wanted in ((40, 3_000), (3_000, 40), (0, 10), (10, 0), (1, 1)):
        keys, wanted = np.unique(r.integers(0, 9_000, keys)), r.integers(0, 9_000, wanted)
        assert (blocks._find(keys, wanted) == np.searchsorted(keys, wanted, "right") - 1).all()


def test_format_is_as_it_was():
    ids = (np.random.default_rng(7).zipf(1.2, 150_000) % VOCABULARY).astype("<u4")
    body = blocks.compress(ids, VOCABULARY)
    assert (len(body), zlib.crc32(body)) == (209_690, 3_285_289_937)
    assert (blocks.decompress(body, len(ids), VOCABULARY) == ids).all()


def test_blocks_of_any_length():
    r = np.random.default_rng(8)
    for n in (0, 1, 2, 255, 256, 511, 512, 2_049, 70_000):
        ids = (r.zipf(1.3, n) % VOCABULARY).astype("<u4")
        lengths, back = blocks.read_block(blocks.write_block(np.array([n, 0]), ids, VOCABULARY))
        assert lengths.tolist() == [n, 0] and back.dtype == ids.dtype and (back == ids).all()


def test_no_small_block_is_left(spark, monkeypatch):
    """Short documents: a task's last block holds about half the ids that end one, or more."""
    monkeypatch.setattr(blocks, "BLOCK_IDS", 1_000)
    r = np.random.default_rng(9)
    words = [5_000, *r.integers(0, 30, 1_000).tolist()]
    df = spark.createDataFrame([(i, "word " * n) for i, n in enumerate(words)], "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        written = blocks.write_ids(df)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = sorted(written.collect(), key=lambda b: (b.shard, b.block))
    assert len(rows) > 9 and [i for b in rows for i in b.doc_ids] == list(range(len(words)))
    assert all(b.n_ids >= 1_000 for b in rows[:-1]) and rows[-1].n_ids >= 470
    back = blocks.read_ids(written).orderBy("doc_id").collect()
    encode = bpe.encoder(PATH)
    assert [b.ids for b in back] == [[*(encode("word " * n).tolist() if n else []), 0] for n in words]
