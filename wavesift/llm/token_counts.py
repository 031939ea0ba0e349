"""Token counts with a shortcut for pre-tokens that are one token."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.llm import bpe
from wavesift.llm.shared import documents, prepared

#: Tokens beyond which a document is over the limit.
LIMIT = 1_024
TOKENIZER = "byte_bpe_50k.json"


@lru_cache(maxsize=2)
def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings that are one pre-token and that the merges turn into one token, each of them tried. The
    driver proves them once for a vocabulary file, before any text is read, and sends them to the workers."""
    coder = bpe.load(path)
    proved = set()
    for token in coder.token_byte_values():
        try:
            string = token.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if bpe.pre_tokens(string) == [string] and len(coder.encode_ordinary(string)) == 1:
            proved.add(string)
    return frozenset(proved)


class Counter:
    """Tokens of whole texts: 1 for a proved pre-token, else the length of its merges, kept in a bounded memo."""

    def __init__(self, path: str, proved: frozenset[str]):
        coder = bpe.load(path)
        self.memo = bpe.Memo(lambda word: len(coder._encode_single_piece(word)))
        self.get = dict.fromkeys(proved, 1).get
        special = coder.special_tokens_set
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.strings = tuple(special)

    def plain(self, text: str) -> int:
        words = bpe.pre_tokens(text)
        known = list(map(self.get, words))
        if None not in known:
            return sum(known)
        merge = self.memo.__getitem__
        return sum([n or merge(w) for n, w in zip(known, words, strict=True)])

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if any(s in text for s in self.strings):
            parts = self.special.split(text)
            return sum(map(self.plain, parts)) + len(parts) - 1
        return self.plain(text)


_counters: dict[str, Counter] = {}


def counter(path: str, digest: str, proved: Broadcast) -> Counter:
    """One for each worker and vocabulary, kept across tasks."""
    if digest not in _counters:
        _counters.clear()
        _counters[digest] = Counter(path, proved.value)
    return _counters[digest]


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text", id: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row.

    A null text counts as empty: no bytes, no tokens. Texts are counted whole, whatever their length; repeated
    rows each return, an empty table gives none, and other columns are not read. Special strings within a text
    count as one token, as the library's default has it.
    """
    prepared(docs.sparkSession)
    path = path or public_tokenizers.path(TOKENIZER)
    with open(path, "rb") as f:
        digest = hashlib.sha256(f.read()).hexdigest()
    proved = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # the vocabulary bounds it

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, digest, proved)
        for b in batches:
            texts = b.column(1).to_pylist()
            sizes = pa.array([len(t.encode("utf-8")) if t else 0 for t in texts], pa.int64())
            yield pa.record_batch([b.column(0), sizes, pa.array(list(map(count, texts)), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    chosen = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    counted = chosen.mapInArrow(each, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document with byte_bpe_50k.json."""
    return count_tokens(documents(spark, sf_dir))
