"""Byte-level BPE over the distinct words of the whole corpus, and decoding by the token-byte table.

Documents are exploded into pre-tokens with their positions, gathered by word within chunks of documents: a chunk has
one row with all positions and one with the words of each hash bucket. Words go to workers by bucket, where each
distinct word is encoded once; their ids are joined back to the chunk, where documents are put together by position.
So a common word travels once for each chunk and not with its positions, and buckets are alike in size. All rows of a
chunk are dealt to one partition by a first exchange, which both the words' way out and the documents' assembly read,
so that positions travel once. Decoding does
the same with ids instead of words: they are exploded with their positions, joined with the token-byte table, and put
together again.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from wavesift.llm import bpe, places
from wavesift.llm.shared import documents, prepared, settle

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters of text in a chunk, beyond which the next document begins another, and documents in it at most.
CHUNK, CHUNK_ROWS = 4_000_000, 20_000
#: Ids that are decoded together.
IDS = 2_000_000
#: Bytes of text for each hash bucket of words, of which a worker holds one at a time.
BUCKET = 64_000_000


class _Numbered(dict):
    """Numbers for values in order of their first appearance."""

    def __missing__(self, value):
        n = self[value] = len(self)
        return n


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Names and texts of a partition's chunks."""
    size, names, texts = 0, [], []
    for b in batches:
        own = b.column(1).to_pylist()
        begun = 0
        for i, t in enumerate(own):
            size += len(t or "")
            texts.append(t)
            if size >= CHUNK or len(texts) >= CHUNK_ROWS:
                names.append(b.column(0).slice(begun, i + 1 - begun))
                yield pa.concat_arrays(names), texts
                size, names, texts, begun = 0, [], [], i + 1
        if begun < len(own):
            names.append(b.column(0).slice(begun))
    if texts:
        yield pa.concat_arrays(names), texts


def _cut(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pre-tokens of a chunk, which of them stand where, and how many each text has."""
    words, spaced, first = _Numbered(), _Numbered(), _Numbered()
    units = []  # a unit: a text's start, or a space and what follows up to the next
    for t in texts:
        found = bpe.pieces(t) if t else []
        if found is None:
            units.append(np.fromiter((-1 - words[w] for w in bpe.pre_tokens(t)), np.int64))
        elif found:
            begun = [2 * first[found[0]]] if found[0] else []
            rest = np.fromiter(map(spaced.__getitem__, found[1:]), np.int64, len(found) - 1)
            units.append(np.concatenate([np.array(begun, np.int64), 2 * rest + 1]))
        else:
            units.append(np.zeros(0, np.int64))
    alone = list(words)  # words that stand alone, of texts that are not cut at spaces
    own = list(map(bpe.short_pre_tokens, chain(first, (" " + u for u in spaced))))
    lengths = np.concatenate([np.fromiter(map(len, own), np.int64, len(own)), np.ones(len(alone), np.int64)])
    starts = np.concatenate([[0], lengths.cumsum()])
    held = np.fromiter(map(words.__getitem__, chain(chain.from_iterable(own), alone)), np.int64, int(starts[-1]))
    alone = len(first) + len(spaced)
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    u = np.concatenate(units) if units else np.zeros(0, np.int64)
    at = np.where(u < 0, alone - 1 - u, np.where(u % 2 == 0, u // 2, len(first) + u // 2))
    wide = lengths[at]
    ends = np.concatenate([[0], wide.cumsum()])
    stream = held[np.repeat(starts[at] - ends[:-1], wide) + np.arange(ends[-1])]
    bounds = ends[np.concatenate([[0], sizes.cumsum()])]
    return list(words), stream, np.diff(bounds)


def _by_bucket(words: list[str], buckets: int) -> tuple[list[tuple[int, list[bytes]]], np.ndarray]:
    """Words by hash bucket, sorted in each, and each word's place among all of them in this order."""
    own = [w.encode("utf-8") for w in words]
    order = np.array(sorted(range(len(own)), key=own.__getitem__), np.int64)
    keys = np.fromiter(map(zlib.crc32, own), np.int64, len(own))[order] % buckets
    by = np.argsort(keys, kind="stable")
    order, keys = order[by], keys[by]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]]).tolist() if len(keys) else [0]
    out = [(int(keys[a]), [own[n] for n in order[a:b].tolist()]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    rank = np.empty(len(own), np.int64)
    rank[order] = np.arange(len(own))
    return out, rank


def explode(docs: DataFrame, buckets: int, text: str = "text", id: str = "doc_id") -> DataFrame:
    """For each chunk a row (chunk, bucket, words) for each bucket of its words, and one row with the ids of its
    documents (held), their numbers of pre-tokens (sizes) and the places of each word, in order of bucket and word.

    A chunk holds what follows each other in a partition, so a partition must give its rows in the same order when
    a lost task is repeated. Rows that come out of a shuffle may not, and are settled first.
    """
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = settle(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), "documents")
        text, id = "text", "doc_id"
    chosen = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    kind = to_arrow_type(chosen.schema["doc_id"].dataType)

    labels = ["chunk", "bucket", "words", "held", "sizes", "places"]

    def told(at: int, names: pa.Array, texts: list[str | None]) -> list[pa.RecordBatch]:
        words, stream, sizes = _cut(texts)
        held, rank = _by_bucket(words, buckets)
        rows = len(held)
        blobs = [places.packed(own) for _, own in held]
        out = [pa.record_batch([pa.array([at] * rows, pa.int64()), pa.array([x for x, _ in held], pa.int32()), pa.array(blobs, pa.binary()), pa.nulls(rows, pa.list_(kind)), pa.nulls(rows, pa.binary()), pa.nulls(rows, pa.binary())], labels)] if rows else []
        whole = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names.cast(kind))
        where = places.stored(*places.gathered(rank[stream], len(words)))
        return [*out, pa.record_batch([pa.array([at], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), whole, pa.array([places.squeezed(sizes)], pa.binary()), pa.array([where], pa.binary())], labels)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, (names, texts) in enumerate(_chunks(batches)):
            yield from told((TaskContext.get().partitionId() << 32) + n, names, texts)
            places.freed()
        names = texts = None
        places.freed()

    return chosen.mapInArrow(each, f"chunk long, bucket int, words binary, held array<{chosen.schema['doc_id'].dataType.simpleString()}>, sizes binary, places binary")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.select(["chunk", "bucket", "words"]).filter(b.column("bucket").is_valid())


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id, in the order of ids."""
    coder = bpe.load(path)
    return [coder.decode_single_token_bytes(n) for n in range(coder.n_vocab)]


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """The token-byte table (token, bytes); the vocabulary bounds it."""
    held = token_bytes(path)
    return spark.createDataFrame(pa.table({"token": pa.array(range(len(held)), pa.int32()), "bytes": pa.array(held, pa.binary())}))


def encode_words(rows: DataFrame, path: str) -> DataFrame:
    """(chunk, bucket, ids) of rows (chunk, bucket, words) that are sorted by bucket within partitions; a worker
    encodes each distinct word of a bucket once. ids hold how many each word has, and all of them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = bpe.load(path)._encode_single_piece
        held, known = None, {}
        for b in batches:
            out = []
            for bucket, words in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                if bucket != held:
                    held, known = bucket, {}
                own = []
                for w in places.unpacked(words.as_py()):
                    if (found := known.get(w)) is None:
                        found = known[w] = array("I", one(w)).tobytes()
                    own.append(found)
                counts = np.fromiter(map(len, own), np.int64, len(own)) // 4
                sizes = places.squeezed(counts)
                out.append(len(sizes).to_bytes(4, "little") + sizes + places.squeezed(np.frombuffer(b"".join(own), "<u4")))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.binary())], ["chunk", "bucket", "ids"])
        held, known = None, {}
        places.freed()

    return rows.mapInArrow(each, "chunk long, bucket int, ids binary")


def _ids(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    return places.loosened(blob[4 : 4 + n]), places.loosened(blob[4 + n :])


def _more(spark: SparkSession, schema: str) -> tuple[list[str], list[pa.DataType]]:
    found = to_arrow_schema(spark.createDataFrame([], schema).schema) if schema else []
    return [f.name for f in found], [f.type for f in found]


def encode(docs: DataFrame, path: str | None = None, text: str = "text", id: str = "doc_id", row: Callable | None = None, schema: str = "") -> DataFrame:
    """doc_id and ids of every row of docs, and the columns of schema that row(ids) makes.

    Null and empty texts have no ids; repeated rows each return; an empty table gives no rows; other columns are
    not read, so they may have any names. There are no special tokens: their strings are ordinary text. A chunk's
    documents are put together in one worker, which holds one chunk at a time.
    """
    spark = prepared(docs.sparkSession)
    path = path or public_tokenizers.path(RANKS)
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets, chunks = max(shuffles, -(-size // BUCKET)), max(shuffles, -(-size // (2 * CHUNK)))
    rows = explode(docs, buckets, text, id).repartition(chunks, "chunk")
    words = rows.mapInArrow(_words, "chunk long, bucket int, words binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    coded = encode_words(words, path)
    labels, types = _more(spark, schema)

    def together(coded: pa.Table, rows: pa.Table) -> pa.Table:
        end = rows.filter(rows.column("sizes").is_valid())
        sizes = places.loosened(end.column("sizes")[0].as_py()).astype(np.int64)
        own = [_ids(blob.as_py()) for blob in coded.sort_by("bucket").column("ids")]
        counts = np.concatenate([np.zeros(0, np.int64), *(c for c, _ in own)]).astype(np.int64)
        flat = np.concatenate([np.zeros(0, np.uint32), *(i for _, i in own)])
        place = places.scattered(*places.restored(end.column("places")[0].as_py()), int(sizes.sum()))
        starts = np.concatenate([[0], counts.cumsum()])
        wide = counts[place]
        ends = np.concatenate([[0], wide.cumsum()])
        at = np.repeat(starts[:-1][place] - ends[:-1], wide)
        at += np.arange(ends[-1], dtype=np.uint32)
        ids = flat[at]
        del place, wide, at, own, flat
        bounds = ends[np.concatenate([[0], sizes.cumsum()])]
        made = zip(*(row(ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)), strict=True) if labels else []
        listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32)))
        names = end.column("held").combine_chunks()
        names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
        places.freed()
        return pa.table([names.flatten(), listed, *(pa.array(c, t) for c, t in zip(made, types, strict=True))], names=["doc_id", "ids", *labels])

    kind = rows.schema["held"].dataType.elementType.simpleString()
    return coded.groupBy("chunk").cogroup(rows.groupBy("chunk")).applyInArrow(together, f"doc_id {kind}, ids array<int>" + (", " + schema if schema else ""))


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), row: Callable | None = None, schema: str = "bytes binary") -> DataFrame:
    """The columns keep of every row and, by default, the bytes that its ids stand for; row(bytes) can make the
    columns of schema instead.

    Ids are exploded with their positions, a row for each distinct one of a batch of rows, and joined with the
    token-byte table, which the vocabulary bounds, so nothing is shuffled. Null ids give null bytes, no ids give no
    bytes; ids that the table lacks are an error. Repeated rows each return; an empty table gives no rows; other
    columns are not read.
    """
    spark = prepared(rows.sparkSession)
    path = path or public_tokenizers.path(RANKS)
    chosen = rows.select(F.struct(*keep).alias("held"), F.col(ids).alias("ids"))
    kept = to_arrow_type(chosen.schema["held"].dataType)
    make = row or (lambda b: [b])
    labels, types = _more(spark, schema)
    most = len(token_bytes(path))  # stands for all ids that the table lacks

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), -1)
            part = np.maximum(sizes, 0).cumsum() // IDS
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(sizes)]]).tolist()
            for a, e in zip(cuts[:-1], cuts[1:], strict=True):
                whole = lists.slice(a, e - a).flatten().to_numpy(zero_copy_only=False)
                whole = np.where((0 <= whole) & (whole <= most), whole, most)
                found = np.flatnonzero(np.bincount(whole))
                if len(found):
                    number = np.zeros(most + 1, np.int32)
                    number[found] = np.arange(len(found))
                    codes = number[whole]
                    del whole
                    n = len(found)
                    yield pa.record_batch([pa.array(found, pa.int32()), places.binary(*places.gathered(codes, n)), pa.nulls(n, pa.list_(kept)), pa.nulls(n, pa.binary())], ["token", "places", "held", "sizes"])
                held = pa.ListArray.from_arrays(pa.array([0, e - a], pa.int32()), pa.concat_arrays([b.column(0).slice(a, e - a)]).cast(kept))
                yield pa.record_batch([pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), held, pa.array([sizes[a:e].astype("<i4").tobytes()], pa.binary())], ["token", "places", "held", "sizes"])
            places.freed()

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, end in places.runs(batches, "sizes"):
            sizes = np.frombuffer(end.column("sizes")[0].as_py(), "<i4").astype(np.int64)
            known = tokens.column("bytes").to_pylist()
            if None in known:
                raise ValueError("an id that the token-byte table lacks")
            place = places.scattered(*places.flat(tokens.column("places")), int(np.maximum(sizes, 0).sum()))
            ends = np.concatenate([[0], np.maximum(sizes, 0).cumsum()]).tolist()
            of = known.__getitem__
            made = (make(None if n < 0 else b"".join(map(of, place[a:b].tolist()))) for n, a, b in zip(sizes.tolist(), ends[:-1], ends[1:], strict=True))
            columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)]
            del tokens, known, place, of
            places.freed()
            yield pa.record_batch([*end.column("held").flatten().flatten(), *columns], [*keep, *labels])

    fields = ", ".join(f"`{c}` {chosen.schema['held'].dataType[c].dataType.simpleString()}" for c in keep)
    exploded = chosen.mapInArrow(apart, f"token int, places binary, held array<{chosen.schema['held'].dataType.simpleString()}>, sizes binary")
    return exploded.join(F.broadcast(token_table(spark, path)), "token", "left").select("places", "bytes", "held", "sizes").mapInArrow(together, f"{fields}, {schema}")


@lru_cache(maxsize=2)
def token_names(path: str) -> list[bytes]:
    """The decimal text of each id."""
    return [str(n).encode() for n in range(len(token_bytes(path)))]


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes that they decode to."""
    path = public_tokenizers.path(RANKS)

    def told(ids: np.ndarray) -> tuple:
        return len(ids), hashlib.sha256(b",".join(map(token_names(path).__getitem__, ids.tolist()))).hexdigest()

    coded = encode(documents(spark, sf_dir), path, row=told, schema="n_tokens long, ids_sha256 string")
    return decode(coded, path, keep=("doc_id", "n_tokens", "ids_sha256"), row=lambda b: [hashlib.sha256(b).hexdigest()], schema="decoded_sha256 string")
