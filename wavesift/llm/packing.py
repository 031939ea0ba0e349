"""Harmonic packing of token sequences into training sequences of one length."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.llm import bpe
from wavesift.llm.shared import documents, prepared

CAPACITY, END = 2_048, 1
TOKENIZER = "byte_bpe_50k.json"
#: Tokens that a worker gathers before it packs and returns them.
WINDOW = 4_000_000

Piece = tuple[int, int, int, int, int]  # document, start, length, sequence, offset


def harmonic(lengths: list[int], capacity: int = CAPACITY) -> list[Piece]:
    """Pieces that hold each document whole once.

    A document of length n up to the capacity belongs to class k = capacity // n. A sequence takes k documents of
    class k, and what stays free takes a piece of a filler: first the documents longer than a sequence, then the
    shortest ones left. So every sequence is full but the last, whose content is cut into powers of two. Documents
    of no tokens get no piece.
    """
    whole = sorted((i for i, n in enumerate(lengths) if 0 < n <= capacity), key=lambda i: -lengths[i])
    fillers = deque(sorted((i for i, n in enumerate(lengths) if n > capacity), key=lambda i: -lengths[i]))
    rows, done = deque(whole), [0] * len(lengths)
    sequences: list[list[tuple[int, int, int]]] = []
    filler = None
    while rows or fillers or filler is not None:
        own: list[tuple[int, int, int]] = []
        free = capacity
        if rows:
            k = capacity // lengths[rows[0]]
            for _ in range(k):
                if not rows or capacity // lengths[rows[0]] != k:
                    break
                i = rows.popleft()
                own.append((i, 0, lengths[i]))
                free -= lengths[i]
        while free:
            if filler is None:
                if fillers:
                    filler = fillers.popleft()
                elif rows:
                    filler = rows.pop()
                else:
                    break
            n = min(free, lengths[filler] - done[filler])
            own.append((filler, done[filler], n))
            done[filler] += n
            free -= n
            if done[filler] == lengths[filler]:
                filler = None
        sequences.append(own)
    if sequences and (used := sum(n for _, _, n in sequences[-1])) < capacity:
        sequences[-1:] = _powers(sequences[-1], used)
    return [(i, at, n, s, offset) for s, own in enumerate(sequences) for (i, at, n), offset in zip(own, np.cumsum([0] + [n for _, _, n in own]).tolist(), strict=False)]


def _powers(own: list[tuple[int, int, int]], used: int) -> list[list[tuple[int, int, int]]]:
    """One unfilled sequence as sequences whose lengths are powers of two, which need no padding."""
    left, out = deque(own), []
    for bit in reversed(range(used.bit_length())):
        if not used >> bit & 1:
            continue
        free, row = 1 << bit, []
        while free:
            i, at, n = left.popleft()
            took = min(n, free)
            row.append((i, at, took))
            free -= took
            if took < n:
                left.appendleft((i, at + took, n - took))
        out.append(row)
    return out


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str | None = None, text: str = "text", id: str = "doc_id", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row for each piece of each row of docs: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone. Texts of any length are cut as needed; repeated rows are packed each
    for itself; an empty table gives no rows; other columns are not read. Workers pack what they read, so nothing
    is shuffled, and a task that runs again makes the same pieces.
    """
    prepared(docs.sparkSession)
    path = path or public_tokenizers.path(TOKENIZER)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = bpe.encoder(path), np.array([end], "<u4")
        sequence = (TaskContext.get().partitionId()) << 32
        names: list = []
        ids: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            nonlocal sequence
            lengths = list(map(len, ids))
            found = harmonic(lengths, capacity)
            out = pa.record_batch(
                [
                    pa.array([names[i] for i, *_ in found], kind),
                    pa.array([at for _, at, *_ in found], pa.int64()),
                    pa.array([n for _, _, n, *_ in found], pa.int64()),
                    pa.array([zlib.crc32(ids[i][at : at + n].data) for i, at, n, *_ in found], pa.int64()),
                    pa.array([lengths[i] for i, *_ in found], pa.int64()),
                    pa.array([sequence + s for *_, s, _ in found], pa.int64()),
                    pa.array([o for *_, o in found], pa.int64()),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            sequence += found[-1][3] + 1
            names.clear()
            ids.clear()
            return out

        kind, gathered = None, 0
        for b in batches:
            kind = b.schema.field(0).type
            for name, string in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                string = string.as_py()
                names.append(name)
                ids.append(np.concatenate([encode(string), tail]) if string else tail)
                gathered += len(ids[-1])
                if gathered >= WINDOW:
                    yield packed()
                    gathered = 0
        if ids:
            yield packed()

    chosen = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(each, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document, in sequences of 2,048 tokens."""
    return pack(documents(spark, sf_dir))
