"""Token ids in compressed binary blocks: adaptive context mixing drives a range coder.

A block is independent of all others. Its ids lie in lanes, which the coder takes in lockstep: at each step every
lane codes one id with the statistics that all lanes have gathered so far. Predictions of three orders are mixed:

- order 2, what followed the last two ids: one id for each context, weighted by how often such a prediction was right
  at its present confidence, and used where it is confident;
- order 1, what followed the last id: all ids that did, by their counts, weighted by how often an id was among them in
  contexts of their kind. The counts are taken anew from all ids so far whenever these have doubled;
- order 0: adaptive frequencies of the ids that the others did not foresee.

An id that order 2 gave in vain is taken out of order 1's ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavesift.llm import bpe
from wavesift.llm.shared import documents, prepared, settle

TOKENIZER, END = "byte_bpe_50k.json", 0
MAGIC, VERSION = b"CMRC", 3
#: Ids after which a block ends with its document, if half as many more are there; lanes of a full block, and ids that a
#: lane has at least.
BLOCK_IDS, LANES, LANE_IDS = 1 << 21, 8_192, 256
#: Bits of the order-2 table, of a probability of order 2, of order 1 and of order 0; steps between the renewals of the
#: latter's frequencies.
TABLE_BITS, UNIT_BITS, NEXT_BITS, TOTAL_BITS, RENEW = 18, 16, 20, 24, 8
#: Rows of one id that may lie in one range of ids.
ALIKE = 1_000
#: Levels of confidence in an order-2 prediction, and the level from which it is used.
CONFIDENCE, SURE = 8, 2
#: Kinds of order-1 contexts, by how many ids follow them anew; one step in so many is watched for the weights of kinds.
KINDS, WATCHED = 12, 8

_u = np.uint64
_NEXT, _BELOW = _u(1 << NEXT_BITS), _u((1 << NEXT_BITS) - 1)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The last place of each wanted value among sorted keys that is not beyond it. They are looked up in order, which
    keeps to the cache; of keys and wanted values the fewer are looked up."""
    bits = max(1, len(wanted).bit_length())
    order = np.sort(wanted << bits | np.arange(len(wanted)))
    found = np.empty(len(wanted), np.int64)
    if len(keys) < len(wanted):
        ends = np.concatenate([[0], np.searchsorted(order, keys << bits), [len(wanted)]])
        places = np.repeat(np.arange(-1, len(keys)), np.diff(ends))
    else:
        places = np.searchsorted(keys, order >> bits, "right") - 1
    found[order & ((1 << bits) - 1)] = places
    return found


def _packed(id: np.ndarray | int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (id << NEXT_BITS + 1 | size) << NEXT_BITS | start


def _span(outcome: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size, which may be 2 ** NEXT_BITS, of packed outcomes."""
    return outcome & ((1 << NEXT_BITS) - 1), (outcome >> NEXT_BITS) & ((1 << NEXT_BITS + 1) - 1)


class Model:
    """What encoder and decoder know alike before each step.

    An order-2 context's cell holds the id it predicts, above three bits that count how sure it is.
    """

    def __init__(self, ids: int, lanes: int):
        self.ids = ids
        self.second = np.zeros(1 << TABLE_BITS, np.int32)
        self.right = np.stack([np.arange(1.0, CONFIDENCE + 1), np.full(CONFIDENCE, CONFIDENCE + 1.0)])
        self.seen = np.zeros(ids, np.int64)
        self.c1 = np.zeros(lanes, np.int64)
        self.near, self.far = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)  # c1, and the id before it
        self.steps, self.counted = 0, 0
        self.fresh = np.stack([0.5 ** np.arange(KINDS), np.ones(KINDS)])  # ids that followed anew, and all, by kind
        self.keys, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.renew()

    def renew(self) -> None:
        """Order-0 frequencies, at least 1 each, that sum to at most 2 ** TOTAL_BITS."""
        free = (1 << TOTAL_BITS) - self.ids
        total = int(self.seen.sum())
        freq = self.seen * free
        freq //= max(total, 1)
        freq += 1
        self.cum = np.zeros(self.ids + 1, np.int64)
        freq.cumsum(out=self.cum[1:])
        self.low, self.freq = self.cum.view(_u), freq.view(_u)

    def count(self, grid: np.ndarray) -> None:
        """Order-1 spans from the ids so far (a row for each step): for each pair of ids its start and size within
        2 ** NEXT_BITS, and for each id where the spans of what follows it end. Pairs since the last count are added
        to those it had."""
        narrow = self.ids <= 1 << 16
        pairs = grid[self.counted :].astype(np.uint32 if narrow else np.int64)
        pairs[1 if not self.counted else 0 :] |= grid[max(0, self.counted - 1) : -1].astype(pairs.dtype) << pairs.dtype.type(16 if narrow else NEXT_BITS)
        pairs = pairs.ravel()
        pairs.sort()
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        keys, n = pairs[first].astype(np.int64), np.diff(np.concatenate([first, [len(pairs)]]))
        if narrow:
            keys = keys >> 16 << NEXT_BITS | keys & 0xFFFF
        keys, n = np.concatenate([self.keys, keys]), np.concatenate([self.times, n])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.counts(keys[first], np.add.reduceat(n, first))

    def counts(self, keys: np.ndarray, times: np.ndarray) -> None:
        """Spans from the pairs so far, in order, and how often each was there."""
        self.keys, self.times = keys, times
        n = self.times
        head = self.keys >> NEXT_BITS
        at = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
        kinds = np.diff(np.concatenate([at, [len(head)]]))
        total = np.add.reduceat(n, at)
        kind = np.minimum(np.searchsorted(2 ** np.arange(KINDS), total // kinds, "right") - 1, KINDS - 1)
        fresh = (self.fresh[0] / self.fresh[1])[kind]
        room = ((1 << NEXT_BITS) - 1 - kinds) * (1 - fresh)
        size = 1 + (np.repeat(room / total, kinds) * n).astype(np.int64)
        ends = size.cumsum()
        start = ends - size - np.repeat((ends - size)[at], kinds)
        self.both = (start << NEXT_BITS | size).astype(_u)  # the size is below 2 ** NEXT_BITS
        self.known, self.kind = np.zeros(self.ids, _u), np.full(self.ids, -1)
        self.known[head[at]] = np.add.reduceat(size, at)
        self.kind[head[at]] = kind
        # outcomes: an id's spans in order, then what they leave, which gives no id
        self.follow = np.zeros(self.ids, np.int64)
        self.follow[head[at]] = kinds
        self.rest = self.follow.cumsum() + np.arange(self.ids)
        self.outcome = np.empty(len(head) + self.ids, np.int64)
        self.outcome[np.arange(len(head)) + head] = _packed(self.keys & ((1 << NEXT_BITS) - 1), start, size)
        known = self.known.view(np.int64)
        self.outcome[self.rest] = _packed(-1, known, (1 << NEXT_BITS) - known)
        self.counted = self.steps

    def guide(self) -> None:
        """What place() needs. Each id's 2 ** NEXT_BITS are cut into equal cells, as many as it has outcomes or up to twice
        that; a cell holds the outcome that its first value lies in."""
        which = np.repeat(np.arange(self.ids), self.follow + 1)
        bits = np.searchsorted(1 << np.arange(NEXT_BITS), self.follow + 1)
        cells = (1 << bits).cumsum()
        first = self.outcome & ((1 << NEXT_BITS) - 1)
        self.begin = which << NEXT_BITS | first
        shift, ahead = NEXT_BITS - bits, cells - (1 << bits)
        self.cells = ahead << 5 | shift
        shift = shift[which]
        begins = ahead[which] + (first + (1 << shift) - 1 >> shift)
        self.held = np.repeat(np.arange(len(which), dtype=np.int32), np.diff(begins, append=cells[-1]))

    def place(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The packed outcome that each lane's value lies in, few places on from its cell's, or looked up; its start and size."""
        cell = self.cells[self.c1]
        k = self.held[(cell >> 5) + (v >> (cell & 31))]
        found = self.outcome[k]
        start, size = _span(found)
        beyond = np.flatnonzero(start + size <= v)
        if len(beyond):
            at, k, low = beyond, k[beyond], v[beyond]
            for _ in range(4):
                k += 1
                own = self.outcome[k]
                found[at] = own
                first, n = _span(own)
                more = np.flatnonzero(first + n <= low)
                at, k, low = at[more], k[more], low[more]
            found[at] = self.outcome[np.searchsorted(self.begin, self.c1[at] << NEXT_BITS | low, "right") - 1]
            start[beyond], size[beyond] = _span(found[beyond])
        return found, start, size

    def predict(self) -> None:
        """The order-2 cells, which lanes are sure of them, and the bounds of such a prediction by confidence."""
        mixed = (self.far * np.uint32(50_287) + self.near) * np.uint32(2_654_435_761)
        self.slot, self.far = (mixed >> np.uint32(32 - TABLE_BITS)).astype(np.intp), self.near
        self.cell = self.second[self.slot]
        self.guess, self.level = self.cell >> 3, self.cell & (CONFIDENCE - 1)
        self.sure = np.flatnonzero(self.level >= SURE)
        unit = 1 << UNIT_BITS
        self.bound = np.minimum(np.maximum((self.right[0] / self.right[1] * unit).astype(np.int64), 1), unit - 1)

    def flags(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size, out of 2 ** UNIT_BITS, of what the sure lanes' predictions turn out to be."""
        bound = self.bound[self.level[self.sure]]
        return np.where(hit, 0, bound), np.where(hit, bound, (1 << UNIT_BITS) - bound)

    def without(self, vain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the order-1 spans of predictions that were in vain, which are taken out; a prediction
        without one has none."""
        wanted = self.c1[vain] << NEXT_BITS | self.guess[vain]
        k = _find(self.keys, wanted)
        there = self.keys[k] == wanted
        both = np.where(there, self.both[k], _NEXT << _u(NEXT_BITS))
        return both >> _u(NEXT_BITS), both & _BELOW

    def next_spans(self, start: np.ndarray, size: np.ndarray, hit: np.ndarray, vain: np.ndarray, gone: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of each lane's order-1 outcome, in place; all for lanes that order 2 foresaw."""
        start, size = start.view(_u), size.view(_u)
        start[hit], size[hit] = 0, _NEXT
        start[vain] -= width * (start[vain] > gone)
        return start, size

    def update(self, s: np.ndarray, hit: np.ndarray, missed: np.ndarray) -> None:
        """s: the ids; hit: of the sure lanes; missed: lanes whose ids neither order 2 nor order 1 foresaw."""
        level = self.level[self.sure]
        self.right[0] += np.bincount(level[hit], minlength=CONFIDENCE)
        self.right[1] += np.bincount(level, minlength=CONFIDENCE)
        own = s.astype(np.int32)
        lower = np.where(self.level > 0, self.cell - ((self.level + 1) >> 1), own << 3)
        self.second[self.slot] = np.where(own == self.guess, np.minimum(self.cell + 1, self.cell | CONFIDENCE - 1), lower)
        if self.counted and self.steps % WATCHED == 0:
            self.fresh[0] += np.bincount(self.kind[self.c1[missed]] + 1, minlength=KINDS + 1)[1:]
            self.fresh[1] += np.bincount(self.kind[self.c1] + 1, minlength=KINDS + 1)[1:] - np.bincount(self.kind[self.c1[self.sure[hit]]] + 1, minlength=KINDS + 1)[1:]
        np.add.at(self.seen, s[missed], 1)
        self.c1, self.near = s, own.view(np.uint32)
        self.steps += 1
        if self.steps % RENEW == 0:
            self.renew()

    def due(self) -> bool:
        """Whether order 1 is to be counted anew: after 8, 16, 32 steps and so on."""
        return self.steps >= 8 and self.steps & self.steps - 1 == 0

    def ids_at(self, v: np.ndarray) -> np.ndarray:
        """The ids whose order-0 spans hold the values v."""
        return np.minimum(_find(self.cum, v), self.ids - 1)


class Writer:
    """Carryless range coders, one for each lane, with 64-bit state and 16-bit words."""

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, _u), np.full(lanes, 0xFFFFFFFFFFFFFFFF, _u)
        self.lane: list[np.ndarray] = []
        self.word: list[np.ndarray] = []

    def spans(self, bits: int, vain: np.ndarray, width: np.ndarray) -> np.ndarray:
        """What one part of a lane's total is: of 2 ** bits, less a width for some lanes."""
        span = self.range >> _u(bits)
        span[vain] = self.range[vain] // (_u(1 << bits) - width)
        return span

    def put(self, at: np.ndarray | slice, start: np.ndarray, size: np.ndarray, span: np.ndarray | int) -> None:
        """Outcomes by their start and size, in parts that span gives or, as a whole number, of 2 ** span."""
        span = self.range[at] >> _u(span) if isinstance(span, int) else span
        low = self.low[at] + span * start.astype(_u, copy=False)
        span = span * size.astype(_u, copy=False)
        open_ = np.flatnonzero(span <= _LEAST)
        while len(open_):
            own, width = _settled(low[open_], span[open_])
            self.lane.append((open_ if isinstance(at, slice) else at[open_]).astype(np.uint16))
            self.word.append((own >> _u(48)).astype("<u2"))
            width <<= _u(16)
            low[open_], span[open_] = own << _u(16), width
            open_ = open_[width <= _LEAST]
        if isinstance(at, slice):
            self.low, self.range = low, span
        else:
            self.low[at], self.range[at] = low, span

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of words of each lane, and the words lane by lane."""
        lanes = np.arange(len(self.low))
        for n in range(4):
            self.lane.append(lanes.astype(np.uint16))
            self.word.append((self.low >> _u(48 - 16 * n)).astype("<u2"))
        lane, word = np.concatenate(self.lane), np.concatenate(self.word)
        return np.bincount(lane, minlength=len(lanes)), word[np.argsort(lane, kind="stable")]


_TOP, _LEAST = _u(1 << 48), _u((1 << 32) - 1)


def _settled(low: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """low and span, the latter cut where the upper word could still change, so that the word can go out."""
    open_ = (low ^ (low + span)) >= _TOP
    return low, np.where(open_, (_u(0) - low) & _LEAST, span) if open_.any() else span


class Reader:
    def __init__(self, counts: np.ndarray, words: np.ndarray):
        self.words = np.concatenate([words, np.zeros(4, "<u2")])
        self.at = np.concatenate([[0], counts.cumsum()[:-1]])
        self.low, self.range = np.zeros(len(counts), _u), np.full(len(counts), 0xFFFFFFFFFFFFFFFF, _u)
        self.code = np.zeros(len(counts), _u)
        for n in range(4):
            self.code = (self.code << _u(16)) | self.words[self.at + n].astype(_u)
        self.at += 4

    spans = Writer.spans

    def look(self, at: np.ndarray | slice, span: np.ndarray | int, most: int) -> np.ndarray:
        """The value, at most so great, that lies next in each lane, in parts as for put()."""
        self.span = self.range[at] >> _u(span) if isinstance(span, int) else span
        return np.minimum((self.code[at] - self.low[at]) // self.span, _u(most))

    def take(self, at: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        low = self.low[at] + self.span * start.astype(_u, copy=False)
        span, code, place = self.span * size.astype(_u, copy=False), self.code[at], self.at[at]
        open_ = np.flatnonzero(span <= _LEAST)
        while len(open_):
            own, width = _settled(low[open_], span[open_])
            own_place = place[open_]
            code[open_] = (code[open_] << _u(16)) | self.words.take(own_place, mode="clip").astype(_u)
            place[open_] = own_place + 1
            width <<= _u(16)
            low[open_], span[open_] = own << _u(16), width
            open_ = open_[width <= _LEAST]
        if isinstance(at, slice):
            self.low, self.range = low, span  # code and place are views
        else:
            self.low[at], self.range[at], self.code[at], self.at[at] = low, span, code, place


def _lanes(n: int) -> int:
    return max(1, min(LANES, n // LANE_IDS))


class Pairs:
    """All pairs of an id and the next in a block that is known whole, found by one sort."""

    def __init__(self, grid: np.ndarray):
        steps, lanes = grid.shape
        bits = grid.size.bit_length()
        order = np.zeros(grid.shape, np.int64)
        order[1:] = grid[:-1]
        order <<= NEXT_BITS
        order |= grid
        order <<= bits
        order += np.arange(lanes)
        order += np.arange(0, grid.size, lanes)[:, None]
        order = order.ravel()
        order.sort()
        first = np.flatnonzero(order[1:] ^ order[:-1] >= 1 << bits) + 1
        first = np.concatenate([[0], first])
        self.keys = order[first] >> bits
        order &= (1 << bits) - 1
        self.which = np.empty(len(order), np.int32)  # of each place
        self.which[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(first, append=len(order)))
        self.which = self.which.reshape(steps, lanes)
        self.times, self.counted = np.zeros(len(self.keys), np.int64), 0

    def count(self, model: Model, step: int) -> None:
        """The model's spans anew, from the steps before this one; then outcome has what each pair is among them."""
        self.times += np.bincount(self.which[self.counted : step].ravel(), minlength=len(self.keys))
        self.counted = step
        there = np.flatnonzero(self.times)
        model.counts(self.keys[there], self.times[there])
        head = self.keys >> NEXT_BITS
        k = model.rest[head]
        k[there] = np.arange(len(there)) + head[there]
        self.outcome = model.outcome[k]


def compress(ids: np.ndarray, vocabulary: int) -> bytes:
    """ids as a checksummed block body that decompress() turns back."""
    n, lanes = len(ids), _lanes(len(ids))
    if not n:
        return b""
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, "<u4")
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)  # a row for each step
    model, out, every, pairs = Model(vocabulary, lanes), Writer(lanes), slice(None), Pairs(grid)
    for step, s in enumerate(grid):
        s = s.astype(np.int64)
        if model.due():
            pairs.count(model, step)
        model.predict()
        sure = model.sure
        hit = s[sure] == model.guess[sure]
        out.put(sure, *model.flags(hit), UNIT_BITS)
        got, vain = sure[hit], sure[~hit]
        if model.counted:
            if step % 8 == 0:
                some = pairs.outcome[pairs.which[step : step + 8]]  # of eight steps, while the table is in the cache
            outcome = some[step % 8]
            there = outcome >= 0
            gone, width = model.without(vain)
            out.put(every, *model.next_spans(*_span(outcome), got, vain, gone, width), out.spans(NEXT_BITS, vain, width))
            there[got] = True
        else:
            there = np.zeros(lanes, bool)
            there[got] = True
        missed = np.flatnonzero(~there)
        own = s[missed]
        out.put(missed, model.low[own], model.freq[own], TOTAL_BITS)
        model.update(s, hit, missed)
    counts, words = out.finish()
    return counts.astype("<u4").tobytes() + words.tobytes()


def decompress(body: bytes, n: int, vocabulary: int) -> np.ndarray:
    lanes = _lanes(n)
    if not n:
        return np.zeros(0, "<u4")
    counts = np.frombuffer(body, "<u4", lanes).astype(np.int64)
    steps = -(-n // lanes)
    model, read = Model(vocabulary, lanes), Reader(counts, np.frombuffer(body, "<u2", -1, 4 * lanes))
    grid, every = np.empty((steps, lanes + 16), "<u4")[:, :lanes], slice(None)  # rows apart in the cache
    for step in range(steps):
        if model.due():
            model.count(grid[:step])
            model.guide()
        model.predict()
        sure = model.sure
        hit = read.look(sure, UNIT_BITS, (1 << UNIT_BITS) - 1).view(np.int64) < model.bound[model.level[sure]]
        read.take(sure, *model.flags(hit))
        got, vain = sure[hit], sure[~hit]
        if model.counted:
            gone, width = model.without(vain)
            v = read.look(every, read.spans(NEXT_BITS, vain, width), (1 << NEXT_BITS) - 1)
            v[vain] = np.minimum(v[vain], _NEXT - _u(1) - width)
            v[vain] += width * (v[vain] >= gone)
            outcome, start, size = model.place(v.view(np.int64))
            read.take(every, *model.next_spans(start, size, got, vain, gone, width))
            s = outcome >> 2 * NEXT_BITS + 1
            there = s >= 0
            there[got] = True
        else:
            s, there = np.zeros(lanes, np.int64), np.zeros(lanes, bool)
            there[got] = True
        s[got] = model.guess[got]
        missed = np.flatnonzero(~there)
        own = model.ids_at(read.look(missed, TOTAL_BITS, (1 << TOTAL_BITS) - 1).view(np.int64))
        read.take(missed, model.low[own], model.freq[own])
        s[missed] = own
        grid[step] = s
        model.update(s, hit, missed)
    return np.ascontiguousarray(grid.T).reshape(-1)[:n]


def write_block(lengths: np.ndarray, ids: np.ndarray, vocabulary: int) -> bytes:
    """Magic, version, vocabulary, documents, ids, checksum of the ids and of the rest; lengths; body."""
    held = lengths.astype("<u4").tobytes() + compress(ids, vocabulary)
    head = np.array([VERSION, vocabulary, len(lengths), len(ids), zlib.crc32(ids.astype("<u4", copy=False).data), zlib.crc32(held)], "<u4")
    return MAGIC + head.tobytes() + held


def read_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and ids of a block; ValueError if its format or a checksum is wrong."""
    if block[:4] != MAGIC:
        raise ValueError("no block of token ids")
    version, vocabulary, rows, n, crc, outer = np.frombuffer(block, "<u4", 6, 4).tolist()
    held = block[28:]
    if version != VERSION or zlib.crc32(held) != outer:
        raise ValueError("a block of another version, or damaged")
    ids = decompress(held[4 * rows :], n, vocabulary)
    if zlib.crc32(ids.data) != crc:
        raise ValueError("a block's ids differ from those written")
    return np.frombuffer(held, "<u4", rows).astype(np.int64), ids


def write_ids(docs: DataFrame, path: str | None = None, text: str = "text", id: str = "doc_id", end: int = END, folder: str | None = None) -> DataFrame:
    """Blocks of the ids of all rows in ascending order of id (null first; ties by text or its hash), written to the folder (which
    must not exist) or, without one, to the shared folder, and read again.

    Columns: shard and block (their order is the order of the file), doc_ids, n_ids, payload. A shard is a range of
    ids; Spark's writer commits each shard's file whole or not at all. A null text counts as empty and is its end
    id alone; repeated rows are written each; an empty table makes no blocks; other columns are not read, so they
    may have any names. A document is never parted, so a very long one makes a long block.
    """
    prepared(docs.sparkSession)
    path = path or public_tokenizers.path(TOKENIZER)
    chosen = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = bpe.encoder(path), np.array([end], "<u4")
        vocabulary = encode.bpe.n_vocab
        shard, number, names, ids, gathered = TaskContext.get().partitionId(), 0, [], [], 0

        def block(n: int | None = None) -> pa.RecordBatch:
            lengths = np.fromiter(map(len, ids[:n]), np.int64)
            whole = np.concatenate(ids[:n])
            own = pa.array([names[:n]], pa.list_(type_))
            return pa.record_batch([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), own, pa.array([len(whole)], pa.int64()), pa.array([write_block(lengths, whole, vocabulary)], pa.binary())], ["shard", "block", "doc_ids", "n_ids", "payload"])

        type_ = None
        for b in batches:
            type_ = b.schema.field(0).type
            for name, string, run in zip(b.column(0).to_pylist(), b.column(1), bpe.runs(b.column(1)), strict=True):
                string = string.as_py()
                names.append(name)
                ids.append(np.concatenate([encode(string, run), tail]) if string else tail)
                gathered += len(ids[-1])
                if 2 * gathered >= 3 * BLOCK_IDS:  # so that no small block is left at the end, as each block learns anew
                    n = 1 + int(np.searchsorted(np.fromiter(map(len, ids), np.int64).cumsum(), BLOCK_IDS))
                    yield block(n)
                    number, names, ids = number + 1, names[n:], ids[n:]
                    gathered = sum(map(len, ids))
        if ids:
            yield block()

    # ranges come from a pass over their keys: texts are only read for it where an id alone would be too much for a range
    most = chosen.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    keys = [F.col("doc_id").asc()] + [F.xxhash64("text").asc()] * (most > ALIKE)
    ordered = chosen.repartitionByRange(*keys).sortWithinPartitions(*keys, "text")
    return settle(ordered.mapInArrow(each, f"shard int, block int, doc_ids array<{kind}>, n_ids long, payload binary"), "token-blocks", folder)


def read_ids(blocks: DataFrame, row=None, schema: str = "ids array<long>") -> DataFrame:
    """doc_id, start, n_tokens and, by default, ids of every document in the blocks, which write_ids() gave or Spark
    read from its folder; row(ids) can make other columns. start is the number of ids before the document in the
    whole file. No blocks give no rows, and each written row returns once, repeated ones too; blocks of another
    version, and damaged ones, are an error."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = prepared(blocks.sparkSession)
    make = row or (lambda ids: [ids.tolist()])
    fields = spark.createDataFrame([], schema).schema.fields
    labels, types = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                lengths, ids = read_block(b.column(3)[n].as_py())
                ends = lengths.cumsum()
                columns = zip(*(make(ids[a:e]) for a, e in zip((ends - lengths).tolist(), ends.tolist(), strict=True)), strict=True)
                rows = len(lengths)
                fixed = [b.column(0).slice(n, 1).take(pa.array([0] * rows)), b.column(1).slice(n, 1).take(pa.array([0] * rows)), b.column(2).slice(n, 1).flatten(), pa.array(ends - lengths), pa.array(lengths)]
                yield pa.record_batch([*fixed, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["shard", "block", "doc_id", "within", "n_tokens", *labels])

    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    found = blocks.select("shard", "block", "doc_ids", "payload").mapInArrow(each, f"shard int, block int, doc_id {kind}, within long, n_tokens long, {schema}")
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row for each shard: few
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("shard", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("earlier")).join(shards, "shard").select("shard", "block", (F.col("ahead") + F.col("earlier")).alias("ahead"))
    return found.join(starts, ["shard", "block"]).select("doc_id", (F.col("ahead") + F.col("within")).alias("start"), "n_tokens", *labels)


def op6_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place, length and checksum, from the blocks written and read back."""
    blocks = write_ids(documents(spark, sf_dir))
    return read_ids(blocks, lambda ids: [zlib.crc32(ids.data)], "ids_crc32 long")
