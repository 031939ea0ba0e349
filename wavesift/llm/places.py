"""Places of values in a sequence, gathered by value: what stands where, as one row for each distinct value."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

#: Bits that one byte of a gap holds; its eighth bit says that another follows. Gaps have five bytes at most.
BITS, BYTES = 7, 5

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it


def freed() -> None:
    """Give memory that is free in this process back to the system; a worker that waits would keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def gathered(codes: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """The ascending places of each of the values 0 .. kinds - 1, all of which occur, as gaps in bytes, and the byte
    at which each value's begin, with the end of all."""
    place = codes.astype(np.int64)
    place <<= 32
    place |= np.arange(len(codes), dtype=np.uint32)
    place.sort()
    place &= 0xFFFFFFFF
    first = np.concatenate([[0], np.bincount(codes, minlength=kinds).cumsum()])
    gaps = np.diff(place, prepend=0)
    gaps[first[:-1]] = place[first[:-1]]
    del place
    wide = np.ones(len(gaps), np.uint8)
    for n in range(1, BYTES):
        more = gaps >= 1 << BITS * n
        if not more.any():
            break
        wide += more
    ends = np.concatenate([[0], wide.cumsum(dtype=np.int64)])
    out = np.empty(ends[-1], np.uint8)
    for n in range(BYTES):
        own = np.flatnonzero(wide > n) if n else slice(None)
        if n and not len(own):
            break
        low = (gaps[own] >> BITS * n).astype(np.uint8) & 127
        low |= (wide[own] > n + 1).view(np.uint8) << 7
        out[ends[:-1][own] + n] = low
    return out, ends[first]


def scattered(packed: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the number of the value that stands there; ValueError unless each place has one."""
    ends = np.flatnonzero(packed < 128)
    first = np.searchsorted(ends, starts)
    sizes = np.diff(first)
    more = (np.diff(ends, prepend=-1) - 1).astype(np.uint8)
    total = packed[ends].astype(np.int64)
    total <<= BITS * more
    for k in range(BYTES - 1):
        own = np.flatnonzero(more > k)
        if not len(own):
            break
        at = ends[own]
        at += k
        at -= more[own]
        part = (packed[at] & 127).astype(np.int64)
        del at
        part <<= BITS * k
        total[own] |= part
        del own, part
    del ends, more
    if len(total) != n:
        raise ValueError(f"{len(total)} places for {n}")
    before = total[first[:-1][sizes > 0]]  # the first gap of each value is its place
    total.cumsum(out=total)
    if n:
        total -= np.repeat(total[first[:-1][sizes > 0]] - before, sizes[sizes > 0])
    out = np.full(n, -1, np.int32)
    out[total] = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    if n and out.min() < 0:
        raise ValueError("a place without a value")
    return out


def binary(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary array of the pieces of data between starts, without a copy for each."""
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where each value's begin, with the end of all."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], pa.binary())
    if not len(whole):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_binary(whole.type) else np.int32
    _, offsets, data = whole.buffers()
    at = np.frombuffer(offsets, kind, len(whole) + 1, whole.offset * np.dtype(kind).itemsize).astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers below 2 ** 32, compressed byte plane by byte plane."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def loosened(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def packed(values: list[bytes]) -> bytes:
    """Strings of bytes in one, compressed."""
    sizes = np.fromiter(map(len, values), "<u4", len(values)).tobytes()
    return zstandard.compress(len(values).to_bytes(4, "little") + sizes + b"".join(values), 3)


def unpacked(blob: bytes) -> list[bytes]:
    raw = zstandard.decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    ends = (np.frombuffer(raw, "<u4", n, 4).cumsum(dtype=np.int64) + 4 + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends], ends, strict=False)]


def stored(data: np.ndarray, starts: np.ndarray) -> bytes:
    """What gathered() gives, compressed."""
    sizes = squeezed(np.diff(starts))
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.compress(data.tobytes(), 3)


def restored(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    sizes = loosened(blob[4 : 4 + n])
    return np.frombuffer(zstandard.decompress(blob[4 + n :]), np.uint8), np.concatenate([[0], sizes.cumsum(dtype=np.int64)])


def runs(batches: Iterator[pa.RecordBatch], mark: str) -> Iterator[tuple[pa.Table, pa.RecordBatch]]:
    """The rows before each row that has a mark, and that row."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        at = 0
        for end in np.flatnonzero(b.column(mark).is_valid().to_numpy(zero_copy_only=False)).tolist():
            yield pa.Table.from_batches([*held, b.slice(at, end - at)]), b.slice(end, 1)
            held, at = [], end + 1
        held.append(b.slice(at))
    if any(b.num_rows for b in held):
        raise ValueError("rows without the row that ends them")
