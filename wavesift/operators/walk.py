"""Kernels over whole sequences: one shuffle by sequence, then sorted rows as Arrow batches, walked run by run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that are gathered before they are returned.
ROWS = 20_000

Arrays = dict[str, np.ndarray | None]


def _array(column: pa.ChunkedArray) -> np.ndarray | None:
    """A column as an array; lists of equal length as a matrix, None where a list is missing or of another length."""
    whole = column.combine_chunks()
    if not (pa.types.is_list(whole.type) or pa.types.is_large_list(whole.type)):
        return whole.to_numpy(zero_copy_only=False)
    sizes = whole.value_lengths()
    if whole.null_count or len(sizes.unique()) != 1:
        return None
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)


def each_sequence(rows: DataFrame, columns: list[str], make: Callable[[Arrays], Arrays], schema: str) -> DataFrame:
    """seq_id and the columns of schema that make() gives for each sequence.

    make() takes the sequence's columns and idx, in order of idx, and gives columns of equal length. A worker holds
    one sequence at a time; rows with a null seq_id are one sequence; an empty table gives no rows.
    """
    names = ["seq_id", *dict.fromkeys(["idx", *columns])]
    chosen = rows.select(*names)
    kind = chosen.schema["seq_id"].dataType
    made = to_arrow_schema(rows.sparkSession.createDataFrame([], f"seq_id {kind.simpleString()}, {schema}").schema)

    def one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts)
        found = make({c: _array(whole.column(c)) for c in names[1:]})
        n = len(next(iter(found.values())))
        key = pa.concat_arrays([parts[0].column(0).slice(0, 1)]).take(pa.array(np.zeros(n, np.int64)))
        return pa.record_batch([key.cast(made.field(0).type), *(pa.array(found[f.name]).cast(f.type) for f in list(made)[1:])], schema=made)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        out: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0)
            own = pa.concat_arrays([held[-1].column(0).slice(held[-1].num_rows - 1), keys]) if held else pa.concat_arrays([keys.slice(0, 1), keys])
            code = own.dictionary_encode(null_encoding="encode").indices.to_numpy()
            cuts = [0, *np.flatnonzero(np.diff(code)).tolist(), b.num_rows]
            for a, e in zip(cuts[:-1], cuts[1:], strict=True):
                if a in cuts[1:-1] and held:
                    out.append(one(held))
                    held = []
                if e > a:
                    held.append(b.slice(a, e - a))
            if sum(x.num_rows for x in out) >= ROWS:
                yield from out
                out = []
        if held:
            out.append(one(held))
        yield from out

    return chosen.repartition("seq_id").sortWithinPartitions("seq_id", "idx").mapInArrow(walk, f"seq_id {kind.simpleString()}, {schema}")
