"""Numpy functions over sorted groups, many groups an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Columns = dict[str, "np.ndarray | list"]


def map_groups(df: DataFrame, key: str, order: list[str], fn: Callable[[object, dict[str, np.ndarray]], Columns], schema: str) -> DataFrame:
    """Rows of ``schema`` that ``fn(key, columns)`` gives for each key's rows in ``order``; rows without a key are left out.

    The rows are dealt by key and sorted, and a task goes through its batches
    with numpy arrays only, so a group costs no table of its own.  A group's
    arrays are in memory while it is worked on.
    """
    names = df.columns
    at = names.index(key)
    dealt = df.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order)
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def array(values: "np.ndarray | list", kind: pa.DataType) -> pa.Array:
        if pa.types.is_timestamp(kind):  # given as microseconds
            values = np.asarray(values, np.int64).astype("datetime64[us]")
        return pa.array(values, kind, from_pandas=True)

    def finish(parts: list[pa.RecordBatch]) -> Columns:
        table = pa.Table.from_batches(parts)
        return fn(parts[0].column(at)[0].as_py(), {n: table.column(n).to_numpy() for n in names if n != key})

    def batch_of(found: list[Columns]) -> Iterator[pa.RecordBatch]:
        found = [f for f in found if len(f[kinds.names[0]])]
        if found:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([array(f[k.name], k.type) for f in found]) for k in kinds], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, done = batch.column(at), []
            change = np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)) + 1
            for a, b in zip([0, *change], [*change, len(keys)], strict=True):
                if parts and parts[0].column(at)[0] != keys[int(a)]:
                    done.append(finish(parts))
                    parts = []
                parts.append(batch.slice(int(a), int(b - a)))
            yield from batch_of(done)
        if parts:
            yield from batch_of([finish(parts)])

    return dealt.mapInArrow(run, schema)
