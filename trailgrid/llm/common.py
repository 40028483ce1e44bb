"""Helpers shared by the document operators: shared folders, Arrow mapping, hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import discard, shared_path, stored

#: Bytes of an Arrow batch, about: a Python worker holds a few batches of texts at a time, whatever the texts' lengths.
ARROW_BYTES = 4_000_000
_LIMITS = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxBytesPerOutputBatch")
#: Most classes of a bounded sample.
CLASSES = 1000
_held: list = [None, None]

__all__ = ["arrow_map", "as_bytes", "bounded_sample", "crc_mod", "different", "discard", "fresh", "held", "map_batches", "materialize", "shared_path", "typed"]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write the rows as a Parquet table in the shared folder and read them back."""
    return stored(df, name)


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit of bytes in an Arrow batch to ``ARROW_BYTES``, unless it is lower already."""
    for name in _LIMITS:
        now = str(spark.conf.get(name)).removesuffix("b")
        if not now.isdigit() or int(now) > ARROW_BYTES:  # -1 stands for no limit
            spark.conf.set(name, str(ARROW_BYTES))


def held(key, make: Callable):
    """What ``make()`` gives, kept by this process until another key is asked for or another operator runs."""
    if _held[0] != key:
        _held[:] = [None, None]
        _held[:] = [key, make()]
    return _held[1]


def tidy(keep=None) -> None:
    """Give memory back to the system: what ``held`` keeps under another key, Arrow's pool, the C heap."""
    if _held[0] != keep:
        _held[:] = [None, None]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keep=None) -> DataFrame:
    """mapInArrow over batches of bounded size without the empty ones; workers are reused, so each task leaves only what ``held`` has under ``keep``."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy(keep)
        try:
            yield from fn(b for b in batches if b.num_rows)
        finally:
            tidy(keep)

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str, keep=None) -> DataFrame:
    """``arrow_map`` with a function of one record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return arrow_map(df, run, schema, keep)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them where a column of ``df`` has the name already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def typed(df: DataFrame) -> str:
    """The schema of ``df`` as text, for mapInArrow."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def different(values: np.ndarray) -> np.ndarray:
    """The sorted different values (by sorting, many times faster than hashing)."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def bounded_sample(df: DataFrame, id_col: str, by: str, most: int) -> DataFrame:
    """About ``most`` rows of each value of ``by``, the same ones at every run.

    Keeps the rows whose hashed id falls below the share ``most / count`` of
    its class; a class of no more than ``most`` rows is kept whole.  The
    shares, a row a class, are broadcast: more than ``CLASSES`` classes are an
    error.
    """
    point = (F.xxhash64(F.col(id_col).cast("string"), F.lit(77)) % 1000003 + 1000003) % 1000003 / 1000003.0
    counts = df.groupBy(by).count().limit(CLASSES + 1).collect()
    if len(counts) > CLASSES:
        raise ValueError(f"more than {CLASSES} different values of {by}")
    shares = df.sparkSession.createDataFrame([(r[0], most / r[1]) for r in counts], f"_class {df.schema[by].dataType.simpleString()}, _share double")
    return df.join(F.broadcast(shares), F.col(by).eqNullSafe(F.col("_class"))).where(point < F.col("_share")).select(*df.columns)


def crc_mod(id_col: str, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus
