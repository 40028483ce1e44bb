"""Whole files written by executors: each appears under its name when it is complete."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame


def place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a URI, or of a local path."""
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def put(path: str, data: bytes) -> int:
    fs, target = place(path)
    fs.create_dir(target.rpartition("/")[0], recursive=True)
    temp = f"{target}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temp) as out:
        out.write(data)
    fs.move(temp, target)
    return len(data)


def write_files(files: DataFrame, folder: str) -> int:
    """Write ``name, content`` rows to a folder that all executors share; the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [put(f"{folder.rstrip('/')}/{n}", c) for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["name", "size"])

    return files.select("name", "content").mapInArrow(run, "name string, size long").count()
