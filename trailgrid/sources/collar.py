"""Packed collar files: a zip of JSON metadata and a binary table of fixes.

``fixes.bin`` starts with the magic ``ELK1``, the numbers of collars (u16),
columns (u16) and rows (u32), padded to 32 bytes; then 32-byte index rows (u32
serial, u32 rows, u64 byte offset from the index's end); then rows of
little-endian doubles: epoch seconds, latitude, longitude and further columns.
``population.json`` describes the herd, ``fixes_meta.json`` maps serials to
their ``local_id``.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the format's constants, its columns in order by group, and the usual choice
MAGIC, HEADER, INDEX = b"ELK1", 32, 32
GROUPS = {
    "Position & Time": ["epoch_seconds", "wld_latitude", "wld_longitude", "speed_kmh", "elevation_m", "bearing", "temp_c", "dt_hours"],
    "Movement Kernel": [
        "impedance", "heat_suppression", "effective_speed", "speed_fast", "speed_slow", "density", "heading_consistency", "gate_state", "thermal_load", "target_elevation",
        "displacement_km", "migration_charge", "spring_energy", "migrating", "migration_direction", "mortality_signal", "stationarity", "directedness", "spatial_spread", "artifact",
    ],
    "Environment": ["snow_depth", "snow_density", "evt_code", "canopy_cover", "canopy_height", "bps_code", "aspect_range", "habitat_quality"],
}
COLUMNS = [c for g in GROUPS.values() for c in g]
DEFAULTS = ["elevation_m", "temp_c", "snow_depth", "snow_density", "evt_code", "canopy_cover", "canopy_height", "bps_code", "aspect_range", "habitat_quality"]


def column_catalog(spark: SparkSession) -> DataFrame:
    """``name, group, position, selected`` of every column of the format."""
    return spark.createDataFrame([(c, g, COLUMNS.index(c), c in DEFAULTS) for g, cs in GROUPS.items() for c in cs], "name string, `group` string, position int, selected boolean")


def read_header(data: bytes) -> tuple[int, int, int]:
    """Collars, columns, rows."""
    if data[:4] != MAGIC:
        raise ValueError("not a packed fix table")
    return struct.unpack_from("<HHI", data, 4)


def _json(z: zipfile.ZipFile, name: str) -> dict:
    return json.loads(z.read(name)) if name in z.namelist() else {}


def metadata(content: bytes) -> dict:
    """What one file says of itself, without its rows: herd, counts, index and local ids."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        herd, meta = _json(z, "population.json"), _json(z, "fixes_meta.json")
        with z.open("fixes.bin") as file:
            collars, columns, rows = read_header(file.read(HEADER))
            index = file.read(INDEX * collars)
    return {
        "population": str(herd.get("population", "Unknown")), "species": str(herd.get("species", "")), "date_range": [str(d) for d in herd.get("date_range", [])],
        "collars": collars, "columns": columns, "rows": rows, "index": [struct.unpack_from("<IIQ", index, INDEX * i) for i in range(collars)], "local_ids": {k: str(v.get("local_id", "")) for k, v in meta.items()},
    }


def decode(content: bytes, wanted: list[str]) -> pd.DataFrame:
    """Rows of one file: serial, local id, time (UTC), position and the wanted columns; each collar from its own offset."""
    info = metadata(content)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        data = z.read("fixes.bin")
    width, first, out = info["columns"], HEADER + INDEX * info["collars"], []
    for serial, n, offset in info["index"]:
        table = np.frombuffer(data, "<f8", n * width, first + offset).reshape(n, width)
        time = pd.to_datetime(np.round(table[:, 0] * 1e6).astype("int64"), unit="us", utc=True)
        cols = {"wld_serial": str(serial), "wld_local_id": info["local_ids"].get(str(serial), ""), "wld_timestamp": time, "wld_lat": table[:, 1], "wld_lon": table[:, 2]}
        at = {c: COLUMNS.index(c) for c in wanted}
        out.append(pd.DataFrame(cols | {c: table[:, i] if i < width else np.full(n, np.nan) for c, i in at.items()}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["wld_serial", "wld_local_id", "wld_timestamp", "wld_lat", "wld_lon", *wanted])


def encode(collars: dict[int, np.ndarray], local_ids: dict[int, str] | None = None, population: str = "") -> bytes:
    """The bytes of a file with these rows, for tests and exchange."""
    index, body = b"", b""
    for serial, table in collars.items():
        index += struct.pack("<IIQ", serial, len(table), len(body)).ljust(INDEX, b"\0")
        body += np.ascontiguousarray(table, "<f8").tobytes()
    width = max((t.shape[1] for t in collars.values()), default=3)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("fixes.bin", (MAGIC + struct.pack("<HHI", len(collars), width, sum(map(len, collars.values())))).ljust(HEADER, b"\0") + index + body)
        z.writestr("fixes_meta.json", json.dumps({str(s): {"local_id": (local_ids or {}).get(s, "")} for s in collars}))
        z.writestr("population.json", json.dumps({"population": population}))
    return out.getvalue()


def read_collars(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All rows of the files at ``path``; a file is read by one task."""
    wanted = columns if columns is not None else DEFAULTS
    unknown = set(wanted) - set(COLUMNS)
    if unknown:
        raise ValueError(f"unknown columns {sorted(unknown)}")
    schema = "wld_serial string, wld_local_id string, wld_timestamp timestamp, wld_lat double, wld_lon double" + "".join(f", `{c}` double" for c in wanted)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                yield decode(content, wanted)

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInPandas(run, schema)
    return rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("wld_lat", "wld_lon", *wanted)})


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``path, population, species, collars, columns, rows`` of each file."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            infos = [metadata(c) for c in frame["content"]]
            yield pd.DataFrame({"path": frame["path"]} | {k: [i[k] for i in infos] for k in ("population", "species", "collars", "columns", "rows")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, population string, species string, collars int, columns int, rows long")
