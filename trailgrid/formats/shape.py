"""Shapefiles (.shp, .shx, .dbf, .prj) as bytes, by the published description of the format.

Shapes: points (1), lines (3) and polygons (5); parts are lists of (x, y).
Attributes are text, numbers or logical values, names have ten bytes.
"""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Iterator

POINT, LINE, POLYGON = 1, 3, 5
_PRJ = {
    4326: 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]',
}


def projection(srid: int | None) -> str | None:
    """The text of the .prj file: WGS84 degrees or a UTM zone on it."""
    if srid in _PRJ:
        return _PRJ[srid]
    if srid and (32601 <= srid <= 32660 or 32701 <= srid <= 32760):
        zone, south = srid % 100, srid >= 32700
        name = f"WGS_1984_UTM_Zone_{zone}{'S' if south else 'N'}"
        return f'PROJCS["{name}",{_PRJ[4326]},PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",500000.0],PARAMETER["False_Northing",{10000000.0 if south else 0.0}],PARAMETER["Central_Meridian",{zone * 6 - 183}.0],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]]'
    return None


def zone_of(prj: str | None) -> tuple[int, bool] | None:
    """Zone and hemisphere of a UTM projection's text; None for degrees."""
    import re

    hit = re.search(r"UTM[ _]zone[ _](\d+)([NS])", prj or "", re.IGNORECASE)
    return (int(hit[1]), hit[2].upper() == "S") if hit else None


def _box(parts: list[list[tuple[float, float]]]) -> tuple[float, float, float, float]:
    xs, ys = [p[0] for part in parts for p in part], [p[1] for part in parts for p in part]
    return min(xs), min(ys), max(xs), max(ys)


def _header(kind: int, size: int, box: tuple) -> bytes:
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i4d4d", 1000, kind, *box, 0.0, 0.0, 0.0, 0.0)


def write_shapes(kind: int, shapes: list[list[list[tuple[float, float]]]]) -> tuple[bytes, bytes]:
    """The .shp and .shx bytes; a shape without parts is a null shape."""
    records, index, at = [], [], 50
    for n, parts in enumerate(shapes, 1):
        if not parts or not parts[0]:
            body = struct.pack("<i", 0)
        elif kind == POINT:
            body = struct.pack("<i2d", kind, *parts[0][0])
        else:
            starts = [sum(len(p) for p in parts[:k]) for k in range(len(parts))]
            points = [v for part in parts for p in part for v in p]
            body = struct.pack("<i4d2i", kind, *_box(parts), len(parts), len(points) // 2) + struct.pack(f"<{len(starts)}i", *starts) + struct.pack(f"<{len(points)}d", *points)
        records.append(struct.pack(">2i", n, len(body) // 2) + body)
        index.append(struct.pack(">2i", at, len(body) // 2))
        at += len(records[-1]) // 2
    full = [s for s in shapes if s and s[0]]
    box = _box([p for s in full for p in s]) if full else (0.0,) * 4
    return _header(kind, 2 * at, box) + b"".join(records), _header(kind, 100 + 8 * len(index), box) + b"".join(index)


def read_shapes(data: bytes) -> Iterator[tuple[int, list[list[tuple[float, float]]]]]:
    """Kind and parts of every record."""
    at = 100
    while at < len(data):
        size = 2 * struct.unpack_from(">i", data, at + 4)[0]
        kind = struct.unpack_from("<i", data, at + 8)[0]
        base = kind % 10  # heights and measures are left out
        if kind == 0:
            yield 0, []
        elif base == POINT:
            yield base, [[struct.unpack_from("<2d", data, at + 12)]]
        elif base in (LINE, POLYGON):
            parts, points = struct.unpack_from("<2i", data, at + 44)
            starts = [*struct.unpack_from(f"<{parts}i", data, at + 52), points]
            xy = struct.unpack_from(f"<{2 * points}d", data, at + 52 + 4 * parts)
            yield base, [[(xy[2 * i], xy[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]
        else:
            raise ValueError(f"shapes of kind {kind} aren't supported")
        at += 8 + size


def write_table(names: list[str], rows: list[tuple]) -> bytes:
    """The .dbf bytes; columns are logical, whole, real or text by their values."""
    fields, columns = [], []
    for k, name in enumerate(names):
        values = [r[k] for r in rows if r[k] is not None]
        if values and all(isinstance(v, bool) for v in values):
            kind, digits, texts = "L", 0, ["?" if r[k] is None else "T" if r[k] else "F" for r in rows]
        elif values and all(isinstance(v, int) for v in values):
            kind, digits, texts = "N", 0, ["" if r[k] is None else str(r[k]) for r in rows]
        elif values and all(isinstance(v, (int, float)) for v in values):
            kind, digits, texts = "F", 11, ["" if r[k] is None or r[k] != r[k] else f"{r[k]:.11e}" for r in rows]
        else:
            kind, digits, texts = "C", 0, ["" if r[k] is None else str(r[k]) for r in rows]
        cells = [t.encode() if kind != "C" else t.encode()[:254].decode("utf-8", "ignore").encode() for t in texts]
        width = max([1, *map(len, cells)])
        columns.append([c.ljust(width) if kind in "CL" else c.rjust(width) for c in cells])
        fields.append(struct.pack("<11sc4xBB14x", name.encode()[:10], kind.encode(), width, digits))
    today = dt.date.today()
    size = 1 + sum(len(c[0]) if c else 1 for c in columns)
    head = struct.pack("<4BIHH20x", 3, today.year - 1900, today.month, today.day, len(rows), 33 + 32 * len(fields), size)
    return head + b"".join(fields) + b"\r" + b"".join(b" " + b"".join(c[i] for c in columns) for i in range(len(rows))) + b"\x1a"


def read_table(data: bytes) -> tuple[list[str], Iterator[tuple[str | None, ...]]]:
    """Names, and every row as trimmed texts (None if blank); deleted rows are left out."""
    n, head, size = struct.unpack_from("<IHH", data, 4)
    names, widths = [], []
    for at in range(32, head - 1, 32):
        if data[at] == 13:
            break
        names.append(data[at : at + 11].split(b"\0")[0].decode())
        widths.append(data[at + 16])

    def rows() -> Iterator[tuple[str | None, ...]]:
        for k in range(n):
            at = head + k * size
            if data[at : at + 1] == b"*":
                continue
            out, at = [], at + 1
            for w in widths:
                out.append(data[at : at + w].decode("utf-8", "replace").strip() or None)
                at += w
            yield tuple(out)

    return names, rows()
