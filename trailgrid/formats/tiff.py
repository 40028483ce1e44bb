"""GeoTIFF rasters of one band: baseline TIFF with LZW strips and the GeoTIFF keys of a projected grid.

A raster is written whole; grids of the population level are some thousand
cells a side.  ``read`` takes what ``write`` makes and plain strips without
compression.
"""

from __future__ import annotations

import struct

import numpy as np

# fixed values: tags and key ids of the TIFF 6.0 and GeoTIFF 1.0 specifications
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, SAMPLE_FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
MODEL_TYPE, RASTER_TYPE, GEOGRAPHIC, PROJECTED = 1024, 1025, 2048, 3072
LZW, NONE = 5, 1
_KINDS = {np.dtype("<f4"): 3, np.dtype("u1"): 1, np.dtype("<i4"): 2, np.dtype("<f8"): 3}
_SIZES = {2: "B", 3: "H", 4: "I", 12: "d"}


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first, widths change a code early."""
    out, held, bits = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    width, nxt = 9, 258

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    run = b""
    for k in range(len(data)):
        byte = data[k : k + 1]
        if len(run) == 0 or run + byte in table:
            run += byte
            continue
        put(table[run] if len(run) > 1 else run[0])
        table[run + byte] = nxt
        nxt += 1
        if nxt == 4094:
            put(256)
            table, width, nxt = {}, 9, 258
        elif nxt in (512, 1024, 2048):
            width += 1
        run = byte
    if run:
        put(table[run] if len(run) > 1 else run[0])
        if nxt in (511, 1023, 2047):  # the reader has counted the last run
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    out, at, width = [], 0, 9
    table: list[bytes] = []
    before = b""
    bits = int.from_bytes(data, "big")
    size = 8 * len(data)
    while at + width <= size:
        code = bits >> (size - at - width) & ((1 << width) - 1)
        at += width
        if code == 257:
            break
        if code == 256:
            table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else before + before[:1]
        out.append(entry)
        if before:
            table.append(before + entry[:1])
        before = entry
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return b"".join(out)


def write(values: np.ndarray, minx: float, maxy: float, px_w: float, px_h: float, srid: int | None = None, nodata: float | None = None, strip_rows: int = 32) -> bytes:
    """The bytes of a file; rows run from north to south."""
    values = np.ascontiguousarray(values, values.dtype.newbyteorder("<"))
    strips = [lzw_encode(values[r : r + strip_rows].tobytes()) for r in range(0, max(1, len(values)), strip_rows)]
    tags: dict[int, tuple[int, list | bytes]] = {
        WIDTH: (4, [values.shape[1]]), HEIGHT: (4, [values.shape[0]]), BITS: (3, [8 * values.itemsize]), COMPRESSION: (3, [LZW]), PHOTOMETRIC: (3, [1]), SAMPLES: (3, [1]),
        ROWS_PER_STRIP: (4, [strip_rows]), SAMPLE_FORMAT: (3, [_KINDS[values.dtype]]), PIXEL_SCALE: (12, [px_w, px_h, 0.0]), TIE_POINT: (12, [0.0, 0.0, 0.0, minx, maxy, 0.0]),
        STRIP_BYTES: (4, [len(s) for s in strips]),
    }
    if srid:
        degrees = 4000 <= srid < 5000
        keys = [(MODEL_TYPE, 2 if degrees else 1), (RASTER_TYPE, 1), (GEOGRAPHIC if degrees else PROJECTED, srid)]
        tags[GEO_KEYS] = 3, [1, 1, 0, len(keys), *(v for k, x in keys for v in (k, 0, 1, x))]
    if nodata is not None:
        tags[NODATA] = 2, f"{nodata:g}".encode() + b"\0"
    starts = [8 + sum(len(s) + len(s) % 2 for s in strips[:k]) for k in range(len(strips))]
    tags[STRIP_OFFSETS] = 4, starts
    body = b"".join(s + b"\0" * (len(s) % 2) for s in strips)
    at = 8 + len(body)
    entries, extra, beyond = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag in sorted(tags):
        kind, data = tags[tag]
        packed = data if isinstance(data, bytes) else struct.pack(f"<{len(data)}{_SIZES[kind]}", *data)
        entries += struct.pack("<HHI", tag, kind, len(data))
        if len(packed) <= 4:
            entries += packed.ljust(4, b"\0")
        else:
            entries += struct.pack("<I", beyond + len(extra))
            extra += packed + b"\0" * (len(packed) % 2)
    return struct.pack("<2sHI", b"II", 42, at) + body + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra


def read(data: bytes) -> tuple[np.ndarray, dict]:
    """Values, and ``minx, maxy, px_w, px_h, srid, nodata``."""
    order, magic, at = struct.unpack_from("<2sHI", data)
    if order != b"II" or magic != 42:
        raise ValueError("not a little-endian TIFF")
    tags = {}
    for k in range(struct.unpack_from("<H", data, at)[0]):
        tag, kind, n = struct.unpack_from("<HHI", data, at + 2 + 12 * k)
        size = struct.calcsize(_SIZES[kind]) * n
        place = at + 10 + 12 * k if size <= 4 else struct.unpack_from("<I", data, at + 10 + 12 * k)[0]
        tags[tag] = data[place : place + n] if kind == 2 else struct.unpack_from(f"<{n}{_SIZES[kind]}", data, place)
    kind = {(3, 32): "<f4", (3, 64): "<f8", (1, 8): "u1", (2, 32): "<i4"}[tags.get(SAMPLE_FORMAT, (1,))[0], tags[BITS][0]]
    strips = [data[o : o + n] for o, n in zip(tags[STRIP_OFFSETS], tags[STRIP_BYTES], strict=True)]
    raw = b"".join(lzw_decode(s) if tags[COMPRESSION][0] == LZW else s for s in strips)
    keys = tags.get(GEO_KEYS, ())
    ids = {keys[i]: keys[i + 3] for i in range(4, len(keys), 4)}
    about = {"minx": tags[TIE_POINT][3], "maxy": tags[TIE_POINT][4], "px_w": tags[PIXEL_SCALE][0], "px_h": tags[PIXEL_SCALE][1], "srid": ids.get(PROJECTED, ids.get(GEOGRAPHIC)), "nodata": float(tags[NODATA].rstrip(b"\0")) if NODATA in tags else None}
    return np.frombuffer(raw, kind).reshape(tags[HEIGHT][0], tags[WIDTH][0]), about
