"""SimHash near-duplicates: majority-bit fingerprints, linked by tiled exact comparison.

Fingerprints within a Hamming radius r agree on two of r + 2 blocks of bits at
least, so the fingerprints are dealt by every pair of blocks.  Inside such a
group tiles are compared exactly with numpy exclusive-or and bit counts; a
tile pair whose population counts differ beyond the radius is skipped.  A
group of more than ``TILE_ROWS`` different fingerprints is cut into tiles that
are spread over tasks (see ``tiles``).  Only a spanning forest of what is
compared is emitted, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes, map_batches, materialize
from .components import connected_components
from .tiles import forest, link_large

TILE_ROWS = 4096
BLOCK = 1024


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``width`` words, repeats included; of the whole sequence if it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        runs = [b" ".join(words)]
    else:
        runs = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, 42) for x in runs), np.uint64, max(1, len(words) - width + 1))


def majority(hashes: np.ndarray) -> int:
    """The 64-bit value with each bit set that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8", copy=False)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The fingerprint of one text; 0 for a null text or one without words."""
    return majority(shingle_hashes((text or b"").lower().split(), width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id, fp`` (signed 64-bit) of every row; other columns are ignored."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known: dict[bytes | None, int] = {}
        fps = [known[t] if t in known else known.setdefault(t, fingerprint(t, width)) for t in as_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, fp long")


def _hook(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of every pair (a, b) in place; a class bears its smallest index."""
    while True:
        low = np.minimum(labels[a], labels[b])
        old = labels.copy()
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up
        if (old == labels).all():
            return


def near_classes(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the number of one that chains of differences within the radius join it to, the same for all of them."""
    weight = np.bitwise_count(fps).astype(np.int16)
    order = np.argsort(weight, kind="stable")
    fps, weight = fps[order], weight[order]
    labels = np.arange(len(fps))
    for i in range(0, len(fps), BLOCK):
        left = fps[i : i + BLOCK]
        most = weight[min(i + BLOCK, len(fps)) - 1] + radius
        for j in range(i, len(fps), BLOCK):
            if weight[j] > most:
                break
            a, b = np.nonzero(np.bitwise_count(left[:, None] ^ fps[None, j : j + BLOCK]) <= radius)
            a, b = a + i, b + j
            if len(keep := np.flatnonzero(labels[a] != labels[b])):
                _hook(labels, a[keep], b[keep])
    out = np.empty(len(fps), np.int64)
    out[order] = order[labels]
    return out


def tile_forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (signed) of a spanning forest of the fingerprints within the radius of one another."""
    if len(fps) == 2:
        near = int(fps[0] ^ fps[1]).bit_count() <= radius
        return forest(fps.view(np.int64), np.zeros(2, int) if near else np.arange(2))
    return forest(fps.view(np.int64), near_classes(fps, radius))


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (k, fp) sorted by the first: the forest of every run of equal k."""
    held: tuple[np.ndarray, np.ndarray] | None = None

    def edges(key: np.ndarray, fps: np.ndarray, last: bool):
        nonlocal held
        if held is not None:
            key, fps = np.concatenate([held[0], key]), np.concatenate([held[1], fps])
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, int)
        ends = np.r_[starts[1:], len(key)]
        if not last and len(starts):
            held = key[starts[-1] :], fps[starts[-1] :]
            starts, ends = starts[:-1], ends[:-1]
        us, vs = [], []
        for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            u, v = tile_forest(fps[s:e], radius)
            if len(u):
                us.append(u)
                vs.append(v)
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs)], ["u", "v"])

    for batch in batches:
        k, fp = (np.array(batch.column(c)) for c in range(2))
        yield from edges(k, fp.view(np.uint64), False)
    if held is not None:
        yield from edges(np.empty(0, np.int64), np.empty(0, np.uint64), True)


def links(distinct: DataFrame, radius: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``u, v``: enough links between the fingerprints of ``distinct`` (column fp) to join all within the radius."""
    n = radius + 2
    edge = [64 * i // n for i in range(n + 1)]
    masks = [((1 << edge[a + 1]) - (1 << edge[a])) | ((1 << edge[b + 1]) - (1 << edge[b])) for a, b in combinations(range(n), 2)]
    keys = [F.xxhash64(F.lit(c), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for c, m in enumerate(masks)]
    rows = distinct.select(F.explode(F.array(*keys)).alias("g"), F.col("fp").alias("id"))
    sizes = rows.groupBy(F.col("g").alias("hg")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("hub")).where(F.col("n") > tile_rows)
    sizes = materialize(sizes.select("hg", F.ceil(F.col("n") / tile_rows).cast("int").alias("t"), "hub"), "simhash-hot")
    hot = bool(sizes.head(1))
    plain = rows.join(sizes.select("hg"), F.col("g") == F.col("hg"), "left_anti") if hot else rows
    found = arrow_map(plain.repartition("g").sortWithinPartitions("g"), lambda it: _compare(it, radius), "u long, v long")
    if not hot:
        return found
    return found.unionByName(link_large(rows, sizes, lambda c: near_classes(c["id"].view(np.uint64), radius), tile_rows, "simhash-hot"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row.

    Texts are lower-cased (A-Z) and cut at ASCII white space; fingerprints of
    ``radius`` or fewer differing bits link, and ``component_id`` is the
    smallest doc_id that links reach.  A null or empty text has fingerprint 0
    and links like any other.  Equal fingerprints form one class before any
    comparison, so copies cost nothing.  Repeated rows give repeated rows; a
    null doc_id gets its component's id and never names a component unless
    all ids there are null.  An empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, width), "simhash")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    parts = connected_components(links(rows.select("fp").distinct(), radius, tile_rows), "simhash-cc")
    member = parts.join(classes, F.col("node") == F.col("fp")).select("fp", "root", "rep")
    least = member.groupBy("root").agg(F.min("rep").alias("least"))
    of = member.join(least, "root").select("fp", "least")
    name = classes.join(of, "fp", "left").select(F.col("fp").alias("f"), F.coalesce("least", "rep").alias("component_id"))
    name = materialize(name, "simhash-names")  # a stored side, so that a fingerprint with very many rows can be split between tasks
    return rows.join(name, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")
